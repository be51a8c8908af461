"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link when they differ in at most three bits.  Of two linked fingerprints there is always a value half-way: at
most two flips from the one and at most one from the other.  Every distinct fingerprint emits the values near it, the values
are shuffled, and fingerprints that meet on a value are verified and linked.

What needs to be emitted follows from parity.  Fingerprints three bits apart differ in parity, so only those of even parity
emit values two flips away; of three differing bits at least two lie in the same half of the word, so both flips are taken
within a half (992 values, the least possible).  All emit themselves and the 64 values one flip away, which meets pairs one
and two bits apart.  On one value, whoever is at most one flip away is within three bits of everybody else there, so a star
around one such fingerprint carries every link of the group: no group emits all its pairs.

Values travel as packed, hashed 64-bit arrays, dealt by hash to buckets of bounded size.  Components come from label
propagation with pointer jumping over the links, which are only between fingerprints that have a neighbour.

Nulls: a null text is like an empty one, with fingerprint zero, which links like any other.  Null doc_ids get a fingerprint
and the component of their group; they never name one unless all of the group are null.  Equal rows come out as often as
they come in.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import arrow_map, bounded_batches, cut, skew_join, text_or_empty

SEED = 42
WORDS = 3
#: Fingerprints whose values are made at once, values that one bucket should hold at most, and fewest buckets as bits.
CHUNK, BUCKET_VALUES, MIN_BITS = 1024, 2_000_000, 8
#: Bits by which values are dealt in one shuffle.
LEVEL_BITS = 12
#: Values that a fingerprint emits on average: 1,057 of even parity, 65 of odd.
VALUES_EACH = 561
#: An odd factor that spreads values over buckets; multiplication by it modulo 2**64 can be undone.
SPREAD = 0x9E3779B97F4A7C15
UNSPREAD = pow(SPREAD, -1, 1 << 64)

_ONE = [1 << i for i in range(64)]
_TWO = [_ONE[i] | _ONE[j] for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
#: What a value's code says: the bits flipped, and how many.
FLIPS = np.array([0, *_ONE, *_TWO], np.uint64)
RADIUS = np.array([0] + [1] * 64 + [2] * len(_TWO), np.uint8)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # both keep to ASCII
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    total, n = np.zeros(64, np.int64), 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    for k in range(0, len(hashes), 65536):  # bounds the unpacked bits, whatever the text's length
        part = hashes[k : k + 65536]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of ``docs`` (doc_id, text); fp is the fingerprint as a signed long."""

    def rows(ids, texts):
        for doc, text in zip(ids, texts, strict=True):
            fp = fingerprint(text, words)
            yield doc, fp - (1 << 64) if fp >> 63 else fp

    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_or_empty()), rows, "doc_id long, fp long")


def ball(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that fingerprints emit, and their codes."""
    parity = np.bitwise_count(fps) & 1
    even, odd = fps[parity == 0], fps[parity == 1]
    values = np.concatenate([(even[:, None] ^ FLIPS).ravel(), (odd[:, None] ^ FLIPS[:65]).ravel()])
    codes = np.concatenate([np.tile(np.arange(len(FLIPS), dtype=np.uint16), len(even)), np.tile(np.arange(65, dtype=np.uint16), len(odd))])
    return values, codes


def meet(spread: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (a < b) of the fingerprints that meet on equal values."""
    order = np.argsort(spread)
    spread = spread[order]
    same = spread[1:] == spread[:-1]
    shared = np.r_[same, False] | np.r_[False, same]
    spread, codes = spread[shared], codes[order][shared]
    order = np.lexsort((codes, spread))  # codes rise with the radius, so the first of a group is the nearest
    spread, codes = spread[order], codes[order]
    starts = np.r_[True, spread[1:] != spread[:-1]] if len(spread) else np.zeros(0, bool)
    fps = (spread * np.uint64(UNSPREAD)) ^ FLIPS[codes]
    first = np.flatnonzero(starts)[np.cumsum(starts) - 1] if len(spread) else np.zeros(0, np.int64)
    a, b = fps[first], fps
    true = (RADIUS[codes[first]] <= 1) & (np.bitwise_count(a ^ b) <= 3) & (a != b)
    a, b = a[true], b[true]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    return pairs[:, 0], pairs[:, 1]


def blobs(spread: np.ndarray, codes: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket: the values that share their first ``bits`` bits, and their codes, both packed."""
    order = np.argsort(spread)
    spread, codes = spread[order], codes[order]
    buckets = spread >> np.uint64(64 - bits)
    cuts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1], True]).tolist()
    raw, marks = spread.tobytes(), codes.tobytes()
    pairs = list(zip(cuts, cuts[1:], strict=False))
    columns = [pa.array(buckets[cuts[:-1]].astype(np.int64)), pa.array([raw[8 * i : 8 * j] for i, j in pairs], pa.binary()), pa.array([marks[2 * i : 2 * j] for i, j in pairs], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "spread", "codes"])


def unpacked(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The values and codes of blobs."""
    return tuple(np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in (("spread", np.uint64), ("codes", np.uint16)))


def links(distinct: DataFrame, count: int) -> DataFrame:
    """Links (a, b) between ``count`` distinct fingerprints (fp) that carry all connections at three bits or fewer.

    Values are dealt to at most ``2 ** LEVEL_BITS`` buckets at a time; where that leaves more than ``BUCKET_VALUES`` in one,
    buckets are dealt again by their next bits, so a bucket that is joined always fits in memory.
    """
    bounded_batches(distinct.sparkSession)
    bits = max(MIN_BITS, (count * VALUES_EACH // BUCKET_VALUES).bit_length())
    steps = [*range(LEVEL_BITS, bits, LEVEL_BITS), bits]

    def emit(batches):
        waiting: list[np.ndarray] = []
        for batch in batches:
            waiting.append(np.asarray(batch.column(0)).view(np.uint64))
            if sum(map(len, waiting)) >= CHUNK:
                fps, waiting = np.concatenate(waiting), []
                for k in range(0, len(fps), CHUNK):
                    values, codes = ball(fps[k : k + CHUNK])
                    yield from blobs(values * np.uint64(SPREAD), codes, steps[0])
        if waiting:
            values, codes = ball(np.concatenate(waiting))
            yield from blobs(values * np.uint64(SPREAD), codes, steps[0])

    def finer(step: int):
        def deal(batches):
            waiting, size = [], 0
            for batch in batches:
                waiting.append(unpacked(batch))
                size += len(waiting[-1][0])
                if size >= 2 * BUCKET_VALUES:
                    yield from blobs(*map(np.concatenate, zip(*waiting, strict=True)), step)
                    waiting, size = [], 0
            if size:
                yield from blobs(*map(np.concatenate, zip(*waiting, strict=True)), step)

        return deal

    def join(table: pa.Table) -> pa.Table:
        a, b = meet(*unpacked(table))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    schema = "bucket long, spread binary, codes binary"
    dealt = distinct.select("fp").mapInArrow(emit, schema)
    for step in steps[1:]:
        dealt = dealt.repartition("bucket").mapInArrow(finer(step), schema)
    return dealt.groupBy("bucket").applyInArrow(join, "a long, b long").distinct()


def components(edges: DataFrame, key: str = "node") -> DataFrame:
    """(node, label): for every end of an edge (a, b) the least node of its component.

    A round takes the least label among neighbours, then the label of that label, so rounds grow with the logarithm of the
    longest chain.  Each round is stored in the checkpoint folder.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))))
    labels = cut(both.groupBy(F.col("a").alias(key)).agg(F.min("b").alias("__m")).select(key, F.least(key, "__m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed(key, "b"), "b").groupBy(F.col("a").alias(key)).agg(F.min("label").alias("__m"))
        lower = labels.join(near, key).select(key, F.col("label").alias("__was"), F.least("label", "__m").alias("label"))
        lower = cut(lower)
        if not lower.where("label < __was").limit(1).count():
            return lower.select(key, "label")
        of = lower.select(F.col(key).alias("label"), F.col("label").alias("__next"))
        labels = cut(lower.join(of, "label", "left").select(key, F.coalesce("__next", "label").alias("label")))


def grouped(fps: DataFrame, best: Column) -> tuple[DataFrame, int]:
    """(fp, rows, label, best) per distinct fingerprint of ``fps`` (fp, ...), and the number of rows.

    Fingerprints of one component share a label; ``best`` is an aggregate over the rows of all of the component.
    """
    total = fps.count()
    distinct = cut(fps.groupBy("fp").agg(best.alias("best"), F.count(F.lit(1)).alias("rows")))
    nodes = cut(components(cut(links(distinct, distinct.count()))).withColumnRenamed("node", "fp"))
    named = nodes.join(distinct, "fp").groupBy("label").agg(F.min("best").alias("least"))
    joined = nodes.join(named, "label").select("fp", "label", "least", F.lit(True).alias("__linked"))
    every = distinct.join(joined, "fp", "left")
    linked = F.col("__linked").isNotNull()
    return cut(every.select("fp", "rows", F.when(linked, F.col("label")).otherwise(F.col("fp")).alias("label"), F.when(linked, F.col("least")).otherwise(F.col("best")).alias("best"))), total


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of ``docs`` (doc_id, text); the component is named by its least doc_id."""
    fps = cut(fingerprints(docs, words))
    every, total = grouped(fps, F.min("doc_id"))
    found = skew_join(fps, every.select("fp", "rows", F.col("best").alias("component_id")), "fp", "rows", total)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that stay when one of each component does.

    Each row is a document of its own: that with the least doc_id stays (one without a doc_id only where all are), of rows
    with the same doc_id the one with the least hash of all its columns; of rows equal in all columns one stays.  So rows
    that share a doc_id but lie in different components all stay, and no component loses its last row.
    """
    names = docs.columns
    own = docs.select(*(F.col(c) for c in names), F.xxhash64(*names).alias("__h1"), F.xxhash64(F.lit(1), *(F.col(c) for c in reversed(names))).alias("__h2"))

    def rows(ids, texts, first, second):
        for doc, text, a, b in zip(ids, texts, first, second, strict=True):
            fp = fingerprint(text, words)
            yield doc, fp - (1 << 64) if fp >> 63 else fp, a, b

    fps = cut(arrow_map(own.select(F.col("doc_id").cast("long"), text_or_empty(), "__h1", "__h2"), rows, "doc_id long, fp long, h1 long, h2 long"))
    every, _ = grouped(fps, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")))
    kept = every.groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.h1").alias("__h1"), F.col("best.h2").alias("__h2"))
    return own.dropDuplicates(["__h1", "__h2"]).join(kept.distinct(), ["__h1", "__h2"], "left_semi").select(*names)
