"""Best-fit packing of tokenised documents by exact-complement hashing.

A document is tokenised, ended with one id, and cut only if it is longer than a sequence.  How pieces are combined depends on
their lengths alone, so the plan is made from the histogram of lengths, which has at most ``capacity`` entries at any input
size.  The plan looks up, for the gap beside each length, a single, a pair or a triple of available lengths that fills it
exactly, and consumes as many of that combination as availability allows; what then remains goes by best fit, largest first.
Of plans with triples, with pairs at most, and with singles only, the one with the fewest sequences is used.
Pieces of one length are exchangeable: each gets a rank among its equals, and the plan maps ranks to sequences.

Ranks come from per-(length, bucket) counts, so a length that a third of all pieces have is never in one task.

Nulls: a null text is packed like an empty one (the end id alone); null doc_ids are kept.  Equal rows are separate
documents.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import bounded_batches, cut, text_or_empty

CAPACITY = 2048
END_ID = 0
BUCKETS = 128


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None, pattern: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a byte-level BPE vocabulary file.

    The ranks file holds the same vocabulary for a faster library; texts with the string of a special token go to the first.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    if ranks is None:
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(fast.encode_ordinary(text), "<u4")

    return encode


def default_encoder() -> Callable[[str], np.ndarray]:
    import public_tokenizers

    return encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def token_pieces(docs: DataFrame, make_encoder: Callable = default_encoder, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): a row per piece; of a cut document only the first is shorter."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * keep_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def cut_up(batches):
        encode = make_encoder()
        for batch in batches:
            out = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    row = (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) + ((ids[a:b].tolist(),) if keep_ids else ())
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(cut_up, schema)


def _largest_pair(free: np.ndarray, gap: int) -> tuple[int, ...]:
    """The two available lengths that sum to ``gap``, the larger as large as possible."""
    half = (gap + 1) // 2
    large = np.flatnonzero((free[half:gap] > 0) & (free[gap - half : 0 : -1] > 0))
    for a in (large[::-1] + half).tolist():
        if 2 * a != gap or free[a] >= 2:
            return a, gap - a
    return ()


def exact_fill(free: np.ndarray, gap: int, most: int = 3) -> tuple[int, ...] | None:
    """At most ``most`` (one, two or three) available lengths that sum to ``gap``; None if there are none."""
    if gap == 0:
        return ()
    if free[gap] > 0:
        return (gap,)
    if most >= 2 and (pair := _largest_pair(free, gap)):
        return pair
    for c in np.flatnonzero(free[:gap])[::-1].tolist() if most >= 3 else ():
        free[c] -= 1
        pair = _largest_pair(free, gap - c)
        free[c] += 1
        if pair:
            return (c, *pair)
    return None


def _plan(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[int, dict[int, int]]]:
    free = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        free[length] = n
    plan: list[tuple[int, dict[int, int]]] = []

    def consume(parts: list[int]) -> None:
        each: dict[int, int] = {}
        for x in parts:
            each[x] = each.get(x, 0) + 1
        times = min(int(free[x]) // k for x, k in each.items())
        for x, k in each.items():
            free[x] -= times * k
        plan.append((times, each))

    for length in range(capacity, 0, -1):
        while free[length] > 0:
            free[length] -= 1
            fill = exact_fill(free, capacity - length, most)
            free[length] += 1
            if fill is None:
                break
            consume([length, *fill])
    for length in range(capacity, 0, -1):
        while free[length] > 0:
            parts, gap = [length], capacity - length
            free[length] -= 1
            while gap and len(fits := np.flatnonzero(free[: gap + 1])):
                x = int(fits[-1])
                k = min(gap // x, int(free[x]))
                parts += [x] * k
                free[x] -= k
                gap -= k * x
            for x in parts:
                free[x] += 1
            consume(parts)
    return plan


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces of it in each sequence}) for all pieces of the histogram.

    Combinations that use up many short pieces early can leave long ones without partners, so the plan is made with triples,
    without them, and with single complements only, and the shortest is taken.  Each step uses up at least one length, so a
    plan has at most twice as many entries as there are lengths.
    """
    plans = [_plan(histogram, capacity, most) for most in (3, 2, 1)]
    return min(plans, key=lambda plan: sum(times for times, _ in plan))


def slot_table(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, pieces per sequence, first sequence, offset), by first rank."""
    ranks: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for times, each in plan:
        offset = 0
        for length, k in each.items():
            first = ranks.get(length, 0)
            rows.setdefault(length, []).append((first, k, sequence, offset))
            ranks[length] = first + times * k
            offset += k * length
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length``; the offsets of a sequence have no gaps."""
    spark = pieces.sparkSession
    bounded_batches(spark)
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    rows = cut(pieces.select(*kept).withColumn("__row", F.monotonically_increasing_id()))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__row"), F.lit(BUCKETS)).cast("int"))
    blocks = cut(rows.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n")))
    slots = slot_table(plan_sequences({r[0]: r[1] for r in blocks.groupBy("length").agg(F.sum("__n")).collect()}, capacity))
    earlier = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("length", "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__bucket").orderBy("__row")
    numbered = rows.join(blocks, ["length", "__bucket"]).withColumn("__rank", F.col("__before") + F.row_number().over(inside) - 1)
    shared = spark.sparkContext.broadcast(slots)

    def look_up(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(n)) for n in ("length", "__rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                table = shared.value[x]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                passed = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + passed // row[:, 1]
                offset[at] = row[:, 3] + passed % row[:, 1] * x
            columns = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    schema = numbered.select(*kept, F.col("__rank").alias("sequence_id"), F.col("__rank").alias("offset")).schema
    return numbered.select(*kept, "__rank").mapInArrow(look_up, schema)


def pack(docs: DataFrame, make_encoder: Callable = default_encoder, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text): one row per piece with its sequence and its place there."""
    return place(token_pieces(docs, make_encoder, capacity, end_id, keep_ids), capacity)
