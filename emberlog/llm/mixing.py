"""Mixing sources to target weights by systematic sampling.

Each source gets a target share of all words by its weight, at most ``max_repeats`` times what it has; the excess is dealt
again by weight until no source is above its cap.  Within a source every document is expected ``target / size`` times.
The expectations are summed up over the source's documents, one random offset is added, and a document is emitted once
for each integer its stretch of the running sum crosses.  Documents are ordered by size class, so the words taken stay close
to the target and not only the number of documents.  Where a few long documents make up a source, the offset still matters;
so of ``offsets`` evenly shifted forms of the one random offset the source uses the one whose words come nearest its target.
With that choice a document's copies are within one of the expected number, but no longer have it as their exact mean;
``offsets=1`` is plain systematic sampling.

No source is ever brought into one task: a source is split into blocks (size class, hash bucket); block counts give the
running sum at the block's start, and only the documents of one block are ordered together.

Nulls: a null text has size 0; null sources form one source, ordered last; null doc_ids are ordinary documents.  Equal rows
are separate documents.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import cut, ranked

#: Weights by the rank of a source's name, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Expected copies are summed as whole multiples of 1 / SCALE, so that sums never depend on their order.
SCALE = 1 << 24
BUCKETS = 32
OFFSETS = 16


def _keyed(docs: DataFrame, doc_id: str, source: str, size: str) -> DataFrame:
    """Add the block of each document.  Size classes are an eighth of an octave wide."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    bits = F.length(F.bin(F.col(size)))
    cls = F.when(F.col(size) <= 0, F.lit(0)).otherwise(bits * 8 + F.expr(f"int(shiftright(`{size}` * 8, length(bin(`{size}`)) - 1))") - 8)
    return docs.withColumns(
        {
            "__key": F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))),
            "__cls": cls,
            "__bucket": F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % BUCKETS,
            "__order": F.substring(digest, 3, 8),
        }
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (__key, source_size) to (__key, source_size, target): the capped shares of all words.

    The level at which weights are served solves ``sum(min(level * weight, max_repeats * size)) = sum(size)``; it is found in
    the order in which sources reach their caps.
    """
    null_last = [F.substring("__key", 1, 1) == "n", F.col("__key")]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    named = ranked(sizes, null_last, {}).select("__key", "source_size", weight.cast("long").alias("weight"))
    cap = F.col("source_size") * max_repeats
    named = named.withColumns({"__cap": cap, "__full_at": cap / F.col("weight")})
    steps = ranked(named, [F.col("__full_at"), F.col("__key")], {"__caps": F.col("__cap"), "__weights": F.col("weight")})
    total = steps.agg(F.sum("source_size"), F.sum("weight")).first()
    words, all_weights = total[0] or 0, total[1] or 0
    level = (F.lit(words) - F.col("__caps")).cast("double") / (F.lit(all_weights) - F.col("__weights")).cast("double")
    found = steps.withColumn("__level", level).where(F.col("__level") <= F.col("__full_at")).agg(F.min_by("__level", "rank")).first()[0] or 0.0
    return steps.select("__key", "source_size", F.least(F.lit(found) * F.col("weight"), F.col("__cap").cast("double")).alias("target"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: str = "mix",
    offsets: int = OFFSETS,
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` (how often the mix has the document, at most ``max_repeats``).

    ``docs`` needs a size (long) per document; its other columns are kept as they are.
    """
    keyed = _keyed(docs, doc_id, source, size)
    block = ["__key", "__cls", "__bucket"]
    blocks = cut(keyed.groupBy(block).agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__words")))
    targets = source_targets(blocks.groupBy("__key").agg(F.sum("__words").alias("source_size")), weights, max_repeats)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * SCALE)).otherwise(0).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("__key")).cast("binary")), 1, 6), 16, 10).cast("long")
    earlier = Window.partitionBy("__key").orderBy(F.desc("__cls"), "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocks.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .join(targets, "__key")
        .withColumn("__rate", rate)
        .select(*block, "source_size", "target", "__rate", (F.col("__rate") * F.col("__before")).alias("__start"))
    )
    blocks = cut(blocks)
    inside = Window.partitionBy(block).orderBy(F.desc(size), "__order", doc_id)
    base = F.col("__start") + F.col("__rate") * (F.row_number().over(inside) - 1)

    def crossed(begin):
        return F.floor((begin + F.col("__rate")) / SCALE) - F.floor(begin / SCALE)

    shifts = [(offset + k * (SCALE // offsets)) % SCALE for k in range(offsets)]
    tried = keyed.select(size, doc_id, *block, "__order").join(blocks, block).withColumn("__base", base)
    words = [F.sum(F.col(size) * crossed(F.col("__base") + shift)) for shift in shifts]
    misses = tried.groupBy("__key").agg(F.first("target").alias("__target"), *(w.alias(f"__w{k}") for k, w in enumerate(words)))
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col(f"__w{k}") - F.col("__target")).alias("miss"), F.lit(k).alias("k")) for k in range(offsets))))["k"]
    chosen = misses.select("__key", ((offset + nearest * (SCALE // offsets)) % SCALE).alias("__offset"))
    blocks = blocks.join(chosen, "__key")
    kept = [c for c in docs.columns if c.lower() not in ("source_size", "target", "copies")]
    return (
        keyed.select(*kept, *block, "__order")
        .join(blocks, block)
        .withColumn("__begin", base + F.col("__offset"))
        .select(*kept, "source_size", "target", crossed(F.col("__begin")).cast("long").alias("copies"))
    )
