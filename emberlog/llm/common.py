"""Helpers that the training-data operators share.

* ``cut`` ends a lineage in the shared checkpoint folder, so a lost executor costs a re-read and not a rerun.
* ``ranked`` numbers rows globally without ever bringing them into one task.
* ``skew_join`` joins a large frame with one row per key, whatever share of the rows one key holds.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes in one Arrow batch.  Texts may be long, so batches stay far below Spark's default of 10,000 rows.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts.

    Spark reads these settings when a plan runs, after the caller has it, so they stay; what the session sets itself is kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where none is named and all is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="emberlog-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and stored in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words of a text, 0 for null; long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def arrow_map(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Apply ``rows(*columns)`` to each Arrow batch; columns arrive as Python lists, result rows are tuples."""
    bounded_batches(df.sparkSession)
    names = [c.split()[0] for c in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(",")]

    def apply(batches):
        for batch in batches:
            found = list(rows(*(c.to_pylist() for c in batch.columns)))
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return df.mapInArrow(apply, schema)


def ranked(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add ``rank`` (from 0, in the given total order) and, per entry of ``sums``, the sum over all earlier rows.

    Rows are dealt by range; only one row per partition meets in one task.  The order must be total up to equal rows.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    whole = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__part").orderBy(*order)
    parts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(c).alias(f"__sum_{k}") for k, c in sums.items()))
    parts = parts.select(
        "__part",
        F.coalesce(F.sum("__n").over(whole), F.lit(0)).alias("__before"),
        *(F.coalesce(F.sum(f"__sum_{k}").over(whole), F.lit(0)).alias(f"__before_{k}") for k in sums),
    )
    out = dealt.join(parts, "__part")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns(
        {"rank": F.col("__before") + F.row_number().over(inside) - 1}
        | {k: F.col(f"__before_{k}") + F.coalesce(F.sum(c).over(earlier), F.lit(0)) for k, c in sums.items()}
    )
    return out.drop("__part", "__before", *(f"__before_{k}" for k in sums))


#: Bytes up to which the side with hot keys is broadcast, and parts that a hot key's rows are dealt to beyond.
BROADCAST_BYTES, SALTS = 32 << 20, 64


def skew_join(many: DataFrame, one: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``many`` with ``one`` (a row per key; column ``rows``: how many rows of ``many`` have the key).

    Keys with over a thousandth of all rows number fewer than a thousand.  While these rows of ``one`` are small, which is
    checked, they are broadcast; larger ones are copied to ``SALTS`` parts that the rows of ``many`` are dealt to.  The other
    keys are shuffled, and none of those is large.
    """
    hot = F.col(rows) > max(total // 1000, 1)
    few = one.where(hot)
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in one.dtypes if t in ("string", "binary")]
    size = few.agg(F.sum(reduce(Column.__add__, texts, F.lit(100)))).first()[0] or 0
    keys = F.broadcast(few.select(key))
    cold = many.join(keys, key, "left_anti")
    if size <= BROADCAST_BYTES:
        joined = many.join(F.broadcast(few), key)
    else:
        dealt = many.join(keys, key, "left_semi").withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
        joined = dealt.join(few.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, "__salt"]).drop("__salt")
    return joined.unionByName(cold.join(one.where(~hot), key, how))


def sampled(df: DataFrame, keys: list[Column], rows: int, size: Column | None = None, most: int = 0, seed: int = 7, by: Column | None = None) -> DataFrame:
    """About ``rows`` of the rows that differ in ``keys``, the same ones on each run; at most twice as many.

    Rows are chosen by a hash of all keys, and equal ones count once, so neither a hot key nor equal rows can take the sample
    or empty it.  With ``size`` the sample is so much smaller that its sizes come to about ``most``.  With ``by``, a column of
    few values, each value has a sample of that size, all from the same two scans.
    """
    named = df.withColumns({"__hash": F.xxhash64(*keys, F.lit(seed)), "__by": F.lit(0) if by is None else by})
    counts = named.groupBy("__by").agg(F.approx_count_distinct("__hash", 0.02).alias("n"), F.avg(size if size is not None else F.lit(1)).alias("mean")).collect()
    chosen, total, widest = F.lit(False), 0, 0
    for r in counts:
        wanted = rows if size is None else max(1, min(rows, int(most / max(r["mean"] or 1, 1))))
        share = int(min(1.0, wanted / max(r["n"], 1)) * (1 << 40))
        chosen, total, widest = chosen | (F.col("__by").eqNullSafe(F.lit(r["__by"])) & (F.pmod("__hash", F.lit(1 << 40)) < share)), total + wanted, max(widest, share)
    # the hash is looked at first, so ``by`` is computed for few rows only
    return named.where((F.pmod("__hash", F.lit(1 << 40)) < widest) & chosen).dropDuplicates(["__hash"]).orderBy("__hash").limit(max(1, 2 * total)).drop("__hash", "__by")
