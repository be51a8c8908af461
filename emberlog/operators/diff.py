"""Differences between two sides: two logs, or two periods of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.errors import QueryError
from emberlog.functions.text import ERROR_LEVELS, normalize_message, round_half_up
from emberlog.functions.timeparse import hours_between

SIDES = ("base", "target")
CHANGED_LIMIT = 50


def in_period(start: str | None, end: str | None):
    """Both ends are included and compare as text; with any bound, rows without a timestamp fail."""
    test = F.lit(True)
    if start:
        test = test & (F.col("timestamp") >= start)
    if end:
        test = test & (F.col("timestamp") <= end)
    return F.coalesce(test, F.lit(False))


def two_periods(parsed: DataFrame, base: tuple[str | None, str | None], target: tuple[str | None, str | None]) -> DataFrame:
    """Add ``side``; an entry in both periods is on both sides."""
    if not any(base) or not any(target):
        raise QueryError("INVALID_INPUT", "both periods need a bound")
    sides = F.array_compact(F.array(F.when(in_period(*base), "base"), F.when(in_period(*target), "target")))
    return parsed.withColumn("side", F.explode(sides))


def two_logs(base: DataFrame, target: DataFrame) -> DataFrame:
    return base.withColumn("side", F.lit("base")).unionByName(target.withColumn("side", F.lit("target")))


def counts(sided: DataFrame, key) -> DataFrame:
    """(key, base_count, target_count) for every value of the key on either side, in one shuffle."""
    both = [F.count_if(F.col("side") == s).alias(f"{s}_count") for s in SIDES]
    return sided.where(key.isNotNull()).groupBy(key.alias("key")).agg(*both)


def error_diff(sided: DataFrame) -> DataFrame:
    """(class, pattern, base_count, target_count, change): new, resolved, and changed, which includes unchanged counts."""
    found = counts(sided.where(F.col("level").isin(*ERROR_LEVELS)), normalize_message(F.col("message"))).withColumnRenamed("key", "pattern")
    kind = F.when(F.col("base_count") == 0, "new").when(F.col("target_count") == 0, "resolved").otherwise("changed")
    return found.select(kind.alias("class"), "pattern", "base_count", "target_count", (F.col("target_count") - F.col("base_count")).alias("change"))


def ordered_errors(diff: DataFrame, kind: str) -> DataFrame:
    """One class in its order; of the changed ones the 50 with the largest change."""
    order = {"new": F.desc("target_count"), "resolved": F.desc("base_count"), "changed": F.desc(F.abs("change"))}[kind]
    rows = diff.where(F.col("class") == kind).orderBy(order, "pattern")
    return rows.limit(CHANGED_LIMIT) if kind == "changed" else rows


def level_diff(sided: DataFrame) -> DataFrame:
    """(level, counts, percents): shares are of each side's parsed lines, with one decimal."""
    totals = sided.agg(*(F.count_if(F.col("side") == s) for s in SIDES)).first()
    found = counts(sided, F.col("level"))
    shares = {f"{s}_percent": round_half_up(F.col(f"{s}_count") / F.lit(float(max(n, 1))) * 100, 1) for s, n in zip(SIDES, totals, strict=True)}
    return found.withColumns(shares).withColumnRenamed("key", "level")


def source_diff(sided: DataFrame) -> DataFrame:
    """(class, source, counts, change) of sources that only one side has or whose counts differ, empty names left out."""
    found = counts(sided.where(F.col("source") != ""), F.col("source")).withColumnRenamed("key", "source")
    kind = F.when(F.col("base_count") == 0, "new").when(F.col("target_count") == 0, "resolved").otherwise("changed")
    return found.select(kind.alias("class"), "source", "base_count", "target_count", (F.col("target_count") - F.col("base_count")).alias("change"))


def side_summary(sided: DataFrame, total_lines: dict[str, int]) -> DataFrame:
    """(side, total_lines, parsed_lines, errors, first, last, lines_per_minute)."""
    total = F.create_map(*(x for s in SIDES for x in (F.lit(s), F.lit(total_lines[s]))))[F.col("side")]
    rows = sided.groupBy("side").agg(F.count(F.lit(1)).alias("parsed_lines"), F.count_if(F.col("level").isin(*ERROR_LEVELS)).alias("errors"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    minutes = hours_between(F.col("first"), F.col("last")) * 60
    rate = F.when(minutes > 0, F.col("total_lines") / minutes).otherwise(0.0)
    return rows.withColumn("total_lines", total.cast("long")).withColumn("lines_per_minute", rate)
