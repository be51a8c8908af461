"""Summaries: level shares, top sources and errors, time range and throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import ERROR_LEVELS, round_half_up
from emberlog.functions.timeparse import hours_between
from emberlog.operators.formats import entries
from emberlog.operators.records import record_entries

TOP = 10


def sampled_lines(lines: DataFrame, sample_size: int = 0) -> DataFrame:
    """The first lines, where a sample size is given."""
    return lines.where(F.col("line_number") <= sample_size) if sample_size > 0 else lines


def level_shares(parsed: DataFrame, total_lines: int) -> DataFrame:
    """(level, count, percent): the share is of all raw lines, with one decimal."""
    counts = parsed.where(F.col("level").isNotNull()).groupBy("level").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("percent", round_half_up(F.col("count") / F.lit(float(total_lines)) * 100, 1))


def top(parsed: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """The most frequent values, of equal ones the lesser first; empty values are left out."""
    counts = parsed.where(F.col(column) != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(k)


def top_sources(parsed: DataFrame) -> DataFrame:
    return top(parsed, "source")


def top_errors(parsed: DataFrame) -> DataFrame:
    """Most frequent messages, as they are, of error entries."""
    return top(parsed.where(F.col("level").isin(*ERROR_LEVELS)), "message")


def time_range(parsed: DataFrame) -> DataFrame:
    """(first, last, hours): least and greatest timestamp text, hours with two decimals."""
    ends = parsed.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return ends.withColumn("hours", round_half_up(F.greatest(hours_between(F.col("first"), F.col("last")), F.lit(0.0)), 2))


def throughput(parsed: DataFrame, total_lines: int) -> DataFrame:
    """(lines_per_minute, peak_minute, peak_count, quiet_minute, quiet_count); of equal minutes the earliest."""
    hours = F.col("hours")
    minutes = parsed.where(F.col("timestamp").isNotNull() & (F.length("timestamp") >= 16)).groupBy(F.substring("timestamp", 1, 16).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    ends = minutes.agg(F.min(F.struct((-F.col("n")).alias("n"), "minute")).alias("peak"), F.min(F.struct("n", "minute")).alias("quiet"))
    rate = F.when(hours > 0, round_half_up(F.lit(float(total_lines)) / (hours * 60), 2)).otherwise(0.0)
    one = F.lit(1).alias("one")
    found = time_range(parsed).select(rate.alias("lines_per_minute"), one).join(ends.select("*", one), "one")  # one row each
    return found.select("lines_per_minute", F.col("peak.minute").alias("peak_minute"), (-F.col("peak.n")).alias("peak_count"), F.col("quiet.minute").alias("quiet_minute"), F.col("quiet.n").alias("quiet_count"))


def summarize(lines: DataFrame, format: str, sample_size: int = 0, separator: str | None = None) -> dict[str, DataFrame]:
    """The parts of a summary by name; records are summarised by their first lines."""
    lines = sampled_lines(lines, sample_size)
    total = lines.count()
    if separator:
        rows = record_entries(lines, separator, format).where(F.col("entry").isNotNull())
        parsed = rows.select(*(F.col(f"entry.{n}").alias(n) for n in ("timestamp", "level", "source", "message")))
    else:
        parsed = entries(lines, format)
    return {"levels": level_shares(parsed, total), "top_sources": top_sources(parsed), "top_errors": top_errors(parsed), "time_range": time_range(parsed), "throughput": throughput(parsed, total)}
