"""Counts over live logs: an extension, with event-time windows and a watermark for late lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.text import ERROR_LEVELS, keyword_level
from emberlog.functions.timeparse import parse_strict
from emberlog.operators.formats import parse


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files as they appear in a folder; line numbers are not defined on a stream."""
    return spark.readStream.option("lineSep", "\n").text(folder).select(F.regexp_replace("value", r"\r\z", "").alias("text"))


def level_counts(lines: DataFrame, format: str, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """(window, level, count) per event-time window; a window is final once the watermark has passed it."""
    entry = parse(F.col("text"), format)
    rows = lines.withColumn("entry", entry).select(parse_strict(F.col("entry.timestamp")).alias("time"), F.coalesce("entry.level", keyword_level(F.col("text"))).alias("level"))
    rows = rows.where(F.col("time").isNotNull() & F.col("level").isNotNull()).withWatermark("time", late)
    return rows.groupBy(F.window("time", f"{minutes} minutes"), "level").agg(F.count(F.lit(1)).alias("count"))


def error_windows(lines: DataFrame, format: str, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """(window, total, errors) per event-time window."""
    entry = parse(F.col("text"), format)
    rows = lines.withColumn("entry", entry).select(parse_strict(F.col("entry.timestamp")).alias("time"), F.col("entry.level").alias("level"))
    rows = rows.where(F.col("time").isNotNull()).withWatermark("time", late)
    return rows.groupBy(F.window("time", f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("level").isin(*ERROR_LEVELS)).alias("errors"))
