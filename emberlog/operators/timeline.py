"""Timelines of typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import DEFAULT_EVENT_TYPES, event_type
from emberlog.functions.timeparse import hours_between
from emberlog.operators.formats import entries
from emberlog.sources.lines import clamp


def timeline_events(lines: DataFrame, format: str, start: str | None = None, end: str | None = None, event_types=None) -> DataFrame:
    """(timestamp, type, source, message, line_number) of the wanted types; both ends are excluded and compare as text."""
    rows = entries(lines, format).withColumn("type", event_type(F.col("message"), F.col("level")))
    rows = rows.where(F.col("type").isin(*(event_types or DEFAULT_EVENT_TYPES)))
    if start:
        rows = rows.where(F.col("timestamp") > start)
    if end:
        rows = rows.where(F.col("timestamp") < end)
    return rows.select("timestamp", "type", "source", "message", "line_number")


def timeline(events: DataFrame, limit: int = 100) -> DataFrame:
    """The first events by timestamp text; equal ones by line."""
    return events.orderBy(F.asc_nulls_first("timestamp"), "line_number").limit(clamp(limit, 100, 500))


def time_span(shown: DataFrame) -> DataFrame:
    """(first, last, minutes) of the shown events."""
    ends = shown.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return ends.withColumn("minutes", hours_between(F.col("first"), F.col("last")) * 60)
