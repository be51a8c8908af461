"""Correlation of logs by an identifier, and, as an extension, by closeness in time."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.errors import QueryError
from emberlog.functions.rx import java
from emberlog.functions.timeparse import micros_between, parse_general
from emberlog.session import stored
from emberlog.sources.lines import clamp

MAX_GROUPS = 50


def correlation_id(field: str):
    """The field among the extra fields, else ``field=value`` in the message; null where empty."""
    pattern = rf"{re.escape(field)}[=: ][\"']?(\S+)"
    written = F.regexp_replace(F.regexp_extract("message", java(pattern), 1), "[\"']+$", "")
    own = F.col("extra_fields")[field]
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(written, F.lit("")))


def groups_by_id(parsed: DataFrame, field: str = "request_id", window_seconds: int = 60) -> DataFrame:
    """(correlation_id, files, size, span_ms) of identifiers in at least two files, within the window.

    A span is in whole milliseconds, halves rounded up, from the exact microseconds; one that cannot be parsed counts as 0.  Only counts and ends are gathered, not a group's events.
    """
    keyed = parsed.withColumn("correlation_id", correlation_id(field)).where(F.col("correlation_id").isNotNull())
    found = keyed.groupBy("correlation_id").agg(F.array_sort(F.collect_set("file")).alias("files"), F.count(F.lit(1)).alias("size"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    span = F.floor(micros_between(F.col("first"), F.col("last")) / 1000 + 0.5).cast("long")
    return found.where(F.size("files") >= 2).withColumn("span_ms", span).where(F.col("span_ms") <= clamp(window_seconds, 60, 3600) * 1000)


def correlate(parsed: DataFrame, field: str = "request_id", window_seconds: int = 60) -> DataFrame:
    """The 50 largest groups: (correlation_id, files, size, span_ms, first, last)."""
    return groups_by_id(parsed, field, window_seconds).orderBy(F.desc("size"), "correlation_id").limit(MAX_GROUPS)


def group_events(parsed: DataFrame, shown: DataFrame, field: str = "request_id") -> DataFrame:
    """The events of the shown groups, with their place by timestamp text, file and line."""
    keyed = parsed.withColumn("correlation_id", correlation_id(field))
    events = keyed.join(F.broadcast(shown.select("correlation_id").limit(MAX_GROUPS)), "correlation_id")
    return events.select("correlation_id", "timestamp", "file", "line_number", "level", "message")


def check_paths(paths: list[str]) -> None:
    if not 2 <= len(paths) <= 10:
        raise QueryError("INVALID_INPUT", "2 to 10 paths are needed")


#: Slices that the time span is cut into, at most; the tables with one row per slice are ordered in one task.
SLICES = 20_000


def time_groups(parsed: DataFrame, gap_seconds: float) -> DataFrame:
    """Extension: runs of events with no gap above ``gap_seconds`` that are in at least two files: (group_start, files, size).

    Events are dealt to slices of time, which grow with the whole span and not with the number of events; a slice's first
    event is compared with the last one of an earlier slice.
    """
    rows = parsed.withColumn("time", parse_general(F.col("timestamp"))).where(F.col("time").isNotNull())
    rows = stored(rows.select("time", "file", "line_number"))
    first, last = rows.agg(F.min(F.unix_seconds("time")), F.max(F.unix_seconds("time"))).first()
    width = max(1, ((last or 0) - (first or 0)) // (SLICES - 1) + 1)
    rows = rows.withColumn("slice", F.floor((F.unix_seconds("time") - F.lit(first or 0)) / width))
    inside = Window.partitionBy("slice").orderBy("time", "file", "line_number")
    ends = rows.groupBy("slice").agg(F.max("time").alias("end"))
    ends = ends.select("slice", F.lag("end").over(Window.orderBy("slice")).alias("end"))  # over at most SLICES rows
    near = rows.join(F.broadcast(ends), "slice").withColumn("since", F.coalesce(F.lag("time").over(inside), F.col("end")))
    opens = F.col("since").isNull() | (F.unix_micros("time") - F.unix_micros("since") > int(gap_seconds * 1e6))
    near = near.withColumn("open", F.when(opens, F.col("time")))
    opened = near.groupBy("slice").agg(F.max("open").alias("open"))
    opened = opened.select("slice", F.last("open", ignorenulls=True).over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    start = F.coalesce(F.last("open", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried"))
    grouped = near.join(F.broadcast(opened), "slice").withColumn("group_start", start).groupBy("group_start").agg(F.array_sort(F.collect_set("file")).alias("files"), F.count(F.lit(1)).alias("size"))
    return grouped.where(F.size("files") >= 2)
