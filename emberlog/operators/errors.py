"""Errors clustered by their normalised message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import ERROR_LEVELS, keyword_level, normalize_message, severity_weight
from emberlog.functions.timeparse import hours_between
from emberlog.operators.formats import entries
from emberlog.operators.records import combined, record_entries
from emberlog.operators.search import page
from emberlog.session import stored
from emberlog.sources.lines import clamp

#: Messages kept per pattern, and lines (then blocks) that are gathered together.
SAMPLES, SAMPLE_BLOCK = 3, 10_000


def error_entries(lines: DataFrame, format: str, stack_traces: bool = False, separator: str | None = None) -> DataFrame:
    """(file, line_number, timestamp, level, message, stack_trace) of error entries.

    Records that the format does not know get the first level word of their text, and their first line as message.
    """
    if separator:
        rows = record_entries(lines, separator, format)
        level = F.when(F.col("entry").isNull(), keyword_level(F.col("text"))).otherwise(F.col("entry.level"))
        rest = F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)"))
        rows = rows.select("file", F.col("start_line").alias("line_number"), F.col("entry.timestamp").alias("timestamp"), level.alias("level"), F.coalesce("entry.message", "first_line").alias("message"), rest.alias("stack_trace"))
    elif stack_traces:
        rows = combined(lines, format).select("file", "line_number", "timestamp", "level", "message", "stack_trace")
    else:
        rows = entries(lines, format).select("file", "line_number", "timestamp", "level", "message", F.lit(None).cast("string").alias("stack_trace"))
    return rows.where(F.col("level").isin(*ERROR_LEVELS))


def clusters(errors: DataFrame) -> DataFrame:
    """(pattern, count, percent, impact, first_line, first_timestamp, last_line, last_timestamp, samples, stack_trace) per pattern.

    First and last are by file and line; the samples are the first three messages; the stack trace is the first error's.
    Messages are normalised once: blocks of lines, then groups of blocks, then patterns keep their first three, so no task
    gathers more than a block's messages, whatever share of all errors a pattern has.
    """
    rows = errors.select(
        normalize_message(F.col("message")).alias("pattern"),
        severity_weight(F.col("level")).alias("weight"),
        F.struct("file", "line_number", "timestamp", "stack_trace").alias("first"),
        F.struct("file", "line_number", "timestamp").alias("last"),
        F.struct("file", "line_number", "message").alias("sample"),
        "file",
        F.floor(F.col("line_number") / SAMPLE_BLOCK).alias("block"),
        F.lit(1).cast("long").alias("count"),
    )

    def gathered(frame: DataFrame, samples, *keys) -> DataFrame:
        few = F.slice(F.array_sort(samples), 1, SAMPLES)
        return frame.groupBy("pattern", *keys).agg(F.sum("count").alias("count"), F.max("weight").alias("weight"), F.min("first").alias("first"), F.max("last").alias("last"), few.alias("samples"))

    blocks = gathered(rows, F.collect_list("sample"), "file", "block")
    more = [F.pmod(F.xxhash64("file"), F.lit(256)).alias("files"), F.floor(F.col("block") / SAMPLE_BLOCK).alias("block")]
    groups = gathered(blocks, F.flatten(F.collect_list("samples")), *more)
    grouped = stored(gathered(groups, F.flatten(F.collect_list("samples"))))
    total = grouped.agg(F.sum("count")).first()[0] or 1
    return grouped.select(
        "pattern",
        "count",
        (F.col("count") / F.lit(total) * 100).alias("percent"),
        (F.col("count") * F.col("weight")).alias("impact"),
        F.col("first.line_number").alias("first_line"),
        F.col("first.timestamp").alias("first_timestamp"),
        F.col("last.line_number").alias("last_line"),
        F.col("last.timestamp").alias("last_timestamp"),
        F.transform("samples", lambda x: x["message"]).alias("samples"),
        F.col("first.stack_trace").alias("stack_trace"),
    )


def extract_errors(lines: DataFrame, format: str, sort_by: str = "count", offset: int = 0, limit: int = 20, **how) -> DataFrame:
    """A page of clusters, by count or by impact."""
    order = F.desc("impact") if sort_by == "impact" else F.desc("count")
    return page(clusters(error_entries(lines, format, **how)), [order, "pattern"], offset, clamp(limit, 20, 100))


def error_rate(errors: DataFrame, total_lines: int) -> DataFrame:
    """(total_errors, percent, per_hour): the share of all raw lines; per hour between the first and the last error, by file
    and line, that have a timestamp."""
    at = F.when(F.col("timestamp").isNotNull(), F.struct("file", "line_number"))
    ends = errors.agg(F.count(F.lit(1)).alias("total_errors"), F.min_by("timestamp", at).alias("a"), F.max_by("timestamp", at).alias("b"))
    hours = hours_between(F.col("a"), F.col("b"))
    percent = F.col("total_errors") / F.lit(float(max(total_lines, 1))) * 100
    return ends.select("total_errors", percent.alias("percent"), F.when(hours > 0, F.col("total_errors") / hours).otherwise(0.0).alias("per_hour"))
