"""Multi-line records by a separator pattern, and stack traces joined to the entries they follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.rx import java
from emberlog.operators.formats import attempts
from emberlog.sources.lines import running, running_sum

MAX_LINES, MAX_BYTES = 500, 65_536


def records(lines: DataFrame, separator: str) -> DataFrame:
    """(file, start_line, line_count, text, truncated): a line that matches the separator starts a record.

    Lines before the first match are records of their own.  After 500 lines or 65,536 bytes, tested from the second line on,
    the rest of a record is left out.
    """
    size = F.octet_length("text").cast("long")
    lines = running(lines.withColumn("__start", F.col("text").rlike(java(separator))), __n=("sum", F.lit(1).cast("long")), __b=("sum", size))
    # where a record starts, as running counts of lines and of the bytes before: a line's place in its record needs no window over it
    lines = running(lines, __first=("max", F.when(F.col("__start"), F.col("__n"))), __from=("max", F.when(F.col("__start"), F.col("__b") - size)))
    k, until = F.col("__n") - F.col("__first") + 1, F.col("__b") - F.col("__from")
    alone = F.col("__first").isNull()
    kept = lines.where(alone | (k <= 2) | ((k - 1 < MAX_LINES) & (until - size < MAX_BYTES)))
    full = ~alone & (k >= 2) & ((k >= MAX_LINES) | (until >= MAX_BYTES))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_number", "text"))), lambda x: x["text"])  # at most 500 lines
    out = kept.groupBy("file", F.coalesce("__first", -F.col("__n")).alias("__record")).agg(F.min("line_number").alias("start_line"), F.count(F.lit(1)).cast("int").alias("line_count"), F.array_join(texts, "\n").alias("text"), F.max(full).alias("truncated"))
    return out.drop("__record")


def combined(lines: DataFrame, format: str) -> DataFrame:
    """Entries with the lines that follow them: (file, line_number, line_count, timestamp, level, source, message, raw, stack_trace, extra_fields).

    A line of the format opens an entry, other lines belong to the open one; before the first they stand alone without a level.
    An entry is one row with all its text, so the lines of one entry must fit in memory together, as any row must.
    """
    rows = running_sum(attempts(lines, format), F.col("entry").isNotNull().cast("long"), "__entry")
    rows = rows.withColumn("__entry", F.when(F.col("__entry") == 0, -F.col("line_number")).otherwise(F.col("__entry")))
    ordered = F.array_sort(F.collect_list(F.struct("line_number", "text")))
    out = rows.groupBy("file", "__entry").agg(F.min("line_number").alias("line_number"), F.count(F.lit(1)).cast("int").alias("line_count"), F.min_by("entry", "line_number").alias("entry"), ordered.alias("rows"))
    texts = F.transform("rows", lambda x: x["text"])
    rest = F.array_join(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(1))), "\n")
    alone = F.col("entry").isNull()
    return out.select(
        "file",
        "line_number",
        "line_count",
        F.col("entry.timestamp").alias("timestamp"),
        F.col("entry.level").alias("level"),
        F.col("entry.source").alias("source"),
        F.when(alone, texts[0]).otherwise(F.col("entry.message")).alias("message"),
        F.array_join(texts, "\n").alias("raw"),
        F.when(F.col("line_count") > 1, rest).alias("stack_trace"),
        F.col("entry.extra").alias("extra_fields"),
    )


def record_entries(lines: DataFrame, separator: str, format: str) -> DataFrame:
    """Records parsed by their first line: ``records`` with ``entry`` (null where the line is not of the format) and ``first_line``."""
    found = records(lines, separator).withColumn("first_line", F.substring_index("text", "\n", 1))
    parsed = attempts(found.withColumns({"__text": F.col("text"), "text": F.col("first_line")}), format)
    return parsed.withColumn("text", F.col("__text")).drop("__text")
