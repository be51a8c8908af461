"""Search, filter, parse and count by level; pages by offset and limit."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.errors import QueryError
from emberlog.functions.rx import matches
from emberlog.functions.text import keyword_level
from emberlog.operators.formats import PARSERS, attempts, entries
from emberlog.operators.records import record_entries, records
from emberlog.sources.lines import clamp, neighbours

LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "CRITICAL", "FATAL")


def page(rows: DataFrame, order: list[str | Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the given order; beyond the end there are none."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(limit)


def page_facts(total: int, offset: int, returned: int) -> dict:
    return {"total": total, "has_more": total > offset + returned, "next_offset": offset + returned}


def search(lines: DataFrame, pattern: str, regex: bool = True, case_sensitive: bool = False, context_lines: int = 0) -> DataFrame:
    """All matching lines with their context; page them with ``page(.., ["file", "line_number"], offset, limit)``."""
    return neighbours(lines, lines.where(matches(F.col("text"), pattern, regex, case_sensitive)), context_lines)


def search_page(lines: DataFrame, pattern: str, regex: bool = True, case_sensitive: bool = False, context_lines: int = 0, offset: int = 0, limit: int = 50) -> DataFrame:
    found = search(lines, pattern, regex, case_sensitive, context_lines)
    return page(found, ["file", "line_number"], offset, clamp(limit, 50, 500))


def search_records(lines: DataFrame, pattern: str, separator: str, regex: bool = True, case_sensitive: bool = False) -> DataFrame:
    """Records whose whole text matches."""
    return records(lines, separator).where(matches(F.col("text"), pattern, regex, case_sensitive))


def time_bound(text: str) -> str:
    """An RFC 3339 bound in its shortest form; INVALID_TIMESTAMP otherwise."""
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:[.,](\d{1,9}))?\d*(Z|[+-]\d{2}:\d{2})", text)
    if not m:
        raise QueryError("INVALID_TIMESTAMP", text)
    try:
        datetime.fromisoformat(m[1])
    except ValueError:
        raise QueryError("INVALID_TIMESTAMP", text) from None
    fraction = (m[2] or "").rstrip("0")
    return m[1] + (f".{fraction}" if fraction else "") + ("Z" if m[3] in ("+00:00", "-00:00") else m[3])


def conditions(levels=None, after=None, before=None, source=None, message=None, text: Column | None = None) -> Column:
    """All given conditions; nulls fail them.  Times compare as text: ``after`` is included, ``before`` is not."""
    tests = [F.lit(True)]
    if levels:
        tests.append(F.upper("level").isin([x.upper() for x in levels]))
    if after:
        tests.append(F.col("timestamp") >= time_bound(after))
    if before:
        tests.append(F.col("timestamp") < time_bound(before))
    if source:
        tests.append(matches(F.col("source"), source))
    if message:
        tests.append(matches(F.col("message") if text is None else text, message))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def filter_lines(lines: DataFrame, format: str, **given) -> DataFrame:
    """Entries that meet the conditions; none for an unknown format."""
    return entries(lines, format).where(conditions(**given))


def filter_records(lines: DataFrame, format: str, separator: str, **given) -> DataFrame:
    """Records whose first line is of the format and that meet the conditions; a message pattern reads the whole record."""
    rows = record_entries(lines, separator, format).where(F.col("entry").isNotNull())
    flat = rows.select("file", "start_line", "line_count", "truncated", "text", *(F.col(f"entry.{n}").alias(n) for n in ("timestamp", "level", "source", "message")))
    return flat.where(conditions(**given, text=F.col("text")))


def parse_errors(lines: DataFrame, format: str) -> DataFrame:
    """Lines that are not of the format; all lines for an unknown format."""
    return attempts(lines, format).where(F.col("entry").isNull()).select("file", "line_number", "text")


def with_level(lines: DataFrame, format: str) -> DataFrame:
    """Add ``level``: the parser's, else the first level word of the line."""
    own = attempts(lines, format)
    level = F.coalesce(F.col("entry.level"), keyword_level(F.col("text"))) if format in PARSERS else keyword_level(F.col("text"))
    return own.withColumn("level", level).drop("entry", "format")


def count_by_level(lines: DataFrame, format: str) -> DataFrame:
    """(level, count) over lines that have a level."""
    return with_level(lines, format).where(F.col("level").isNotNull()).groupBy("level").agg(F.count(F.lit(1)).alias("count"))
