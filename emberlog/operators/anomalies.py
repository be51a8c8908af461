"""Anomalies: windows with many errors or many lines, gaps, and error types that only appear late."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.text import ERROR_LEVELS, normalize_message
from emberlog.functions.timeparse import parse_strict, stamp_text, window_start, zone_of
from emberlog.operators.search import page
from emberlog.session import stored
from emberlog.sources.lines import BLOCK_LINES, clamp, running_sum

#: How many times the average counts, by sensitivity.
FACTORS = {"error_spike": {"low": 5.0, "medium": 3.0, "high": 2.0}, "rate_change": {"low": 5.0, "medium": 3.0, "high": 2.0}, "gap": {"low": 10.0, "medium": 5.0, "high": 3.0}}
RANKS = {"high": 0, "medium": 1, "low": 2}
EVIDENCE = 5
#: The descriptions.
SPIKE_WORDS = "Error rate increased %.1fx compared to baseline in %d-minute window"
RATE_WORDS = "Log volume increased %.1fx compared to average in %d-minute window"
GAP_WORDS = "No log entries for %.0f seconds (expected interval: ~%.1f seconds)"
NEW_WORDS = "New error pattern appeared that was not seen in the first 80% of the file"


def narrow(parsed: DataFrame) -> DataFrame:
    """What the four kinds need of the entries, stored once: texts and patterns are kept of errors alone."""
    error = F.col("level").isin(*ERROR_LEVELS)
    return stored(parsed.select("file", "line_number", "timestamp", "level", F.when(error, normalize_message(F.col("message"))).alias("pattern"), F.when(error, F.col("raw")).alias("raw")))


def timed(parsed: DataFrame) -> DataFrame:
    """Entries with a time that can be parsed strictly, with ``time`` and ``is_error``."""
    rows = parsed.withColumns({"time": parse_strict(F.col("timestamp")), "is_error": F.coalesce(F.col("level").isin(*ERROR_LEVELS), F.lit(False))})
    return rows.where(F.col("time").isNotNull())


def window_keys(minutes: int) -> list:
    return [window_start(F.col("time"), minutes).alias("start"), zone_of(F.col("timestamp")).alias("zone")]


def window_counts(rows: DataFrame, minutes: int) -> DataFrame:
    """(start, zone, total, errors, evidence) per window; entries whose texts have another offset form other windows.

    The evidence is the first five error lines by file and line, taken block by block first.
    """
    keys = ["start", "zone"]
    rows = rows.select("*", *window_keys(minutes))
    counts = rows.groupBy(keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("is_error").alias("errors"))
    errors = rows.where("is_error").withColumn("block", F.floor(F.col("line_number") / BLOCK_LINES))
    few = errors.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "file", "block").orderBy("line_number"))).where(F.col("k") <= EVIDENCE)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("file", "line_number"))).where(F.col("k") <= EVIDENCE)
    lines = F.array_sort(F.collect_list(F.struct("file", "line_number", F.col("raw").alias("content"))))
    evidence = few.groupBy(keys).agg(F.transform(lines, lambda e: F.struct(e["line_number"].alias("line_number"), e["content"].alias("content"))).alias("evidence"))
    return counts.join(evidence, keys, "left")


def gaps(rows: DataFrame) -> DataFrame:
    """(line_number, since, time, since_zone, zone, seconds) to the previous entry in line order; negative ones are left out.

    Blocks of lines are compared inside; the first entry of a block is compared with the last of an earlier one.
    """
    stamp = F.struct("time", zone_of(F.col("timestamp")).alias("zone"))
    rows = rows.select("file", "line_number", stamp.alias("stamp"), F.floor(F.col("line_number") / BLOCK_LINES).alias("block"))
    inside = Window.partitionBy("file", "block").orderBy("line_number")
    ends = rows.groupBy("file", "block").agg(F.max_by("stamp", "line_number").alias("end"))
    ends = ends.select("file", "block", F.last("end", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("end"))
    near = rows.join(ends, ["file", "block"]).withColumn("since", F.coalesce(F.lag("stamp").over(inside), F.col("end")))
    seconds = (F.unix_micros("stamp.time") - F.unix_micros("since.time")) / 1e6
    near = near.select("line_number", F.col("since.time").alias("since"), F.col("stamp.time").alias("time"), F.col("since.zone").alias("since_zone"), F.col("stamp.zone").alias("zone"), seconds.alias("seconds"))
    return near.where("seconds >= 0")


def _row(kind: str, severity: str, description, start, end, value, baseline, details: dict, evidence):
    text = F.create_map(*(x for k, v in details.items() for x in (F.lit(k), v.cast("string"))))
    fields = {"type": F.lit(kind), "severity": F.lit(severity), "description": description, "start": start, "end": end, "value": value, "baseline": baseline, "details": text, "evidence": evidence}
    return [c.alias(n) for n, c in fields.items()]


def _no_evidence():
    return F.array().cast("array<struct<line_number:bigint,content:string>>")


def _above(windows: DataFrame, column: str, kind: str, severity: str, sensitivity: str, minutes: int, words: str, names: tuple[str, str], evidence) -> DataFrame:
    mean = windows.agg(F.avg(column)).first()[0] or 0.0
    value, base = F.col(column).cast("double"), F.lit(float(mean))
    text = F.format_string(words, value / base, F.lit(minutes))
    details = {names[0]: base, names[1]: value, "multiplier": value / base}
    ends = [stamp_text(F.col("start") + k * 60 * minutes, F.col("zone")) for k in (0, 1)]
    return windows.where((value > base * FACTORS[kind][sensitivity]) & (base > 0)).select(*_row(kind, severity, text, *ends, value, base, details, evidence))


def error_spikes(windows: DataFrame, sensitivity: str = "medium", minutes: int = 5) -> DataFrame:
    """Windows whose errors are above so many times the average window's, with their first error lines."""
    return _above(windows, "errors", "error_spike", "high", sensitivity, minutes, SPIKE_WORDS, ("baseline_error_rate", "spike_error_rate"), F.coalesce("evidence", _no_evidence()))


def rate_changes(windows: DataFrame, sensitivity: str = "medium", minutes: int = 5) -> DataFrame:
    """Windows whose lines are above so many times the average window's."""
    return _above(windows, "total", "rate_change", "medium", sensitivity, minutes, RATE_WORDS, ("avg_volume", "window_volume"), _no_evidence())


def long_gaps(found: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """Gaps above so many times the average gap; their ends are in whole seconds and in each entry's own offset."""
    mean = found.agg(F.avg("seconds")).first()[0] or 0.0
    base = F.lit(float(mean))
    text = F.format_string(GAP_WORDS, F.col("seconds"), base)
    ends = [stamp_text(F.floor(F.unix_micros(t) / 1_000_000), F.col(z)) for t, z in (("since", "since_zone"), ("time", "zone"))]
    details = {"gap_duration_seconds": F.col("seconds"), "avg_interval_seconds": base}
    return found.where((F.col("seconds") > base * FACTORS["gap"][sensitivity]) & (base > 0)).select(*_row("gap", "high", text, *ends, F.col("seconds"), base, details, _no_evidence()))


def new_error_types(parsed: DataFrame) -> DataFrame:
    """Error patterns of the last fifth of all parsed entries that the first four fifths do not have."""
    total = parsed.count()
    edge = max(1, total * 8 // 10)
    numbered = running_sum(parsed, F.lit(1).cast("long"), "ordinal")
    errors = numbered.where(F.col("level").isin(*ERROR_LEVELS))
    if "pattern" not in parsed.columns:
        errors = errors.withColumn("pattern", normalize_message(F.col("message")))
    first = F.min(F.struct("ordinal", "line_number", "timestamp", "raw"))
    grouped = errors.groupBy("pattern").agg(F.count(F.lit(1)).alias("count"), first.alias("first")).where(F.col("first.ordinal") > edge)
    seen = F.coalesce("first.timestamp", F.lit(""))
    none = F.lit(None).cast("double")
    details = {"pattern": F.col("pattern"), "occurrences": F.col("count"), "first_seen_line": F.col("first.line_number")}
    evidence = F.array(F.struct(F.col("first.line_number").alias("line_number"), F.col("first.raw").alias("content")))
    return grouped.select(*_row("new_error_type", "low", F.lit(NEW_WORDS), seen, seen, F.col("count").cast("double"), none, details, evidence))


def detect_anomalies(parsed: DataFrame, minutes: int = 5, sensitivity: str = "medium") -> DataFrame:
    """All four kinds over parsed entries (file, line_number, timestamp, level, message, raw)."""
    minutes = clamp(minutes, 5, 60)
    parsed = parsed if "pattern" in parsed.columns else narrow(parsed)
    rows = timed(parsed)
    windows, found = stored(window_counts(rows, minutes)), gaps(rows)
    parts = [error_spikes(windows, sensitivity, minutes), rate_changes(windows, sensitivity, minutes), long_gaps(found, sensitivity), new_error_types(parsed)]
    return reduce(DataFrame.unionByName, parts)


def anomaly_page(anomalies: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page by severity, start, type and description."""
    rank = F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))[F.col("severity")]
    return page(anomalies, [rank, "start", "type", "description"], offset, clamp(limit, 50, 200))
