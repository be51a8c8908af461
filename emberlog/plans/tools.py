"""One function per question about log files, with the usual parameters: paths in, an answer out.

An answer is a dict.  Rows are lazy DataFrames, single facts (totals, paging, formats) are Python values; ``as_plain`` turns an
answer into lists and dicts, at most ``MOST_ROWS`` rows of each frame.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.errors import QueryError
from emberlog.functions.rx import matches
from emberlog.functions.text import ERROR_LEVELS
from emberlog.operators import anomalies, correlate, diff, errors, formats, records, search, summary
from emberlog.operators import timeline as timelines
from emberlog.session import stored
from emberlog.sources.lines import clamp, first_lines, neighbours, read_lines, read_range, tail

MOST_ROWS = 1000


def as_plain(answer: dict) -> dict:
    """The answer with its frames as lists of dicts."""

    def plain(value):
        if isinstance(value, DataFrame):
            return [r.asDict(recursive=True) for r in value.limit(MOST_ROWS).collect()]
        return as_plain(value) if isinstance(value, dict) else value

    return {k: plain(v) for k, v in answer.items()}


def _paged(total: int, offset: int, limit: int) -> dict:
    facts = search.page_facts(total, offset, max(0, min(limit, total - offset)))
    return {"has_more": facts["has_more"], "next_offset": facts["next_offset"], "truncated": facts["has_more"]}


def read_logs(spark: SparkSession, path: str, start_line: int = 1, num_lines: int = 100) -> dict:
    """A range of lines; the total is told only when the range reaches the end."""
    lines = read_lines(spark, path)
    start, n = max(1, start_line), clamp(num_lines, 100, 1000)
    shown = read_range(lines, start, n)
    last = lines.agg(F.max("line_number")).first()[0] or 0
    more = last > start + n - 1
    return {"lines": shown, "total_lines": 0 if more else last, "has_more": more, "file_size_bytes": os.path.getsize(path), "current_range": {"start": start, "end": min(start + n - 1, last)}}


def tail_logs(spark: SparkSession, path: str, num_lines: int = 50) -> dict:
    lines = read_lines(spark, path)
    total = lines.count()
    return {"lines": tail(lines, num_lines), "total_lines": total, "file_size_bytes": os.path.getsize(path), "showing_from_line": max(1, total - clamp(num_lines, 50, 1000) + 1)}


def search_logs(spark: SparkSession, path: str, pattern: str, is_regex: bool = False, case_sensitive: bool = False, context_lines: int = 0, max_results: int = 50, offset: int = 0, record_separator: str = "") -> dict:
    """Matching lines with context, or matching records."""
    if not pattern:
        raise QueryError("VALIDATION_ERROR", "a pattern is needed")
    lines, limit = read_lines(spark, path), clamp(max_results, 50, 500)
    if record_separator:
        units = records.records(lines, record_separator).withColumn("__hit", matches(F.col("text"), pattern, is_regex, case_sensitive))
        total, searched = units.agg(F.count_if("__hit"), F.sum("line_count")).first()
        found, order = units.where("__hit").drop("__hit"), ["file", "start_line"]
    else:
        hit = matches(F.col("text"), pattern, is_regex, case_sensitive)
        total, searched = lines.agg(F.count_if(hit), F.count(F.lit(1))).first()
        found, order = search.page(lines.where(hit), ["file", "line_number"], offset, limit), ["file", "line_number"]
        return {"matches": neighbours(lines, found, context_lines).orderBy(*order), "total_matches": total, "searched_lines": searched, "pattern_used": pattern} | _paged(total, offset, limit)
    return {"matches": search.page(found, order, offset, limit), "total_matches": total, "searched_lines": searched or 0, "pattern_used": pattern} | _paged(total, offset, limit)


def parse_logs(spark: SparkSession, path: str, start_line: int = 1, num_lines: int = 50, format_hint: str = "auto") -> dict:
    """Parsed lines of a range, and those that are not of the format.  A known hint is taken with full confidence."""
    row = None if format_hint in formats.PARSERS else formats.detect(first_lines(spark, path)).first()
    found = format_hint if format_hint in formats.PARSERS else row["format"] if row else "unknown"
    shown = stored(read_range(read_lines(spark, path), start_line, clamp(num_lines, 50, 500)))
    good, bad = formats.entries(shown, found), search.parse_errors(shown, found)
    return {"detected_format": found, "confidence": row["confidence"] if row else float(found != "unknown"), "records": good, "parse_errors": bad, "total_parsed": good.count(), "total_errors": bad.count()}


def filter_logs(spark: SparkSession, path: str, level=(), after: str = "", before: str = "", source: str = "", message_pattern: str = "", max_results: int = 100, offset: int = 0, record_separator: str = "") -> dict:
    """Entries, or records, that meet all conditions; all totals are 0 for an unknown format."""
    lines, limit = read_lines(spark, path), clamp(max_results, 100, 1000)
    given = {"levels": list(level), "after": after, "before": before, "source": source, "message": message_pattern}
    found = formats.detect_one(first_lines(spark, path))
    if record_separator:
        rows, order = search.filter_records(lines, found, record_separator, **given), ["file", "start_line"]
    else:
        rows, order = search.filter_lines(lines, found, **given), ["file", "line_number"]
    known = found != "unknown"
    total = rows.count() if known else 0
    scanned = (records.records(lines, record_separator).count() if record_separator else lines.count()) if known else 0
    applied = {k: v for k, v in (("level", list(level)), ("after", after), ("before", before), ("source", source), ("message_pattern", message_pattern)) if v}
    return {"entries": search.page(rows, order, offset, limit), "total_matched": total, "total_scanned": scanned, "applied_filters": applied} | _paged(total, offset, limit)


def count_by_level(spark: SparkSession, path: str) -> dict:
    lines = read_lines(spark, path)
    counts = stored(search.count_by_level(lines, formats.detect_one(first_lines(spark, path))))
    return {"counts": counts, "total_lines": lines.count(), "parsed_lines": counts.agg(F.sum("count")).first()[0] or 0}


def summarize_logs(spark: SparkSession, path: str, sample_size: int = 0, record_separator: str = "") -> dict:
    lines = read_lines(spark, path)
    found, total = formats.detect_one(first_lines(spark, path)), lines.count()
    parts = summary.summarize(lines, found, sample_size, record_separator or None)
    analyzed = min(total, sample_size) if sample_size > 0 else total
    info = {"name": os.path.basename(path), "path": path, "size_bytes": os.path.getsize(path), "total_lines": total}
    return {"file_info": info, "detected_format": found, "sampled": 0 < sample_size <= total, "lines_analyzed": analyzed} | parts


def extract_errors(spark: SparkSession, path: str, include_stack_traces: bool = False, max_clusters: int = 20, offset: int = 0, sort_by: str = "count", record_separator: str = "") -> dict:
    lines, limit = read_lines(spark, path), clamp(max_clusters, 20, 100)
    found = stored(errors.error_entries(lines, formats.detect_one(first_lines(spark, path)), include_stack_traces, record_separator or None))
    clusters = errors.clusters(found)
    total = clusters.count()
    rate = errors.error_rate(found, lines.count()).first()
    order = F.desc("impact") if sort_by == "impact" else F.desc("count")
    facts = {"total_errors": rate["total_errors"], "total_clusters": total, "error_rate": {"errors_per_hour": rate["per_hour"], "percentage_of_all_lines": rate["percent"]}, "levels_included": list(ERROR_LEVELS)}
    return {"clusters": search.page(clusters, [order, "pattern"], offset, limit)} | facts | _paged(total, offset, limit)


def timeline(spark: SparkSession, path: str, after: str = "", before: str = "", event_types=(), max_events: int = 100) -> dict:
    lines = read_lines(spark, path)
    events = stored(timelines.timeline_events(lines, formats.detect_one(first_lines(spark, path)), after or None, before or None, list(event_types) or None))
    shown, total = timelines.timeline(events, max_events), events.count()
    return {"events": shown, "time_span": timelines.time_span(shown).first().asDict(), "event_count": total, "truncated": total > clamp(max_events, 100, 500)}


def detect_anomalies(spark: SparkSession, path: str, window_minutes: int = 5, sensitivity: str = "medium", max_results: int = 50, offset: int = 0) -> dict:
    if sensitivity not in ("low", "medium", "high"):
        sensitivity = "medium"
    lines, minutes, limit = read_lines(spark, path), clamp(window_minutes, 5, 60), clamp(max_results, 50, 200)
    parsed = anomalies.narrow(formats.entries(lines, formats.detect_one(first_lines(spark, path))))
    found = stored(anomalies.detect_anomalies(parsed, minutes, sensitivity))
    total, rows = found.count(), anomalies.timed(parsed)
    at = F.struct("file", "line_number")
    a, b = rows.agg(F.min_by("time", at), F.max_by("time", at)).first()
    ends = (b - a).total_seconds() / 3600 if a and b else 0.0
    windows = rows.select(*anomalies.window_keys(minutes)).distinct().count()
    facts = {"total_lines_analyzed": lines.count(), "time_span_hours": ends, "window_minutes": minutes, "sensitivity": sensitivity, "windows_analyzed": windows}
    return {"anomalies": anomalies.anomaly_page(found, offset, limit), "total_anomalies": total, "analysis_metadata": facts} | _paged(total, offset, limit)


def diff_logs(spark: SparkSession, base_path: str, target_path: str = "", base_after: str = "", base_before: str = "", target_after: str = "", target_before: str = "") -> dict:
    """Two logs, or two periods of one; each log's format is detected by itself."""
    base_lines = read_lines(spark, base_path)
    base = formats.entries(base_lines, formats.detect_one(first_lines(spark, base_path)))
    periods = (base_after or None, base_before or None), (target_after or None, target_before or None)
    if target_path:
        target_lines = read_lines(spark, target_path)
        target = formats.entries(target_lines, formats.detect_one(first_lines(spark, target_path)))
        sided = diff.two_logs(base.where(diff.in_period(*periods[0])), target.where(diff.in_period(*periods[1])))
        totals = {"base": base_lines.count(), "target": target_lines.count()}
    else:
        sided = diff.two_periods(base, *periods)
        totals = dict.fromkeys(diff.SIDES, base_lines.count())
    sided = stored(sided.select("side", "timestamp", "level", "source", F.when(F.col("level").isin(*ERROR_LEVELS), F.col("message")).alias("message")))
    changes, sources = stored(diff.error_diff(sided)), stored(diff.source_diff(sided))
    kinds = {"new_errors": "new", "resolved_errors": "resolved", "changed_errors": "changed"}
    named = {"new_sources": "new", "disappeared_sources": "resolved", "changed_sources": "changed"}
    out = {"summaries": diff.side_summary(sided, totals), "level_changes": diff.level_diff(sided).orderBy("level")}
    out |= {k: diff.ordered_errors(changes, v) for k, v in kinds.items()}
    return out | {k: sources.where(F.col("class") == v).orderBy(F.desc(F.abs("change")), "source") for k, v in named.items()}


def correlate_logs(spark: SparkSession, paths: list[str], correlation_field: str = "request_id", time_window_seconds: int = 60) -> dict:
    """Identifiers that several of 2 to 10 logs share; each log's format is detected by itself."""
    correlate.check_paths(paths)
    parsed = None
    for path in paths:
        lines = read_lines(spark, path)
        one = formats.entries(lines, formats.detect_one(first_lines(spark, path))).withColumn("file", F.lit(path))
        parsed = one if parsed is None else parsed.unionByName(one)
    groups = correlate.groups_by_id(parsed, correlation_field or "request_id", time_window_seconds)
    shown, total = correlate.correlate(parsed, correlation_field or "request_id", time_window_seconds), groups.count()
    files = parsed.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("entries_parsed"))
    events = correlate.group_events(parsed, shown, correlation_field or "request_id").orderBy("correlation_id", "timestamp", "file", "line_number")
    return {"correlated_groups": shown, "events": events, "total_groups": total, "groups_returned": min(total, correlate.MAX_GROUPS), "files_analyzed": files}
