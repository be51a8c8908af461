"""The questions end to end, on small files."""

from __future__ import annotations

import json

import pytest

from emberlog.errors import QueryError
from emberlog.plans import tools


def line(second: int, level: str, msg: str, **more) -> str:
    return json.dumps({"timestamp": f"2025-01-15T10:{second // 60:02d}:{second % 60:02d}Z", "level": level, "msg": msg} | more)


@pytest.fixture
def app(log):
    levels = ("info", "warn", "error", "info", "fatal")
    return log("\n".join(line(k, levels[k % 5], f"step {k} done", source="api" if k % 2 else "db", request_id=f"r{k // 2}") for k in range(20)) + "\nbroken\n")


def test_read_and_tail(spark, app):
    a = tools.as_plain(tools.read_logs(spark, app, 3, 2))
    assert [r["line_number"] for r in a["lines"]] == [3, 4] and a["has_more"] and a["total_lines"] == 0
    a = tools.read_logs(spark, app, 20, 10)
    assert not a["has_more"] and a["total_lines"] == 21 and a["current_range"] == {"start": 20, "end": 21}
    a = tools.as_plain(tools.tail_logs(spark, app, 2))
    assert [r["text"] for r in a["lines"]][-1] == "broken" and a["showing_from_line"] == 20


def test_search(spark, app):
    a = tools.as_plain(tools.search_logs(spark, app, "STEP 1", max_results=4, context_lines=1))
    assert a["total_matches"] == 11 and len(a["matches"]) == 4 and a["has_more"] and a["next_offset"] == 4
    assert len(a["matches"][0]["before_context"]) == 1
    assert tools.search_logs(spark, app, "x.*", is_regex=True)["total_matches"] == 0
    assert tools.search_logs(spark, app, "done", record_separator=r"^\{")["total_matches"] == 20
    for bad, code in (("", "VALIDATION_ERROR"), ("(", "INVALID_REGEX")):
        with pytest.raises(QueryError) as e:
            tools.search_logs(spark, app, bad, is_regex=True)
        assert e.value.code == code


def test_parse_filter_count(spark, app):
    a = tools.parse_logs(spark, app)
    assert (a["detected_format"], a["total_parsed"], a["total_errors"], a["confidence"]) == ("json", 20, 1, 1.0)
    a = tools.as_plain(tools.filter_logs(spark, app, level=["error"], source="d", max_results=1))
    assert a["total_matched"] == 2 and a["total_scanned"] == 21 and len(a["entries"]) == 1 and a["applied_filters"] == {"level": ["error"], "source": "d"}
    a = tools.as_plain(tools.count_by_level(spark, app))
    assert {r["level"]: r["count"] for r in a["counts"]} == {"INFO": 8, "WARN": 4, "ERROR": 4, "FATAL": 4} and a["parsed_lines"] == 20


def test_unknown_format_filters_to_nothing(spark, log):
    path = log("free text\nERROR more\n")
    a = tools.filter_logs(spark, path, level=["error"])
    assert a["total_matched"] == a["total_scanned"] == 0
    assert tools.as_plain(tools.count_by_level(spark, path))["counts"] == [{"level": "ERROR", "count": 1}]


def test_summary_and_errors(spark, app):
    a = tools.as_plain(tools.summarize_logs(spark, app, sample_size=10))
    assert a["sampled"] and a["lines_analyzed"] == 10 and a["file_info"]["total_lines"] == 21 and a["top_sources"][0]["count"] == 5
    a = tools.as_plain(tools.extract_errors(spark, app, sort_by="impact"))
    assert a["total_errors"] == 8 and a["total_clusters"] == 1 and a["clusters"][0]["pattern"] == "step <N> done" and a["clusters"][0]["impact"] == 80.0


def test_timeline_and_anomalies(spark, app):
    a = tools.as_plain(tools.timeline(spark, app, max_events=3))
    assert a["event_count"] == 12 and a["truncated"] and len(a["events"]) == 3
    a = tools.detect_anomalies(spark, app)
    assert a["analysis_metadata"]["windows_analyzed"] == 1 and a["total_anomalies"] == 0


def test_diff_and_correlate(spark, app, log):
    other = log("\n".join(line(k, "error", f"new {k}", request_id=f"r{k}") for k in range(4)), "other.log")
    a = tools.as_plain(tools.diff_logs(spark, app, other))
    assert [r["pattern"] for r in a["new_errors"]] == ["new <N>"] and [r["pattern"] for r in a["resolved_errors"]] == ["step <N> done"]
    a = tools.as_plain(tools.diff_logs(spark, app, base_before="2025-01-15T10:00:09Z", target_after="2025-01-15T10:00:10Z"))
    assert {r["side"]: r["parsed_lines"] for r in a["summaries"]} == {"base": 10, "target": 10}
    with pytest.raises(QueryError):
        tools.diff_logs(spark, app)
    a = tools.as_plain(tools.correlate_logs(spark, [app, other]))
    assert a["total_groups"] == 4 and a["correlated_groups"][0]["size"] == 3 and len(a["events"]) == 12
    with pytest.raises(QueryError):
        tools.correlate_logs(spark, [app])
