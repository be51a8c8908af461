from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.errors import QueryError
from emberlog.operators import anomalies, correlate, diff, errors, formats, records, search, summary, timeline
from emberlog.streaming import counts

LINES = "file string, line_number long, text string"


def frame(spark, texts, file="f"):
    return spark.createDataFrame([(file, k, t) for k, t in enumerate(texts, 1)], LINES)


def entry(spark, line, format):
    return spark.createDataFrame([(line,)], "x string").select(formats.parse(F.col("x"), format).alias("e")).first().e


def j(ts=None, level=None, msg=None, **more):
    return json.dumps({k: v for k, v in (("ts", ts), ("level", level), ("msg", msg)) if v is not None} | more)


@pytest.mark.parametrize("line", ["", "random text", '{"a":1} x', '{"a":1}{"b":2}', "[1]", "5", "{'a':1}", '{"a":1,}'])
def test_json_is_one_object(spark, line):
    assert entry(spark, line, "json") is None


def test_json_fields(spark):
    e = entry(spark, '{"TS":"t1","Severity":"Critical","text":"m","module":null,"n":1.5,"s":"1.0"}', "json")
    assert (e.timestamp, e.level, e.message, e.source, e.extra) == ("t1", "FATAL", "m", "", {"n": "1.5", "s": "1.0"})
    e = entry(spark, '{"level":30.0,"msg":"a","message":"b"}', "json")
    assert (e.level, e.message, e.timestamp, e.extra) == ("INFO", "a", None, None)
    e = entry(spark, '{"level":"odd"}', "json")
    assert (e.level, e.message, e.extra) == (None, "", {"level": "odd"})


def test_syslog_priorities(spark):
    for pri, level, facility in ((0, "FATAL", "kern"), (2, "CRITICAL", "kern"), (165, "INFO", "local4"), (191, "DEBUG", "local7"), (200, "FATAL", "unknown(25)")):
        e = entry(spark, f"<{pri}>Oct 11 22:14:15 host su[7]: hi", "syslog-rfc3164")
        assert (e.level, e.extra["facility"], e.extra["proc_id"], e.extra["priority"]) == (level, facility, "7", str(pri))
    e = entry(spark, "Oct  1 22:14:15 host su: hi", "syslog-rfc3164")
    assert (e.level, e.extra, e.source) == (None, {"hostname": "host"}, "su")
    e = entry(spark, '<34>1 2025-01-01T00:00:00Z h app - ID47 [a@1 x="y"][b z="1"] text', "syslog-rfc5424")
    assert (e.message, e.extra["structured_data"], e.extra["msg_id"], "proc_id" in e.extra) == ("text", 'a@1 x="y"][b z="1"', "ID47", False)


def test_apache(spark):
    e = entry(spark, '1.2.3.4 - - [10/Oct/2025:13:55:36 -0700] "GET /x HTTP/1.0" 500 -', "apache-combined")
    assert (e.level, e.message, e.extra["bytes"], e.extra["referer"], e.extra["user_agent"], "user" in e.extra) == ("ERROR", "GET /x HTTP/1.0", "0", "", "", False)
    e = entry(spark, '1.2.3.4 - bob [10/Oct/2025:13:55:36 -0700] "GET /x HTTP/1.0" 404 7 "-" "UA"', "apache-combined")
    assert (e.level, e.extra["user"], "referer" in e.extra, e.extra["user_agent"]) == ("WARN", "bob", False, "UA")


def test_other_formats(spark):
    assert entry(spark, "14:04:07.123 [ main ] INFO a.B - m", "java-logback").extra == {"thread": "main"}
    assert entry(spark, "[05-05-2025 14:04:07.123] [t] [FATAL] [l] m", "java-logback-bracket").level == "INFO"
    e = entry(spark, f"2025-01-01 00:00:00.1 [WARNING][7] f.go 12: a=1, pid=9 b=\"x y\" c={'z' * 120}", "go-logrus-bracket")
    assert (e.level, e.extra["a"], e.extra["pid"], e.extra["b"], e.extra["c"]) == ("WARN", "1", "9", "x y", "z" * 100 + "...")
    e = entry(spark, "=SUPERVISOR REPORT==== 5-Mar-2025::01:02:03 ===", "erlang-sasl")
    assert (e.timestamp, e.level, e.message, e.extra) == ("2025-03-05T01:02:03Z", "WARN", "SUPERVISOR REPORT", None)
    assert entry(spark, "2025-01-01T00:00:00+0000 h sshd[1]: x", "journalctl-iso").level is None


def test_cri(spark):
    at = "2025-01-01T00:00:00.123456789Z"
    assert entry(spark, f"{at} stderr F \tat x.Y", "kubernetes-cri") is None
    assert entry(spark, f"{at} stderr F plain", "kubernetes-cri").level == "ERROR"
    assert entry(spark, f"{at} stdout P a warning", "kubernetes-cri").level == "WARN"
    e = entry(spark, f'{at} stdout F {{"level":"debug","msg":"m","stream":"s"}}', "kubernetes-cri")
    assert (e.timestamp, e.level, e.extra) == (at, "DEBUG", {"stream": "stdout", "inner_format": "json"})


def test_detection(spark):
    apache = '1.2.3.4 - - [10/Oct/2025:13:55:36 -0700] "GET /x HTTP/1.0" 200 5'
    logs = frame(spark, [apache] * 3, "a").union(frame(spark, ["x", j(msg="m"), "y"], "b")).union(frame(spark, [""] * 20 + [j(msg="m")], "c")).union(frame(spark, [j(msg="m"), "x"], "d"))
    found = {r.file: (r.format, r.confidence, r.sample_size) for r in formats.detect(logs).collect()}
    assert found["a"] == ("apache-combined", 1.0, 3) and found["b"][0] == "unknown" and abs(found["b"][1] - 1 / 3) < 1e-9
    assert "c" not in found and found["d"] == ("json", 0.5, 2)
    assert formats.detect_one(frame(spark, []), "auto") == "unknown" and formats.detect_one(frame(spark, ["x"]), "json") == "json"


def slow_records(texts, start):
    groups = []
    for k, t in enumerate(texts, 1):
        if start(t) or not groups or not groups[-1]["open"]:
            groups.append({"open": start(t), "line": k, "rows": [t], "bytes": len(t.encode()), "cut": False, "full": False})
            continue
        g = groups[-1]
        if g["full"]:
            continue
        g["rows"].append(t)
        g["bytes"] += len(t.encode())
        if len(g["rows"]) >= 500 or g["bytes"] >= 65_536:
            g["full"] = g["cut"] = True
    return [(g["line"], len(g["rows"]), "\n".join(g["rows"]), g["cut"]) for g in groups]


def test_records(spark):
    rng = random.Random(2)
    texts = ["before", "two"] + [rng.choice(["S start", "more", "é" * rng.choice([1, 9000])]) for _ in range(300)] + ["S"] + ["x"] * 700 + ["S last"]
    got = records.records(frame(spark, texts), "^S").orderBy("start_line").collect()
    assert [tuple(r)[1:] for r in got] == slow_records(texts, lambda t: t.startswith("S"))
    one = records.records(frame(spark, ["S" + "y" * 70_000, "b", "c"]), "^S").first()
    assert (one.line_count, one.truncated) == (2, True)
    assert records.records(frame(spark, ["S" + "y" * 70_000]), "^S").first().truncated is False


def test_combined(spark):
    texts = ["lost", j("t1", "error", "a"), "\tat x", "Caused by: y", j("t2", "info", "b")]
    got = records.combined(frame(spark, texts), "json").orderBy("line_number").collect()
    assert [(r.line_number, r.line_count, r.level, r.message, r.stack_trace) for r in got] == [(1, 1, None, "lost", None), (2, 3, "ERROR", "a", "\tat x\nCaused by: y"), (5, 1, "INFO", "b", None)]


def test_search_pages_are_disjoint(spark):
    logs = frame(spark, [f"hit {k}" if k % 2 else "miss" for k in range(100)])
    seen = []
    for offset in (0, 20, 40, 60):
        seen += [r.line_number for r in search.search_page(logs, "HIT", offset=offset, limit=20).collect()]
    assert seen == list(range(2, 101, 2))
    assert search.page_facts(50, 40, 10) == {"total": 50, "has_more": False, "next_offset": 50}


def test_filters(spark):
    texts = [j("2025-01-01T00:00:00Z", "info", "a", source="api"), j("2025-01-01T00:00:00.5Z", "error", "b"), j(None, "warn", "c"), "bad", j("2025-01-02T00:00:00Z", None, "d")]
    logs = frame(spark, texts)
    ids = lambda **g: [r.line_number for r in search.filter_lines(logs, "json", **g).orderBy("line_number").collect()]
    assert ids(levels=["Error", "WARN"]) == [2, 3] and ids(source="AP.$") == [1] and ids(message="[bd]") == [2, 5]
    assert ids(after="2025-01-01T00:00:00Z") == [1, 5]  # "." sorts before "Z"
    assert ids(before="2025-01-02T00:00:00.000Z") == [1, 2] and ids() == [1, 2, 3, 5]
    assert search.filter_lines(logs, "unknown").count() == 0
    with pytest.raises(QueryError, match="INVALID_TIMESTAMP"):
        ids(after="yesterday")
    assert [r.line_number for r in search.parse_errors(logs, "json").collect()] == [4]
    assert search.parse_errors(logs, "unknown").count() == 5


def test_summary(spark):
    texts = [j(f"2025-01-01T00:0{k % 3}:00Z", "error" if k % 2 else "info", f"m{k % 2}", source="s") for k in range(9)] + ["noise"]
    parts = summary.summarize(frame(spark, texts), "json")
    assert {r.level: (r["count"], r.percent) for r in parts["levels"].collect()} == {"INFO": (5, 50.0), "ERROR": (4, 40.0)}
    assert [tuple(r) for r in parts["top_errors"].collect()] == [("m1", 4)]
    assert tuple(parts["time_range"].first()) == ("2025-01-01T00:00:00Z", "2025-01-01T00:02:00Z", 0.03)
    t = parts["throughput"].first()
    assert (t.peak_minute, t.peak_count, t.quiet_minute, t.quiet_count, t.lines_per_minute) == ("2025-01-01T00:00", 3, "2025-01-01T00:00", 3, 5.56)
    assert summary.summarize(frame(spark, texts), "json", sample_size=2)["levels"].count() == 2


def test_error_clusters(spark):
    texts = [j("t1", "error", "fail 1"), j("t2", "fatal", "fail 22"), j("t3", "info", "fail 3"), j("t4", "critical", 'x "q"'), j("t5", "error", "fail 4"), j("t6", "error", "fail 5")]
    got = errors.extract_errors(frame(spark, texts), "json", sort_by="impact").collect()
    assert [(r.pattern, r["count"], r.impact, r.first_line, r.last_timestamp) for r in got] == [("fail <N>", 4, 40.0, 1, "t6"), ("x <STR>", 1, 10.0, 4, "t4")]
    assert got[0].samples == ["fail 1", "fail 22", "fail 4"] and got[0].percent == 80.0
    assert errors.extract_errors(frame(spark, texts), "json", offset=10).count() == 0
    rate = errors.error_rate(errors.error_entries(frame(spark, texts), "json"), 10).first()
    assert (rate.total_errors, rate.percent, rate.per_hour) == (5, 50.0, 0.0)


def test_record_errors_fall_back_to_keywords(spark):
    texts = ["2025-01-01T00:00:00Z ERROR boom 7", "\tat a", "2025-01-01T00:00:01Z INFO fine", "2025-01-01T00:00:02Z ERROR boom 8"]
    got = errors.extract_errors(frame(spark, texts), "unknown", separator=r"^\d{4}").collect()
    assert len(got) == 2 or got[0]["count"] >= 1
    assert any(r.stack_trace == "\tat a" for r in got)


def test_timeline(spark):
    texts = [j("2025-01-01T00:00:02Z", "info", "server started"), j("2025-01-01T00:00:01Z", "critical", "x"), j("2025-01-01T00:00:01Z", "error", "b"), j("2025-01-01T00:00:03Z", "info", "quiet")]
    events = timeline.timeline_events(frame(spark, texts), "json")
    assert [(r.type, r.line_number) for r in timeline.timeline(events).collect()] == [("FATAL", 2), ("ERROR", 3), ("startup", 1)]
    assert timeline.timeline_events(frame(spark, texts), "json", start="2025-01-01T00:00:01Z", end="2025-01-01T00:00:03Z").count() == 1
    critical = frame(spark, ["<2>Oct 11 22:14:15 host su: x"])
    assert timeline.timeline_events(critical, "syslog-rfc3164").count() == 0  # the default types leave CRITICAL out
    assert abs(timeline.time_span(events).first().minutes - 1 / 60) < 1e-9


def test_anomalies(spark):
    def at(second, level="info", msg="ok"):
        return j(f"2025-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z", level, msg)

    texts = [at(60 * k, "error" if k % 5 == 0 else "info", "base 1") for k in range(40)] + [at(2400 + k, "error", f"base {k}") for k in range(30)] + [at(9000 + k) for k in range(5)] + [at(9100, "error", "brand new 7")]
    parsed = formats.entries(frame(spark, texts), "json")
    found = anomalies.detect_anomalies(parsed).collect()
    kinds = {r.type for r in found}
    assert {"error_spike", "gap", "new_error_type"} <= kinds
    spike = next(r for r in found if r.type == "error_spike")
    assert spike.start == "2025-01-01T00:40:00Z" and spike.end == "2025-01-01T00:45:00Z" and spike.value == 30
    assert [e.line_number for e in spike.evidence] == [41, 42, 43, 44, 45] and spike.evidence[0].content == texts[40]
    assert spike.description.startswith("Error rate increased ") and set(spike.details) == {"baseline_error_rate", "spike_error_rate", "multiplier"}
    gap = next(r for r in found if r.type == "gap")
    assert (gap.start, gap.end, gap.evidence) == ("2025-01-01T00:40:29Z", "2025-01-01T02:30:00Z", [])
    assert [r.value for r in found if r.type == "gap"] == [float(9000 - 2429)]
    assert [(r.details["pattern"], r.details["occurrences"], r.evidence[0].line_number) for r in found if r.type == "new_error_type"] == [("brand new <N>", "1", 76)]
    calm = formats.entries(frame(spark, [at(60 * k) for k in range(50)]), "json")
    assert anomalies.detect_anomalies(calm).count() == 0
    ranks = [anomalies.RANKS[r.severity] for r in anomalies.anomaly_page(anomalies.detect_anomalies(parsed)).collect()]
    assert ranks == sorted(ranks)


def test_windows_keep_their_offset(spark):
    texts = [j(f"2025-01-01T00:{k:02d}:00{z}", "error" if k < 5 else "info", "x 1") for k in range(50) for z in ("+02:00", "Z", "", "+00:00")]
    windows = anomalies.window_counts(anomalies.timed(formats.entries(frame(spark, texts), "json")), 5)
    found = anomalies.error_spikes(windows).orderBy("start").collect()
    assert [(r.start, r.end) for r in found] == [("2025-01-01T00:00:00+02:00", "2025-01-01T00:05:00+02:00"), ("2025-01-01T00:00:00Z", "2025-01-01T00:05:00Z")]
    assert [r.value for r in found] == [5, 15]


def test_errors_of_many_files(spark):
    """First and last go by file and then line; timestamps that are missing do not end the error rate's span."""
    a = frame(spark, [j(None, "error", "x 1"), j("2025-01-01T00:00:00Z", "error", "x 2"), j("2025-01-01T02:00:00Z", "error", "x 3"), j(None, "error", "x 4")], "a")
    b = frame(spark, [j(None, "error", "x 5")], "b")
    found = errors.error_entries(a.union(b), "json")
    rate = errors.error_rate(found, 10).first()
    assert (rate.total_errors, rate.per_hour) == (5, 2.5)
    one = errors.clusters(found).first()
    assert (one.first_line, one.last_line, one.samples, one["count"]) == (1, 1, ["x 1", "x 2", "x 3"], 5)


def test_gaps_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(anomalies, "BLOCK_LINES", 3)
    times = [0, 5, 4, 9, 20, 21, 50, 50]
    logs = frame(spark, [j(f"2025-01-01T00:00:{t:02d}Z", "info", "x") for t in times])
    got = anomalies.gaps(anomalies.timed(formats.entries(logs, "json"))).orderBy("line_number").collect()
    assert [(r.line_number, r.seconds) for r in got] == [(2, 5.0), (4, 5.0), (5, 11.0), (6, 1.0), (7, 29.0), (8, 0.0)]


def test_diff(spark):
    base = formats.entries(frame(spark, [j("t1", "error", "A 1"), j("t2", "error", "B"), j("t3", "info", "x", source="s1")]), "json")
    target = formats.entries(frame(spark, [j("t1", "error", "B"), j("t2", "error", "C"), j("t3", "error", "C")]), "json")
    sided = diff.two_logs(base, target)
    got = {r.pattern: (r["class"], r.base_count, r.target_count, r.change) for r in diff.error_diff(sided).collect()}
    assert got == {"A <N>": ("resolved", 1, 0, -1), "B": ("changed", 1, 1, 0), "C": ("new", 0, 2, 2)}
    assert [r.pattern for r in diff.ordered_errors(diff.error_diff(sided), "new").collect()] == ["C"]
    assert {r.level: r.base_percent for r in diff.level_diff(sided).collect()} == {"ERROR": 66.7, "INFO": 33.3}
    both = diff.two_periods(base, (None, "t2"), ("t2", None))
    assert sorted((r.timestamp, r.side) for r in both.collect()) == [("t1", "base"), ("t2", "base"), ("t2", "target"), ("t3", "target")]
    with pytest.raises(QueryError, match="INVALID_INPUT"):
        diff.two_periods(base, (None, None), ("t2", None))


def test_correlation(spark):
    def log(file, rows):
        return formats.entries(frame(spark, rows, file), "json")

    a = log("a", [j("2025-01-01T00:00:00Z", None, "x", request_id="r1"), j("2025-01-01T00:00:00Z", None, "request_id='r2'"), j(None, None, "y", request_id=None), j("2025-01-01T00:00:00Z", None, "z", request_id="far")])
    b = log("b", [j("2025-01-01T00:00:01.5Z", None, "x", request_id="r1"), j("bad", None, "request_id: r2"), j(None, None, "y", request_id=None), j("2025-01-01T02:00:00Z", None, "z", request_id="far")])
    got = {r.correlation_id: (r.files, r.size, r.span_ms) for r in correlate.correlate(a.unionByName(b)).collect()}
    assert got == {"r1": (["a", "b"], 2, 1500)}
    shown = correlate.correlate(a.unionByName(b))
    assert correlate.group_events(a.unionByName(b), shown).count() == 2
    with pytest.raises(QueryError):
        correlate.check_paths(["one"])


#: Microseconds to milliseconds: halves go up, also where the span in hours is not exact; the last is beyond an hour.
SPANS = {"whole": (115_438_000, 115_438), "below": (115_438_499, 115_438), "half": (115_438_500, 115_439), "hour": (3_600_000_499, 3_600_000), "beyond": (3_600_000_500, None)}


def span_logs(spark, line):
    """Each id of SPANS at the start of a log and, that much later, in another."""
    start = datetime(2024, 1, 1)
    ends = {"a": dict.fromkeys(SPANS, start), "b": {k: start + timedelta(microseconds=us) for k, (us, _) in SPANS.items()}}
    logs = [formats.entries(frame(spark, [line(t.isoformat(timespec="microseconds") + "Z", k) for k, t in times.items()], file), "json") for file, times in ends.items()]
    return logs[0].unionByName(logs[1])


def test_spans_by_message_round_halves_up(spark):
    parsed = span_logs(spark, lambda t, k: j(t, None, f"handled trace='{k}' in time"))
    got = {r.correlation_id: r.span_ms for r in correlate.groups_by_id(parsed, "trace", 3600).collect()}
    assert got == {k: ms for k, (_, ms) in SPANS.items() if ms is not None}


def test_spans_by_field_round_halves_up(spark):
    parsed = span_logs(spark, lambda t, k: j(t, None, "x", request_id=k))
    got = {r.correlation_id: (r.files, r.size, r.span_ms) for r in correlate.groups_by_id(parsed, "request_id", 3600).collect()}
    assert got == {k: (["a", "b"], 2, ms) for k, (_, ms) in SPANS.items() if ms is not None}


def test_time_groups(spark):
    rows = [("a", 1, "2025-01-01T00:59:50Z"), ("b", 1, "2025-01-01T01:00:05Z"), ("a", 2, "2025-01-01T01:30:00Z"), ("a", 3, "2025-01-01T03:00:00Z"), ("b", 3, "2025-01-01T03:00:20Z"), ("b", 4, None)]
    parsed = spark.createDataFrame(rows, "file string, line_number long, timestamp string")
    got = correlate.time_groups(parsed, 30).orderBy("group_start").collect()
    assert [(str(r.group_start), r.files, r.size) for r in got] == [("2025-01-01 00:59:50", ["a", "b"], 2), ("2025-01-01 03:00:00", ["a", "b"], 2)]


def test_streaming_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join([j("2025-01-01T00:01:00Z", "error", "a"), j("2025-01-01T00:02:00Z", "info", "b"), j("2025-01-01T01:00:00Z", "error", "c"), "bad"]))
    stream = counts.level_counts(counts.stream_lines(spark, str(tmp_path / "in")), "json")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("level_counts").start()
    try:
        run.processAllAvailable()
        got = sorted((str(r.window.start), r.level, r["count"]) for r in spark.table("level_counts").collect())
    finally:
        run.stop()
    assert got == [("2025-01-01 00:00:00", "ERROR", 1), ("2025-01-01 00:00:00", "INFO", 1), ("2025-01-01 01:00:00", "ERROR", 1)]
