from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from emberlog.errors import QueryError
from emberlog.functions import rx, text, timeparse
from emberlog.sources import metrics


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string").orderBy("k").select(column).collect()]


def test_re2_semantics(spark):
    assert values(spark, F.col("x").rlike(rx.java("a$")), ["a", "a\n"]) == [True, False]
    assert values(spark, F.regexp_extract("x", rx.java("(.+)"), 1), ["a\rb c\nd"]) == ["a\rb c"]
    assert values(spark, F.regexp_replace("x", rx.java(r"\b\d+\b"), "<N>"), ["ä5 x 7 a8 9é"]) == ["ä<N> x <N> a8 <N>é"]
    assert values(spark, F.col("x").rlike(rx.java("ÉCOLE", True)), ["une école"]) == [True]
    assert values(spark, F.col("x").rlike(rx.java(r"\s")), ["a\x0bb", "a b"]) == [False, True]
    assert values(spark, F.regexp_extract("x", rx.java(r"(?P<word>[[a]+)"), 1), ["x[a["]) == ["[a["]


@pytest.mark.parametrize("bad", ["(?=a)", "(?<!a)b", r"(a)\1", "a++", "[a", "(a", "*a", "a|*b"])
def test_what_re2_lacks_is_refused(bad):
    with pytest.raises(QueryError) as e:
        rx.java(bad)
    assert e.value.code == "INVALID_REGEX"


def test_literals_fold_case(spark):
    assert values(spark, rx.matches(F.col("x"), "a.B", regex=False), ["xA.by", "axb"]) == [True, False]
    assert values(spark, rx.matches(F.col("x"), "a.B", regex=False, case_sensitive=True), ["a.b", "a.B"]) == [False, True]


@pytest.mark.parametrize(
    ("message", "normal"),
    [
        ("id 123e4567-e89b-12d3-a456-426614174000 done", "id <UUID> done"),
        ("from 10.0.0.1:80", "from <IP>:<N>"),
        ("at 0xDEADbeef", "at <HEX>"),
        ("open /var/log/a-b.log failed", "open <PATH> failed"),
        ('user "bob 7" left', "user <STR> left"),
        ("10/20 of v2", "<N><PATH> of v2"),
        ("", ""),
    ],
)
def test_normal_messages(spark, message, normal):
    assert values(spark, text.normalize_message(F.col("x")), [message]) == [normal]


def test_keyword_levels(spark):
    lines = ["a warning: b", "xERROR y", "say Info", "error_x", "", "TRACE DEBUG", "é-fatal"]
    assert values(spark, text.keyword_level(F.col("x")), lines) == ["WARN", None, "INFO", None, None, "TRACE", "FATAL"]


def test_event_types(spark):
    lines = ["service restarted", "conversion done", "graceful shutdown", "FATAL x", "reconnect", "plain"]
    assert values(spark, text.event_type(F.col("x"), F.lit(None).cast("string")), lines) == ["startup", "deploy", "shutdown", "crash", "connection", "INFO"]


def test_sizes(spark):
    got = values(spark, text.human_size(F.col("x").cast("long")), ["0", "1023", "1024", "1280", "1792", "1048576", "5368709120"])
    assert got == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.8 KB", "1.0 MB", "5.0 GB"]


def test_globs():
    for glob, name, hit in [("*.log", "a.log", True), ("*.log", "d/a.log", False), ("a?c", "abc", True), ("[!a]x", "bx", True), ("[a-c]x", "dx", False), (r"\*", "*", True), ("a.c", "abc", False)]:
        assert bool(re.search(text.glob_pattern(glob).replace(r"\z", r"\Z"), name)) == hit


def test_times(spark):
    rows = ["2025-01-15T10:00:00Z", "2025-01-15T10:00:00.5+01:00", "2025-01-15T10:00:00", "2025-01-15 10:00:00.25", "2025-01-15", "2025-1-5 1:2:3", "2025-01-15T10:00:00+0000", "15/Jan/2025:10:00:00 +0100", "Jan  5 10:00:00", "nonsense", None]
    general = values(spark, timeparse.parse_general(F.col("x")).isNotNull(), rows)
    assert general == [True, True, True, True, False, False, False, True, True, False, False]
    strict = values(spark, timeparse.parse_strict(F.col("x")).isNotNull(), rows)
    assert strict == [True, True, True] + [False] * 8
    apart = timeparse.hours_between(F.lit("Jan 5 10:00:00"), F.lit("Jan  5 12:30:00"))
    assert spark.range(1).select(apart).first()[0] == 2.5


@pytest.mark.parametrize("minutes", [5, 7, 9, 11, 13, 60])
def test_windows_count_from_year_one(spark, minutes):
    from datetime import UTC, datetime, timedelta

    when = datetime(2025, 3, 4, 5, 6, 7, tzinfo=UTC)
    since = (when - datetime(1, 1, 1, tzinfo=UTC)) // timedelta(minutes=minutes) * timedelta(minutes=minutes)
    expected = (datetime(1, 1, 1, tzinfo=UTC) + since - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()
    got = spark.range(1).select(timeparse.window_start(F.to_timestamp(F.lit("2025-03-04T05:06:07Z")), minutes)).first()[0]
    assert got == expected


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 99, 100, 101])
def test_nearest_rank(spark, n):
    rows = spark.range(1, n + 1).select((F.col("id") * 10).alias("v"))
    for p in (50, 95):
        assert rows.agg(metrics.nearest_rank("v", p)).first()[0] == 10 * -(-p * n // 100)


def test_durations():
    assert metrics.parse_since("7d").days == 7 and metrics.parse_since("1h30m").seconds == 5400
    with pytest.raises(QueryError):
        metrics.parse_since("soon")


def test_metrics_capture_and_aggregate(spark, tmp_path):
    @metrics.captured(str(tmp_path), "search")
    def call(x):
        if x < 0:
            raise QueryError("INVALID_INPUT", "negative")
        return "y" * x

    call(3)
    call(60_000)
    with pytest.raises(QueryError):
        call(-1)
    (tmp_path / "events-2000-01-01.jsonl").write_text('not json\n{"ts":"2000-01-01T00:00:00Z","tool":"old","status":"ok","duration_ms":5,"response_bytes":1}\n')
    events = metrics.read_events(spark, str(tmp_path))
    assert events.count() == 4
    recent = metrics.aggregate(events, "tool", since=metrics.parse_since("1h")).collect()
    assert [(r.key, r.calls, r.errors, r.error_rate) for r in recent] == [("search", 3, 1, 0.333)]
    assert {r.key for r in metrics.aggregate(events, "warning").collect()} == {"<none>", "LARGE_RESPONSE"}
    with pytest.raises(QueryError):
        metrics.aggregate(events, "color")
