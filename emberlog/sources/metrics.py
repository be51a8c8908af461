"""Tool metrics: JSON-lines events of query calls, their capture, and latency and error aggregates."""

from __future__ import annotations

import functools
import json
import os
import re
import time
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.errors import QueryError
from emberlog.functions.text import round_half_up
from emberlog.sources.lines import clamp

SLOW_MS, LARGE_BYTES = 2000, 51_200
SCHEMA = "ts TIMESTAMP, tool STRING, status STRING, duration_ms BIGINT, response_bytes INT, warning STRING, error_code STRING, file_bytes BIGINT"
GROUPS = ("tool", "status", "warning")


def read_events(spark: SparkSession, folder: str, since: timedelta | None = None, now: datetime | None = None) -> DataFrame:
    """Events of a folder's ``events-*.jsonl`` files and of what ``write_events`` wrote, those before ``now - since`` left out as they are read; lines that are no events are left out."""
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "{events-*.jsonl,part-*.json}").json(folder).where("ts IS NOT NULL")
    return rows if since is None else rows.where(F.col("ts") >= F.lit((now or datetime.now(UTC)) - since))


def write_events(events: DataFrame, folder: str) -> None:
    """Append events as JSON, one folder per day."""
    events.withColumn("day", F.to_date("ts")).write.partitionBy("day").mode("append").json(folder)


def warning_for(duration_ms: int, response_bytes: int) -> str | None:
    return "SLOW_CALL" if duration_ms > SLOW_MS else "LARGE_RESPONSE" if response_bytes > LARGE_BYTES else None


def captured(folder: str, tool: str):
    """Decorator: append an event per call to the day's file of ``folder``; the result's size is that of its text."""

    def wrap(call):
        @functools.wraps(call)
        def run(*args, **kwargs):
            began, status, code, size = time.monotonic(), "ok", None, 0
            try:
                result = call(*args, **kwargs)
                size = len(str(result).encode())
                return result
            except Exception as e:
                status, code = "error", getattr(e, "code", type(e).__name__)
                raise
            finally:
                now, ms = datetime.now(UTC), int((time.monotonic() - began) * 1000)
                event = {"ts": now.isoformat().replace("+00:00", "Z"), "tool": tool, "status": status, "duration_ms": ms, "response_bytes": size, "warning": warning_for(ms, size), "error_code": code}
                with open(os.path.join(folder, f"events-{now:%Y-%m-%d}.jsonl"), "a", encoding="utf-8") as out:
                    out.write(json.dumps({k: v for k, v in event.items() if v is not None}) + "\n")

        return run

    return wrap


def parse_since(text: str = "24h") -> timedelta:
    """``7d``, or hours, minutes, seconds and milliseconds as in ``1h30m``."""
    if m := re.fullmatch(r"(\d+)d", text):
        return timedelta(days=int(m[1]))
    parts = re.findall(r"(\d+(?:\.\d+)?)(h|ms|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise QueryError("INVALID_INPUT", f"bad duration {text!r}")
    unit = {"h": 3600, "m": 60, "s": 1, "ms": 0.001}
    return timedelta(seconds=sum(float(a) * unit[b] for a, b in parts))


def nearest_rank(name: str, percent: int) -> Column:
    """The exact percentile of a column by nearest rank: the value at position ceil(percent / 100 * n)."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY `{name}`)").cast("long")


def aggregate(events: DataFrame, by: str = "tool", since: timedelta | None = None, now: datetime | None = None, tool: str | None = None, top_k: int = 10) -> DataFrame:
    """(key, calls, errors, error_rate, p50_ms, p95_ms, avg_bytes, warnings) by tool, status or warning, most calls first.

    ``warnings`` maps each warning of the group to its calls; null where there is none.
    """
    if by not in GROUPS:
        raise QueryError("INVALID_INPUT", f"cannot group by {by!r}")
    if since is not None:
        events = events.where(F.col("ts") >= F.lit((now or datetime.now(UTC)) - since))
    if tool:
        events = events.where(F.col("tool") == tool)
    calls, errors = F.count(F.lit(1)), F.count_if(F.col("status") == "error")
    key = F.coalesce(F.col(by), F.lit("<none>")) if by == "warning" else F.col(by)
    keyed = events.withColumn("__key", key)
    counted = keyed.where(F.col("warning") != "").groupBy("__key", "warning").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("warning", "n"))))
    warnings = counted.groupBy(F.col("__key").alias("key")).agg(pairs.alias("warnings"))
    out = keyed.groupBy(F.col("__key").alias("key")).agg(
        calls.alias("calls"),
        errors.alias("errors"),
        round_half_up(errors / calls, 3).alias("error_rate"),
        nearest_rank("duration_ms", 50).alias("p50_ms"),
        nearest_rank("duration_ms", 95).alias("p95_ms"),
        F.expr("sum(CAST(response_bytes AS BIGINT)) div count(1)").alias("avg_bytes"),
    )
    shown = out.orderBy(F.desc("calls"), "key").limit(clamp(top_k, 10, 1000))
    return shown.join(warnings, shown["key"].eqNullSafe(warnings["key"]), "left").drop(warnings["key"]).orderBy(F.desc("calls"), "key")
