"""Log lines rendered from the ``events`` table, one renderer per format.

The expressions are SQL that Spark and DuckDB read alike, so an oracle can compute from the same columns what the engine has to
find in the text.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import shared_folder

SPARK_TS = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
DUCKDB_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"

COLUMNS = {
    "line_number": "event_id + 1",
    "level": "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END",
    "source": "concat('svc-', CAST(user_id % 10 AS STRING))",
    "u": "CAST(user_id AS STRING)",
    "n": "CAST(CAST(floor(value) AS BIGINT) AS STRING)",
    "h": "md5(CAST(event_id AS STRING))",
    "request": "concat('r', CAST(CAST(floor(event_id / 4) AS BIGINT) AS STRING))",
    "file": "CAST(event_id % 3 AS STRING)",
}
#: By user_id % 8, so that clusters, differences and new patterns have something to find.
MESSAGES = (
    "concat('request completed user_id=', u, ' status=200 in ', n, ' ms')",
    "concat('connection lost to 10.0.', CAST(user_id % 256 AS STRING), '.7 after ', n, ' ms user_id=', u)",
    "concat('failed to read /var/data/', source, '/part-', n, '.log user_id=', u)",
    "concat('invalid token 0x', substr(h, 1, 8), ' for \"user-', u, '\" user_id=', u)",
    "concat('job ', substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12), ' failed with code ', n, ' user_id=', u)",
    "concat('deployment version ', n, ' started user_id=', u)",
    "concat('queue depth ', n, ' over limit, retry user_id=', u)",
    "concat('timeout waiting for \"lock ', n, '\" user_id=', u)",
)
#: Appears only in the last tenth of the events.
LATE = "concat('checksum mismatch in block ', n, ' user_id=', u)"

MESSAGE = "CASE WHEN event_id * 10 >= last_id * 9 AND user_id % 8 = 2 THEN " + LATE + " " + " ".join(f"WHEN user_id % 8 = {k} THEN {m}" for k, m in enumerate(MESSAGES)) + " END"

DAY = "CAST(CAST(substr(t, 9, 2) AS INT) AS STRING)"
MONTH = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', (CAST(substr(t, 6, 2) AS INT) - 1) * 3 + 1, 3)"
SEVERITY = "CASE level WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 4 WHEN 'INFO' THEN 6 ELSE 7 END"
STATUS = "CASE level WHEN 'ERROR' THEN '500' WHEN 'WARN' THEN '404' ELSE '200' END"
STAMP = "concat(substr(t, 1, 10), ' ', substr(t, 12, 12))"
JSON_MESSAGE = "replace(message, '\"', concat(chr(92), '\"'))"
JSON = f"concat('{{\"timestamp\":\"', t, '\",\"level\":\"', lower(level), '\",\"msg\":\"', {JSON_MESSAGE}, '\",\"logger\":\"', source, '\",\"request_id\":\"', request, '\",\"user\":', u, '}}')"
JSON_EXTRA = "concat('request_id=', request, ';user=', u)"
PRI = f"CAST(128 + {SEVERITY} AS STRING)"
SEVERITY_NAME = "CASE level WHEN 'ERROR' THEN 'err' WHEN 'WARN' THEN 'warning' WHEN 'INFO' THEN 'info' ELSE 'debug' END"
APACHE_DATE = f"concat(substr(t, 9, 2), '/', {MONTH}, '/', substr(t, 1, 4), ':', substr(t, 12, 8), ' +0000')"
APACHE_LEVEL = "CASE WHEN level = 'DEBUG' THEN 'INFO' ELSE level END"
HOST = "concat('10.1.', CAST(user_id % 256 AS STRING), '.9')"
COMMON = f"concat({HOST}, ' - ', CASE WHEN user_id % 2 = 0 THEN '-' ELSE concat('u', u) END, ' [', {APACHE_DATE}, '] \"GET /item/', n, ' HTTP/1.1\" ', {STATUS}, ' ', CASE WHEN user_id % 5 = 0 THEN '-' ELSE n END"
APACHE_EXTRA = "'method=GET;path=/item/', n, ';protocol=HTTP/1.1;'"
USER = "CASE WHEN user_id % 2 = 0 THEN '' ELSE concat(';user=u', u) END"
SIZE = "concat('bytes=', CASE WHEN user_id % 5 = 0 THEN '0' ELSE n END)"
REPORT = "CASE level WHEN 'ERROR' THEN 'ERROR REPORT' WHEN 'WARN' THEN 'WARNING REPORT' WHEN 'INFO' THEN 'PROGRESS REPORT' ELSE 'CRASH REPORT' END"

#: Format: (line, timestamp, level, source, message, extra fields), as SQL on the columns above.
FORMATS = {
    "json": (JSON, "t", "level", "source", "message", JSON_EXTRA),
    "syslog-rfc5424": (
        f"concat('<', {PRI}, '>1 ', t, ' host1 ', source, ' ', u, ' - ', CASE WHEN user_id % 2 = 0 THEN '-' ELSE concat('[x@1 id=\"', n, '\"]') END, ' ', message)",
        "t", "level", "source", "message",
        f"concat('facility=local0;hostname=host1;priority=', {PRI}, ';proc_id=', u, ';severity=', {SEVERITY_NAME}, CASE WHEN user_id % 2 = 0 THEN '' ELSE concat(';structured_data=x@1 id=\"', n, '\"') END, ';version=1')",
    ),
    "syslog-rfc3164": (
        f"concat(CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('<', {PRI}, '>') END, {MONTH}, ' ', lpad({DAY}, 2, ' '), ' ', substr(t, 12, 8), ' host1 ', source, '[', u, ']: ', message)",
        f"concat({MONTH}, ' ', lpad({DAY}, 2, ' '), ' ', substr(t, 12, 8))", "CASE WHEN user_id % 3 <> 0 THEN level END", "source", "message",
        f"CASE WHEN user_id % 3 = 0 THEN concat('hostname=host1;proc_id=', u) ELSE concat('facility=local0;hostname=host1;priority=', {PRI}, ';proc_id=', u, ';severity=', {SEVERITY_NAME}) END",
    ),
    "apache-combined": (
        f"{COMMON}, ' \"http://ref/', u, '\" \"agent/', u, '\"')",
        APACHE_DATE, APACHE_LEVEL, HOST, "concat('GET /item/', n, ' HTTP/1.1')",
        f"concat({SIZE}, ';', {APACHE_EXTRA}, 'referer=http://ref/', u, ';remote_host=', {HOST}, ';status=', {STATUS}, {USER}, ';user_agent=agent/', u)",
    ),
    "apache-common": (f"{COMMON})", APACHE_DATE, APACHE_LEVEL, HOST, "concat('GET /item/', n, ' HTTP/1.1')", f"concat({SIZE}, ';', {APACHE_EXTRA}, 'remote_host=', {HOST}, ';status=', {STATUS}, {USER})"),
    "journalctl-iso": ("concat(substr(t, 1, 19), '+0000 host1 ', source, '[', u, ']: ', message)", "concat(substr(t, 1, 19), '+0000')", "CAST(NULL AS STRING)", "source", "message", "concat('hostname=host1;pid=', u)"),
    "java-logback": (f"concat({STAMP}, ' [main-', u, '] ', level, ' ', source, ' - ', message)", STAMP, "level", "source", "message", "concat('thread=main-', u)"),
    "java-logback-bracket": (
        "concat('[', substr(t, 9, 2), '-', substr(t, 6, 2), '-', substr(t, 1, 4), ' ', substr(t, 12, 12), '] [ main ] [', rpad(level, 5, ' '), '] ', CASE WHEN user_id % 2 = 0 THEN '' ELSE concat('[', substr(h, 1, 16), '] ') END, '[', source, '] ', message)",
        "concat(substr(t, 9, 2), '-', substr(t, 6, 2), '-', substr(t, 1, 4), ' ', substr(t, 12, 12))", "level", "source", "message",
        "concat('thread=main', CASE WHEN user_id % 2 = 0 THEN '' ELSE concat(';trace_id=', substr(h, 1, 16)) END)",
    ),
    "spring-boot": (
        "concat(substr(t, 1, 23), 'Z  ', level, ' ', u, ' --- ', CASE WHEN user_id % 2 = 0 THEN '' ELSE '[app] ' END, '[           main] ', source, '   : ', message)",
        "concat(substr(t, 1, 23), 'Z')", "level", "source", "message", "concat(CASE WHEN user_id % 2 = 0 THEN '' ELSE 'app=app;' END, 'pid=', u, ';thread=main')",
    ),
    "go-logrus-bracket": (f"concat({STAMP}, ' [', level, '][', u, '] ', source, '.go ', n, ': done user_id=', u, ', code=\"', n, '\"')", STAMP, "level", "concat(source, '.go')", "concat('done user_id=', u, ', code=\"', n, '\"')", "concat('code=', n, ';line_number=', n, ';pid=', u, ';user_id=', u)"),
    "erlang-sasl": (f"concat('=', {REPORT}, '==== ', {DAY}, '-', {MONTH}, '-', substr(t, 1, 4), '::', substr(t, 12, 8), ' ===')", "concat(substr(t, 1, 19), 'Z')", "CASE level WHEN 'DEBUG' THEN 'FATAL' ELSE level END", "CAST(NULL AS STRING)", REPORT, "''"),
    "habitat-sup": ("concat('hab-sup(MR): ', t, ' ', level, ' ', source, ': ', message)", "t", "level", "source", "message", "'worker=MR'"),
    "kubernetes-cri": (
        f"concat(substr(t, 1, 26), '123Z ', CASE WHEN user_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END, ' F ', CASE WHEN user_id % 3 = 0 THEN concat('plain ', u) ELSE {JSON} END)",
        "concat(substr(t, 1, 26), '123Z')", "CASE WHEN user_id % 3 <> 0 THEN level WHEN user_id % 2 = 0 THEN 'INFO' ELSE 'ERROR' END", "CASE WHEN user_id % 3 <> 0 THEN source END", "CASE WHEN user_id % 3 <> 0 THEN message ELSE concat('plain ', u) END",
        "concat(CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('inner_format=json;request_id=', request, ';') END, 'stream=', CASE WHEN user_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END, CASE WHEN user_id % 3 = 0 THEN '' ELSE concat(';user=', u) END)",
    ),
}
STACK = ("concat(chr(9), 'at com.app.Svc.run(Svc.java:', n, ')')", "concat('Caused by: java.io.IOException: code ', n)")


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the columns that renderers use."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg(F.max("event_id")).first()[0] or 0
    rows = events.withColumn("t", F.expr(SPARK_TS)).withColumn("last_id", F.lit(last)).withColumns({k: F.expr(v) for k, v in COLUMNS.items()})
    return rows.withColumn("message", F.expr(MESSAGE))


def lines(spark: SparkSession, sf_dir: str, format: str = "json") -> DataFrame:
    """(file, line_number, text): all events as one log of the format."""
    return columns(spark, sf_dir).select(F.lit("events").alias("file"), "line_number", F.expr(FORMATS[format][0]).alias("text"))


def stacked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines; errors are followed by two lines of a stack trace.  Line numbers rise but leave gaps."""
    rows = columns(spark, sf_dir)
    extra = F.when(F.col("level") == "ERROR", F.array(*map(F.expr, STACK))).otherwise(F.array().cast("array<string>"))
    texts = F.posexplode(F.concat(F.array(F.expr(JSON)), extra)).alias("k", "text")
    return rows.select("event_id", texts).select(F.lit("events").alias("file"), (F.col("event_id") * 3 + F.col("k") + 1).alias("line_number"), "text")


def stored_log(spark: SparkSession, sf_dir: str, compression: str = "none", files: int = 4, line_end: str = "\n") -> str:
    """Write the JSON log as text files, four of them by default, to the shared folder; returns the folder."""
    folder = posixpath.join(shared_folder(spark), f"log-{uuid.uuid4().hex}")
    rows = columns(spark, sf_dir).repartitionByRange(files, "line_number").sortWithinPartitions("line_number")
    rows.select(F.expr(JSON).alias("text")).write.option("compression", compression).option("lineSep", line_end).text(folder)
    return folder


def cte() -> str:
    """The same columns for DuckDB, as a CTE named ``e``."""
    inner = ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items())
    return f"c AS (SELECT *, {DUCKDB_TS} AS t, (SELECT max(event_id) FROM events) AS last_id, {inner} FROM events), e AS (SELECT *, {MESSAGE} AS message FROM c)"
