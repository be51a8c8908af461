"""Log formats: each is a column function from a line to an entry struct, null where the line is not of the format.

An entry has timestamp, level, source, message and extra (a map).  Timestamps stay as they are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.rx import groups, java
from emberlog.functions.text import let
from emberlog.sources.lines import sample

EXTRA = "map<string,string>"

#: The line patterns.
APACHE_COMBINED = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)\s+(\S+)"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)")?(?:\s+"([^"]*)")?$'
APACHE_COMMON = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)\s+(\S+)"\s+(\d{3})\s+(\S+)$'
ERLANG = r"^=([A-Z][A-Z ]+)=+\s+(\d{1,2}-[A-Za-z]{3}-\d{4})::(\d{2}:\d{2}:\d{2})\s+===\s*$"
LOGRUS = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)\s+\[([A-Z]+)\]\[(\d+)\]\s+(\S+)\s+(\d+):\s+(.+)$"
LOGRUS_PAIR = r'(\w+)=(?:"([^"]*)"|([\S]+))'
HABITAT = r"^hab-sup\(([^)]+)\):\s+(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z)\s+(DEBUG|INFO|WARN|ERROR|TRACE)\s+(\S+)\s+(.+)$"
LOGBACK_A = r"^(\d{2}:\d{2}:\d{2}[.,]\d{3})\s+\[([^\]]+)\]\s+(TRACE|DEBUG|INFO|WARN|ERROR)\s+(\S+)\s+-\s+(.*)$"
LOGBACK_B = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]\d{3})\s+(TRACE|DEBUG|INFO|WARN|ERROR)\s+\[([^\]]+)\]\s+(\S+)\s+-\s+(.*)$"
LOGBACK_C = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]\d{3})\s+\[([^\]]+)\]\s+(TRACE|DEBUG|INFO|WARN|ERROR)\s+(\S+)\s+-\s+(.*)$"
LOGBACK_BRACKET = r"^\[(\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2}\.\d{3})\]\s+\[([^\]]+)\]\s+\[([A-Z]+)\s*\]\s+(?:\[([0-9a-f]+)\]\s+)?\[([^\]]+)\]\s+(.+)$"
JOURNAL = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?[+-]\d{4})\s+(\S+)\s+([^\[ :]+)(?:\[(\d+)\])?:\s+(.*)$"
CRI = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+\S*)\s+(stdout|stderr)\s+([FP]) (.*)$"
CONTINUATION = r"^(?:\tat |Caused by:|Traceback \(most recent call last\):|   at |\s+)"
SPRING_3 = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}\S*)\s+(TRACE|DEBUG|INFO|WARN|ERROR)\s+(\d+)\s+---\s+\[([^\]]*)\]\s+\[([^\]]*)\]\s+(\S+)\s+:\s+(.*)$"
SPRING_2 = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]\d{3}\S*)\s+(TRACE|DEBUG|INFO|WARN|ERROR)\s+(\d+)\s+---\s+\[([^\]]*)\]\s+(\S+)\s+:\s+(.*)$"
SYSLOG_3164 = r"^(?:<(\d{1,3})>)?(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)$"
SYSLOG_5424 = r"^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:-|(\[(?:[^\]]*)\](?:\s*\[(?:[^\]]*)\])*))\s*(.*)$"

#: Names of syslog facilities and severities, and the level of each severity.
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert clock local0 local1 local2 local3 local4 local5 local6 local7".split()
SEVERITIES = "emerg alert crit err warning notice info debug".split()
SEVERITY_LEVELS = "FATAL FATAL CRITICAL ERROR WARN INFO INFO DEBUG".split()

#: JSON keys of the four known fields, and texts of levels.
JSON_KEYS = {
    "timestamp": ("ts", "time", "timestamp", "@timestamp", "date", "datetime", "t"),
    "level": ("level", "severity", "log_level", "loglevel", "lvl", "priority"),
    "message": ("msg", "message", "log", "text", "body"),
    "source": ("source", "logger", "component", "module", "name", "service"),
}
JSON_LEVELS = {
    "trace": "TRACE",
    "10": "TRACE",
    "debug": "DEBUG",
    "20": "DEBUG",
    "info": "INFO",
    "information": "INFO",
    "30": "INFO",
    "warn": "WARN",
    "warning": "WARN",
    "40": "WARN",
    "error": "ERROR",
    "err": "ERROR",
    "50": "ERROR",
    "fatal": "FATAL",
    "critical": "FATAL",
    "60": "FATAL",
}


def _entry(matched: Column, timestamp, level, source, message, extra: dict[str, Column] | Column) -> Column:
    none = F.lit(None).cast("string")
    if isinstance(extra, dict):  # null values are left out
        pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in extra.items()]
        extra = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if pairs else F.lit(None).cast(EXTRA)
    fields = {"timestamp": timestamp, "level": level, "source": source, "message": message}
    made = F.struct(*((none if v is None else v).alias(k) for k, v in fields.items()), extra.cast(EXTRA).alias("extra"))
    return F.when(matched, made)


def _unless(value: Column, *texts: str) -> Column:
    return F.when(~value.isin(*texts), value)


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, java(r"^\s+|\s+$"), "")


def _java_level(level: Column) -> Column:
    return F.when(level.isin("TRACE", "DEBUG", "WARN", "ERROR"), level).otherwise("INFO")


def _number_text(value: Column) -> Column:
    """A JSON number with a whole value is written without decimals."""
    return F.regexp_replace(value, r"^(-?\d+)\.0$", "$1")


def parse_json(line: Column) -> Column:
    """One JSON object; keys of known fields in any case, of several the first in the fixed order wins."""
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    objects = F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<map<string,string>>", options)
    one = let(objects, lambda o: F.when(F.size(o) == 1, F.coalesce(F.get(o, F.lit(0)), F.create_map().cast(EXTRA))))
    found = F.when(line.rlike(r"(?s)\A\s*(?:\{.*\}|null)\s*\z"), one)
    return let(found, lambda m: let(F.map_entries(m), lambda pairs: _json_entry(m, pairs)))


def _json_entry(found: Column, pairs: Column) -> Column:
    levels = F.create_map(*(F.lit(x) for pair in JSON_LEVELS.items() for x in pair))
    fields = {k for name in ("timestamp", "message", "source") for k in JSON_KEYS[name]}

    def first(name: str) -> Column:
        keys = F.array(*map(F.lit, JSON_KEYS[name]))
        own = F.filter(pairs, lambda p: F.lower(p["key"]).isin(*JSON_KEYS[name]))
        ranked = F.transform(own, lambda p: F.struct(F.array_position(keys, F.lower(p["key"])).alias("rank"), F.coalesce(p["value"], F.lit("")).alias("value")))
        return _number_text(F.array_min(ranked)["value"])

    def is_extra(key: Column, value: Column) -> Column:
        known_level = F.lower(_number_text(F.coalesce(value, F.lit("")))).isin(*JSON_LEVELS)
        return ~F.lower(key).isin(*fields) & ~(F.lower(key).isin(*JSON_KEYS["level"]) & known_level)

    extra = F.map_filter(found, is_extra)
    return _entry(found.isNotNull(), first("timestamp"), F.element_at(levels, F.lower(first("level"))), first("source"), F.coalesce(first("message"), F.lit("")), F.when(F.size(extra) > 0, extra))


def parse_spring(line: Column) -> Column:
    new = let(groups(line, SPRING_3, 7), lambda g: _entry(g.isNotNull(), g[0], _java_level(g[1]), g[5], g[6], {"pid": g[2], "app": _trimmed(g[3]), "thread": _trimmed(g[4])}))
    old = let(groups(line, SPRING_2, 6), lambda g: _entry(g.isNotNull(), g[0], _java_level(g[1]), g[4], g[5], {"pid": g[2], "thread": _trimmed(g[3])}))
    return F.coalesce(new, old)


def parse_logrus(line: Column) -> Column:
    return let(groups(line, LOGRUS, 6), _logrus_entry)


def _logrus_entry(g: Column) -> Column:
    level = F.when(g[1] == "WARNING", "WARN").when(g[1].isin("TRACE", "DEBUG", "WARN", "ERROR", "FATAL", "CRITICAL"), g[1]).otherwise("INFO")
    keys = F.slice(F.regexp_extract_all(g[5], F.lit(java(LOGRUS_PAIR)), 1), 1, 10)
    quoted = F.regexp_extract_all(g[5], F.lit(java(LOGRUS_PAIR)), 2)
    bare = F.regexp_extract_all(g[5], F.lit(java(LOGRUS_PAIR)), 3)

    def pair(key: Column, k: Column) -> Column:
        value = F.when(F.get(quoted, k) != "", F.get(quoted, k)).otherwise(F.get(bare, k))
        cut = F.when(F.octet_length(value) > 100, F.concat(F.substring(value, 1, 100), F.lit("..."))).otherwise(value)
        return F.struct(key.alias("key"), F.rtrim(cut, F.lit(",")).alias("value"))

    pairs = F.concat(F.array(F.struct(F.lit("pid").alias("key"), g[2].alias("value")), F.struct(F.lit("line_number").alias("key"), g[4].alias("value"))), F.transform(keys, pair))
    last = F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))  # a later pair replaces an earlier one
    return _entry(g.isNotNull(), g[0], level, g[3], g[5], F.map_from_entries(last))


def parse_logback_bracket(line: Column) -> Column:
    return let(groups(line, LOGBACK_BRACKET, 6), _logback_bracket_entry)


def _logback_bracket_entry(g: Column) -> Column:
    return _entry(g.isNotNull(), g[0], _java_level(g[2]), _trimmed(g[4]), _trimmed(g[5]), {"thread": _trimmed(g[1]), "trace_id": _unless(g[3], "")})


def parse_logback(line: Column) -> Column:
    def made(pattern: str, level: int, thread: int) -> Column:
        return let(groups(line, pattern, 5), lambda g: _entry(g.isNotNull(), g[0], g[level], g[3], g[4], {"thread": _trimmed(g[thread])}))

    return F.coalesce(made(LOGBACK_A, 2, 1), made(LOGBACK_B, 1, 2), made(LOGBACK_C, 2, 1))


def parse_erlang(line: Column) -> Column:
    return let(groups(line, ERLANG, 3), _erlang_entry)


def _erlang_entry(g: Column) -> Column:
    kind = _trimmed(g[0])
    level = F.when(kind == "ERROR REPORT", "ERROR").when(kind == "CRASH REPORT", "FATAL").when(kind.isin("SUPERVISOR REPORT", "WARNING REPORT"), "WARN").otherwise("INFO")
    date = F.try_to_timestamp(F.concat(F.initcap(g[1]), F.lit(" "), g[2]), F.lit("d-MMM-yyyy HH:mm:ss"))
    stamp = F.coalesce(F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(g[1], F.lit("T"), g[2]))
    return _entry(g.isNotNull(), stamp, level, None, kind, {})


def parse_habitat(line: Column) -> Column:
    return let(groups(line, HABITAT, 5), _habitat_entry)


def _habitat_entry(g: Column) -> Column:
    return _entry(g.isNotNull(), g[1], g[2], F.regexp_replace(g[3], r":\z", ""), g[4], {"worker": g[0]})


def _priority(text: Column) -> tuple[Column, dict[str, Column]]:
    """(level, extra fields) of a syslog priority; nulls where there is none."""
    pri = F.when(text != "", text).cast("int")
    facility, severity = F.floor(pri / 8).cast("int"), pri % 8
    name = F.when(facility < len(FACILITIES), F.get(F.array(*map(F.lit, FACILITIES)), facility)).otherwise(F.concat(F.lit("unknown("), facility.cast("string"), F.lit(")")))
    level = F.get(F.array(*map(F.lit, SEVERITY_LEVELS)), severity)
    return level, {"priority": pri, "severity": F.get(F.array(*map(F.lit, SEVERITIES)), severity), "facility": F.when(pri.isNotNull(), name)}


def parse_syslog5424(line: Column) -> Column:
    return let(groups(line, SYSLOG_5424, 9), _syslog5424_entry)


def _syslog5424_entry(g: Column) -> Column:
    level, extra = _priority(g[0])
    data = F.regexp_replace(g[7], r"(?s)\A\[(.*)\]\z", "$1")
    return _entry(g.isNotNull(), g[2], level, g[4], g[8], {"hostname": g[3], "version": g[1], "proc_id": _unless(g[5], "-"), "msg_id": _unless(g[6], "-"), "structured_data": F.when(g[7] != "", data)} | extra)


def parse_journal(line: Column) -> Column:
    return let(groups(line, JOURNAL, 5), _journal_entry)


def _journal_entry(g: Column) -> Column:
    return _entry(g.isNotNull(), g[0], None, g[2], g[4], {"hostname": g[1], "pid": _unless(g[3], "")})


def parse_syslog3164(line: Column) -> Column:
    return let(groups(line, SYSLOG_3164, 6), _syslog3164_entry)


def _syslog3164_entry(g: Column) -> Column:
    level, extra = _priority(g[0])
    return _entry(g.isNotNull(), g[1], level, g[3], g[5], {"hostname": g[2], "proc_id": _unless(g[4], "")} | extra)


def _apache(g: Column, more: dict[str, Column]) -> Column:
    status = g[7].cast("int")
    level = F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")
    size = F.when(g[8] == "-", "0").otherwise(g[8])
    extra = {"remote_host": g[0], "identity": _unless(g[1], "-"), "user": _unless(g[2], "-"), "method": g[4], "path": g[5], "protocol": g[6], "status": g[7], "bytes": size}
    return _entry(g.isNotNull(), g[3], level, g[0], F.concat_ws(" ", g[4], g[5], g[6]), extra | more)


def parse_apache_combined(line: Column) -> Column:
    return let(groups(line, APACHE_COMBINED, 11), lambda g: _apache(g, {"referer": _unless(g[9], "-"), "user_agent": g[10]}))


def parse_apache_common(line: Column) -> Column:
    return let(groups(line, APACHE_COMMON, 9), lambda g: _apache(g, {}))


def parse_cri(line: Column) -> Column:
    """The container prefix, then the first of five formats that knows the rest; the prefix's timestamp wins."""
    return let(groups(line, CRI, 4), _cri_entry)


def _cri_entry(g: Column) -> Column:
    inner = g[3]
    upper = F.upper(inner)
    level = F.when(upper.contains("ERROR"), "ERROR").when(upper.contains("WARN"), "WARN").when(upper.contains("DEBUG"), "DEBUG").when(g[1] == "stderr", "ERROR").otherwise("INFO")

    def tried(name: str) -> Column:
        marks = F.create_map(F.lit("stream"), g[1], F.lit("inner_format"), F.lit(name))

        def made(e: Column) -> Column:
            own = F.map_filter(F.coalesce(e["extra"], F.create_map().cast(EXTRA)), lambda k, v: ~k.isin("stream", "inner_format"))
            return _entry(e.isNotNull(), g[0], e["level"], e["source"], e["message"], F.map_concat(own, marks))

        return let(PARSERS[name](inner), made)

    plain = _entry(g.isNotNull(), g[0], level, None, inner, {"stream": g[1]})
    names = ("json", "java-logback-bracket", "spring-boot", "go-logrus-bracket", "java-logback")
    return F.when(g.isNotNull() & ~inner.rlike(java(CONTINUATION)), F.coalesce(*map(tried, names), plain))


#: The formats in the order in which detection prefers them.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "kubernetes-cri": parse_cri,
    "json": parse_json,
    "spring-boot": parse_spring,
    "go-logrus-bracket": parse_logrus,
    "java-logback-bracket": parse_logback_bracket,
    "java-logback": parse_logback,
    "erlang-sasl": parse_erlang,
    "habitat-sup": parse_habitat,
    "syslog-rfc5424": parse_syslog5424,
    "journalctl-iso": parse_journal,
    "syslog-rfc3164": parse_syslog3164,
    "apache-combined": parse_apache_combined,
    "apache-common": parse_apache_common,
}
MIN_CONFIDENCE = 0.5


def parse(line: Column, format: str) -> Column:
    return PARSERS[format](line)


def detect(lines: DataFrame) -> DataFrame:
    """(file, format, confidence, sample_size, successful_parses) per file, from its first lines.

    The format that most sample lines have wins, of equal ones the earlier; below one half it is ``unknown``.
    """
    tried = sample(lines).groupBy("file").agg(F.count(F.lit(1)).alias("sample_size"), *(F.count(parse(F.col("text"), n)).alias(f"n{k}") for k, n in enumerate(PARSERS)))
    best = F.array_max(F.array(*(F.struct(F.col(f"n{k}").alias("n"), F.lit(-k).alias("k"), F.lit(n).alias("format")) for k, n in enumerate(PARSERS))))
    share = F.col("best.n") / F.col("sample_size")
    return tried.withColumn("best", best).select("file", F.when(share >= MIN_CONFIDENCE, F.col("best.format")).otherwise("unknown").alias("format"), share.alias("confidence"), F.col("sample_size").cast("long").alias("sample_size"), F.col("best.n").alias("successful_parses"))


def detect_one(lines: DataFrame, hint: str = "auto") -> str:
    """The format of a single file; a known hint is taken as it is."""
    if hint in PARSERS:
        return hint
    row = detect(lines).first()
    return row["format"] if row else "unknown"


def entry_columns() -> list:
    """The entry schema, from rows of ``attempts``."""
    parts = {n: F.col(f"entry.{n}").alias(n) for n in ("timestamp", "level", "source", "message")}
    return ["file", "line_number", F.lit(1).alias("line_count"), *parts.values(), F.col("text").alias("raw"), F.col("entry.extra").alias("extra_fields"), "format"]


NO_ENTRY = "struct<timestamp:string,level:string,source:string,message:string,extra:map<string,string>>"


def entries(lines: DataFrame, format: str) -> DataFrame:
    """Parsed lines (file, line_number, line_count, timestamp, level, source, message, raw, extra_fields, format); others are left out.

    The entry comes out of a generator, so filters on its fields stay above it and a line is parsed once.
    """
    found = F.array_compact(F.array(_parsed(format)))
    return lines.select("file", "line_number", "text", F.explode(found).alias("entry")).withColumn("format", F.lit(format)).select(*entry_columns())


def attempts(lines: DataFrame, format: str) -> DataFrame:
    """All lines with their ``entry``, null where the line is not of the format."""
    return lines.select("*", F.explode(F.array(_parsed(format))).alias("entry")).withColumn("format", F.lit(format))


def _parsed(format: str) -> Column:
    return parse(F.col("text"), format) if format in PARSERS else F.lit(None).cast(NO_ENTRY)
