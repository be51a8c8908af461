"""Scalar functions on log text: levels, normalised messages, sizes, globs, event types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.rx import java

#: What is replaced in a message, in this order.
NORMAL_FORMS = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"/[\w./\-]+", "<PATH>"),
    (r'"[^"]*"', "<STR>"),
    (r"\b\d+\b", "<N>"),
)
ERROR_LEVELS = ("ERROR", "FATAL", "CRITICAL")
SEVERITY = {"FATAL": 10.0, "CRITICAL": 8.0, "ERROR": 5.0, "WARN": 2.0}
#: Words that make a message a lifecycle event; the first category with a word decides.
LIFECYCLE = (
    ("startup", ("started", "listening on", "server ready", "boot complete")),
    ("shutdown", ("shutting down", "stopped", "graceful shutdown", "sigterm")),
    ("deploy", ("deployed", "deployment", "release", "version")),
    ("restart", ("restarting", "restarted", "respawn")),
    ("crash", ("crash", "panic", "fatal", "core dump", "segfault")),
    ("connection", ("connected", "disconnected", "connection lost", "reconnect")),
)
DEFAULT_EVENT_TYPES = ("ERROR", "WARN", "FATAL", "startup", "shutdown", "deploy", "restart", "crash", "connection")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, wherever the optimizer moves the result."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def normalize_message(message: Column) -> Column:
    """The message with its variable parts replaced by placeholders."""
    for pattern, name in NORMAL_FORMS:
        message = F.regexp_replace(message, java(pattern), name)
    return message


def keyword_level(line: Column) -> Column:
    """The level a line names first, as a whole word in any case; null if none."""
    word = F.upper(F.regexp_extract(line, java(r"\b(FATAL|CRITICAL|ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE)\b", ignore_case=True), 1))
    return F.when(word == "WARNING", "WARN").when(word != "", word)


def severity_weight(level: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in SEVERITY.items():
        out = F.when(level == name, weight).otherwise(out)
    return out


def event_type(message: Column, level: Column) -> Column:
    """Lifecycle category of the message, else the level, else INFO."""
    low, out = F.lower(message), None
    for name, words in LIFECYCLE:
        for word in words:
            hit = low.contains(word)
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.coalesce(level, F.lit("INFO")))


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB, with one decimal from KB on."""
    out = F.format_string("%d B", size)
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(size / float(1024**power), 1))).otherwise(out)
    return out


def round_half_up(value: Column, digits: int) -> Column:
    """Rounding of values that are not negative, half away from zero."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def glob_pattern(glob: str) -> str:
    """A Java pattern for a file-name glob; ``*`` and ``?`` do not cross ``/``."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            body = glob[k + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "^!" else body).replace("[", r"\[") + "]")
            k = end
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out.append(re.escape(glob[k]))
        else:
            out.append(re.escape(c))
        k += 1
    return r"\A" + "".join(out) + r"\z"
