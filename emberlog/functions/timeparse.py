"""Timestamps stay text; these parse them for durations and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from the year 1, from which windows are counted, to 1970.
YEAR_ONE = 62_135_596_800
_ISO = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
_ZONE = r"(?:Z|[+-]\d{2}:\d{2})\z"


def _shaped(ts: Column, shape: str, value: Column) -> Column:
    return F.when(ts.rlike(shape), value)


def _plain(ts: Column) -> Column:
    return F.try_to_timestamp(F.translate(ts, ",", "."))


def parse_strict(ts: Column) -> Column:
    """RFC 3339, or the same without a zone; null otherwise."""
    return F.coalesce(_shaped(ts, _ISO + r"(?:[.,]\d+)?" + _ZONE, _plain(ts)), _shaped(ts, _ISO + r"(?:[.,]\d+)?\z", _plain(ts)))


def parse_general(ts: Column) -> Column:
    """RFC 3339, date and time with ``T`` or a space, ``Jan 2 15:04:05`` (of year 0), and the web server layout; else null."""
    syslog = F.concat(F.lit("0000 "), F.regexp_replace(ts, r"\s+", " "))
    return F.coalesce(
        parse_strict(ts),
        _shaped(ts, r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?\z", _plain(ts)),
        _shaped(ts, r"\A[A-Z][a-z]{2} {1,2}\d{1,2} \d{2}:\d{2}:\d{2}(?:\.\d+)?\z", F.try_to_timestamp(F.regexp_replace(syslog, r"\.\d+$", ""), F.lit("yyyy MMM d HH:mm:ss"))),
        _shaped(ts, r"\A\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}\z", F.try_to_timestamp(ts, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))),
    )


def micros_between(first: Column, last: Column) -> Column:
    """Microseconds from one timestamp text to another, 0 where one cannot be parsed."""
    return F.coalesce(F.unix_micros(parse_general(last)) - F.unix_micros(parse_general(first)), F.lit(0).cast("long"))


def hours_between(first: Column, last: Column) -> Column:
    """Hours from one timestamp text to another, 0 where one cannot be parsed."""
    return micros_between(first, last) / 3.6e9


def window_start(time: Column, minutes: int) -> Column:
    """Start of the ``minutes``-long window, counted from the year 1, as seconds since 1970."""
    seconds = F.floor(F.unix_micros(time) / 1_000_000)
    return seconds - F.pmod(seconds + F.lit(YEAR_ONE), F.lit(60 * minutes))


def zone_of(ts: Column) -> Column:
    """The offset that a timestamp text carries; ``Z`` for none and for a zero offset."""
    zone = F.regexp_extract(ts, r"(Z|[+-]\d{2}:\d{2})\z", 1)
    return F.when(zone.isin("", "+00:00", "-00:00"), "Z").otherwise(zone)


def stamp_text(seconds: Column, zone: Column) -> Column:
    """Seconds since 1970 as RFC 3339 text in an offset that ``zone_of`` gives."""
    part = [F.substring(zone, k, 2).try_cast("int") for k in (2, 5)]
    shift = F.when(zone == "Z", 0).otherwise(F.when(F.substring(zone, 1, 1) == "-", -60).otherwise(60) * (part[0] * 60 + part[1]))
    return F.concat(F.date_format(F.timestamp_seconds(seconds + shift), "yyyy-MM-dd'T'HH:mm:ss"), zone)
