"""Text scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
ISO = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$"


def iso_time(value: Column) -> Column:
    """Time of an ISO date or date and time; null for any other text, bare clock times and years too."""
    return F.when(value.rlike(ISO), F.try_to_timestamp(value))


def iso_stamp(ts: Column) -> Column:
    return F.concat(F.date_format(ts, STAMP), F.lit("+00:00"))


def lag_label(seconds: Column) -> Column:
    """250 -> `4m 10s`, 55 -> `55s`."""
    minutes = F.floor(seconds / 60).cast("bigint")
    rest = F.concat((seconds - minutes * 60).cast("string"), F.lit("s"))
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), rest)).otherwise(rest)


def clock(ts_text: Column) -> Column:
    """HH:MM:SS of an ISO timestamp text; text that is no timestamp passes through."""
    return F.coalesce(F.date_format(iso_time(ts_text), "HH:mm:ss"), ts_text)


def slug(title: Column) -> Column:
    """Lower-case file stem of at most 80 characters."""
    dashed = F.lower(F.regexp_replace(title, r"[^\p{L}\p{N}]+", "-"))
    return F.coalesce(F.nullif(F.left(F.trim(dashed, F.lit("-")), F.lit(80)), F.lit("")), F.lit("document"))


def html_escape(value: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def strip(value: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.trim(value, F.lit(" \t\n\r\x0b\x0c"))


def first_line(value: Column) -> Column:
    return F.split(value, r"\r\n|\n|\r", 2)[0]


def words(value: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(value), r"[^\p{L}\p{N}]+"), lambda word: word != "")
