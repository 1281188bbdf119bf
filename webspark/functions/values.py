"""JSON, map, date and number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_json(t: Column) -> Column:
    """The text if it parses, else null."""
    return F.when(F.try_parse_json(t).isNotNull(), t)


def json_in_text(t: Column) -> Column:
    """First candidate that parses: the whole text, a fenced block, {…}, […]."""
    part = lambda p, g=1: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    return F.coalesce(
        valid_json(F.trim(t)),
        valid_json(F.trim(part(r"(?s)```json\s*(.*?)\s*```"))),
        valid_json(part(r"(?s)(\{.*\})")),
        valid_json(part(r"(?s)(\[.*\])")),
    )


def json_object_in_text(t: Column) -> Column:
    """As ``json_in_text`` with fences of any kind, objects only."""
    part = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return F.coalesce(
        *(F.when(c.startswith("{"), valid_json(c)) for c in (F.trim(t), part(r"(?s)```(?:json)?\s*(.*?)\s*```"), part(r"(?s)(\{.*\})")))
    )


def clamp_priority(p: Column) -> Column:
    """Digit strings to numbers, other strings to 3, then between 1 and 3."""
    n = F.when(p.rlike("^[0-9]+$"), p.try_cast("int")).otherwise(F.lit(3))
    return F.greatest(F.lit(1), F.least(F.lit(3), n))


def clamp_priority_int(p: Column) -> Column:
    return F.when(p <= 1, 1).when(p == 2, 2).otherwise(3)


def duration(seconds: Column) -> Column:
    """Duration with one decimal: seconds, minutes or hours."""
    return (
        F.when(seconds < 60, F.concat(F.format_string("%.1f", F.bround(seconds, 1)), F.lit("秒")))
        .when(seconds < 3600, F.concat(F.format_string("%.1f", F.bround(seconds / 60, 1)), F.lit("分钟")))
        .otherwise(F.concat(F.format_string("%.1f", F.bround(seconds / 3600, 1)), F.lit("小时")))
    )


def duration_between(start: Column, end: Column) -> Column:
    """Whole-second duration between two times; in progress while the end is null."""
    s = F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6).cast("bigint")
    num = lambda c: c.cast("string")
    m, r, h, hm = F.floor(s / 60), s % 60, F.floor(s / 3600), F.floor((s % 3600) / 60)
    return (
        F.when(end.isNull(), F.lit("进行中 / In Progress"))
        .when(s < 60, F.concat(num(s), F.lit("秒 / "), num(s), F.lit("s")))
        .when(s < 3600, F.concat(num(m), F.lit("分"), num(r), F.lit("秒 / "), num(m), F.lit("m "), num(r), F.lit("s")))
        .otherwise(F.concat(num(h), F.lit("小时"), num(hm), F.lit("分 / "), num(h), F.lit("h "), num(hm), F.lit("m")))
    )


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0)), 1)


def megabytes(size: Column) -> Column:
    return F.round(size / F.lit(1048576.0), 2)
