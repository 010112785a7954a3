"""Dates as documents write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Year, month, day; then time, fraction and offset.
_STAMP = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:(?:[Tt]|[ \t]+)([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]*))?[ \t]*(Z|([-+])([0-9]{1,2})(?::?([0-9]{2}))?)?)?$"


def parse_datetime(s: Column) -> Column:
    """A UTC timestamp of a date, a date and time, or one with an offset; null where it is none of them.

    One- or two-digit months and days, a T or spaces between, fractions to the
    microsecond, Z or hours with optional minutes of offset.
    """
    g = lambda i: F.regexp_extract(F.trim(s), _STAMP, i)
    n = lambda i: F.coalesce(F.try_to_number(F.nullif(g(i), F.lit("")), F.lit("9999")).cast("int"), F.lit(0))
    micro = F.coalesce(F.rpad(F.substring(g(7), 1, 6), 6, "0").cast("double"), F.lit(0.0)) / 1e6
    micro = F.when(g(7) == "", 0.0).otherwise(micro)
    stamp = F.try_make_timestamp_ltz(n(1), n(2), n(3), n(4), n(5), (n(6) + micro).cast("decimal(16,6)"), F.lit("UTC"))
    away = (n(10) * 60 + n(11)) * F.when(g(9) == "-", -1).otherwise(1)
    return F.when(F.trim(s).rlike(_STAMP), F.timestamp_add("MINUTE", -away, stamp))


def own_date(s: Column) -> Column:
    """struct(year, month, day) as written, before any offset is applied; null where the text is no date."""
    g = lambda i: F.regexp_extract(F.trim(s), _STAMP, i).cast("int")
    return F.when(parse_datetime(s).isNotNull(), F.struct(g(1).alias("year"), g(2).alias("month"), g(3).alias("day")))


_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%y": "yy", "%j": "DDD", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%e": "d", "%%": "%"}


def date_text(ts: Column, pattern: str = "%Y-%m-%d") -> Column:
    """A timestamp by a strftime pattern."""
    import re

    return F.date_format(ts, re.sub(r"%.|[A-Za-z]+", lambda m: _STRFTIME.get(m[0], f"'{m[0]}'"), pattern))


def before(a: Column, b: Column) -> Column:
    return parse_datetime(a) < parse_datetime(b)


def after(a: Column, b: Column) -> Column:
    return parse_datetime(a) > parse_datetime(b)
