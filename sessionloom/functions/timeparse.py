"""RFC 3339 times, kept as their strings; ordered by microseconds and what is below them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def lenient(c: Column) -> Column:
    """Timestamp, null unless the whole string is RFC 3339."""
    micros = F.when(F.length(c) > 27, F.regexp_replace(c, r"(\.[0-9]{6})[0-9]+", "$1")).otherwise(c)  # 27: six digits and Z
    return F.when(c.rlike(RFC3339), F.try_to_timestamp(micros))


def below_micros(c: Column) -> Column:
    """Nanoseconds below the microsecond, 0 if none are given."""
    return F.when(F.length(c) > 27, F.rpad(F.regexp_extract(c, r"\.[0-9]{6}([0-9]{1,3})", 1), 3, "0").cast("int")).otherwise(0)  # as in lenient


def order_key(c: Column) -> Column:
    """Struct that sorts as the instants do."""
    return F.struct(lenient(c).alias("us"), F.coalesce(below_micros(c), F.lit(0)).alias("ns"))


def bad_time(c: Column) -> Column:
    """Of a non-blank string: whether it is no RFC 3339 time (such rows are quarantined where times must parse)."""
    return (F.coalesce(c, F.lit("")) != "") & lenient(c).isNull()


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, truncated; null if either is missing."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000).cast("long")


def stale(c: Column, now: Column, days: int = 7) -> Column:
    """Blank, no time, or more than ``days`` before ``now``."""
    t = lenient(c)
    return t.isNull() | (F.unix_micros(now) - F.unix_micros(t) > days * 86_400_000_000)
