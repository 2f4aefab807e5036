"""Frequencies, buckets and session times as column expressions.

A day bucket starts at local midnight, and intraday buckets count from local midnight too, so that 5h bars
are alike in batch and stream. Timestamps are local (session time zone or without one)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"s": 1, "min": 60, "h": 3600, "d": 86400}


def seconds(freq: str) -> int:
    """Length of a frequency such as ``15min`` or ``1d`` in seconds."""
    m = re.fullmatch(r"(\d+)(s|min|h|d)", freq)
    if not m or int(m[1]) < 1:
        raise ValueError(f"unknown frequency {freq!r}")
    return int(m[1]) * _UNITS[m[2]]


def time_of_day(ts: Column) -> Column:
    """Seconds since midnight."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def clock(hhmm: str) -> int:
    h, m = hhmm.split(":")[:2]
    return int(h) * 3600 + int(m) * 60


def bucket(ts: Column, freq: str) -> Column:
    """Start of the bucket that holds ``ts``."""
    n = seconds(freq)
    day = F.date_trunc("day", ts)
    if n % 86400 == 0:
        return day
    return day + F.make_dt_interval(secs=(F.floor(time_of_day(ts) / n) * n).cast("decimal(18,6)"))


def partition_key(ts: Column, freq: str) -> Column:
    """Storage partition: ISO Monday for second and minute bars, month for hours, year for days."""
    unit = re.sub(r"\d", "", freq)
    if unit in ("s", "min"):
        return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")
    return F.date_format(ts, "yyyy-MM") if unit == "h" else F.date_format(ts, "yyyy")


def key_range(key: Column, freq: str) -> tuple[Column, Column]:
    """First and last date of a storage partition."""
    unit = re.sub(r"\d", "", freq)
    if unit in ("s", "min"):
        first = F.to_date(key, "yyyy-MM-dd")
        return first, F.date_add(first, 6)
    if unit == "h":
        first = F.to_date(F.concat(key, F.lit("-01")), "yyyy-MM-dd")
        return first, F.last_day(first)
    return F.make_date(key.cast("int"), F.lit(1), F.lit(1)), F.make_date(key.cast("int"), F.lit(12), F.lit(31))


def covering_range(first: Column, last: Column, freq: str) -> tuple[Column, Column]:
    """First and last date of the partitions that hold the dates from ``first`` to ``last``."""
    return key_range(partition_key(first, freq), freq)[0], key_range(partition_key(last, freq), freq)[1]


def session(ts: Column) -> Column:
    """``pre`` before 09:30, ``regular`` before 16:00, ``post`` after."""
    t = time_of_day(ts)
    return F.when(t < clock("09:30"), "pre").when(t < clock("16:00"), "regular").otherwise("post")
