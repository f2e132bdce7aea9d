"""Timestamp arithmetic on TIMESTAMP_NTZ columns (sessions run in UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOUR_MICROS = 3_600_000_000


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros(ts) -> Column:
    return F.unix_micros(as_col(ts).cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value.cast("bigint")).cast("timestamp_ntz")


def hours_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(HOUR_MICROS))


def plus_hours(ts, hours) -> Column:
    step = hours if isinstance(hours, Column) else F.lit(hours)
    return from_micros(micros(ts) + (step * F.lit(HOUR_MICROS)).cast("bigint"))


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
