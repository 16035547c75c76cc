"""Time as integer milliseconds since the epoch, so that window bounds are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ms(timestamp: Column) -> Column:
    return F.unix_millis(timestamp.cast("timestamp"))


def to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def to_text(ms: Column) -> Column:
    """RFC 3339 UTC text with milliseconds and a ``Z``."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_ms(at_ms: Column, then_ms: Column) -> Column:
    """Never negative, and null without a time (``greatest`` alone would turn null into 0)."""
    return F.when(then_ms.isNotNull(), F.greatest(F.lit(0).cast("long"), at_ms - then_ms))


def seconds_after(ms: Column, seconds: int) -> Column:
    return ms + F.lit(seconds * 1000).cast("long")


def whole_seconds(ms: Column) -> Column:
    return F.floor(ms / 1000).cast("long")


def int_div(value: Column, divisor: int) -> Column:
    """Floor division of integers, exact for negative values too."""
    d = F.lit(divisor).cast("long")
    return ((value - F.pmod(value, d)) / d).cast("long")
