"""Exact decimal expressions.

Inputs are held as ``decimal(20,8)``; a quotient of two such values is ``decimal(38,18)``.
Wider operands lose scale (``decimal(38,8)/decimal(38,8)`` is ``decimal(38,6)``), so
:func:`ratio` narrows its operands first and keeps the wide quotient for those that do not fit.
Sums over many amounts are ``decimal(38,8)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(20,8)"
RATIO = "decimal(38,18)"
TOTAL = "decimal(38,8)"
# Fixed value: canonical decimal text.
CANONICAL_PATTERN = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]*[1-9])?$"


def amount(value: Column) -> Column:
    return value.cast(AMOUNT)


def is_canonical(text: Column) -> Column:
    return text.rlike(CANONICAL_PATTERN) & (text != "-0")


def canonical(value: Column) -> Column:
    """Plain decimal text: no exponent, no trailing zeros, never ``-0``."""
    text = F.regexp_replace(value.cast("string"), r"(\.[0-9]*[1-9])0+$|\.0+$", "$1")
    return F.when(value == 0, F.lit("0")).otherwise(text)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Exact quotient at 18 decimals, at 6 where an operand has 13 or more digits before the point.

    Null (UNKNOWN) for a zero or missing denominator.
    """
    narrow = F.try_divide(numerator.try_cast(AMOUNT), denominator.try_cast(AMOUNT)).cast(RATIO)
    wide = F.try_divide(numerator.try_cast(TOTAL), denominator.try_cast(TOTAL)).try_cast(RATIO)
    return F.coalesce(narrow, wide)


def price_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient of two prices kept at 12 decimals; 14 decimals in the result."""
    return F.try_divide(numerator.try_cast("decimal(24,12)"), denominator.try_cast("decimal(24,12)")).cast(RATIO)


def relative_change(current: Column, baseline: Column) -> Column:
    return ratio(current - baseline, baseline)


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(left > right, 1).when(left < right, -1).when(left == right, 0)


def is_positive(value: Column) -> Column:
    return value > 0


def notional(price: Column, quantity: Column) -> Column:
    return (price * quantity).cast(AMOUNT)


def mid_price(bid: Column, ask: Column) -> Column:
    return ((bid + ask) / F.lit(2).cast("decimal(1,0)")).cast(AMOUNT)


def taker_side(buyer_is_maker: Column) -> Column:
    return F.when(buyer_is_maker, "SELL").otherwise("BUY")


def round_down(value: Column, places: int) -> Column:
    """Towards minus infinity at ``places`` decimals (amounts are never negative)."""
    return F.floor(value, F.lit(places))
