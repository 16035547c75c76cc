"""Condition progress, gaps and pass/fail states."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.decimals import RATIO
from tidewatch.functions.decimals import price_ratio as ratio

EPSILON = Decimal("0.000000000001")


def _num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(Decimal(str(value)))


def clamp(value: Column) -> Column:
    zero, one = F.lit(0).cast(RATIO), F.lit(1).cast(RATIO)
    return F.when(value.isNotNull(), F.least(one, F.greatest(zero, value)))


def progress_down(current: Column, neutral, target) -> Column:
    """Share of the way from neutral down to target; null when target is not below neutral."""
    neutral, target = _num(neutral), _num(target)
    return F.when(target < neutral, clamp(ratio(neutral - current, neutral - target)))


def progress_up(current: Column, neutral, target) -> Column:
    neutral, target = _num(neutral), _num(target)
    return F.when(target > neutral, clamp(ratio(current - neutral, target - neutral)))


def duration_progress(elapsed_seconds: Column, target_seconds) -> Column:
    target = _num(target_seconds)
    return F.when(
        (elapsed_seconds >= 0) & (target > 0),
        F.least(F.lit(1).cast(RATIO), ratio(elapsed_seconds, target)),
    )


def value_and_duration_progress(value_progress: Column, elapsed_seconds: Column, target_seconds) -> Column:
    duration = duration_progress(elapsed_seconds, target_seconds)
    return F.when(value_progress.isNotNull() & duration.isNotNull(), F.least(value_progress, duration))


def passes(operator: str, current: Column, target) -> Column:
    return current <= _num(target) if operator == "LTE" else current >= _num(target)


def progress_for(operator: str, current: Column, target) -> Column:
    """Clamped progress towards an inclusive bound."""
    target = _num(target)
    one, zero = F.lit(1).cast(RATIO), F.lit(0).cast(RATIO)
    reached = F.when(passes(operator, current, target), one)
    if operator == "LTE":
        return reached.when(target < 0, progress_down(current, 0, target)).when(current.isNotNull(), zero)
    distance = (target - current) / F.greatest(F.abs(target), F.lit(EPSILON))
    return reached.when(target > 0, progress_up(current, 0, target)).when(
        current.isNotNull(), clamp((F.lit(1) - distance).cast(RATIO))
    )


def gap_for(operator: str, current: Column, target) -> Column:
    target = _num(target)
    distance = current - target if operator == "LTE" else target - current
    return F.when(current.isNotNull(), F.greatest(F.lit(0).cast(RATIO), distance.cast(RATIO)))


def panel_progress(operator: str, current: Column, target) -> Column:
    """Panel variant: a value on the wrong side of zero has no progress until it passes."""
    target = _num(target)
    one, zero = F.lit(1).cast(RATIO), F.lit(0).cast(RATIO)
    reached = F.when(passes(operator, current, target), one)
    if operator == "LTE":
        return reached.when((target == 0) | (current >= 0), zero).when(
            current.isNotNull(), F.least(one, ratio(F.abs(current), F.abs(target)))
        )
    return reached.when((target == 0) | (current <= 0), zero).when(
        current.isNotNull(), F.greatest(zero, ratio(current, target))
    )


def directional_state(operator: str, current: Column, state: Column, fresh: Column, target) -> Column:
    """UNKNOWN unless KNOWN, STALE once expired, else PASS/FAIL with an inclusive bound."""
    return (
        F.when(state != "KNOWN", "UNKNOWN")
        .when(~fresh, "STALE")
        .when(passes(operator, current, target), "PASS")
        .otherwise("FAIL")
    )


def boolean_state(value: Column, veto: bool = False) -> Column:
    """A null value is UNKNOWN."""
    return (
        F.when(value.isNull(), "UNKNOWN")
        .when(value, "PASS")
        .otherwise("VETO" if veto else "FAIL")
    )


def composite_state(states: list[Column]) -> Column:
    """All children pass, else UNKNOWN if any child is UNKNOWN or STALE, else FAIL."""
    all_pass, any_unknown = F.lit(True), F.lit(False)
    for state in states:
        all_pass = all_pass & (state == "PASS")
        any_unknown = any_unknown | state.isin("UNKNOWN", "STALE")
    return F.when(all_pass, "PASS").when(any_unknown, "UNKNOWN").otherwise("FAIL")


def composite_progress(parts: list[Column]) -> Column:
    """Smallest child progress; unknown if any child is unknown."""
    complete = F.lit(True)
    for part in parts:
        complete = complete & part.isNotNull()
    return F.when(complete, F.least(*parts))


def passed_count(states: list[Column]) -> Column:
    total = F.lit(0)
    for state in states:
        total = total + F.when(state == "PASS", 1).otherwise(0)
    return total


def percent_text(value: Column) -> Column:
    """Percent with three decimals, a dash when missing."""
    return F.coalesce(F.format_string("%.3f%%", (value * 100).cast("double")), F.lit("—"))
