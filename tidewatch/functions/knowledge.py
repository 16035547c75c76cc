"""Four-way knowledge: KNOWN, UNKNOWN, UNSUPPORTED, ERROR; STALE is judged at an instant.

Inside operators a feature travels as ``x`` and ``x_state`` columns.  The struct form is
for the edges, where one column has to carry value, state, reason and times together.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KNOWN, UNKNOWN, UNSUPPORTED, ERROR = "KNOWN", "UNKNOWN", "UNSUPPORTED", "ERROR"


def _knowledge(
    state: Column,
    value: Column,
    observed_ms: Column,
    expires_ms: Column,
    reason: Column,
    since_ms: Column,
    retryable: Column,
    evidence: Column,
) -> Column:
    return F.struct(
        state.alias("state"),
        value.alias("value"),
        observed_ms.cast("long").alias("observed_ms"),
        expires_ms.cast("long").alias("expires_ms"),
        reason.cast("string").alias("reason"),
        since_ms.cast("long").alias("since_ms"),
        retryable.cast("boolean").alias("retryable"),
        evidence.cast("array<string>").alias("evidence_ids"),
    )


def known(value: Column, observed_ms: Column, evidence: Column | None = None,
          expires_ms: Column | None = None) -> Column:
    none = F.lit(None)
    return _knowledge(F.lit(KNOWN), value, observed_ms, none if expires_ms is None else expires_ms,
                      none, none, none, F.array() if evidence is None else evidence)


def unknown(reason: Column, since_ms: Column, value_type: str = "decimal(38,18)") -> Column:
    none = F.lit(None)
    return _knowledge(F.lit(UNKNOWN), none.cast(value_type), none, none, reason, since_ms, none, none)


def unsupported(reason: Column, value_type: str = "decimal(38,18)") -> Column:
    none = F.lit(None)
    return _knowledge(F.lit(UNSUPPORTED), none.cast(value_type), none, none, reason, none, none, none)


def error(reason: Column, observed_ms: Column, retryable: Column,
          value_type: str = "decimal(38,18)") -> Column:
    none = F.lit(None)
    return _knowledge(F.lit(ERROR), none.cast(value_type), observed_ms, none, reason, none, retryable, none)


def from_nullable(value: Column, reason: Column, at_ms: Column) -> Column:
    """KNOWN where the value exists, UNKNOWN with a reason where it does not."""
    return _knowledge(
        F.when(value.isNotNull(), KNOWN).otherwise(UNKNOWN),
        value,
        F.when(value.isNotNull(), at_ms),
        F.lit(None),
        F.when(value.isNull(), reason),
        F.when(value.isNull(), at_ms),
        F.lit(None),
        F.when(value.isNotNull(), F.array().cast("array<string>")),
    )


def state_of(value: Column) -> Column:
    return F.when(value.isNotNull(), KNOWN).otherwise(UNKNOWN)


def is_fresh(state: Column, expires_ms: Column, at_ms: Column) -> Column:
    """KNOWN and either without expiry or not yet expired at the instant."""
    return (state == KNOWN) & (expires_ms.isNull() | (expires_ms >= at_ms))


def freshness(received_ms: Column, at_ms: Column, limit_ms: int) -> Column:
    """UNKNOWN without data, FRESH up to and including the limit, STALE beyond it."""
    return (
        F.when(received_ms.isNull(), UNKNOWN)
        .when(at_ms - received_ms <= limit_ms, "FRESH")
        .otherwise("STALE")
    )
