"""Session, soak and replay reports over journals."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import ReportRules
from tidewatch.functions.decimals import relative_change
from tidewatch.operators.ordered import contiguous_observed, first_hits, stage_changes
from tidewatch.operators.running import fixed_segments


def soak_progress(started_ms: Column, now_ms: Column, required_ms: int) -> tuple[Column, Column, Column]:
    """(elapsed, progress, status) of a run."""
    elapsed = F.when(started_ms.isNull(), 0).otherwise(F.greatest(F.lit(0), now_ms - started_ms)).cast("long")
    status = (
        F.when(started_ms.isNull(), "NOT_STARTED")
        .when(elapsed < required_ms, "IN_PROGRESS")
        .otherwise("ELAPSED_NOT_YET_REVIEWED")
    )
    return elapsed, F.least(F.lit(1.0), elapsed / F.lit(float(required_ms))), status


def shadow_report(journal: DataFrame, keys: Sequence[str], now: Column, rules: ReportRules, width_ms: int = 86_400_000) -> DataFrame:
    """Latest session, contiguous observation, signals and integrity per journal.

    ``journal``: keys, ``sequence``, ``kind``, ``recorded_ms``.  Everything is plain grouped
    aggregation; the latest session is the rows from the last RUNTIME_START on.
    """
    keys = list(keys)
    kind, seq, at = F.col("kind"), F.col("sequence"), F.col("recorded_ms")
    overall = journal.groupBy(*keys).agg(
        F.max(F.when(kind == "RUNTIME_START", F.struct(seq, at))).alias("__start"),
        F.max(F.struct(seq, at, kind)).alias("__last"),
        F.count_if(kind == "SHADOW_SELL_CREATED").alias("sell_signals"),
        F.count(F.lit(1)).alias("records"),
        F.max(seq).alias("latest_sequence"),
    )
    snapshots = journal.filter(kind == "SOURCE_SNAPSHOT")
    observed = contiguous_observed(
        snapshots, keys, "recorded_ms", rules.contiguous_gap_ms, fixed_segments(at, width_ms)
    ).select(*keys, "observed_ms")
    joined = overall.join(observed, keys, "left")
    started, last = F.col("__start.recorded_ms"), F.col("__last.recorded_ms")
    active = (
        started.isNotNull() & (F.col("__last.kind") != "RUNTIME_STOP") & (now - last <= rules.contiguous_gap_ms)
    )
    elapsed = F.when(
        started.isNull(), 0
    ).otherwise(F.greatest(F.lit(0), F.when(active, now).otherwise(last) - started)).cast("long")
    seen = F.coalesce("observed_ms", F.lit(0)).cast("long")
    return joined.select(
        *keys,
        F.when(started.isNull(), "NOT_STARTED").when(active, "IN_PROGRESS").otherwise("STOPPED_OR_STALE").alias("session_status"),
        started.alias("started_ms"),
        F.when(started.isNotNull(), last).alias("last_observed_ms"),
        elapsed.alias("elapsed_ms"),
        F.least(F.lit(1.0), elapsed / F.lit(float(rules.soak_ms))).alias("soak_progress"),
        (elapsed >= rules.soak_ms).alias("soak_met"),
        seen.alias("observed_ms"),
        F.least(F.lit(1.0), seen / F.lit(float(rules.shadow_ms))).alias("shadow_progress"),
        (seen >= rules.shadow_ms).alias("shadow_met"),
        "sell_signals",
        "records",
        "latest_sequence",
    )


def transitions(stages: DataFrame, keys: Sequence[str], at: str, width_ms: int) -> DataFrame:
    """Stage changes of a replay, with where they came from."""
    return stage_changes(stages, keys, [at], "stage", fixed_segments(F.col(at), width_ms))


def replay_milestones(evaluated: DataFrame) -> DataFrame:
    """First instant each model was ready."""
    return first_hits(
        evaluated.withColumn("run", F.lit("replay")), ["run"], "as_of_ms",
        {
            "first_sell_ready_ms": F.col("sell_stage") == "SELL_READY",
            "first_rebuy_ready_ms": F.col("rebuy_stage") == "REBUY_READY",
        },
    )


def open_interest_audit(series: DataFrame, baseline: Column, at: str, value: str, limit: Decimal) -> DataFrame:
    """Change of every row of one series against a frozen baseline."""
    change = relative_change(F.col(value), baseline)
    return series.select("*", change.alias("change"), (change <= F.lit(limit)).alias("limit_reached"))
