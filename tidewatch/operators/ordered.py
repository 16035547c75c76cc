"""Streaks, running lows, stage runs, latches and sampling over ordered rows.

All take ``segment``: a column that does not decrease along the order, so that one key is
worked on by many tasks (see :mod:`tidewatch.operators.running`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.times import whole_seconds
from tidewatch.operators.running import SEGMENT, Measure, running
from tidewatch.session import checkpointed


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                  segment: Column | None) -> DataFrame:
    """Newest earlier non-null value per key, as new columns."""
    return running(
        df, keys, order, {n: Measure("last", v) for n, v in values.items()}, inclusive=False, segment=segment
    )


def persistence(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column,
                segment: Column | None, name: str = "held") -> DataFrame:
    """``<name>_since`` and whole ``<name>_seconds`` of the current streak of true.

    Anything but true (false, null) ends the streak; the first true instant counts 0 seconds.
    ``order[0]`` is the instant in milliseconds.
    """
    at = order[0]
    flagged = df.withColumn("__now", F.coalesce(condition, F.lit(False)))
    before = with_previous(flagged, keys, order, {"__before": F.col("__now")}, segment)
    starts = F.col("__now") & ~F.coalesce(F.col("__before"), F.lit(False))
    held = running(
        before, keys, order, {"__start": Measure("max", F.when(starts, F.col(at)))}, segment=segment
    )
    since = F.when(F.col("__now"), F.col("__start"))
    return held.select(
        *df.columns,
        since.alias(f"{name}_since"),
        whole_seconds(F.col(at) - since).alias(f"{name}_seconds"),
    )


def running_low(df: DataFrame, keys: Sequence[str], order: Sequence[str], price: Column, segment: Column | None,
                started_ms: Column | None = None) -> DataFrame:
    """Lowest price so far, when it was first reached, and whole seconds since.

    Rows before ``started_ms`` do not count.  An equal price does not reset the clock.
    """
    at = order[0]
    usable = price if started_ms is None else F.when(F.col(at) >= started_ms, price)
    found = running(
        df, keys, order,
        {"__low": Measure("min", F.when(usable.isNotNull(), F.struct(usable.alias("price"), F.col(at).alias("ms"))))},
        segment=segment,
    )
    return found.select(
        *df.columns,
        F.col("__low.price").alias("low"),
        F.col("__low.ms").alias("low_ms"),
        whole_seconds(F.col(at) - F.col("__low.ms")).alias("seconds_since_low"),
    )


def shared_low_clock(lows: DataFrame, at: str) -> DataFrame:
    """Seconds since any asset last made a new low, per instant."""
    shared = lows.groupBy(at).agg(F.max("low_ms").alias("last_low_ms"))
    return shared.withColumn(
        "no_new_low_seconds", F.coalesce(whole_seconds(F.col(at) - F.col("last_low_ms")), F.lit(0).cast("long"))
    )


def stage_changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], stage: str, segment: Column | None) -> DataFrame:
    """Rows whose stage differs from the row before (the first row changes from null)."""
    return with_previous(df, keys, order, {"from_stage": F.col(stage)}, segment).filter(
        F.col("from_stage").isNull() | (F.col("from_stage") != F.col(stage))
    )


def stage_entered(df: DataFrame, keys: Sequence[str], order: Sequence[str], stage: str, segment: Column | None) -> DataFrame:
    """First instant (``order[0]``) of the current run of equal stages."""
    at = order[0]
    before = with_previous(df, keys, order, {"__from": F.col(stage)}, segment)
    enters = F.col("__from").isNull() | (F.col("__from") != F.col(stage))
    found = running(
        before, keys, order, {"__entered": Measure("last", F.when(enters, F.col(at)))}, segment=segment
    )
    return found.select(*df.columns, F.col("__entered").alias("stage_entered"))


def first_hits(df: DataFrame, keys: Sequence[str], at: str, conditions: dict[str, Column]) -> DataFrame:
    """Earliest instant each condition holds."""
    return df.groupBy(*keys).agg(*[F.min(F.when(c, F.col(at))).alias(n) for n, c in conditions.items()])


def latched_context(df: DataFrame, keys: Sequence[str], order: Sequence[str], ready: Column, segment: Column | None,
                    recorded: Column | None = None) -> DataFrame:
    """Context that stays set from the first ready instant, or from the latest user-recorded one.

    ``recorded`` marks rows at which a user recorded the fact; a later record replaces an earlier one.
    """
    at = order[0]
    measures = {"__first_ready": Measure("min", F.when(ready, F.col(at)))}
    if recorded is not None:
        measures["__recorded"] = Measure("max", F.when(recorded, F.col(at)))
    found = running(df, keys, order, measures, segment=segment)
    by_user = F.col("__recorded") if recorded is not None else F.lit(None).cast("long")
    return found.select(
        *df.columns,
        F.when(by_user.isNotNull(), "USER_RECORDED")
        .when(F.col("__first_ready").isNotNull(), "SHADOW_REFERENCE")
        .otherwise("NONE")
        .alias("context"),
        F.coalesce(by_user, F.col("__first_ready")).alias("context_ms"),
    )


def contiguous_observed(samples: DataFrame, keys: Sequence[str], at: str, limit_ms: int, segment: Column | None) -> DataFrame:
    """Sum of the gaps between neighbouring samples that are at most ``limit_ms``."""
    gaps = with_previous(samples, keys, [at], {"__previous": F.col(at)}, segment)
    gap = F.col(at) - F.col("__previous")
    return gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.sum(F.when(gap.between(0, limit_ms), gap)), F.lit(0)).alias("observed_ms"),
    )


def sample_grid(df: DataFrame, at: str, start_ms: int, every_ms: int) -> DataFrame:
    """On a regular grid: keep the instants that are a multiple of ``every_ms`` apart."""
    return df.filter(F.pmod(F.col(at) - F.lit(start_ms), F.lit(every_ms)) == 0)


def _lead(bounds: np.ndarray, exits: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Last kept instant after a span, for last kept instants before it."""
    if not len(bounds):
        return kept
    hit = np.searchsorted(bounds, kept)
    return np.where(hit < len(bounds), exits[np.minimum(hit, len(exits) - 1)], kept)


def _shortest(bounds: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step for each different exit: the last bound that leads there."""
    last = np.append(exits[1:] != exits[:-1], True)
    return bounds[last], exits[last]


def sample_every(df: DataFrame, run: str, at: str, every_ms: int, segment_ms: int = 3_600_000,
                 fan_in: int = 64) -> DataFrame:
    """On irregular instants: keep one when at least ``every_ms`` passed since the last kept.

    The choice is sequential, yet no task holds a run.  A time segment is a step function from the instant kept
    last before it to the instant kept last in it: at most ``every_ms + 1`` steps, and mostly a few, since choices
    that begin apart soon meet.  ``fan_in`` neighbouring functions are composed into one of the same kind, level by
    level, until one covers the run; the way down tells every segment what was kept before it, and each segment then
    replays its one true choice.  A task sees ``fan_in`` functions or the instants of one segment.

    All rows of a kept instant stay.  Rows without a run or an instant are in no run and go.
    """
    if segment_ms < every_ms:
        raise ValueError("a segment must be at least as long as the sampling distance")
    run_type = df.schema[run].dataType.simpleString()
    nothing = -(2**62)
    instants = (
        df.select(F.col(run).alias("run"), F.col(at).cast("long").alias("at")).dropna().distinct()
        .withColumn("node", F.floor(F.col("at") / segment_ms).cast("long"))
    )
    function = f"run {run_type}, node long, bounds array<long>, exits array<long>"

    def of_segment(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["at"].to_numpy())
        follows = np.searchsorted(times, times + every_ms)
        end = np.where(follows < len(times), follows, np.arange(len(times)))
        while not np.array_equal(end, further := end[end]):
            end = further
        # the first choice of a segment is below its first instant plus the distance, or the one after that
        entries = np.arange(np.searchsorted(times, times[0] + every_ms) + 1).clip(max=len(times) - 1)
        bounds, exits = _shortest(times[entries] - every_ms, times[end[entries]])
        return pd.DataFrame({"run": [pdf["run"].iloc[0]], "node": [pdf["node"].iloc[0]], "bounds": [bounds], "exits": [exits]})

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        bounds = exits = np.empty(0, np.int64)
        for b, e in pdf.sort_values("node")[["bounds", "exits"]].itertuples(index=False):
            b, e = np.asarray(b, np.int64), np.asarray(e, np.int64)
            beyond = b[b > bounds[-1]] if len(bounds) else b
            points = np.concatenate([bounds, beyond])
            bounds, exits = _shortest(points, _lead(b, e, _lead(bounds, exits, points)))
        return pd.DataFrame({"run": [pdf["run"].iloc[0]], "node": [pdf["above"].iloc[0]], "bounds": [bounds], "exits": [exits]})

    def handed_down(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("node")
        kept, before = np.array([ordered["kept"].iloc[0]]), []
        for b, e in ordered[["bounds", "exits"]].itertuples(index=False):
            before.append(int(kept[0]))
            kept = _lead(np.asarray(b, np.int64), np.asarray(e, np.int64), kept)
        return pd.DataFrame({"run": ordered["run"], "node": ordered["node"], "kept": before})

    def replayed(pdf: pd.DataFrame) -> pd.DataFrame:
        times, last, out = np.sort(pdf["at"].to_numpy()), int(pdf["kept"].iloc[0]), []
        while (nxt := np.searchsorted(times, last + every_ms)) < len(times):
            last = int(times[nxt])
            out.append(last)
        return pd.DataFrame({"run": pdf["run"].iloc[0], "at": out})

    levels = [checkpointed(instants.groupBy("run", "node").applyInPandas(of_segment, function))]
    low, high = levels[0].agg(F.min("node"), F.max("node")).first()
    if low is None:
        return df.limit(0)

    def above(level: int) -> Column:
        """Number of a node in the next level; the first level counts from the earliest segment."""
        return F.floor((F.col("node") - F.lit(low if level == 0 else 0)) / fan_in).cast("long").alias("above")

    width = high - low + 1
    while width > fan_in:
        grouped = levels[-1].select("*", above(len(levels) - 1)).groupBy("run", "above")
        levels.append(checkpointed(grouped.applyInPandas(composed, function)))
        width = -(-width // fan_in)
    known = levels[-1].select("run", F.lit(0).cast("long").alias("above")).distinct().withColumn("kept", F.lit(nothing).cast("long"))
    for level in reversed(range(len(levels))):
        children = levels[level].select("*", above(level)).join(known, ["run", "above"])
        told = children.groupBy("run", "above").applyInPandas(handed_down, f"run {run_type}, node long, kept long")
        known = told.select("run", F.col("node").alias("above"), "kept")
    marked = instants.join(known.withColumnRenamed("above", "node"), ["run", "node"])
    kept = marked.groupBy("run", "node").applyInPandas(replayed, f"run {run_type}, at long")
    return df.join(kept.select(F.col("run").alias(run), F.col("at").alias(at)), [run, at], "left_semi")


def timeline(events: DataFrame, run: str, event_id: str, at: str, size: int) -> DataFrame:
    """Newest ``size`` distinct events per run, newest first.

    The first record of an id counts.  ``row_number <= size`` is pruned before the shuffle.
    """
    distinct = events.groupBy(run, event_id).agg(F.min_by(F.struct(*[c for c in events.columns if c not in (run, event_id)]), at).alias("e"))
    ranked = distinct.withColumn(
        "position",
        F.row_number().over(Window.partitionBy(run).orderBy(F.col(f"e.{at}").desc(), F.col(event_id).desc())),
    )
    return ranked.filter(F.col("position") <= size).select(run, event_id, "e.*", "position")


def sequence_audit(journal: DataFrame, keys: Sequence[str], sequence: str, record_id: str, payload_hash: str,
                   payload: str, event_ms: str, observed_ms: str, width: int = 1_000_000) -> DataFrame:
    """Violations of an append-only journal, one row per record and rule.

    Sequence equals the record position (so numbers are contiguous from 1), ids are unique,
    the payload hash matches, and the event is not later than its observation.
    """
    keys = list(keys)
    segment = F.floor(F.col(sequence) / width).cast("long")
    counted = running(
        journal, keys, [sequence, record_id], {"position": Measure("sum", F.lit(1).cast("long"))}, segment=segment
    )
    copies = journal.groupBy(*keys, record_id).agg(F.count(F.lit(1)).alias("copies"))
    repeated = copies.filter("copies > 1")
    checked = counted.join(repeated, [*keys, record_id], "left")
    rules = F.array_compact(
        F.array(
            F.when(F.col(sequence) != F.col("position"), "SEQUENCE_GAP"),
            F.when(F.col("copies").isNotNull(), "DUPLICATE_ID"),
            F.when(F.concat(F.lit("sha256:"), F.sha2(payload, 256)) != F.col(payload_hash), "HASH_MISMATCH"),
            F.when(F.col(event_ms) > F.col(observed_ms), "EVENT_AFTER_OBSERVATION"),
        )
    )
    return checked.select(*keys, sequence, record_id, F.explode(rules).alias("violation"))


__all__ = [
    "SEGMENT", "contiguous_observed", "first_hits", "latched_context", "persistence", "running_low",
    "sample_every", "sample_grid", "sequence_audit", "shared_low_clock", "stage_changes",
    "stage_entered", "timeline", "with_previous",
]
