"""Lookups at irregular instants, frozen baselines and policy joins."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.decimals import AMOUNT, TOTAL, notional, ratio, relative_change
from tidewatch.functions.knowledge import state_of
from tidewatch.operators.grid import stabbing_max
from tidewatch.operators.running import Measure, running, with_segments


def asof_join(
    probes: DataFrame, series: DataFrame, keys: Sequence[str], at: str, series_ms: str, fields: Sequence[str],
    name: str = "found", segments: int | None = None, by_time: bool = True,
) -> DataFrame:
    """For each probe the newest series row of its key at or before ``at`` (an exact hit counts).

    Both sides are reduced to one row per key and millisecond, put in one order and scanned in
    segments, so neither a hot key nor repeated probes gather in one task.  ``fields`` order
    rows of equal time; with ``by_time=False`` they alone decide which of the rows seen so far wins.
    """
    keys = list(keys)
    held = F.struct(F.col(series_ms), *fields) if by_time else F.struct(*fields)
    latest = series.groupBy(*keys, F.col(series_ms).alias("__ms")).agg(F.max(held).alias("__row"))
    wanted = probes.select(*keys, F.col(at).alias("__ms")).distinct()
    merged = latest.withColumn("__probe", F.lit(0)).unionByName(
        wanted.withColumn("__probe", F.lit(1)), allowMissingColumns=True
    )
    sample = series.select(F.col(series_ms).alias("__ms"))
    scanned = running(
        with_segments(merged, "__ms", segments, sample), keys, ["__ms", "__probe"],
        {name: Measure("max", F.col("__row"))},
    )
    answers = scanned.filter("__probe = 1").select(*keys, F.col("__ms").alias(at), name)
    return probes.join(answers, [*keys, at], "left")


def flow_at(
    probes: DataFrame, trades: DataFrame, keys: Sequence[str], at: str, trade_ms: str, window_ms: int,
    segments: int | None = None,
) -> DataFrame:
    """Buy, sell and record sums in ``[t - window, t]`` at chosen instants.

    Amounts are UNKNOWN (null), not zero, when no trade of the window has a known quantity and side.
    The window sum is the running sum at *t* minus the running sum just before the window, so
    each trade is read once whatever the number and overlap of the probes.
    """
    keys = list(keys)
    value = notional(F.col("price"), F.col("quantity"))
    per_ms = trades.groupBy(*keys, F.col(trade_ms).alias("__ms")).agg(
        F.sum(F.when(F.col("side") == "BUY", value)).alias("buy"),
        F.sum(F.when(F.col("side") == "SELL", value)).alias("sell"),
        F.count_if(F.col("quantity").isNotNull() & F.col("side").isin("BUY", "SELL")).alias("eligible"),
        F.count(F.lit(1)).alias("n"),
    )
    sums = ("buy", "sell", "eligible", "n")
    instants = probes.select(*keys, at).distinct()
    edges = instants.select(
        *keys, at,
        F.explode(
            F.array(
                F.struct(F.col(at).alias("ms"), F.lit(1).alias("sign")),
                F.struct((F.col(at) - window_ms - 1).alias("ms"), F.lit(-1).alias("sign")),
            )
        ).alias("e"),
    ).select(*keys, at, F.col("e.ms").alias("__ms"), F.col("e.sign").alias("__sign"))
    merged = per_ms.withColumn("__order", F.lit(0)).unionByName(
        edges.withColumn("__order", F.lit(1)), allowMissingColumns=True
    )
    sample = trades.select(F.col(trade_ms).alias("__ms"))
    scanned = running(
        with_segments(merged, "__ms", segments, sample), keys, ["__ms", "__order"],
        {f"__{c}": Measure("sum", F.col(c)) for c in sums},
    )
    zero = F.lit(0).cast(AMOUNT)
    summed = (
        scanned.filter("__order = 1")
        .groupBy(*keys, at)
        .agg(
            *[
                F.sum(F.coalesce(F.col(f"__{c}"), F.lit(0)) * F.col("__sign")).alias(f"__{c}")
                for c in sums
            ]
        )
        .select(
            *keys, at,
            F.when(F.col("__eligible") > 0, F.col("__buy").cast(TOTAL)).alias("buy_notional"),
            F.when(F.col("__eligible") > 0, F.col("__sell").cast(TOTAL)).alias("sell_notional"),
            F.col("__n").cast("long").alias("records"),
        )
        .withColumn(
            "buy_sell_ratio",
            F.when(F.col("sell_notional") != zero, ratio(F.col("buy_notional"), F.col("sell_notional"))),
        )
    )
    return probes.join(summed, [*keys, at], "left")


def return_at(
    probes: DataFrame, closes: DataFrame, keys: Sequence[str], at: str, close_ms: str, price: str, window_ms: int,
    segments: int | None = None,
) -> DataFrame:
    """Return from ``t - window`` to ``t`` with exact-or-previous closes."""
    now = asof_join(probes, closes, keys, at, close_ms, [price], "__now", segments)
    shifted = probes.select(*keys, at).distinct().withColumn("__earlier", F.col(at) - window_ms)
    before = asof_join(shifted, closes, keys, "__earlier", close_ms, [price], "__before", segments)
    joined = now.join(before.select(*keys, at, "__before"), [*keys, at], "left")
    value = relative_change(F.col(f"__now.{price}"), F.col(f"__before.{price}"))
    return joined.select(
        *probes.columns, F.col(f"__now.{price}").alias("close"), value.alias("ret"), state_of(value).alias("ret_state")
    )


def freeze_baseline(
    events: DataFrame, series: DataFrame, keys: Sequence[str], armed_ms: str, tolerance_ms: int,
    value: str = "value", row_id: str = "id", segments: int | None = None,
) -> DataFrame:
    """Newest KNOWN series row observed within the tolerance before arming and received by then.

    ``series``: keys, ``observed_ms``, ``received_ms``, value (null when not KNOWN), id.  A row is seen
    from the later of its two times.  The newest observation seen so far is the only candidate:
    if it is too old, so are all others.
    """
    eligible = series.filter(F.col(value).isNotNull()).select(
        *keys, "observed_ms", F.col(row_id).alias("id"), F.col(value).alias("value"),
        F.greatest("observed_ms", "received_ms").alias("__seen"),
    )
    found = asof_join(
        events, eligible, keys, armed_ms, "__seen", ["observed_ms", "id", "value"], "__base", segments, by_time=False
    )
    base = F.when(F.col(armed_ms) - F.col("__base.observed_ms") <= tolerance_ms, F.col("__base"))
    return found.withColumn("__base", base).select(
        *events.columns,
        F.col("__base.value").alias("baseline"),
        F.col("__base.observed_ms").alias("baseline_ms"),
        F.col("__base.id").alias("baseline_id"),
        state_of(F.col("__base.value")).alias("baseline_state"),
    )


def series_changes(series: DataFrame, baselines: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Change of every series row against the one frozen baseline of its key."""
    joined = series.join(baselines.select(*keys, "baseline"), list(keys), "left")
    return joined.withColumn("change", F.when(F.col("baseline") > 0, relative_change(F.col(value), F.col("baseline"))))


def baseline_changes(
    events: DataFrame, series: DataFrame, keys: Sequence[str], armed_ms: str, at_ms: str, value: str,
    limit: Decimal,
) -> DataFrame:
    """Per event: smallest change of its series against its baseline, when, and whether it
    ever reached the limit.

    For a positive baseline the smallest change is at the smallest value, so the series is
    reduced to one row per key before it meets the events.
    """
    lowest = series.groupBy(*keys).agg(F.min(F.struct(F.col(value), F.col(at_ms))).alias("__low"))
    joined = events.select(*keys, armed_ms, "baseline").join(lowest, list(keys), "left")
    change = F.when(F.col("baseline") > 0, relative_change(F.col(f"__low.{value}"), F.col("baseline")))
    return joined.select(
        *keys, armed_ms,
        change.alias("minimum_change"),
        F.when(change.isNotNull(), F.col(f"__low.{at_ms}")).alias("minimum_ms"),
        F.coalesce(change <= F.lit(limit), F.lit(False)).alias("limit_reached"),
    )


def event_low(trades: DataFrame, keys: Sequence[str], at: str, price: str, start: Column, end: Column) -> DataFrame:
    """Lowest price and its first time inside ``[start, end]``."""
    return (
        trades.filter(F.col(at).between(start, end))
        .groupBy(*keys)
        .agg(F.min(F.struct(F.col(price), F.col(at))).alias("__low"))
        .select(*keys, F.col(f"__low.{price}").alias("low"), F.col(f"__low.{at}").alias("low_ms"))
    )


def policy_lookup(df: DataFrame, policy: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Policy columns by key, UNKNOWN where the policy has none.

    Left unhinted on purpose: Spark broadcasts the policy when its measured size is small.
    """
    joined = df.join(policy.select(key, *columns), key, "left")
    return joined.select(*df.columns, *[F.coalesce(c, F.lit("UNKNOWN")).alias(c) for c in columns])


def without_relays(df: DataFrame, relays: DataFrame, source: str) -> DataFrame:
    return df.join(relays.select(source), source, "left_anti")


def with_thresholds(df: DataFrame, key: str, thresholds: dict[str, Decimal], name: str = "threshold") -> DataFrame:
    """Per-asset threshold from the configuration (a fixed short list, so a CASE, not a join)."""
    chain = None
    for asset, limit in thresholds.items():
        hit = F.col(key) == asset
        chain = F.when(hit, F.lit(limit)) if chain is None else chain.when(hit, F.lit(limit))
    return df.withColumn(name, chain.cast("decimal(20,8)"))


def latest_qualifying(
    grid_rows: DataFrame, items: DataFrame, qualifies: Column, occurred_ms: str, received_ms: str, item_id: str,
    window_ms: int, step_ms: int, start_ms: int, fields: Sequence[str] = (),
) -> DataFrame:
    """Newest received item that passes the news gate at each grid instant.

    The time-free part of the gate filters first.  The rest is an interval of instants per
    item: from the later of its two times until the earlier plus the window, in grid steps.
    """
    def point(ms: Column) -> Column:
        return F.floor((ms - F.lit(start_ms)) / step_ms).cast("long")

    low = point(F.greatest(F.col(occurred_ms), F.col(received_ms)) + F.lit(step_ms - 1))
    high = point(F.least(F.col(occurred_ms), F.col(received_ms)) + F.lit(window_ms))
    held = F.struct(F.col(received_ms).alias("received_ms"), F.col(item_id).alias("item_id"), *fields)
    candidates = items.filter(qualifies & F.col(occurred_ms).isNotNull())
    rows = grid_rows.withColumn("__point", point(F.col("as_of_ms")))
    found = stabbing_max(rows, candidates, [], "__point", low, high, held, window_ms // step_ms + 1, "item")
    return found.drop("__point")


def orphans(ledger: DataFrame, event_id: str, parent_id: str, sequence: str) -> DataFrame:
    """Rows whose parent does not exist earlier in the ledger."""
    # one row per id (its first position): equality join first, then a check, never all pairs
    first = ledger.groupBy(F.col(event_id).alias(parent_id)).agg(F.min(sequence).alias("__first"))
    children = ledger.filter(F.col(parent_id).isNotNull())
    return (
        children.join(first, parent_id, "left")
        .filter(F.col("__first").isNull() | (F.col("__first") >= F.col(sequence)))
        .select(*ledger.columns)
    )


def illegal_transitions(
    changes: DataFrame, allowed: Sequence[tuple[str, str, str]], model: str = "model", source: str = "from_stage",
    target: str = "to_stage",
) -> DataFrame:
    """Stage changes missing from the allow-list; ``*`` allows any source, staying is legal.

    With ``to_model`` or version columns present, a change across them is illegal as well.
    """
    pairs = [f"{m}|{a}|{b}" for m, a, b in allowed]
    direct = F.concat_ws("|", model, source, target).isin(pairs)
    wildcard = F.concat_ws("|", F.col(model), F.lit("*"), F.col(target)).isin(pairs)
    crosses = F.lit(False)
    for left, right in ((model, "to_model"), ("from_version", "to_version")):
        if left in changes.columns and right in changes.columns:
            crosses = crosses | (F.col(left) != F.col(right))
    return changes.withColumn(
        "violation",
        F.when(crosses, "CROSS_MODEL_OR_VERSION").when(
            (F.col(source) != F.col(target)) & ~direct & ~wildcard, "UNDEFINED_TRANSITION"
        ),
    ).filter(F.col("violation").isNotNull())


def counterfactual_baseline(
    events: DataFrame, series: DataFrame, keys: Sequence[str], armed_ms: str, later_ms: str, tolerance_ms: int
) -> DataFrame:
    """Legal baseline at arming next to the one a later cut-off would have picked.

    A difference shows what reading ahead would have changed.
    """
    legal = freeze_baseline(events, series, keys, armed_ms, tolerance_ms)
    late = freeze_baseline(
        events.select(*keys, armed_ms, later_ms).distinct(), series, keys, later_ms, tolerance_ms
    ).select(
        *keys, armed_ms, later_ms,
        F.col("baseline").alias("illegal_baseline"), F.col("baseline_ms").alias("illegal_baseline_ms"),
    )
    return legal.join(late, [*keys, armed_ms, later_ms], "left").withColumn(
        "differs", ~F.col("baseline_ms").eqNullSafe(F.col("illegal_baseline_ms"))
    )
