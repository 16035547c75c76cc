"""Staged SELL / REBUY decisions over feature snapshots, one row per snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import StagedRules
from tidewatch.functions.decimals import RATIO
from tidewatch.functions.hashing import stable_id
from tidewatch.functions.progress import (
    boolean_state,
    composite_progress,
    composite_state,
    passed_count,
    passes,
    progress_for,
)
from tidewatch.operators.features import (
    data_health,
    event_return,
    flow_zscore,
    max_drawdown,
    order_flow,
    required_drawdown,
    rolling_mad,
    volume_anomaly,
)
from tidewatch.operators.grid import Grid

EXECUTABLE = ("SHADOW_CANDIDATE", "ACTIONABLE_WITH_EVIDENCE")


def _directional(operator: str, value: Column, target) -> Column:
    """UNKNOWN for a missing value, else PASS/FAIL with an inclusive bound."""
    return F.when(value.isNull(), "UNKNOWN").when(passes(operator, value, target), "PASS").otherwise("FAIL")


def data_gate(health: Column, future_data: Column) -> Column:
    ok = (health == "PASS") & ~F.coalesce(future_data, F.lit(False))
    return boolean_state(F.when(health != "UNKNOWN", ok), veto=True)


def feature_snapshot(
    prices: DataFrame, trades: DataFrame, key: str, grid: Grid, references: Sequence[str], target: str,
    thresholds: dict[str, Decimal], volume_baseline: Column, rules: StagedRules, window_ms: int | None = None,
    sigma_lookback_ms: int | None = None, clock_drift_ms: Column | None = None, essential: Sequence[str] | None = None,
) -> DataFrame:
    """All features of every instant in one row, with a content-hash id.

    Per-asset features are joined once in long form and turned sideways by one grouping, so the
    number of shuffles does not grow with the number of features.
    """
    spark = prices.sparkSession
    assets = [*references, target]
    window = window_ms or rules.window_ms
    rows = grid.rows(spark, key, assets)
    returns = event_return(prices, rows, key, grid, window)
    falls = max_drawdown(prices, rows, key, grid, window)
    lookback = sigma_lookback_ms or rules.sigma_lookback_seconds * 1000
    sigma = rolling_mad(returns, key, grid, "ret", lookback, rules.mad_factor, rules.mad_minimum_samples)
    per_asset = returns.join(falls, [key, "as_of_ms"]).join(sigma.drop("samples"), [key, "as_of_ms"])
    columns = []
    for i, asset in enumerate(assets):
        mine = F.col(key) == asset
        for c in ("ret", "price", "max_drawdown", "sigma", "latest_received_ms"):
            columns.append(F.max(F.when(mine, F.col(c))).alias(f"{c}_{i}"))
    wide = per_asset.groupBy("as_of_ms").agg(*columns)
    n = len(references)
    complete, hits, total = F.lit(True), F.lit(0), F.lit(0).cast(RATIO)
    for i, asset in enumerate(references):
        r = F.col(f"ret_{i}")
        complete = complete & r.isNotNull()
        hits = hits + F.when(r <= F.lit(thresholds[asset]), 1).otherwise(0)
        total = total + F.coalesce(r, F.lit(0).cast(RATIO))
    known = sum((F.col(f"ret_{i}").isNotNull().cast("int") for i in range(n + 1)), F.lit(0))
    wide = wide.select(
        "*",
        F.when(complete, hits).cast("long").alias("shock_breadth"),
        F.when(complete, (F.col(f"ret_{n}") - (total / F.lit(n).cast("decimal(2,0)"))).cast(RATIO)).alias("excess_return"),
        (known / F.lit(float(n + 1))).alias("price_coverage"),
    )
    flow_rows = grid.rows(spark, key, [target])
    flow = order_flow(trades.filter(F.col(key) == target), flow_rows, key, grid, window)
    score = flow_zscore(flow, [key], grid, "net_flow", lookback, rules.zscore_minimum_samples)
    volume = volume_anomaly(prices.filter(F.col(key).isin(*references)), grid, window, volume_baseline)
    at = F.col("as_of_ms")
    ages = wide.select(
        "as_of_ms",
        F.explode(
            F.array(*[F.struct(F.lit(a).alias(key), (at - F.col(f"latest_received_ms_{i}")).alias("age_ms")) for i, a in enumerate(assets)])
        ).alias("a"),
    ).select(
        "as_of_ms", "a.*", (F.lit(None).cast("long") if clock_drift_ms is None else clock_drift_ms).alias("clock_drift_ms"),
        F.lit(False).alias("future_data"), F.lit(0).alias("gap_sources"),
    )
    health = data_health(
        ages, key, assets, essential or [references[0], references[-1], target],
        rules.price_freshness_seconds * 1000, rules.maximum_clock_drift_ms,
    ).select("as_of_ms", "health", "stale_sources")
    joined = (
        wide.join(flow.drop(key, "trades", "eligible"), "as_of_ms")
        .join(score.select("as_of_ms", "zscore"), "as_of_ms")
        .join(volume.select("as_of_ms", "volume_anomaly"), "as_of_ms")
        .join(health, "as_of_ms")
    )
    content = {c: F.col(c) for c in joined.columns if c != "stale_sources"}
    return joined.withColumn("snapshot_id", stable_id("feature", content))


def evaluate_sell(
    snapshots: DataFrame, fixed: Sequence[Decimal], arm_index: Sequence[int], mode: Column, economic: Column,
    rules: StagedRules,
) -> DataFrame:
    """Data gate, risk context, drawdown on the armed assets, flow with persistence, quotes.

    ``fixed`` are the fixed thresholds by asset index, ``arm_index`` the assets that must fall.
    Snapshots carry ``news_context`` (NEWS_ARMED, NO_NEWS, UNKNOWN), ``pressure_seconds`` (null when
    the timer is inactive) and ``executable`` (any chain passed the quote gate).
    """
    gate = data_gate(F.col("health"), F.col("future_data"))
    breadth, volume = F.col("shock_breadth"), F.col("volume_anomaly")
    arm_known = breadth.isNotNull() & volume.isNotNull()
    market_armed = F.coalesce(
        arm_known & (breadth >= rules.breadth_minimum) & (volume >= F.lit(rules.volume_anomaly_minimum)), F.lit(False)
    )
    news = F.col("news_context")
    risk = boolean_state(F.when(~((news == "UNKNOWN") & ~arm_known), (news == "NEWS_ARMED") | market_armed))
    falls, parts = [], []
    for i in arm_index:
        sigma = F.col(f"sigma_{i}").cast("decimal(20,8)")
        need = required_drawdown(F.lit(fixed[i]), sigma, F.lit(rules.volatility_multiplier)).cast("decimal(20,8)")
        value = F.when(sigma.isNotNull(), F.col(f"ret_{i}"))
        falls.append(_directional("LTE", value, need))
        parts.append(progress_for("LTE", value, need))
    flow = [
        _directional("LTE", F.col("buy_sell_ratio"), rules.sell_ratio_maximum),
        _directional("GTE", F.col("pressure_seconds"), rules.sell_persistence_seconds),
    ]
    states = snapshots.select(
        "*", gate.alias("data_gate"), risk.alias("risk_context"), composite_state(falls).alias("market_shock"),
        composite_progress(parts).alias("market_shock_progress"), composite_state(flow).alias("sell_flow"),
        boolean_state(F.col("executable")).alias("executability"),
    )
    stage = (
        F.when(F.col("data_gate") != "PASS", "DATA_BLOCKED")
        .when(F.col("risk_context") != "PASS", "SELL_IDLE")
        .when(F.col("market_shock") != "PASS", F.when(news == "NEWS_ARMED", "NEWS_ARMED").otherwise("MARKET_ARMED"))
        .when(F.col("sell_flow") != "PASS", "SELL_PRETRIGGER")
        .otherwise("SELL_CONFIRMED")
    )
    live = (mode == "LIVE_READ_ONLY") & (economic == "PASS")
    ready = F.col("stage").isin("SELL_PRETRIGGER", "SELL_CONFIRMED")
    tranche = F.when(F.col("stage") == "SELL_PRETRIGGER", "SELL_TRANCHE_1").otherwise("SELL_TRANCHE_2")
    action = (
        F.when(F.col("stage") == "DATA_BLOCKED", "BLOCKED")
        .when(ready & ~F.col("executable"), "BLOCKED")
        .when(ready, F.when(live, tranche).otherwise(F.concat(F.lit("SHADOW_"), tranche)))
        .when(F.col("stage") != "SELL_IDLE", "WATCH")
        .otherwise("NO_ACTION")
    )
    fraction = F.when(
        ready & F.col("executable"),
        F.when(F.col("stage") == "SELL_PRETRIGGER", F.lit(rules.first_sell_fraction)).otherwise(F.lit(rules.second_sell_fraction)),
    ).otherwise(F.lit(Decimal("0.00")))
    checks = [F.col(c) for c in ("risk_context", "market_shock", "sell_flow", "executability")]
    return states.withColumn("stage", stage).select(
        "*", passed_count(checks).cast("long").alias("passed"), F.lit(4).cast("long").alias("required"),
        action.alias("action"), fraction.alias("fraction"),
    )


def evaluate_rebuy(snapshots: DataFrame, stability: Sequence[tuple[int, Decimal]], mode: Column, economic: Column, rules: StagedRules) -> DataFrame:
    """No new low, open-interest flush, flow recovery, stability, damage veto and sell fact.

    ``stability``: (asset index, smallest return).  Snapshots carry ``seconds_since_low``,
    ``open_interest_change``, ``recovery_seconds``, ``stability_seconds``, ``permanent_damage``,
    ``has_sell_fact``, ``first_tranche_ms`` (or null) and ``executable``.
    """
    gate = data_gate(F.col("health"), F.col("future_data"))
    base = {
        "no_new_low": _directional("GTE", F.col("seconds_since_low"), rules.no_new_low_seconds),
        "open_interest_flush": _directional("LTE", F.col("open_interest_change"), rules.open_interest_decline),
        "flow_recovery": composite_state([
            _directional("GTE", F.col("buy_sell_ratio"), rules.rebuy_ratio_minimum),
            _directional("GTE", F.col("recovery_seconds"), rules.flow_persistence_seconds),
        ]),
        "market_stability": composite_state([
            *[_directional("GTE", F.col(f"ret_{i}"), limit) for i, limit in stability],
            _directional("GTE", F.col("stability_seconds"), rules.stability_seconds),
        ]),
    }
    states = snapshots.select(
        "*", gate.alias("data_gate"),
        boolean_state(F.col("permanent_damage") == "PASS", veto=True).alias("damage_gate"),
        *[c.alias(n) for n, c in base.items()],
        boolean_state(F.col("executable")).alias("executability"),
    )
    market = passed_count([F.col(n) for n in base])
    waited = (F.col("as_of_ms") - F.col("first_tranche_ms")) / 1000.0
    stage = (
        F.when(~F.col("has_sell_fact"), "REBUY_INACTIVE")
        .when(F.col("damage_gate") != "PASS", "REBUY_VETOED")
        .when(F.col("data_gate") != "PASS", "REBUY_WAIT")
        .when(market < 4, F.when(F.col("first_tranche_ms").isNull() & (market >= 3), "REBUY_ARMED").otherwise("REBUY_WAIT"))
        .when(~F.col("executable"), "REBUY_ARMED")
        .when(F.col("first_tranche_ms").isNull(), "REBUY_TRANCHE_1")
        .when(waited >= rules.second_tranche_seconds, "REBUY_COMPLETE")
        .otherwise("REBUY_TRANCHE_2_WAIT")
    )
    live = (mode == "LIVE_READ_ONLY") & (economic == "PASS")
    tranche = F.when(F.col("stage") == "REBUY_TRANCHE_1", "REBUY_TRANCHE_1").otherwise("REBUY_TRANCHE_2")
    trades = F.col("stage").isin("REBUY_TRANCHE_1", "REBUY_COMPLETE")
    action = (
        F.when(F.col("stage") == "REBUY_VETOED", "VETOED")
        .when(F.col("stage") == "REBUY_ARMED", "PREPARE_REBUY_QUOTE")
        .when(trades, F.when(live, tranche).otherwise(F.concat(F.lit("SHADOW_"), tranche)))
        .when(F.col("stage") != "REBUY_INACTIVE", "WATCH")
        .otherwise("NO_ACTION")
    )
    return states.withColumn("stage", stage).select(
        "*", (market + F.when(F.col("executability") == "PASS", 1).otherwise(0)).cast("long").alias("passed"),
        F.lit(5).cast("long").alias("required"), action.alias("action"),
        F.when(trades, F.lit(rules.rebuy_fraction)).otherwise(F.lit(Decimal("0.0"))).alias("fraction"),
    )
