"""SELL and REBUY panels at every instant of the grid, all instants at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import PanelRules
from tidewatch.functions.decimals import RATIO
from tidewatch.functions.progress import gap_for, panel_progress, passes
from tidewatch.functions.times import whole_seconds
from tidewatch.operators.features import asset_state, order_flow_received
from tidewatch.operators.grid import Grid
from tidewatch.operators.lookups import latest_qualifying
from tidewatch.operators.news import timeless_gate
from tidewatch.operators.ordered import latched_context, running_low
from tidewatch.operators.running import Measure, running
from tidewatch.session import checkpointed

SELL_CONDITIONS = ("S1", "S2", "S3", "S4")
REBUY_CONDITIONS = ("B1", "B2", "B3", "B4")


def grid_timers(df: DataFrame, keys: Sequence[str], grid: Grid, conditions: dict[str, Column]) -> DataFrame:
    """Whole seconds each condition has been true without a break, 0 when it is not.

    On a regular grid a streak starts one step after the last instant that was not true, so
    one running maximum per timer is enough and all timers share one pass.
    """
    at = F.col("as_of_ms")
    measures = {
        f"__broken_{n}": Measure("max", F.when(~F.coalesce(c, F.lit(False)), at)) for n, c in conditions.items()
    }
    found = running(df, keys, ["as_of_ms"], measures, segment=grid.segment())
    columns = []
    for name in conditions:
        broken = F.col(f"__broken_{name}")
        since = F.coalesce(broken + F.lit(grid.step_ms), F.lit(grid.start_ms))
        columns.append(F.when(broken == at, F.lit(0)).otherwise(whole_seconds(at - since)).cast("long").alias(name))
    return found.select(*df.columns, *columns)


def market_frame(
    quotes: DataFrame, trades: DataFrame, gaps: DataFrame | None, key: str, grid: Grid,
    references: Sequence[str], target: str, rules: PanelRules,
) -> DataFrame:
    """One row per instant: asset states side by side, flow of the target, shared low clock."""
    spark = quotes.sparkSession
    assets = [*references, target]
    states = asset_state(
        quotes.filter(F.col(key).isin(*assets)), grid.rows(spark, key, assets), key, grid,
        rules.freshness_ms, rules.return_window_ms, rules.retention_ms,
    )
    fresh = F.col("freshness") == "FRESH"
    lows = running_low(states, [key], ["as_of_ms"], F.when(fresh, F.col("price")), grid.segment())
    columns = []
    for i, asset in enumerate(assets):
        mine = F.col(key) == asset
        for c in ("price", "ret", "freshness", "age_ms"):
            columns.append(F.max(F.when(mine, F.col(c))).alias(f"{c}_{i}"))
    wide = lows.groupBy("as_of_ms").agg(
        *columns,
        F.count_if(fresh).alias("fresh_assets"),
        F.count_if(F.col("freshness") == "STALE").alias("stale_assets"),
        F.count_if((F.col("freshness") == "STALE") & (F.col(key) != target)).alias("stale_references"),
        F.max("low_ms").alias("last_low_ms"),
    )
    n = len(references)
    complete = F.lit(True)
    total = F.lit(0).cast(RATIO)
    for i in range(n):
        complete = complete & F.col(f"ret_{i}").isNotNull()
        total = total + F.coalesce(F.col(f"ret_{i}"), F.lit(0).cast(RATIO))
    mean = (total / F.lit(n).cast("decimal(2,0)")).cast(RATIO)
    wide = wide.withColumn("excess_return", F.when(complete, (F.col(f"ret_{n}") - mean).cast(RATIO)))
    flow = order_flow_received(
        trades.filter(F.col(key) == target), None if gaps is None else gaps.filter(F.col(key) == target),
        grid.rows(spark, key, [target]), key, grid, rules.return_window_ms, rules.freshness_ms,
    ).drop(key)
    return wide.join(flow, "as_of_ms")


def _usable(status: Column) -> Column:
    return status.isin("HEALTHY", "DEGRADED")


def _source_state(status: Column) -> Column:
    return F.when(status.isin("STALE", "ERROR"), "STALE").otherwise("UNKNOWN")


def conditions(frame: DataFrame, grid: Grid, references: Sequence[str], rules: PanelRules) -> DataFrame:
    """States, progress, gaps and durations of the eight conditions.

    ``frame``: :func:`market_frame` plus ``news_status``, ``market_status`` and ``item`` (newest
    qualifying news or null).
    """
    ratio, buy, sell = F.col("buy_sell_ratio"), F.col("buy_notional"), F.col("sell_notional")
    excess, flow = F.col("excess_return"), F.col("flow_state")
    only_buys = F.coalesce((buy > 0) & (sell == 0), F.lit(False))
    pressure = (flow == "KNOWN") & (ratio <= F.lit(rules.sell_ratio_maximum))
    normal_ratio = only_buys | F.coalesce(ratio >= F.lit(rules.rebuy_ratio_minimum), F.lit(False))
    timed = grid_timers(
        frame, [], grid,
        {
            "pressure_seconds": pressure,
            "recovery_seconds": excess >= F.lit(rules.relative_return_minimum),
            "normal_seconds": (flow == "KNOWN") & normal_ratio,
        },
    )
    usable, unusable = _usable(F.col("news_status")), _source_state(F.col("news_status"))
    item_age = whole_seconds(F.col("as_of_ms") - F.col("item.received_ms"))
    n = len(references)
    returns = [F.col(f"ret_{i}") for i in range(n)]
    known = sum((r.isNotNull().cast("int") for r in returns), F.lit(0))
    falling = sum(
        (F.when(r <= F.lit(limit), 1).otherwise(0) for r, limit in zip(returns, rules.cross_asset_maximum, strict=True)),
        F.lit(0),
    )

    def one(p: Column) -> Column:
        return F.least(F.lit(1.0), p.cast("double"))

    def flow_state(passing: Column) -> Column:
        return (
            F.when(flow == "STALE", "STALE").when(flow != "KNOWN", "UNKNOWN").when(passing, "PASS").otherwise("FAIL")
        )

    def missing_state(stale: Column) -> Column:
        return F.when(stale, "STALE").otherwise("UNKNOWN")

    pressure_passes = F.coalesce(ratio <= F.lit(rules.sell_ratio_maximum), F.lit(False))
    low_seconds = F.coalesce(whole_seconds(F.col("as_of_ms") - F.col("last_low_ms")), F.lit(0).cast("long"))
    any_stale = F.col("stale_assets") > 0
    recovery_target, normal_target = rules.relative_recovery_seconds, rules.flow_normal_seconds
    return timed.select(
        "*",
        # S1: a qualifying item in the window, from a usable source
        F.when(~usable, unusable).when(F.col("item").isNull(), "FAIL").otherwise("PASS").alias("S1"),
        F.when(usable, F.when(F.col("item").isNull(), 0.0).otherwise(1.0)).alias("S1_progress"),
        F.when(item_age.isNotNull(), F.greatest(F.lit(0).cast("long"), item_age)).alias("S1_seconds"),
        # S2: enough reference assets fell below their own threshold
        F.when(known < n, missing_state(F.col("stale_references") > 0))
        .when(falling >= rules.cross_asset_minimum, "PASS")
        .otherwise("FAIL")
        .alias("S2"),
        F.when(known == n, one(falling / F.lit(float(rules.cross_asset_minimum)))).alias("S2_progress"),
        # S3: the target fell more than the references
        F.when(excess.isNull(), missing_state(any_stale))
        .when(passes("LTE", excess, rules.relative_return_maximum), "PASS")
        .otherwise("FAIL")
        .alias("S3"),
        panel_progress("LTE", excess, rules.relative_return_maximum).cast("double").alias("S3_progress"),
        gap_for("LTE", excess, rules.relative_return_maximum).alias("S3_gap"),
        # S4: persistent selling
        flow_state(pressure_passes & (F.col("pressure_seconds") >= rules.sell_pressure_seconds)).alias("S4"),
        F.when(
            ratio.isNotNull(),
            F.least(
                F.lit(1.0),
                panel_progress("LTE", ratio, rules.sell_ratio_maximum).cast("double"),
                F.col("pressure_seconds") / F.lit(float(rules.sell_pressure_seconds)),
            ),
        ).alias("S4_progress"),
        # B1: quiet since the last qualifying item
        F.when(~usable, unusable)
        .when(F.col("item").isNull() | (item_age >= rules.macro_quiet_seconds), "PASS")
        .otherwise("FAIL")
        .alias("B1"),
        F.when(
            usable,
            F.when(F.col("item").isNull(), 1.0).otherwise(one(item_age / F.lit(float(rules.macro_quiet_seconds)))),
        ).alias("B1_progress"),
        # B2: four fresh prices and no new low anywhere for long enough
        F.when(F.col("fresh_assets") < n + 1, missing_state(any_stale))
        .when(low_seconds >= rules.no_new_low_seconds, "PASS")
        .otherwise("FAIL")
        .alias("B2"),
        F.when(
            F.col("fresh_assets") == n + 1, one(low_seconds / F.lit(float(rules.no_new_low_seconds)))
        ).alias("B2_progress"),
        low_seconds.alias("no_new_low_seconds"),
        # B3: the target recovered against the references
        F.when(excess.isNull(), missing_state(any_stale))
        .when(
            passes("GTE", excess, rules.relative_return_minimum) & (F.col("recovery_seconds") >= recovery_target),
            "PASS",
        )
        .otherwise("FAIL")
        .alias("B3"),
        F.when(
            excess.isNotNull(),
            F.least(
                panel_progress("GTE", excess, rules.relative_return_minimum).cast("double"),
                one(F.col("recovery_seconds") / F.lit(float(recovery_target))),
            ),
        ).alias("B3_progress"),
        gap_for("GTE", excess, rules.relative_return_minimum).alias("B3_gap"),
        # B4: selling back to normal; buys without sells count
        flow_state(normal_ratio & (F.col("normal_seconds") >= normal_target)).alias("B4"),
        F.when(
            only_buys | ratio.isNotNull(),
            F.least(
                F.lit(1.0),
                F.when(only_buys, 1.0).otherwise(
                    panel_progress("GTE", ratio, rules.rebuy_ratio_minimum).cast("double")
                ),
                F.col("normal_seconds") / F.lit(float(normal_target)),
            ),
        ).alias("B4_progress"),
    )


def next_gap(names: Sequence[str]) -> Column:
    """First condition, in fixed order, that does not pass; null when all pass."""
    listed = F.array(*[F.struct(F.lit(n).alias("id"), F.col(n).alias("state")) for n in names])
    return F.try_element_at(F.filter(listed, lambda c: c["state"] != "PASS"), F.lit(1))["id"]


def _passed(names: Sequence[str]) -> Column:
    return sum((F.when(F.col(n) == "PASS", 1).otherwise(0) for n in names), F.lit(0)).cast("long")


def panels(judged: DataFrame, grid: Grid, recorded: Column | None = None) -> DataFrame:
    """Stage, output, passed count and next gap of both models.

    Stage order matters: a ready or armed stage comes before missing data.  Once SELL_READY
    was reached (or a user recorded a sell) the sell context stays set for the REBUY model.
    """
    ready = (_passed(SELL_CONDITIONS) == 4).alias("ready")
    latched = latched_context(
        judged.withColumn("__ready", ready), [], ["as_of_ms"], F.col("__ready"), grid.segment(), recorded
    )
    market = ("S2", "S3", "S4")
    stressed = _passed(market) == 3
    missing = F.lit(False)
    for name in market:
        missing = missing | F.col(name).isin("UNKNOWN", "STALE")
    unusable = ~_usable(F.col("market_status")) | ~_usable(F.col("news_status"))
    sell_stage = (
        F.when(F.col("__ready"), "SELL_READY")
        .when(F.col("S1") == "PASS", "NEWS_ARMED")
        .when(stressed, "MARKET_ARMED")
        .when(missing | unusable, "DATA_UNAVAILABLE")
        .otherwise("NO_ACTION")
    )
    recovered = _passed(REBUY_CONDITIONS) == 4
    has_context = F.col("context") != "NONE"
    blocked = F.lit(False)
    for name in REBUY_CONDITIONS:
        blocked = blocked | F.col(name).isin("UNKNOWN", "STALE")
    rebuy_stage = (
        F.when(recovered & has_context, "REBUY_READY")
        .when(blocked, "DATA_UNAVAILABLE")
        .when(has_context | (_passed(REBUY_CONDITIONS) > 0), "REBUY_WAIT")
        .otherwise("NO_ACTION")
    )
    return latched.select(
        *judged.columns,
        "context",
        "context_ms",
        sell_stage.alias("sell_stage"),
        F.when(sell_stage == "SELL_READY", "SHADOW_CANDIDATE")
        .when(sell_stage.isin("NEWS_ARMED", "MARKET_ARMED"), "WATCH")
        .otherwise("NO_ACTION")
        .alias("sell_output"),
        _passed(SELL_CONDITIONS).alias("sell_passed"),
        next_gap(SELL_CONDITIONS).alias("sell_next_gap"),
        rebuy_stage.alias("rebuy_stage"),
        F.when(recovered & has_context, "SHADOW_CANDIDATE").otherwise("NO_ACTION").alias("rebuy_output"),
        _passed(REBUY_CONDITIONS).alias("rebuy_passed"),
        F.when(recovered & ~has_context, "SELL_CONTEXT").otherwise(next_gap(REBUY_CONDITIONS)).alias("rebuy_next_gap"),
    )


def evaluate(
    quotes: DataFrame, trades: DataFrame, gaps: DataFrame | None, news: DataFrame, health: DataFrame | None,
    key: str, grid: Grid, references: Sequence[str], target: str, rules: PanelRules,
) -> DataFrame:
    """The whole pipeline from ticks and classified news to panels.

    ``health``: ``as_of_ms``, ``news_status``, ``market_status``; both HEALTHY when not given.
    The frame (one row per instant) is checkpointed before the timers and the latch, which
    each read it twice, so the work over the ticks is done once.
    """
    frame = market_frame(quotes, trades, gaps, key, grid, references, target, rules)
    instants = grid.instants(quotes.sparkSession)
    item = latest_qualifying(
        instants, news, timeless_gate(), "occurred_ms", "received_ms", "item_id", rules.macro_arm_window_ms,
        grid.step_ms, grid.start_ms,
    )
    joined = frame.join(item, "as_of_ms")
    if health is None:
        joined = joined.withColumn("news_status", F.lit("HEALTHY")).withColumn("market_status", F.lit("HEALTHY"))
    else:
        joined = joined.join(health, "as_of_ms", "left").fillna(
            "WARMING_UP", ["news_status", "market_status"]
        )
    return panels(conditions(checkpointed(joined), grid, references, rules), grid)


def long_conditions(evaluated: DataFrame) -> DataFrame:
    """One row per instant, model and condition."""
    rows = [
        F.struct(
            F.lit("SELL" if n.startswith("S") else "REBUY").alias("model"), F.lit(n).alias("condition_id"),
            F.col(n).alias("state"), F.col(f"{n}_progress").alias("progress"),
        )
        for n in (*SELL_CONDITIONS, *REBUY_CONDITIONS)
    ]
    return evaluated.select("as_of_ms", F.explode(F.array(*rows)).alias("c")).select("as_of_ms", "c.*")


def stage_rows(evaluated: DataFrame) -> DataFrame:
    """One row per instant and model with its stage."""
    rows = [
        F.struct(F.lit("SELL").alias("model"), F.col("sell_stage").alias("stage"), F.col("sell_passed").alias("passed")),
        F.struct(F.lit("REBUY").alias("model"), F.col("rebuy_stage").alias("stage"), F.col("rebuy_passed").alias("passed")),
    ]
    return evaluated.select("as_of_ms", F.explode(F.array(*rows)).alias("p")).select("as_of_ms", "p.*")


def dashboard(evaluated: DataFrame, references: Sequence[str], target: str) -> DataFrame:
    """Health, market rows and both panels of every instant in one nested row."""
    assets = [*references, target]
    market = F.array(
        *[
            F.struct(
                F.lit(a).alias("asset"), F.col(f"price_{i}").alias("price"), F.col(f"ret_{i}").alias("ret"),
                F.col(f"age_ms_{i}").alias("age_ms"), F.col(f"freshness_{i}").alias("freshness"),
            )
            for i, a in enumerate(assets)
        ]
    )

    def panel(model: str, names: Sequence[str], prefix: str) -> Column:
        checks = F.array(
            *[F.struct(F.lit(n).alias("id"), F.col(n).alias("state"), F.col(f"{n}_progress").alias("progress")) for n in names]
        )
        return F.struct(
            F.lit(model).alias("model"), F.col(f"{prefix}_stage").alias("stage"), F.col(f"{prefix}_output").alias("output"),
            F.col(f"{prefix}_passed").alias("passed"), F.col(f"{prefix}_next_gap").alias("next_gap"), checks.alias("conditions"),
        )

    return evaluated.select(
        "as_of_ms",
        F.struct("news_status", "market_status").alias("sources"),
        F.col("item").alias("latest_macro_item"),
        market.alias("market"),
        panel("SELL", SELL_CONDITIONS, "sell").alias("sell"),
        panel("REBUY", REBUY_CONDITIONS, "rebuy").alias("rebuy"),
    )
