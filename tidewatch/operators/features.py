"""Market features per evaluation instant.

Observations carry: the key column (asset), ``event_ms``, ``received_ms``, ``id``, ``price``
and, for trades, ``quantity`` (null when not KNOWN) and ``side`` (BUY, SELL, UNKNOWN).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.decimals import AMOUNT, RATIO, TOTAL, notional, ratio, relative_change
from tidewatch.functions.knowledge import freshness, state_of
from tidewatch.functions.progress import EPSILON
from tidewatch.functions.times import age_ms, int_div
from tidewatch.operators.grid import (
    Grid,
    Timeline,
    asof_any_age,
    asof_latest,
    cell,
    resolution,
    summarise,
    visible_sums,
)
from tidewatch.operators.selection import counted, medians
from tidewatch.operators.validation import known_flow_rows
from tidewatch.session import checkpointed


# --- prices and returns -------------------------------------------------------------------


def asset_state(
    quotes: DataFrame, grid_rows: DataFrame, key: str, grid: Grid, freshness_ms: int, window_ms: int,
    retention_ms: int,
) -> DataFrame:
    """Receive-time price, age, freshness and return per asset and instant.

    The return needs a FRESH latest price and a price received at or before ``t - window``.
    """
    found = asof_latest(
        quotes,
        grid_rows,
        [key],
        grid,
        {"received_ms": F.col("received_ms"), "id": F.col("id"), "price": F.col("price")},
        F.col("received_ms"),
        {"latest": 0, "base": window_ms},
        retention_ms,
    )
    at = F.col("as_of_ms")
    fresh = freshness(F.col("latest.received_ms"), at, freshness_ms)
    return found.select(
        key,
        "as_of_ms",
        F.col("latest.price").alias("price"),
        age_ms(at, F.col("latest.received_ms")).alias("age_ms"),
        fresh.alias("freshness"),
        F.when(fresh == "FRESH", relative_change(F.col("latest.price"), F.col("base.price"))).alias("ret"),
        F.col("latest.id").alias("latest_id"),
        F.col("latest.received_ms").alias("latest_received_ms"),
    )


def event_return(
    observations: DataFrame, grid_rows: DataFrame, key: str, grid: Grid, window_ms: int
) -> DataFrame:
    """Event-ordered return with receive visibility and no freshness test."""
    seen = F.greatest(F.col("event_ms"), F.col("received_ms"))
    lagged = F.greatest(F.col("event_ms") + F.lit(window_ms), F.col("received_ms"))
    found = asof_any_age(
        observations,
        grid_rows,
        [key],
        grid,
        {
            "event_ms": F.col("event_ms"),
            "received_ms": F.col("received_ms"),
            "id": F.col("id"),
            "price": F.col("price"),
        },
        {"latest": seen, "base": lagged},
    )
    value = relative_change(F.col("latest.price"), F.col("base.price"))
    return found.select(
        key,
        "as_of_ms",
        value.alias("ret"),
        state_of(value).alias("ret_state"),
        F.when(value.isNotNull(), F.col("latest.received_ms")).alias("observed_ms"),
        F.col("latest.price").alias("price"),
        F.col("latest.received_ms").alias("latest_received_ms"),
    )


def exact_lag_return(
    closes: DataFrame, key: str, time_ms: str, price: str, window_ms: int
) -> DataFrame:
    """Price at exactly ``t`` and ``t - window``; a missing side is an error row."""
    earlier = closes.select(
        key, (F.col(time_ms) + F.lit(window_ms)).alias(time_ms), F.col(price).alias("base_price")
    )
    joined = closes.join(earlier, [key, time_ms], "left")
    return joined.withColumn("ret", relative_change(F.col(price), F.col("base_price"))).withColumn(
        "ret_state", F.when(F.col("base_price").isNull(), "ERROR").otherwise("KNOWN")
    )


# --- drawdown -----------------------------------------------------------------------------


def _span(rows: Column) -> Column:
    """Fold time-ordered (high, low, drawdown) pieces into the drawdown of the whole."""
    start = F.struct(
        F.lit(None).cast(AMOUNT).alias("high"), F.lit(0).cast(RATIO).alias("worst")
    )

    def step(acc: Column, piece: Column) -> Column:
        across = F.coalesce(relative_change(piece["low"], acc["high"]), F.lit(0).cast(RATIO))
        return F.struct(
            F.greatest(acc["high"], piece["high"]).cast(AMOUNT).alias("high"),
            F.least(acc["worst"], piece["worst"], across).cast(RATIO).alias("worst"),
        )

    return F.aggregate(rows, start, step)["worst"]


def _piece(at: Column, since: Column, until: Column, high: Column, low: Column, worst: Column) -> Column:
    """Part of a path: its place, the steps of the grid at which it holds, and what a fold needs of it."""
    return F.struct(
        at.cast("long").alias("at"), since.cast("long").alias("since"), until.cast("long").alias("until"),
        high.cast(AMOUNT).alias("high"), low.cast(AMOUNT).alias("low"), worst.cast(RATIO).alias("worst"),
    )


def _path_cells(observations: DataFrame, key: str, grid: Grid, res: int, window_ms: int) -> DataFrame:
    """One row per (key, cell): its pieces by version, and whether it still grows after its end.

    A version is a step of the grid at which more of the cell is seen.  Rows that are received when their window is over
    are in none and go first, so a cell has at most as many versions as a window has instants.
    """
    start, step = F.lit(grid.start_ms).cast("long"), grid.step_ms
    zero = F.lit(0).cast("long")
    seen = int_div(F.greatest(F.col("event_ms"), F.col("received_ms")) - start + (step - 1), step)
    marked = (
        observations.filter(F.col("event_ms").between(grid.start_ms - window_ms, grid.end_ms) & F.col("price").isNotNull())
        .select(key, "event_ms", "received_ms", "id", F.col("price").cast(AMOUNT).alias("price"), F.greatest(seen, zero).alias("seen"))
        .filter(F.col("seen") * step <= F.col("event_ms") - start + window_ms)
    )
    by_ms = Window.partitionBy(key, "event_ms", "seen").orderBy("received_ms", "id")
    high_so_far = F.max("price").over(by_ms.rowsBetween(Window.unboundedPreceding, 0))
    instants = (
        marked.withColumn("fall", relative_change(F.col("price"), high_so_far))
        .groupBy(key, "event_ms", "seen")
        .agg(F.max("price").alias("high"), F.min("price").alias("low"), F.min("fall").alias("worst"))
        .withColumn("cell", cell(F.col("event_ms"), grid, res))
    )
    versions = F.collect_set("seen").over(Window.partitionBy(key, "cell"))
    seen_at = instants.withColumn("versions", versions).withColumn(
        "version", F.explode(F.filter("versions", lambda v: v >= F.col("seen")))
    )
    in_time = Window.partitionBy(key, "cell", "version").orderBy("event_ms", "seen")
    high_before = F.max("high").over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    pieces = (
        seen_at.withColumn("across", relative_change(F.col("low"), high_before))
        .groupBy(key, "cell", "version")
        .agg(F.max("high").alias("high"), F.min("low").alias("low"), F.min(F.least("worst", "across")).alias("worst"))
        .groupBy(key, "cell")
        .agg(F.array_sort(F.collect_list(F.struct("version", "high", "low", "worst"))).alias("found"))
    )
    closed = F.greatest(int_div(int_div(F.col("cell"), 2) * res + (step - 1), step), zero)
    only = F.element_at("found", 1)
    late = (F.size("found") > 1) | (only["version"] > closed)
    parts = F.transform(
        "found",
        lambda p, i: _piece(F.col("cell"), p["version"], F.get(F.col("found"), i + 1)["version"], p["high"], p["low"], p["worst"]),
    )
    return pieces.select(
        key, "cell", late.alias("late"), F.when(late, parts).alias("parts"),
        *[F.when(~late, only[c]).alias(c) for c in ("high", "low", "worst")],
    )


def max_drawdown(
    observations: DataFrame, grid_rows: DataFrame, key: str, grid: Grid, window_ms: int
) -> DataFrame:
    """Deepest fall from a running high inside ``[t - window, t]`` of event time.

    Two neighbouring pieces of a path combine exactly: the worst of both, or the later low against the earlier high.  So
    ticks reduce to one (high, low, worst) piece per millisecond, then per cell.  Blocks of cells are as long as a window,
    so a window is the end of one block and the beginning of the next: running extremes from either end of a block give
    both with one look-up each, and no window gathers its cells.

    A cell that still grows after its end stands between two stretches of cells that do not, with one piece a version; an
    instant folds the stretches and the versions that hold then.  Their number depends on the grid, not on the ticks.
    """
    # cells of a minute, or about 64 to a window if that is longer
    widest = 60_000 * max(1, window_ms // (64 * 60_000))
    res = math.gcd(resolution(grid, window_ms), widest)
    size = 2 * (window_ms // res) + 1
    end = cell(F.col("as_of_ms"), grid, res)
    begin = end - (size - 1)
    looked_up = F.array_compact(F.array(
        F.struct(F.lit("head").alias("side"), end.alias("cell")),
        F.when(int_div(begin, size) != int_div(end, size), F.struct(F.lit("tail").alias("side"), begin.alias("cell"))),
    ))
    probes = grid_rows.select(key, "as_of_ms", F.explode(looked_up).alias("__p")).select(key, "as_of_ms", "__p.*")
    cells = _path_cells(observations, key, grid, res, window_ms)
    frame = cells.unionByName(probes, allowMissingColumns=True).withColumn("block", int_div(F.col("cell"), size))
    after_cells = F.col("side").isNotNull()
    so_far, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)

    def from_end(df: DataFrame, name: str, order: Column, crossing) -> DataFrame:
        """The path from one end of the block to each row: stretches and growing cells, as pieces."""
        growing = F.when(F.col("late"), 1)
        of_block = Window.partitionBy(key, "block").orderBy(order, after_cells)
        df = df.withColumn("stretch", F.count(growing).over(of_block.rowsBetween(*before)))
        inside = Window.partitionBy(key, "block", "stretch").orderBy(order, after_cells)
        df = df.withColumn("crossed", F.least("worst", crossing(inside.rowsBetween(*before))))
        w = inside.rowsBetween(*so_far)
        own = F.when(F.col("high").isNotNull(), F.col("cell"))
        stretch = _piece(F.min(own).over(w), F.lit(0), F.lit(None), F.max("high").over(w), F.min("low").over(w), F.min("crossed").over(w))
        df = df.withColumn("mine", F.filter(F.array(stretch), lambda p: p["high"].isNotNull()))
        listed = F.collect_list(F.when(F.col("late"), F.concat("mine", "parts")))
        whole = Window.partitionBy(key, "block").orderBy("stretch", order, after_cells).rowsBetween(*so_far)
        return df.withColumn(name, F.concat(F.flatten(listed.over(whole)), F.col("mine"))).drop("stretch", "crossed", "mine")

    frame = from_end(frame, "head", F.asc("cell"), lambda w: relative_change(F.col("low"), F.max("high").over(w)))
    frame = from_end(frame, "tail", F.desc("cell"), lambda w: relative_change(F.min("low").over(w), F.col("high")))
    path = F.when(F.col("side") == "head", F.col("head")).otherwise(F.col("tail"))
    gathered = frame.filter(F.col("side").isNotNull()).groupBy(key, "as_of_ms").agg(F.flatten(F.collect_list(path)).alias("path"))
    now = int_div(F.col("as_of_ms") - F.lit(grid.start_ms), grid.step_ms)
    visible = F.array_sort(
        F.filter("path", lambda p: (p["since"] <= now) & (p["until"].isNull() | (p["until"] > now)))
    )
    return gathered.select(
        key,
        "as_of_ms",
        F.when(F.size(visible) > 0, _span(visible)).alias("max_drawdown"),
        F.when(F.size(visible) > 0, "KNOWN").otherwise("UNKNOWN").alias("max_drawdown_state"),
    )


# --- order flow ---------------------------------------------------------------------------


def _side_value(side: str) -> Column:
    value = notional(F.col("price"), F.col("quantity"))
    return F.when(F.col("side") == side, value)


def order_flow(
    trades: DataFrame, grid_rows: DataFrame, key: str, grid: Grid, window_ms: int
) -> DataFrame:
    """Event-time buy/sell notional, net, ratio and coverage with receive visibility.

    No trades: all UNKNOWN.  None eligible: only coverage KNOWN.  Both sides zero: ratio
    UNKNOWN.  Sell side zero: divided by 1e-12.
    """
    eligible = F.col("quantity").isNotNull() & (F.col("side") != "UNKNOWN")
    summed = visible_sums(
        trades,
        grid_rows,
        [key],
        grid,
        F.col("event_ms"),
        F.col("received_ms"),
        window_ms,
        {
            "n": F.lit(1).cast("long"),
            "n_eligible": eligible.cast("long"),
            "buy": F.coalesce(F.when(eligible, _side_value("BUY")), F.lit(0).cast(AMOUNT)),
            "sell": F.coalesce(F.when(eligible, _side_value("SELL")), F.lit(0).cast(AMOUNT)),
        },
    )
    n, e = F.coalesce("n", F.lit(0)), F.coalesce("n_eligible", F.lit(0))
    zero = F.lit(0).cast(AMOUNT)
    buy = F.when(e > 0, F.col("buy").cast(TOTAL))
    sell = F.when(e > 0, F.col("sell").cast(TOTAL))
    # decimal(38,10) holds a buy side of up to 10^16 over 1e-12; beyond that the ratio is UNKNOWN, not an error.
    value = F.when(
        (e > 0) & (sell == zero) & (buy > zero),
        F.try_multiply(buy.try_cast("decimal(25,8)"), F.lit(10**12).cast("decimal(13,0)")).try_cast("decimal(38,10)"),
    ).when((e > 0) & (sell != zero), ratio(buy, sell).try_cast("decimal(38,10)"))
    return summed.select(
        key,
        "as_of_ms",
        n.alias("trades"),
        e.alias("eligible"),
        buy.alias("buy_notional"),
        sell.alias("sell_notional"),
        (buy - sell).cast(TOTAL).alias("net_flow"),
        value.alias("buy_sell_ratio"),
        F.when(n > 0, ratio(e, n)).alias("coverage"),
        F.when(n == 0, "NO_TRADES")
        .when(e == 0, "NONE_ELIGIBLE")
        .when((buy == zero) & (sell == zero), "BOTH_ZERO")
        .otherwise("KNOWN")
        .alias("flow_state"),
    )


def order_flow_received(
    trades: DataFrame, gaps: DataFrame | None, grid_rows: DataFrame, key: str, grid: Grid,
    window_ms: int, freshness_ms: int,
) -> DataFrame:
    """Receive-time flow.  State: GAP > NO_TRADES > STALE > KNOWN; amounts only when KNOWN.

    Only trades with a known quantity and side count, so a KNOWN amount is never a stand-in zero.
    ``gaps`` holds the key and ``received_ms`` of each detected sequence gap.
    """
    res = resolution(grid, window_ms)
    measures = {
        "buy": F.sum(_side_value("BUY")),
        "sell": F.sum(_side_value("SELL")),
        "n": F.count(F.lit(1)),
        "first_ms": F.min("received_ms"),
        "last_ms": F.max("received_ms"),
    }
    usable = known_flow_rows(trades)
    cells = summarise(usable, [key], F.col("received_ms"), grid, res, measures)
    if gaps is not None:
        gap_cells = summarise(
            gaps, [key], F.col("received_ms"), grid, res, {"gap_ms": F.max("received_ms")}
        )
        cells = cells.unionByName(gap_cells, allowMissingColumns=True)
    else:
        cells = cells.withColumn("gap_ms", F.lit(None).cast("long"))
    timeline = Timeline(cells, grid_rows, [key], grid, res, window_ms)
    w = timeline.window(window_ms)
    raw = timeline.select(
        {
            "buy": F.sum("buy").over(w),
            "sell": F.sum("sell").over(w),
            "n": F.coalesce(F.sum("n").over(w), F.lit(0)),
            "first_ms": F.min("first_ms").over(w),
            "last_ms": F.max("last_ms").over(w),
            "gap_ms": F.max("gap_ms").over(w),
        }
    )
    age = age_ms(F.col("as_of_ms"), F.col("last_ms"))
    state = (
        F.when(F.col("gap_ms").isNotNull(), "GAP")
        .when(F.col("n") == 0, "NO_TRADES")
        .when(age > freshness_ms, "STALE")
        .otherwise("KNOWN")
    )
    zero = F.lit(0).cast(AMOUNT)
    buy, sell = F.coalesce(F.col("buy").cast(TOTAL), zero), F.coalesce(F.col("sell").cast(TOTAL), zero)
    return raw.select(
        key,
        "as_of_ms",
        state.alias("flow_state"),
        F.when(state == "KNOWN", buy).alias("buy_notional"),
        F.when(state == "KNOWN", sell).alias("sell_notional"),
        F.when((state == "KNOWN") & (sell != zero), ratio(buy, sell)).alias("buy_sell_ratio"),
        F.when(
            F.col("n") > 0,
            F.least(
                F.lit(1).cast(RATIO),
                ratio(F.col("last_ms") - F.col("first_ms") + freshness_ms, F.lit(window_ms)),
            ),
        ).alias("coverage"),
        F.when(F.col("n") > 0, age).alias("flow_age_ms"),
    )


def volume_anomaly(
    observations: DataFrame, grid: Grid, window_ms: int, baseline: Column
) -> DataFrame:
    """Notional of all reference assets in the window over a baseline.

    UNKNOWN without an eligible trade or with a baseline that is missing or not positive.
    """
    spark = observations.sparkSession
    eligible = observations.filter(F.col("quantity").isNotNull()).withColumn("scope", F.lit("reference"))
    summed = visible_sums(
        eligible,
        grid.rows(spark, "scope", ["reference"]),
        ["scope"],
        grid,
        F.col("event_ms"),
        F.col("received_ms"),
        window_ms,
        {"n": F.lit(1).cast("long"), "total": notional(F.col("price"), F.col("quantity"))},
    )
    value = F.when((baseline > 0) & (F.col("n") > 0), ratio(F.col("total"), baseline))
    return summed.select(
        "as_of_ms", value.alias("volume_anomaly"), state_of(value).alias("volume_anomaly_state")
    )


# --- cross-asset --------------------------------------------------------------------------


def cross_asset(
    returns: DataFrame, key: str, references: Sequence[str], target: str,
    thresholds: dict[str, Decimal],
) -> DataFrame:
    """Breadth of falling reference assets, excess return of the target and price coverage.

    Breadth and excess are UNKNOWN when any return they need is missing.
    """
    def value_of(asset: str) -> Column:
        return F.max(F.when(F.col(key) == asset, F.col("ret")))

    wide = returns.groupBy("as_of_ms").agg(
        *[value_of(a).alias(f"ret_{i}") for i, a in enumerate(references)],
        value_of(target).alias("ret_target"),
        F.count("ret").alias("known"),
        F.count(F.lit(1)).alias("assets"),
    )
    parts = [F.col(f"ret_{i}") for i in range(len(references))]
    complete = F.lit(True)
    hits = F.lit(0)
    total = F.lit(0).cast(RATIO)
    for asset, part in zip(references, parts, strict=True):
        complete = complete & part.isNotNull()
        hits = hits + F.when(part <= F.lit(thresholds[asset]), 1).otherwise(0)
        total = total + F.coalesce(part, F.lit(0).cast(RATIO))
    mean = (total / F.lit(len(references)).cast("decimal(2,0)")).cast(RATIO)
    return wide.select(
        "as_of_ms",
        F.when(complete, hits).cast("long").alias("shock_breadth"),
        F.when(complete, (F.col("ret_target") - mean).cast(RATIO)).alias("excess_return"),
        ratio(F.col("known"), F.col("assets")).alias("price_coverage"),
    )


# --- baselines and statistics -------------------------------------------------------------


def mad_scale(history: DataFrame, keys: Sequence[str], value: str, factor: Decimal, minimum: int) -> DataFrame:
    """1.4826 x median absolute deviation per key; UNKNOWN below the minimum sample count.

    Both medians come from running counts of distinct values (see ``selection``): no task holds the values of a key.
    """
    keys = list(keys)
    counts = counted(history.select(*keys, F.col(value).cast("double").alias("__value")), keys, "__value")
    centres = medians(counts, keys, "__value", "__centre").drop("samples").withColumnsRenamed({k: f"__of_{k}" for k in keys})
    near = counts.join(centres, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    away = F.abs(F.col("__value") - F.col("__centre"))
    distances = checkpointed(near.groupBy(*keys, away.alias("__away")).agg(F.sum("n").alias("n")))
    spread = medians(distances, keys, "__away", "mad")
    scaled = F.when(F.col("samples") >= minimum, F.col("mad") * F.lit(float(factor)))
    return spread.select(*keys, "samples", scaled.alias("sigma"), state_of(scaled).alias("sigma_state"))


def _lookback(df: DataFrame, keys: Sequence[str], at: str, lookback_ms: int, bucket_ms: int):
    """Copies of per-instant rows in look-back buckets, and the frame ``[t - lookback, t)``."""
    own = int_div(F.col(at), bucket_ms)
    reaches = F.when((own + 1) * bucket_ms - F.col(at) <= lookback_ms, own + 1)
    copies = df.withColumn("__b", F.explode(F.array_compact(F.array(own, reaches))))
    window = Window.partitionBy(*keys, "__b").orderBy(at).rangeBetween(-lookback_ms, -1)
    return copies, window, F.col("__b") == own


def rolling_mad(
    returns: DataFrame, key: str, grid: Grid, value: str, lookback_ms: int, factor: Decimal, minimum: int
) -> DataFrame:
    """MAD scale of the KNOWN returns in the ``lookback`` before each instant.

    Rows are one per instant, so a window array never exceeds ``lookback / step`` numbers.
    """
    numbers = returns.select(key, "as_of_ms", F.col(value).cast("double").alias("x"))
    copies, w, own = _lookback(numbers, [key], "as_of_ms", lookback_ms, grid.bucket(lookback_ms, 1))
    with_list = copies.withColumn("xs", F.array_sort(F.collect_list("x").over(w))).filter(own)

    def middle(xs: Column) -> Column:
        n = F.size(xs)
        low = F.get(xs, F.floor((n - 1) / 2).cast("int"))
        high = F.get(xs, F.floor(n / 2).cast("int"))
        return (low + high) / 2

    spread = F.array_sort(F.transform("xs", lambda x: F.abs(x - F.col("centre"))))
    sigma = F.when(F.size("xs") >= minimum, middle(spread) * F.lit(float(factor)))
    return with_list.withColumn("centre", middle(F.col("xs"))).select(
        key, "as_of_ms", F.size("xs").cast("long").alias("samples"), sigma.alias("sigma"),
        state_of(sigma).alias("sigma_state"),
    )


def required_drawdown(fixed: Column, sigma: Column, multiplier: Column) -> Column:
    """The larger of the fixed and the volatility threshold, as a negative return."""
    return -F.greatest(F.abs(fixed), F.abs(sigma * multiplier))


def flow_zscore(
    flows: DataFrame, keys: Sequence[str], grid: Grid, value: str, lookback_ms: int, minimum: int
) -> DataFrame:
    """(x - mean) / population deviation of the KNOWN values in the ``lookback`` before t."""
    numbers = flows.select(*keys, "as_of_ms", F.col(value).cast("double").alias("x"))
    copies, w, own = _lookback(numbers, keys, "as_of_ms", lookback_ms, grid.bucket(lookback_ms, 1))
    scored = copies.select(
        *keys, "as_of_ms", "x", "__b",
        F.avg("x").over(w).alias("mean"),
        F.stddev_pop("x").over(w).alias("deviation"),
        F.count("x").over(w).alias("samples"),
    ).filter(own)
    z = F.when(
        (F.col("samples") >= minimum) & (F.col("deviation") > 0),
        (F.col("x") - F.col("mean")) / F.col("deviation"),
    )
    return scored.select(*keys, "as_of_ms", "samples", z.alias("zscore"), state_of(z).alias("zscore_state"))


def oi_change(baseline: Column, current: Column) -> Column:
    """Relative change; UNKNOWN when a side is missing or the baseline is not positive."""
    return F.when(baseline > 0, relative_change(current, baseline))


# --- health and snapshots -----------------------------------------------------------------


def data_health(
    ages: DataFrame, key: str, assets: Sequence[str], essential: Sequence[str], limit_ms: int,
    drift_limit_ms: int,
) -> DataFrame:
    """PASS, DEGRADED, BLOCKED or UNKNOWN per instant.

    ``ages``: key, ``as_of_ms``, ``age_ms`` (null without data), ``clock_drift_ms`` (null when
    unknown), ``future_data`` and ``gap_sources``.
    """
    state = (
        F.when(F.col("age_ms").isNull(), "UNKNOWN")
        .when(F.col("age_ms") <= limit_ms, "FRESH")
        .otherwise("STALE")
    )
    graded = ages.withColumn("freshness", state)
    not_fresh = F.col("freshness") != "FRESH"
    wide = graded.filter(F.col(key).isin(*assets)).groupBy("as_of_ms").agg(
        F.sort_array(F.collect_set(F.when(not_fresh, F.concat(F.lit("market."), F.col(key))))).alias("stale_sources"),
        F.bool_or(not_fresh & F.col(key).isin(*essential)).alias("essential_stale"),
        F.max("clock_drift_ms").alias("clock_drift_ms"),
        F.bool_or("future_data").alias("future_data"),
        F.max("gap_sources").alias("gap_sources"),
    )
    blocked = (
        (F.abs("clock_drift_ms") > drift_limit_ms) | F.col("essential_stale") | (F.col("gap_sources") > 0)
    )
    return wide.withColumn(
        "health",
        F.when(F.col("future_data"), "BLOCKED")
        .when(F.col("clock_drift_ms").isNull(), "UNKNOWN")
        .when(blocked, "BLOCKED")
        .when(F.size("stale_sources") > 0, "DEGRADED")
        .otherwise("PASS"),
    )


def evidence_union(df: DataFrame, keys: Sequence[str], row_id: str, evidence: str) -> DataFrame:
    """Distinct ids of the rows and of their evidence, one row per key and id.

    Long form on purpose: a key may own a third of all ids, which must not become one array.
    """
    none = F.array().cast("array<string>")
    listed = F.array_append(F.coalesce(F.col(evidence), none), F.col(row_id))
    return df.select(*keys, F.explode(listed).alias("evidence_id")).distinct()


def evidence_array(left: Column, right: Column) -> Column:
    """Distinct ids of two bounded evidence lists of one row."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(left, none), F.coalesce(right, none)))
