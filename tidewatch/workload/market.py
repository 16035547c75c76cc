"""Grid features over the event ticks and the trade rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import to_ms
from tidewatch.operators import features, lookups, selection, validation
from tidewatch.operators.arrivals import approximate_quantiles, last_n_samples
from tidewatch.operators.grid import Grid, asof_any_age, grid_over, resolution, summarise, Timeline
from tidewatch.workload.registry import number, numbers, query
from tidewatch.workload.tables import ASSETS, DAY, HOUR, REFERENCES, TARGET, TICKS_SQL, grid_sql, table, ticks, trades

STEP, WINDOW, RETENTION, FRESH = HOUR, 6 * HOUR, DAY, HOUR // 2
THRESHOLDS = {"view": Decimal("-0.1"), "click": Decimal("-0.2"), "signup": Decimal("-0.3")}


def tick_grid(t: DataFrame, step: int = STEP, time: str = "received_ms") -> Grid:
    return grid_over(t, time, step)


def rows(t: DataFrame, grid: Grid) -> DataFrame:
    """The grid for every key of the ticks."""
    return grid.rows_of(t, "asset")


# --- as-of ---------------------------------------------------------------------------------

ONE_PER_TIME = """newest AS (SELECT asset, received_ms, arg_max(struct_pack(id := id, price := price), id) AS r
            FROM ticks GROUP BY ALL)"""


@query(
    "asof_latest",
    f"""WITH {TICKS_SQL}, {grid_sql(STEP)}, {ONE_PER_TIME}
SELECT g.asset, g.as_of_ms, n.r.id AS latest_id, CAST(n.r.price AS DOUBLE) AS latest_price,
       b.r.id AS lagged_id, CAST(b.r.price AS DOUBLE) AS lagged_price
FROM grid g
ASOF LEFT JOIN newest n ON g.asset = n.asset AND g.as_of_ms >= n.received_ms
ASOF LEFT JOIN newest b ON g.asset = b.asset AND g.as_of_ms - {WINDOW} >= b.received_ms""",
)
def asof_latest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    grid = tick_grid(t)
    found = asof_any_age(
        t, rows(t, grid), ["asset"], grid,
        {"received_ms": F.col("received_ms"), "id": F.col("id"), "price": F.col("price")},
        {"latest": F.col("received_ms"), "lagged": F.col("received_ms") + WINDOW},
    )
    return found.select(
        "asset", "as_of_ms", F.col("latest.id").alias("latest_id"), number("latest.price").alias("latest_price"),
        F.col("lagged.id").alias("lagged_id"), number("lagged.price").alias("lagged_price"),
    )


@query(
    "asset_state",
    f"""WITH {TICKS_SQL}, {grid_sql(STEP)}, {ONE_PER_TIME},
found AS (SELECT g.asset, g.as_of_ms, n.received_ms AS n_ms, n.r AS n, b.received_ms AS b_ms, b.r AS b
  FROM grid g
  ASOF LEFT JOIN newest n ON g.asset = n.asset AND g.as_of_ms >= n.received_ms
  ASOF LEFT JOIN newest b ON g.asset = b.asset AND g.as_of_ms - {WINDOW} >= b.received_ms),
kept AS (SELECT asset, as_of_ms, CASE WHEN n_ms >= as_of_ms - {RETENTION} THEN n END AS n,
  CASE WHEN n_ms >= as_of_ms - {RETENTION} THEN n_ms END AS n_ms,
  CASE WHEN b_ms >= as_of_ms - {RETENTION} THEN b END AS b FROM found)
SELECT asset, as_of_ms, CAST(n.price AS DOUBLE) AS price, as_of_ms - n_ms AS age_ms,
  CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN as_of_ms - n_ms <= {FRESH} THEN 'FRESH' ELSE 'STALE' END AS freshness,
  CASE WHEN as_of_ms - n_ms <= {FRESH} THEN round(CAST(n.price - b.price AS DOUBLE) / CAST(b.price AS DOUBLE), 8) END AS ret,
  n.id AS latest_id
FROM kept""",
)
def asset_state_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    grid = tick_grid(t)
    state = features.asset_state(t, rows(t, grid), "asset", grid, FRESH, WINDOW, RETENTION)
    return numbers(state.drop("latest_received_ms"), "price", "ret")


EVENT_ASOF_SQL = f"""ev_latest AS (
  SELECT g.asset, g.as_of_ms, arg_max(struct_pack(p := t.price, r := t.received_ms), (t.event_ms, t.received_ms, t.id)) AS n
  FROM grid g JOIN ticks t ON t.asset = g.asset AND greatest(t.event_ms, t.received_ms) <= g.as_of_ms GROUP BY ALL),
ev_base AS (
  SELECT g.asset, g.as_of_ms, arg_max(t.price, (t.event_ms, t.received_ms, t.id)) AS b
  FROM grid g JOIN ticks t ON t.asset = g.asset AND greatest(t.event_ms + {WINDOW}, t.received_ms) <= g.as_of_ms GROUP BY ALL),
ev_return AS (
  SELECT g.asset, g.as_of_ms, CAST(n.p - b AS DOUBLE) / CAST(b AS DOUBLE) AS ret, n.p AS price, n.r AS latest_received_ms
  FROM grid g LEFT JOIN ev_latest USING (asset, as_of_ms) LEFT JOIN ev_base USING (asset, as_of_ms))"""


@query(
    "event_return",
    f"""WITH {TICKS_SQL}, {grid_sql(STEP)}, {EVENT_ASOF_SQL}
SELECT asset, as_of_ms, round(ret, 8) AS ret, CASE WHEN ret IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END AS ret_state,
  CASE WHEN ret IS NOT NULL THEN latest_received_ms END AS observed_ms
FROM ev_return""",
)
def event_return_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    grid = tick_grid(t)
    found = features.event_return(t, rows(t, grid), "asset", grid, WINDOW)
    return numbers(found.select("asset", "as_of_ms", "ret", "ret_state", "observed_ms"), "ret")


CLOSES_SQL = f"""closes AS (SELECT asset, (event_ms // {HOUR} + 1) * {HOUR} - 1 AS close_ms, arg_max(price, (event_ms, id)) AS price
FROM ticks GROUP BY ALL)"""


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly closes of the ticks: the last price of each hour at its last millisecond."""
    t = ticks(spark, sf_dir)
    close = (F.floor(F.col("event_ms") / HOUR) + 1) * HOUR - 1
    return t.groupBy("asset", close.cast("long").alias("close_ms")).agg(
        F.max(F.struct("event_ms", "id", "price"))["price"].alias("price")
    )


@query(
    "exact_lag_return",
    f"""WITH {TICKS_SQL}, {CLOSES_SQL}
SELECT c.asset, c.close_ms, CAST(c.price AS DOUBLE) AS price,
  round(CAST(c.price - b.price AS DOUBLE) / CAST(b.price AS DOUBLE), 8) AS ret,
  CASE WHEN b.price IS NULL THEN 'ERROR' ELSE 'KNOWN' END AS ret_state
FROM closes c LEFT JOIN closes b ON b.asset = c.asset AND b.close_ms = c.close_ms - {HOUR}""",
)
def exact_lag_return_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.exact_lag_return(closes(spark, sf_dir), "asset", "close_ms", "price", HOUR)
    return numbers(found.drop("base_price"), "price", "ret")


@query(
    "exact_or_previous_close",
    f"""WITH {TICKS_SQL}, {CLOSES_SQL}
SELECT t.asset, t.id, t.event_ms, c.close_ms, CAST(c.price AS DOUBLE) AS close_price
FROM ticks t ASOF LEFT JOIN closes c ON c.asset = t.asset AND t.event_ms >= c.close_ms""",
)
def exact_or_previous_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = ticks(spark, sf_dir).select("asset", "id", "event_ms")
    found = lookups.asof_join(probes, closes(spark, sf_dir), ["asset"], "event_ms", "close_ms", ["price"])
    return found.select(
        "asset", "id", "event_ms", F.col("found.close_ms").alias("close_ms"), number("found.price").alias("close_price")
    )


@query(
    "metrics_at_instants",
    f"""WITH {TICKS_SQL}, {CLOSES_SQL},
cum AS (SELECT asset, event_ms,
    CASE WHEN count(CASE WHEN quantity IS NOT NULL AND side <> 'UNKNOWN' THEN 1 END) OVER w > 0 THEN coalesce(sum(CASE WHEN side = 'BUY' THEN CAST(price * quantity AS DECIMAL(20,8)) END) OVER w, 0) END AS buy,
    CASE WHEN count(CASE WHEN quantity IS NOT NULL AND side <> 'UNKNOWN' THEN 1 END) OVER w > 0 THEN coalesce(sum(CASE WHEN side = 'SELL' THEN CAST(price * quantity AS DECIMAL(20,8)) END) OVER w, 0) END AS sell,
    count(*) OVER w AS records, id
  FROM ticks WINDOW w AS (PARTITION BY asset ORDER BY event_ms RANGE BETWEEN {WINDOW} PRECEDING AND CURRENT ROW))
SELECT t.asset, t.id, t.event_ms, round(CAST(t.buy AS DOUBLE), 6) AS buy_notional, round(CAST(t.sell AS DOUBLE), 6) AS sell_notional,
  t.records, round(CASE WHEN t.sell <> 0 THEN CAST(t.buy AS DOUBLE) / CAST(t.sell AS DOUBLE) END, 8) AS buy_sell_ratio,
  round(CAST(c.price - b.price AS DOUBLE) / CAST(b.price AS DOUBLE), 8) AS ret
FROM cum t
ASOF LEFT JOIN closes c ON c.asset = t.asset AND t.event_ms >= c.close_ms
ASOF LEFT JOIN closes b ON b.asset = t.asset AND t.event_ms - {WINDOW} >= b.close_ms""",
)
def metrics_at_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    probes = t.select("asset", "id", "event_ms")
    flow = lookups.flow_at(probes, t, ["asset"], "event_ms", "event_ms", WINDOW)
    found = lookups.return_at(flow, closes(spark, sf_dir), ["asset"], "event_ms", "close_ms", "price", WINDOW)
    return numbers(numbers(found.drop("close", "ret_state"), "buy_sell_ratio", "ret"), "buy_notional", "sell_notional", places=6)


# --- windows -------------------------------------------------------------------------------

FLOW_WINDOW_SQL = f"""flow AS (
  SELECT g.asset, g.as_of_ms, count(t.id) AS n,
    count(CASE WHEN t.quantity IS NOT NULL AND t.side <> 'UNKNOWN' THEN 1 END) AS e,
    sum(CASE WHEN t.side = 'BUY' THEN CAST(t.price * t.quantity AS DECIMAL(20,8)) END) AS buy,
    sum(CASE WHEN t.side = 'SELL' THEN CAST(t.price * t.quantity AS DECIMAL(20,8)) END) AS sell
  FROM grid g LEFT JOIN ticks t ON t.asset = g.asset AND t.event_ms BETWEEN g.as_of_ms - {WINDOW} AND g.as_of_ms
    AND t.received_ms <= g.as_of_ms GROUP BY ALL),
flows AS (SELECT asset, as_of_ms, n, e, CASE WHEN e > 0 THEN coalesce(buy, 0) END AS buy, CASE WHEN e > 0 THEN coalesce(sell, 0) END AS sell FROM flow)"""


@query(
    "order_flow",
    f"""WITH {TICKS_SQL}, {grid_sql(STEP)}, {FLOW_WINDOW_SQL}
SELECT asset, as_of_ms, n AS trades, e AS eligible, round(CAST(buy AS DOUBLE), 6) AS buy_notional, round(CAST(sell AS DOUBLE), 6) AS sell_notional,
  round(CAST(buy - sell AS DOUBLE), 6) AS net_flow,
  round(CASE WHEN sell = 0 AND buy > 0 THEN CAST(buy AS DOUBLE) * 1e12 WHEN sell <> 0 THEN CAST(buy AS DOUBLE) / CAST(sell AS DOUBLE) END, 4) AS buy_sell_ratio,
  round(CASE WHEN n > 0 THEN CAST(e AS DOUBLE) / n END, 8) AS coverage,
  CASE WHEN n = 0 THEN 'NO_TRADES' WHEN e = 0 THEN 'NONE_ELIGIBLE' WHEN buy = 0 AND sell = 0 THEN 'BOTH_ZERO' ELSE 'KNOWN' END AS flow_state
FROM flows""",
)
def order_flow_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    grid = tick_grid(t)
    flow = features.order_flow(t, rows(t, grid), "asset", grid, WINDOW)
    flow = numbers(flow, "coverage")
    flow = numbers(flow, "buy_sell_ratio", places=4)
    return numbers(flow, "buy_notional", "sell_notional", "net_flow", places=6)


def gaps_of(t: DataFrame, minimum: int = 40) -> DataFrame:
    """A gap: more than ``minimum`` ids passed since the asset's last tick (natural in the data)."""
    from tidewatch.operators.running import Measure, running, with_segments

    scanned = running(
        with_segments(t, "received_ms", tie="id"), ["asset"], ["received_ms", "id"],
        {"previous": Measure("max", F.col("id"))}, inclusive=False,
    )
    return scanned.filter(F.col("id") > F.col("previous") + minimum).select("asset", "received_ms", "id")


GAPS_SQL = """gaps AS (SELECT * FROM (SELECT asset, received_ms, id,
  max(id) OVER (PARTITION BY asset ORDER BY received_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
  FROM ticks) WHERE id > previous + 40)"""

RECEIVED_FLOW_SQL = f"""received_flow AS (
  SELECT g.asset, g.as_of_ms, count(t.id) AS n, min(t.received_ms) AS first_ms, max(t.received_ms) AS last_ms,
    coalesce(sum(CASE WHEN t.side = 'BUY' THEN CAST(t.price * t.quantity AS DECIMAL(20,8)) END), 0) AS buy,
    coalesce(sum(CASE WHEN t.side = 'SELL' THEN CAST(t.price * t.quantity AS DECIMAL(20,8)) END), 0) AS sell
  FROM grid g LEFT JOIN ticks t ON t.asset = g.asset AND t.quantity IS NOT NULL AND t.side <> 'UNKNOWN' AND t.received_ms BETWEEN g.as_of_ms - {WINDOW} AND g.as_of_ms GROUP BY ALL),
last_gap AS (SELECT g.asset, g.as_of_ms, x.received_ms AS gap_ms FROM grid g
  ASOF LEFT JOIN (SELECT asset, received_ms FROM gaps GROUP BY ALL) x ON x.asset = g.asset AND g.as_of_ms >= x.received_ms),
stated AS (SELECT f.*, CASE WHEN gap_ms >= as_of_ms - {WINDOW} THEN 'GAP' WHEN n = 0 THEN 'NO_TRADES'
    WHEN as_of_ms - last_ms > {FRESH} THEN 'STALE' ELSE 'KNOWN' END AS flow_state
  FROM received_flow f JOIN last_gap USING (asset, as_of_ms))"""


@query(
    "order_flow_received",
    f"""WITH {TICKS_SQL}, {grid_sql(STEP)}, {GAPS_SQL}, {RECEIVED_FLOW_SQL}
SELECT asset, as_of_ms, flow_state,
  CASE WHEN flow_state = 'KNOWN' THEN round(CAST(buy AS DOUBLE), 6) END AS buy_notional,
  CASE WHEN flow_state = 'KNOWN' THEN round(CAST(sell AS DOUBLE), 6) END AS sell_notional,
  CASE WHEN flow_state = 'KNOWN' AND sell <> 0 THEN round(CAST(buy AS DOUBLE) / CAST(sell AS DOUBLE), 8) END AS buy_sell_ratio,
  CASE WHEN n > 0 THEN round(least(1.0, CAST(last_ms - first_ms + {FRESH} AS DOUBLE) / {WINDOW}), 8) END AS coverage,
  as_of_ms - last_ms AS flow_age_ms
FROM stated""",
)
def order_flow_received_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    grid = tick_grid(t)
    flow = features.order_flow_received(t, gaps_of(t), rows(t, grid), "asset", grid, WINDOW, FRESH)
    return numbers(numbers(flow, "buy_sell_ratio", "coverage"), "buy_notional", "sell_notional", places=6)


@query(
    "gap_impact",
    f"""WITH {TICKS_SQL}, {grid_sql(STEP)}, {GAPS_SQL}
SELECT g.asset, g.as_of_ms, count(x.id) > 0 AS gap_active, count(x.id) AS active_gaps
FROM grid g LEFT JOIN gaps x ON x.asset = g.asset AND x.received_ms BETWEEN g.as_of_ms - {WINDOW} AND g.as_of_ms GROUP BY ALL""",
)
def gap_impact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    grid = tick_grid(t)
    res = resolution(grid, WINDOW)
    cells = summarise(gaps_of(t), ["asset"], F.col("received_ms"), grid, res, {"n": F.count(F.lit(1))})
    timeline = Timeline(cells, rows(t, grid), ["asset"], grid, res, WINDOW)
    active = timeline.select({"active_gaps": F.coalesce(F.sum("n").over(timeline.window(WINDOW)), F.lit(0))})
    return active.select("asset", "as_of_ms", (F.col("active_gaps") > 0).alias("gap_active"), "active_gaps")


@query(
    "max_drawdown",
    f"""WITH {TICKS_SQL}, {grid_sql(STEP)},
w AS (SELECT g.asset, g.as_of_ms, t.price, max(t.price) OVER (PARTITION BY g.asset, g.as_of_ms
    ORDER BY t.event_ms, t.received_ms, t.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high
  FROM grid g LEFT JOIN ticks t ON t.asset = g.asset AND t.event_ms BETWEEN g.as_of_ms - {WINDOW} AND g.as_of_ms AND t.received_ms <= g.as_of_ms)
SELECT asset, as_of_ms, round(min(CAST(price - high AS DOUBLE) / CAST(high AS DOUBLE)), 8) + 0.0 AS max_drawdown,
  CASE WHEN count(price) > 0 THEN 'KNOWN' ELSE 'UNKNOWN' END AS max_drawdown_state
FROM w GROUP BY ALL""",
)
def max_drawdown_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    grid = tick_grid(t)
    return numbers(features.max_drawdown(t, rows(t, grid), "asset", grid, WINDOW), "max_drawdown")


BASELINE = Decimal("20000")


@query(
    "volume_anomaly",
    f"""WITH {TICKS_SQL}, {grid_sql(STEP, ('all',))}
SELECT g.as_of_ms, round(CAST(sum(CAST(t.price * t.quantity AS DECIMAL(20,8))) AS DOUBLE) / 20000, 8) AS volume_anomaly,
  CASE WHEN count(t.id) > 0 THEN 'KNOWN' ELSE 'UNKNOWN' END AS volume_anomaly_state
FROM grid g LEFT JOIN ticks t ON t.asset IN ('view', 'click', 'signup') AND t.quantity IS NOT NULL
  AND t.event_ms BETWEEN g.as_of_ms - {WINDOW} AND g.as_of_ms AND t.received_ms <= g.as_of_ms GROUP BY ALL""",
)
def volume_anomaly_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    found = features.volume_anomaly(
        t.filter(F.col("asset").isin(*REFERENCES)), tick_grid(t), WINDOW, F.lit(BASELINE).cast("decimal(20,8)")
    )
    return numbers(found, "volume_anomaly")


@query(
    "cross_asset",
    f"""WITH {TICKS_SQL}, {grid_sql(STEP, ASSETS)}, {EVENT_ASOF_SQL},
p AS (SELECT as_of_ms, max(ret) FILTER (asset = 'view') AS a, max(ret) FILTER (asset = 'click') AS b,
  max(ret) FILTER (asset = 'signup') AS c, max(ret) FILTER (asset = 'purchase') AS t, count(ret) AS k FROM ev_return GROUP BY ALL)
SELECT as_of_ms, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN
    CAST((round(a, 15) <= -0.1)::INT + (round(b, 15) <= -0.2)::INT + (round(c, 15) <= -0.3)::INT AS BIGINT) END AS shock_breadth,
  round(t - (a + b + c) / 3, 8) AS excess_return, round(k / 4, 8) AS price_coverage
FROM p""",
)
def cross_asset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    grid = tick_grid(t)
    returns = features.event_return(t, grid.rows(spark, "asset", ASSETS), "asset", grid, WINDOW)
    found = features.cross_asset(returns, "asset", REFERENCES, TARGET, THRESHOLDS)
    return numbers(found, "excess_return", "price_coverage")


@query(
    "required_drawdown",
    f"""WITH {TICKS_SQL}, {CLOSES_SQL},
r AS (SELECT c.asset, CAST(c.price - b.price AS DOUBLE) / CAST(b.price AS DOUBLE) AS ret
  FROM closes c JOIN closes b ON b.asset = c.asset AND b.close_ms = c.close_ms - {HOUR}),
m AS (SELECT asset, count(*) AS samples, CASE WHEN count(*) >= 5 THEN mad(ret) * 1.4826 END AS sigma FROM r GROUP BY ALL)
SELECT asset, samples, round(sigma, 6) AS sigma, CASE WHEN sigma IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END AS sigma_state,
  round(-greatest(CASE asset WHEN 'view' THEN 0.1 WHEN 'click' THEN 0.2 WHEN 'signup' THEN 0.3 WHEN 'purchase' THEN 0.25 END, abs(sigma * 2)), 6) AS required
FROM m""",
)
def required_drawdown_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = features.exact_lag_return(closes(spark, sf_dir), "asset", "close_ms", "price", HOUR)
    sigma = features.mad_scale(returns, ["asset"], "ret", Decimal("1.4826"), 5)
    fixed = lookups.with_thresholds(sigma, "asset", {**THRESHOLDS, "purchase": Decimal("-0.25")}, "fixed")
    need = features.required_drawdown(F.col("fixed").cast("double"), F.col("sigma"), F.lit(2.0))
    return fixed.select(
        "asset", "samples", number("sigma", 6).alias("sigma"), "sigma_state", number(need, 6).alias("required")
    )


@query(
    "rolling_mad",
    f"""WITH {TICKS_SQL}, {grid_sql(STEP)}, {EVENT_ASOF_SQL},
h AS (SELECT a.asset, a.as_of_ms, count(b.ret) AS samples, mad(b.ret) * 1.4826 AS sigma
  FROM ev_return a LEFT JOIN ev_return b ON b.asset = a.asset AND b.as_of_ms >= a.as_of_ms - {DAY} AND b.as_of_ms < a.as_of_ms GROUP BY ALL)
SELECT asset, as_of_ms, samples, CASE WHEN samples >= 5 THEN round(sigma, 6) END AS sigma,
  CASE WHEN samples >= 5 THEN 'KNOWN' ELSE 'UNKNOWN' END AS sigma_state FROM h""",
)
def rolling_mad_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    grid = tick_grid(t)
    returns = features.event_return(t, rows(t, grid), "asset", grid, WINDOW)
    found = features.rolling_mad(returns, "asset", grid, "ret", DAY, Decimal("1.4826"), 5)
    return numbers(found, "sigma", places=6)


@query(
    "flow_zscore",
    f"""WITH {TICKS_SQL}, {grid_sql(STEP)}, {FLOW_WINDOW_SQL},
x AS (SELECT asset, as_of_ms, CAST(buy - sell AS DOUBLE) AS v FROM flows),
h AS (SELECT a.asset, a.as_of_ms, a.v, count(b.v) AS samples, avg(b.v) AS m, stddev_pop(b.v) AS s
  FROM x a LEFT JOIN x b ON b.asset = a.asset AND b.as_of_ms >= a.as_of_ms - {DAY} AND b.as_of_ms < a.as_of_ms GROUP BY ALL)
SELECT asset, as_of_ms, samples, CASE WHEN samples >= 20 AND s > 0 THEN round((v - m) / s, 5) END AS zscore,
  CASE WHEN samples >= 20 AND s > 0 AND v IS NOT NULL THEN 'KNOWN' ELSE 'UNKNOWN' END AS zscore_state FROM h""",
)
def flow_zscore_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    grid = tick_grid(t)
    flow = features.order_flow(t, rows(t, grid), "asset", grid, WINDOW)
    scored = features.flow_zscore(flow, ["asset"], grid, "net_flow", DAY, 20)
    return numbers(scored, "zscore", places=5)


@query(
    "data_health",
    f"""WITH {TICKS_SQL}, {grid_sql(STEP, ASSETS)},
last AS (SELECT g.asset, g.as_of_ms, g.as_of_ms - t.received_ms AS age FROM grid g
  ASOF LEFT JOIN (SELECT asset, received_ms FROM ticks GROUP BY ALL) t ON t.asset = g.asset AND g.as_of_ms >= t.received_ms),
s AS (SELECT asset, as_of_ms, coalesce(age <= {FRESH}, false) AS fresh FROM last),
d AS (SELECT as_of_ms, count(*) FILTER (NOT fresh) AS stale_sources,
  bool_or(NOT fresh AND asset IN ('view', 'signup', 'purchase')) AS essential, (as_of_ms // {HOUR}) % 1500 - 100 AS drift FROM s GROUP BY ALL)
SELECT as_of_ms, stale_sources, CASE WHEN abs(drift) > 1000 OR essential THEN 'BLOCKED' WHEN stale_sources > 0 THEN 'DEGRADED' ELSE 'PASS' END AS health FROM d""",
)
def data_health_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    grid = tick_grid(t)
    state = features.asset_state(t, grid.rows(spark, "asset", ASSETS), "asset", grid, FRESH, WINDOW, RETENTION)
    ages = state.select(
        "asset", "as_of_ms", "age_ms",
        (F.pmod(F.floor(F.col("as_of_ms") / HOUR), F.lit(1500)) - 100).alias("clock_drift_ms"),
        F.lit(False).alias("future_data"), F.lit(0).alias("gap_sources"),
    )
    health = features.data_health(ages, "asset", ASSETS, ["view", "signup", "purchase"], FRESH, 1000)
    return health.select("as_of_ms", F.size("stale_sources").cast("long").alias("stale_sources"), "health")


@query(
    "evidence_union",
    f"""WITH {TICKS_SQL}, ids AS (SELECT DISTINCT asset, unnest([CAST(id AS VARCHAR), 'side:' || side, 'lot:' || coalesce(CAST(CAST(quantity AS BIGINT) AS VARCHAR), 'none')]) AS v FROM ticks)
SELECT asset, v AS evidence_id FROM ids""",
)
def evidence_union_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).select(
        "asset", F.col("id").cast("string").alias("id"),
        F.array(
            F.concat(F.lit("side:"), "side"),
            F.concat(F.lit("lot:"), F.coalesce(F.col("quantity").cast("long").cast("string"), F.lit("none"))),
        ).alias("evidence"),
    )
    return features.evidence_union(t, ["asset"], "id", "evidence")


@query(
    "nearest_rank_quantiles",
    """SELECT event_type, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, max(v) AS max
FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY ALL""",
)
def nearest_rank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    ranks = {"p50": selection.nearest(0.5), "p95": selection.nearest(0.95), "p99": selection.nearest(0.99)}
    found = selection.at_ranks(selection.counted(e, ["event_type"], "v"), ["event_type"], "v", ranks)
    return found.select("event_type", *ranks, F.col("greatest").alias("max"))


@query("approximate_quantiles", "SELECT DISTINCT event_type, true AS p50, true AS p95, true AS p99 FROM events")
def approximate_quantiles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each sketched quantile is within its bound in ranks, one ten-thousandth of the rows, of the exact one."""
    e = table(spark, sf_dir, "events").select("event_type", "value")
    sketch = e.groupBy("event_type").agg(approximate_quantiles("value").alias("sketch"))

    def within(k: int, p: float) -> Column:
        v, n = F.col("sketch")[k], F.count("value")
        low, high = F.count_if(F.col("value") < v), F.count_if(F.col("value") <= v)
        return ((low <= p * n + n / 10_000 + 1) & (high >= p * n - n / 10_000 - 1)).alias(f"p{round(100 * p)}")

    ranked = e.join(sketch, "event_type").groupBy("event_type")
    return ranked.agg(within(0, 0.5), within(1, 0.95), within(2, 0.99))


@query(
    "last_n_samples",
    """SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500""",
)
def last_n_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    kept = last_n_samples(e, ["event_type"], [F.desc("ts"), F.desc("event_id")], 500, F.col("event_id"))
    return kept.select("event_type", "event_id")


@query(
    "bounded_retention",
    f"""WITH {TICKS_SQL} SELECT asset, id, received_ms FROM ticks WHERE received_ms >= (SELECT max(received_ms) FROM ticks) - {DAY}""",
)
def bounded_retention_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = validation.bounded_retention(ticks(spark, sf_dir), "received_ms", DAY)
    return kept.select("asset", "id", "received_ms")


# --- baselines -----------------------------------------------------------------------------

RISK_SQL = f"""risk AS (SELECT user_id, event_id AS risk_id, (epoch_us(ts) // 1000) AS armed_ms FROM events WHERE event_type = 'error'),
series AS (SELECT user_id, event_id AS id, (epoch_us(ts) // 1000) AS observed_ms, (epoch_us(ts) // 1000) + (event_id % 7) * 1800000 AS received_ms,
  CASE WHEN event_id % 11 <> 0 THEN CAST(value AS DECIMAL(20,8)) END AS value FROM events WHERE event_type <> 'error'),
frozen AS (SELECT r.user_id, r.risk_id, r.armed_ms, arg_max(s, (s.observed_ms, s.id)) AS b
  FROM risk r LEFT JOIN series s ON s.user_id = r.user_id AND s.value IS NOT NULL AND s.observed_ms <= r.armed_ms
    AND r.armed_ms - s.observed_ms <= {DAY} AND s.received_ms <= r.armed_ms GROUP BY ALL)"""


def risk_series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Risk events (errors per user) and a delayed, partly unknown series per user."""
    e = table(spark, sf_dir, "events")
    at = to_ms(F.col("ts"))
    risk = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("risk_id"), at.alias("armed_ms"))
    series = e.filter("event_type <> 'error'").select(
        "user_id", F.col("event_id").alias("id"), at.alias("observed_ms"),
        (at + F.pmod("event_id", F.lit(7)) * 1_800_000).alias("received_ms"),
        F.when(F.pmod("event_id", F.lit(11)) != 0, F.col("value").cast("decimal(20,8)")).alias("value"),
    )
    return risk, series


@query(
    "freeze_baseline",
    f"""WITH {RISK_SQL} SELECT user_id, risk_id, armed_ms, b.observed_ms AS baseline_ms, b.id AS baseline_id,
  CAST(b.value AS DOUBLE) AS baseline, CASE WHEN b.value IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END AS baseline_state FROM frozen""",
)
def freeze_baseline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk, series = risk_series(spark, sf_dir)
    return numbers(lookups.freeze_baseline(risk, series, ["user_id"], "armed_ms", DAY), "baseline")


@query(
    "baseline_changes",
    f"""WITH {RISK_SQL}, low AS (SELECT user_id, min(value) AS v, arg_min(observed_ms, (value, observed_ms)) AS at_ms FROM series GROUP BY ALL),
c AS (SELECT f.user_id, f.risk_id, f.armed_ms, CASE WHEN b.value > 0 THEN CAST(v - b.value AS DOUBLE) / CAST(b.value AS DOUBLE) END AS ch, at_ms FROM frozen f LEFT JOIN low USING (user_id))
SELECT user_id, armed_ms, round(ch, 8) AS minimum_change, CASE WHEN ch IS NOT NULL THEN at_ms END AS minimum_ms, coalesce(round(ch, 12) <= -0.05, false) AS limit_reached FROM c""",
)
def baseline_changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk, series = risk_series(spark, sf_dir)
    frozen = lookups.freeze_baseline(risk, series, ["user_id"], "armed_ms", DAY)
    known = series.filter(F.col("value").isNotNull())
    found = lookups.baseline_changes(frozen, known, ["user_id"], "armed_ms", "observed_ms", "value", Decimal("-0.05"))
    return numbers(found, "minimum_change")


@query(
    "counterfactual_baseline",
    f"""WITH {RISK_SQL}, later AS (SELECT r.user_id, r.risk_id, r.armed_ms, arg_max(s, (s.observed_ms, s.id)) AS b
  FROM risk r LEFT JOIN series s ON s.user_id = r.user_id AND s.value IS NOT NULL AND s.observed_ms <= r.armed_ms + {WINDOW}
    AND r.armed_ms + {WINDOW} - s.observed_ms <= {DAY} AND s.received_ms <= r.armed_ms + {WINDOW} GROUP BY ALL)
SELECT f.user_id, f.risk_id, f.armed_ms, CAST(f.b.value AS DOUBLE) AS baseline, CAST(l.b.value AS DOUBLE) AS illegal_baseline,
  f.b.observed_ms IS DISTINCT FROM l.b.observed_ms AS differs FROM frozen f JOIN later l USING (user_id, risk_id, armed_ms)""",
)
def counterfactual_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk, series = risk_series(spark, sf_dir)
    events = risk.withColumn("later_ms", F.col("armed_ms") + WINDOW)
    found = lookups.counterfactual_baseline(events, series, ["user_id"], "armed_ms", "later_ms", DAY)
    return numbers(found, "baseline", "illegal_baseline").select(
        "user_id", "risk_id", "armed_ms", "baseline", "illegal_baseline", "differs"
    )


@query(
    "series_changes",
    """WITH f AS (SELECT user_id, arg_min(CAST(value AS DECIMAL(20,8)), (ts, event_id)) AS baseline FROM events GROUP BY ALL)
SELECT e.event_id, round(CAST(CAST(value AS DECIMAL(20,8)) - baseline AS DOUBLE) / CAST(baseline AS DOUBLE), 8) AS change
FROM events e JOIN f USING (user_id)""",
)
def series_changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(20,8)"))
    first = e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "value"))["value"].alias("baseline"))
    changed = lookups.series_changes(e, first, ["user_id"], "value")
    return numbers(changed, "change").select("event_id", "change")


@query(
    "event_low",
    f"""SELECT l_returnflag AS asset, min(p) AS low, arg_min(at_ms, (p, at_ms)) AS low_ms FROM (
  SELECT l_returnflag, (epoch_us(l_shipdate) // 1000) AS at_ms, CAST(round(l_extendedprice * 100) AS BIGINT) AS p FROM lineitem
  WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31') GROUP BY ALL""",
)
def event_low_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("asset"), to_ms(F.col("l_shipdate")).alias("at"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("p"),
    )
    start, end = F.lit(820454400000), F.lit(946598400000)
    return lookups.event_low(li, ["asset"], "at", "p", start, end)
