"""Panels and staged decisions over the event ticks and document news.

Events are minutes apart, so the windows are hours: one evaluation an hour, six-hour returns.
"""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import DEFAULT, PANEL_TRANSITIONS
from tidewatch.operators import features, lookups, news as news_ops
from tidewatch.operators.ordered import first_hits, persistence
from tidewatch.plans import panels, reports, staged
from tidewatch.session import checkpointed
from tidewatch.workload.market import (
    FLOW_WINDOW_SQL, GAPS_SQL, RECEIVED_FLOW_SQL, ONE_PER_TIME, EVENT_ASOF_SQL, gaps_of, tick_grid,
)
from tidewatch.workload.registry import number, numbers, query
from tidewatch.workload.tables import ASSETS, DAY, HOUR, REFERENCES, TARGET, TICKS_SQL, grid_sql, table, ticks

STEP, WINDOW, RETENTION, FRESH = HOUR, 6 * HOUR, DAY, 2 * HOUR
RULES = replace(
    DEFAULT.panel, return_window_ms=WINDOW, retention_ms=RETENTION, freshness_ms=FRESH, macro_arm_window_ms=12 * HOUR,
    cross_asset_maximum=(Decimal("-0.1"), Decimal("-0.2"), Decimal("-0.3")), relative_return_maximum=Decimal("-0.25"),
    sell_pressure_seconds=3600, macro_quiet_seconds=4 * 3600, no_new_low_seconds=24 * 3600, relative_recovery_seconds=2 * 3600,
    flow_normal_seconds=2 * 3600, sell_ratio_maximum=Decimal("0.8"), rebuy_ratio_minimum=Decimal("1.1"),
)
START = 1704067200000
ITEM_STEP = 600_000


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ten minutes apart, classified by their labels and language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    occurred = F.lit(START) + F.col("doc_id") * ITEM_STEP
    return d.select(
        F.col("doc_id").alias("item_id"), occurred.alias("occurred_ms"),
        (occurred + F.pmod("doc_id", F.lit(5)) * ITEM_STEP).alias("received_ms"),
        F.col("quality").isNotNull().alias("macro_relevant"),
        F.when(F.col("lang") == "en", "RISK_OFF").otherwise("UNKNOWN").alias("direction"),
        F.when(F.col("toxic") == 1, "SYSTEMIC").when(F.col("quality") == 0, "HIGH").otherwise("MEDIUM").alias("severity"),
    )


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    grid = tick_grid(t)
    health = grid.instants(spark).select(
        "as_of_ms",
        F.when(F.pmod(F.floor(F.col("as_of_ms") / HOUR), F.lit(97)) == 0, "STALE").otherwise("HEALTHY").alias("news_status"),
        F.lit("HEALTHY").alias("market_status"),
    )
    return panels.evaluate(
        t, t, gaps_of(t, 200), news_items(spark, sf_dir), health, "asset", grid, REFERENCES, TARGET, RULES
    )


def _hours(condition: str, name: str) -> str:
    """Seconds a condition has held on the hourly grid."""
    return f"CASE WHEN {condition} THEN (as_of_ms - coalesce(max(CASE WHEN NOT coalesce({condition}, false) THEN as_of_ms END) OVER w + {STEP}, (SELECT s FROM bounds))) // 1000 ELSE 0 END AS {name}"


PANEL_SQL = f"""{TICKS_SQL}, {grid_sql(STEP, ASSETS)}, {GAPS_SQL.replace('previous + 40', 'previous + 200')}, {ONE_PER_TIME},
{RECEIVED_FLOW_SQL.replace(f'> {HOUR // 2} THEN', f'> {FRESH} THEN')},
found AS (SELECT g.asset, g.as_of_ms, n.received_ms AS n_ms, n.r AS n, b.received_ms AS b_ms, b.r AS b FROM grid g
  ASOF LEFT JOIN newest n ON g.asset = n.asset AND g.as_of_ms >= n.received_ms
  ASOF LEFT JOIN newest b ON g.asset = b.asset AND g.as_of_ms - {WINDOW} >= b.received_ms),
asset_rows AS (SELECT asset, as_of_ms, CASE WHEN n_ms >= as_of_ms - {RETENTION} THEN n.price END AS price,
  CASE WHEN n_ms IS NULL OR n_ms < as_of_ms - {RETENTION} THEN 'UNKNOWN' WHEN as_of_ms - n_ms <= {FRESH} THEN 'FRESH' ELSE 'STALE' END AS freshness,
  CASE WHEN as_of_ms - n_ms <= {FRESH} AND b_ms >= as_of_ms - {RETENTION} THEN CAST(n.price - b.price AS DOUBLE) / CAST(b.price AS DOUBLE) END AS ret FROM found),
lows AS (SELECT *, arg_min(as_of_ms, (price, as_of_ms)) FILTER (freshness = 'FRESH') OVER (PARTITION BY asset ORDER BY as_of_ms ROWS UNBOUNDED PRECEDING) AS low_ms FROM asset_rows),
wide AS (SELECT as_of_ms, max(ret) FILTER (asset = 'view') AS r0, max(ret) FILTER (asset = 'click') AS r1, max(ret) FILTER (asset = 'signup') AS r2, max(ret) FILTER (asset = 'purchase') AS r3,
  count(*) FILTER (freshness = 'FRESH') AS fresh_assets, count(*) FILTER (freshness = 'STALE') AS stale_assets, count(*) FILTER (freshness = 'STALE' AND asset <> 'purchase') AS stale_refs, max(low_ms) AS last_low_ms FROM lows GROUP BY ALL),
news AS (SELECT doc_id AS item_id, {START} + doc_id * {ITEM_STEP} AS occurred_ms, {START} + doc_id * {ITEM_STEP} + (doc_id % 5) * {ITEM_STEP} AS received_ms FROM documents JOIN labels USING (doc_id)
  WHERE lang = 'en' AND (toxic = 1 OR quality = 0)),
item AS (SELECT g.as_of_ms, max(i.received_ms) AS item_ms FROM (SELECT DISTINCT as_of_ms FROM grid) g LEFT JOIN news i ON greatest(occurred_ms, received_ms) <= g.as_of_ms AND g.as_of_ms <= least(occurred_ms, received_ms) + {12 * HOUR} GROUP BY ALL),
frame AS (SELECT w.*, r3 - (r0 + r1 + r2) / 3 AS excess, s.flow_state, CASE WHEN flow_state = 'KNOWN' THEN CAST(buy AS DOUBLE) END AS buy, CASE WHEN flow_state = 'KNOWN' THEN CAST(sell AS DOUBLE) END AS sell,
  CASE WHEN flow_state = 'KNOWN' AND sell <> 0 THEN CAST(buy AS DOUBLE) / CAST(sell AS DOUBLE) END AS ratio, item_ms, (as_of_ms // {HOUR}) % 97 <> 0 AS usable
  FROM wide w JOIN (SELECT * FROM stated WHERE asset = 'purchase') s USING (as_of_ms) JOIN item USING (as_of_ms)),
flags AS (SELECT *, coalesce(buy > 0 AND sell = 0, false) AS only_buys, flow_state = 'KNOWN' AND ratio <= 0.8 AS pressing, flow_state = 'KNOWN' AND (coalesce(buy > 0 AND sell = 0, false) OR coalesce(ratio >= 1.1, false)) AS normal FROM frame),
timed AS (SELECT *, {_hours('pressing', 'pressure_seconds')}, {_hours('excess >= 0', 'recovery_seconds')}, {_hours('normal', 'normal_seconds')}, (as_of_ms - item_ms) // 1000 AS item_age, coalesce((as_of_ms - last_low_ms) // 1000, 0) AS low_seconds
  FROM flags WINDOW w AS (ORDER BY as_of_ms ROWS UNBOUNDED PRECEDING)),
cond AS (SELECT *, CASE WHEN NOT usable THEN 'STALE' WHEN item_ms IS NULL THEN 'FAIL' ELSE 'PASS' END AS S1,
  CASE WHEN r0 IS NULL OR r1 IS NULL OR r2 IS NULL THEN CASE WHEN stale_refs > 0 THEN 'STALE' ELSE 'UNKNOWN' END WHEN (r0 <= -0.1)::INT + (r1 <= -0.2)::INT + (r2 <= -0.3)::INT >= 2 THEN 'PASS' ELSE 'FAIL' END AS S2,
  CASE WHEN excess IS NULL THEN CASE WHEN stale_assets > 0 THEN 'STALE' ELSE 'UNKNOWN' END WHEN excess <= -0.25 THEN 'PASS' ELSE 'FAIL' END AS S3,
  CASE WHEN flow_state = 'STALE' THEN 'STALE' WHEN flow_state <> 'KNOWN' THEN 'UNKNOWN' WHEN ratio <= 0.8 AND pressure_seconds >= 3600 THEN 'PASS' ELSE 'FAIL' END AS S4,
  CASE WHEN NOT usable THEN 'STALE' WHEN item_ms IS NULL OR item_age >= 14400 THEN 'PASS' ELSE 'FAIL' END AS B1,
  CASE WHEN fresh_assets < 4 THEN CASE WHEN stale_assets > 0 THEN 'STALE' ELSE 'UNKNOWN' END WHEN low_seconds >= 86400 THEN 'PASS' ELSE 'FAIL' END AS B2,
  CASE WHEN excess IS NULL THEN CASE WHEN stale_assets > 0 THEN 'STALE' ELSE 'UNKNOWN' END WHEN excess >= 0 AND recovery_seconds >= 7200 THEN 'PASS' ELSE 'FAIL' END AS B3,
  CASE WHEN flow_state = 'STALE' THEN 'STALE' WHEN flow_state <> 'KNOWN' THEN 'UNKNOWN' WHEN (only_buys OR coalesce(ratio >= 1.1, false)) AND normal_seconds >= 7200 THEN 'PASS' ELSE 'FAIL' END AS B4 FROM timed),
progress AS (SELECT *, CASE WHEN usable THEN CASE WHEN item_ms IS NULL THEN 0.0 ELSE 1.0 END END AS S1_progress,
  CASE WHEN r0 IS NOT NULL AND r1 IS NOT NULL AND r2 IS NOT NULL THEN least(1.0, ((r0 <= -0.1)::INT + (r1 <= -0.2)::INT + (r2 <= -0.3)::INT) / 2.0) END AS S2_progress,
  CASE WHEN excess IS NULL THEN NULL WHEN excess <= -0.25 THEN 1.0 WHEN excess >= 0 THEN 0.0 ELSE least(1.0, abs(excess) / 0.25) END AS S3_progress,
  CASE WHEN ratio IS NOT NULL THEN least(1.0, CASE WHEN ratio <= 0.8 THEN 1.0 ELSE 0.0 END, pressure_seconds / 3600.0) END AS S4_progress,
  CASE WHEN usable THEN CASE WHEN item_ms IS NULL THEN 1.0 ELSE least(1.0, item_age / 14400.0) END END AS B1_progress,
  CASE WHEN fresh_assets = 4 THEN least(1.0, low_seconds / 86400.0) END AS B2_progress,
  CASE WHEN excess IS NOT NULL THEN least(CASE WHEN excess >= 0 THEN 1.0 ELSE 0.0 END, least(1.0, recovery_seconds / 7200.0)) END AS B3_progress,
  CASE WHEN only_buys OR ratio IS NOT NULL THEN least(1.0, CASE WHEN only_buys OR ratio >= 1.1 THEN 1.0 WHEN ratio <= 0 THEN 0.0 ELSE ratio / 1.1 END, normal_seconds / 7200.0) END AS B4_progress FROM cond),
counted AS (SELECT *, (S1 = 'PASS')::INT + (S2 = 'PASS')::INT + (S3 = 'PASS')::INT + (S4 = 'PASS')::INT AS sp, (B1 = 'PASS')::INT + (B2 = 'PASS')::INT + (B3 = 'PASS')::INT + (B4 = 'PASS')::INT AS bp FROM progress),
latched AS (SELECT *, min(CASE WHEN sp = 4 THEN as_of_ms END) OVER (ORDER BY as_of_ms ROWS UNBOUNDED PRECEDING) AS context_ms FROM counted),
panels AS (SELECT *, CASE WHEN sp = 4 THEN 'SELL_READY' WHEN S1 = 'PASS' THEN 'NEWS_ARMED' WHEN S2 = 'PASS' AND S3 = 'PASS' AND S4 = 'PASS' THEN 'MARKET_ARMED'
    WHEN 'UNKNOWN' IN (S2, S3, S4) OR 'STALE' IN (S2, S3, S4) OR NOT usable THEN 'DATA_UNAVAILABLE' ELSE 'NO_ACTION' END AS sell_stage,
  CASE WHEN bp = 4 AND context_ms IS NOT NULL THEN 'REBUY_READY' WHEN 'UNKNOWN' IN (B1, B2, B3, B4) OR 'STALE' IN (B1, B2, B3, B4) THEN 'DATA_UNAVAILABLE' WHEN context_ms IS NOT NULL OR bp > 0 THEN 'REBUY_WAIT' ELSE 'NO_ACTION' END AS rebuy_stage FROM latched)"""


@query(
    "panel_conditions",
    f"""WITH {PANEL_SQL} SELECT as_of_ms, S1, S2, S3, S4, B1, B2, B3, B4, {", ".join(f"round({c}_progress, 7)::DOUBLE AS {c}_progress" for c in ("S1", "S2", "S3", "S4", "B1", "B2", "B3", "B4"))} FROM panels""",
)
def conditions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (*panels.SELL_CONDITIONS, *panels.REBUY_CONDITIONS)
    judged = evaluated(spark, sf_dir)
    return judged.select("as_of_ms", *names, *[number(f"{n}_progress", 7).alias(f"{n}_progress") for n in names])


_NEXT = "CASE {} END".format
_SELL_GAP = " ".join(f"WHEN {c} <> 'PASS' THEN '{c}'" for c in ("S1", "S2", "S3", "S4"))
_BUY_GAP = " ".join(f"WHEN {c} <> 'PASS' THEN '{c}'" for c in ("B1", "B2", "B3", "B4"))


@query(
    "decision_panels",
    f"""WITH {PANEL_SQL} SELECT as_of_ms, sell_stage, CASE WHEN sell_stage = 'SELL_READY' THEN 'SHADOW_CANDIDATE' WHEN sell_stage IN ('NEWS_ARMED', 'MARKET_ARMED') THEN 'WATCH' ELSE 'NO_ACTION' END AS sell_output,
  CAST(sp AS BIGINT) AS sell_passed, CASE {_SELL_GAP} END AS sell_next_gap, rebuy_stage, CASE WHEN rebuy_stage = 'REBUY_READY' THEN 'SHADOW_CANDIDATE' ELSE 'NO_ACTION' END AS rebuy_output, CAST(bp AS BIGINT) AS rebuy_passed,
  CASE WHEN bp = 4 AND context_ms IS NULL THEN 'SELL_CONTEXT' {_BUY_GAP} END AS rebuy_next_gap, CASE WHEN context_ms IS NULL THEN 'NONE' ELSE 'SHADOW_REFERENCE' END AS context, context_ms FROM panels""",
)
def panels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select(
        "as_of_ms", "sell_stage", "sell_output", "sell_passed", "sell_next_gap", "rebuy_stage", "rebuy_output", "rebuy_passed",
        "rebuy_next_gap", "context", "context_ms",
    )


@query(
    "panel_stage_changes",
    f"""WITH {PANEL_SQL}, s AS (SELECT as_of_ms, 'SELL' AS model, sell_stage AS stage FROM panels UNION ALL SELECT as_of_ms, 'REBUY', rebuy_stage FROM panels)
SELECT as_of_ms, model, before AS from_stage, stage FROM (SELECT *, lag(stage) OVER (PARTITION BY model ORDER BY as_of_ms) AS before FROM s) WHERE before IS NULL OR before <> stage""",
)
def changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.stage_rows(evaluated(spark, sf_dir))
    return reports.transitions(rows, ["model"], "as_of_ms", 4096 * STEP).select("as_of_ms", "model", "from_stage", "stage")


@query(
    "panel_milestones",
    f"""WITH {PANEL_SQL} SELECT min(as_of_ms) FILTER (sell_stage = 'SELL_READY') AS first_sell_ready_ms, min(as_of_ms) FILTER (rebuy_stage = 'REBUY_READY') AS first_rebuy_ready_ms FROM panels""",
)
def milestones_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.replay_milestones(evaluated(spark, sf_dir)).drop("run")


@query(
    "dashboard_state",
    f"""WITH {PANEL_SQL} SELECT as_of_ms, item_ms, sell_stage, rebuy_stage, concat_ws(',', S1, S2, S3, S4) AS sell_states, fresh_assets FROM panels""",
)
def dashboard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = panels.dashboard(evaluated(spark, sf_dir), REFERENCES, TARGET)
    states = F.array_join(F.transform("sell.conditions", lambda c: c["state"]), ",")
    fresh = F.size(F.filter("market", lambda m: m["freshness"] == "FRESH")).cast("long")
    return shown.select(
        "as_of_ms", F.col("latest_macro_item.received_ms").alias("item_ms"), F.col("sell.stage").alias("sell_stage"),
        F.col("rebuy.stage").alias("rebuy_stage"), states.alias("sell_states"), fresh.alias("fresh_assets"),
    )


# --- staged model --------------------------------------------------------------------------

S_RULES = replace(
    DEFAULT.staged, window_ms=WINDOW, price_freshness_seconds=FRESH // 1000, sell_persistence_seconds=3600, flow_persistence_seconds=7200,
    stability_seconds=7200, no_new_low_seconds=12 * 3600, open_interest_decline=Decimal("-0.5"), volatility_multiplier=Decimal("0.25"),
    breadth_minimum=2, volume_anomaly_minimum=Decimal("1"), sell_ratio_maximum=Decimal("0.8"),
)
FIXED = (Decimal("-0.1"), Decimal("-0.2"), Decimal("-0.3"), Decimal("-0.25"))
THRESHOLDS = dict(zip(REFERENCES, FIXED, strict=False))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    grid = tick_grid(t)
    return staged.feature_snapshot(
        t, t, "asset", grid, REFERENCES, TARGET, THRESHOLDS, F.lit(Decimal(20000)).cast("decimal(20,8)"), S_RULES,
        WINDOW, DAY, F.pmod(F.floor(F.col("as_of_ms") / HOUR), F.lit(1020)),
    )


_SIGMA = """SELECT a.asset, a.as_of_ms, CASE WHEN count(b.ret) >= 5 THEN mad(b.ret) * 1.4826 END AS sigma FROM ev_return a LEFT JOIN ev_return b ON b.asset = a.asset
  AND b.as_of_ms >= a.as_of_ms - {day} AND b.as_of_ms < a.as_of_ms GROUP BY ALL""".format(day=DAY)
SNAPSHOT_SQL = f"""{TICKS_SQL}, {grid_sql(STEP, ASSETS)}, {EVENT_ASOF_SQL}, {FLOW_WINDOW_SQL}, sig AS ({_SIGMA}),
wide AS (SELECT as_of_ms, max(ret) FILTER (asset = 'view') AS r0, max(ret) FILTER (asset = 'click') AS r1, max(ret) FILTER (asset = 'signup') AS r2, max(ret) FILTER (asset = 'purchase') AS r3,
  max(sigma) FILTER (asset = 'view') AS s0, max(sigma) FILTER (asset = 'signup') AS s2, max(sigma) FILTER (asset = 'purchase') AS s3, count(ret) AS known,
  count(*) FILTER (coalesce(as_of_ms - latest_received_ms > {FRESH}, true)) AS stale, bool_or(coalesce(as_of_ms - latest_received_ms > {FRESH}, true) AND asset IN ('view', 'signup', 'purchase')) AS essential
  FROM ev_return JOIN sig USING (asset, as_of_ms) GROUP BY ALL),
vol AS (SELECT g.as_of_ms, CAST(sum(CAST(t.price * t.quantity AS DECIMAL(20,8))) AS DOUBLE) / 20000 AS volume FROM (SELECT DISTINCT as_of_ms FROM grid) g LEFT JOIN ticks t ON t.asset IN ('view', 'click', 'signup') AND t.quantity IS NOT NULL
  AND t.event_ms BETWEEN g.as_of_ms - {WINDOW} AND g.as_of_ms AND t.received_ms <= g.as_of_ms GROUP BY ALL),
snap AS (SELECT w.*, CASE WHEN r0 IS NOT NULL AND r1 IS NOT NULL AND r2 IS NOT NULL THEN (r0 <= -0.1)::INT + (r1 <= -0.2)::INT + (r2 <= -0.3)::INT END AS breadth, r3 - (r0 + r1 + r2) / 3 AS excess, volume,
  CASE WHEN f.sell = 0 AND f.buy > 0 THEN CAST(f.buy AS DOUBLE) * 1e12 WHEN f.sell <> 0 THEN CAST(f.buy AS DOUBLE) / CAST(f.sell AS DOUBLE) END AS ratio,
  CASE WHEN (as_of_ms // {HOUR}) % 1020 > 1000 OR essential THEN 'BLOCKED' WHEN stale > 0 THEN 'DEGRADED' ELSE 'PASS' END AS health
  FROM wide w JOIN (SELECT * FROM flows WHERE asset = 'purchase') f USING (as_of_ms) JOIN vol USING (as_of_ms))"""


@query(
    "feature_snapshot",
    f"""WITH {SNAPSHOT_SQL} SELECT as_of_ms, round(r3, 7) AS ret_target, CAST(breadth AS BIGINT) AS shock_breadth, round(excess, 7) AS excess_return, round(volume, 6) AS volume_anomaly, round(ratio, 4) AS buy_sell_ratio,
  round(known / 4.0, 8)::DOUBLE AS price_coverage, health, true AS has_id FROM snap""",
)
def snapshot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir)
    return s.select(
        "as_of_ms", number("ret_3", 7).alias("ret_target"), "shock_breadth", number("excess_return", 7).alias("excess_return"),
        number("volume_anomaly", 6).alias("volume_anomaly"), number("buy_sell_ratio", 4).alias("buy_sell_ratio"),
        number("price_coverage").alias("price_coverage"), "health", F.col("snapshot_id").rlike("^feature-[0-9a-f]{24}$").alias("has_id"),
    )


def timed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with the seconds their flow and stability conditions have held, null where they do not."""
    s = checkpointed(snapshots(spark, sf_dir))
    ratio = F.col("buy_sell_ratio")
    timed = panels.grid_timers(
        s, [], tick_grid(ticks(spark, sf_dir)),
        {
            "__p": ratio <= F.lit(Decimal("0.8")), "__r": ratio >= F.lit(Decimal("1.1")),
            "__s": (F.col("ret_0") >= F.lit(Decimal("-0.1"))) & (F.col("ret_2") >= F.lit(Decimal("-0.3"))),
        },
    )
    active = lambda timer, on: F.when(F.coalesce(on, F.lit(False)), F.col(timer))
    return timed.select(
        "*", F.lit(False).alias("future_data"),
        active("__p", ratio <= F.lit(Decimal("0.8"))).alias("pressure_seconds"),
        active("__r", ratio >= F.lit(Decimal("1.1"))).alias("recovery_seconds"),
        active("__s", (F.col("ret_0") >= F.lit(Decimal("-0.1"))) & (F.col("ret_2") >= F.lit(Decimal("-0.3")))).alias("stability_seconds"),
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed snapshots with news context and quote outcome by formula; :mod:`tidewatch.workload.inputs` has them from data."""
    hour = F.floor(F.col("as_of_ms") / HOUR)
    return timed_snapshots(spark, sf_dir).select(
        "*",
        F.when(F.pmod(hour, F.lit(3)) == 0, "NEWS_ARMED").when(F.pmod(hour, F.lit(3)) == 1, "NO_NEWS").otherwise("UNKNOWN").alias("news_context"),
        (F.pmod(hour, F.lit(5)) != 0).alias("executable"),
        (F.pmod(hour, F.lit(30)) * 3600).alias("seconds_since_low"),
        F.col("ret_3").alias("open_interest_change"),
        F.when(F.pmod(hour, F.lit(11)) == 0, "FAIL").otherwise("PASS").alias("permanent_damage"),
        (F.pmod(hour, F.lit(13)) != 0).alias("has_sell_fact"),
        F.when(F.pmod(hour, F.lit(2)) == 0, F.col("as_of_ms") - F.pmod(hour, F.lit(7)) * 100_000).alias("first_tranche_ms"),
    )


def _held(condition: str) -> str:
    return f"CASE WHEN {condition} THEN (as_of_ms - coalesce(max(CASE WHEN NOT coalesce({condition}, false) THEN as_of_ms END) OVER w + {STEP}, (SELECT s FROM bounds))) // 1000 END"


JUDGED_SQL = f"""{SNAPSHOT_SQL}, j AS (SELECT *, {_held('ratio <= 0.8')} AS pressure, {_held('ratio >= 1.1')} AS recovery, {_held('(r0 >= -0.1 AND r2 >= -0.3)')} AS stability, as_of_ms // {HOUR} AS h FROM snap WINDOW w AS (ORDER BY as_of_ms ROWS UNBOUNDED PRECEDING))"""


def _fall(i: int, fixed: float) -> str:
    return f"CASE WHEN s{i} IS NULL OR r{i} IS NULL THEN 'UNKNOWN' WHEN r{i} <= -greatest({fixed}, s{i} * 0.25) THEN 'PASS' ELSE 'FAIL' END"


@query(
    "staged_sell",
    f"""WITH {JUDGED_SQL}, c AS (SELECT *, coalesce(breadth >= 2 AND volume >= 1, false) AS armed, breadth IS NOT NULL AND volume IS NOT NULL AS arm_known, [{_fall(0, 0.1)}, {_fall(2, 0.3)}, {_fall(3, 0.25)}] AS falls,
  [CASE WHEN ratio IS NULL THEN 'UNKNOWN' WHEN ratio <= 0.8 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN pressure IS NULL THEN 'UNKNOWN' WHEN pressure >= 3600 THEN 'PASS' ELSE 'FAIL' END] AS flow FROM j),
d AS (SELECT *, CASE WHEN h % 3 = 2 AND NOT arm_known THEN 'UNKNOWN' WHEN h % 3 = 0 OR armed THEN 'PASS' ELSE 'FAIL' END AS risk, CASE WHEN list_unique(falls) = 1 AND falls[1] = 'PASS' THEN 'PASS' WHEN list_contains(falls, 'UNKNOWN') THEN 'UNKNOWN' ELSE 'FAIL' END AS shock,
  CASE WHEN list_unique(flow) = 1 AND flow[1] = 'PASS' THEN 'PASS' WHEN list_contains(flow, 'UNKNOWN') THEN 'UNKNOWN' ELSE 'FAIL' END AS sf, h % 5 <> 0 AS ex FROM c),
e AS (SELECT *, CASE WHEN health <> 'PASS' THEN 'DATA_BLOCKED' WHEN risk <> 'PASS' THEN 'SELL_IDLE' WHEN shock <> 'PASS' THEN CASE WHEN h % 3 = 0 THEN 'NEWS_ARMED' ELSE 'MARKET_ARMED' END WHEN sf <> 'PASS' THEN 'SELL_PRETRIGGER' ELSE 'SELL_CONFIRMED' END AS stage FROM d)
SELECT as_of_ms, stage, risk AS risk_context, shock AS market_shock, sf AS sell_flow, CAST((risk = 'PASS')::INT + (shock = 'PASS')::INT + (sf = 'PASS')::INT + ex::INT AS BIGINT) AS passed,
  CASE WHEN stage = 'DATA_BLOCKED' THEN 'BLOCKED' WHEN stage IN ('SELL_PRETRIGGER', 'SELL_CONFIRMED') AND NOT ex THEN 'BLOCKED' WHEN stage = 'SELL_PRETRIGGER' THEN 'SHADOW_SELL_TRANCHE_1' WHEN stage = 'SELL_CONFIRMED' THEN 'SHADOW_SELL_TRANCHE_2' WHEN stage <> 'SELL_IDLE' THEN 'WATCH' ELSE 'NO_ACTION' END AS action,
  CAST(CASE WHEN ex AND stage = 'SELL_PRETRIGGER' THEN 0.25 WHEN ex AND stage = 'SELL_CONFIRMED' THEN 0.75 ELSE 0 END AS DOUBLE) AS fraction FROM e""",
)
def sell_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = staged.evaluate_sell(_judged(spark, sf_dir), FIXED, (0, 2, 3), F.lit("REPLAY"), F.lit("POSITIVE_EV_NOT_PROVEN"), S_RULES)
    return out.select(
        "as_of_ms", "stage", "risk_context", "market_shock", "sell_flow", "passed", "action", F.col("fraction").cast("double").alias("fraction")
    )


@query(
    "staged_rebuy",
    f"""WITH {JUDGED_SQL}, c AS (SELECT *, CASE WHEN (h % 30) * 3600 >= 43200 THEN 'PASS' ELSE 'FAIL' END AS b1, CASE WHEN r3 IS NULL THEN 'UNKNOWN' WHEN r3 <= -0.5 THEN 'PASS' ELSE 'FAIL' END AS b2,
  CASE WHEN coalesce(ratio >= 1.1 AND recovery >= 7200, false) THEN 'PASS' WHEN ratio IS NULL OR recovery IS NULL THEN 'UNKNOWN' ELSE 'FAIL' END AS b3,
  CASE WHEN coalesce(r0 >= -0.1 AND r2 >= -0.3 AND stability >= 7200, false) THEN 'PASS' WHEN r0 IS NULL OR r2 IS NULL OR stability IS NULL THEN 'UNKNOWN' ELSE 'FAIL' END AS b4, h % 5 <> 0 AS ex, CASE WHEN h % 2 = 0 THEN as_of_ms - (h % 7) * 100000 END AS ft FROM j),
d AS (SELECT *, (b1 = 'PASS')::INT + (b2 = 'PASS')::INT + (b3 = 'PASS')::INT + (b4 = 'PASS')::INT AS m FROM c),
e AS (SELECT *, CASE WHEN h % 13 = 0 THEN 'REBUY_INACTIVE' WHEN h % 11 = 0 THEN 'REBUY_VETOED' WHEN health <> 'PASS' THEN 'REBUY_WAIT' WHEN m < 4 THEN CASE WHEN ft IS NULL AND m >= 3 THEN 'REBUY_ARMED' ELSE 'REBUY_WAIT' END WHEN NOT ex THEN 'REBUY_ARMED' WHEN ft IS NULL THEN 'REBUY_TRANCHE_1'
  WHEN (as_of_ms - ft) / 1000.0 >= 300 THEN 'REBUY_COMPLETE' ELSE 'REBUY_TRANCHE_2_WAIT' END AS stage FROM d)
SELECT as_of_ms, stage, b1 AS no_new_low, b2 AS open_interest_flush, b3 AS flow_recovery, b4 AS market_stability, CAST(m + ex::INT AS BIGINT) AS passed,
  CASE stage WHEN 'REBUY_VETOED' THEN 'VETOED' WHEN 'REBUY_ARMED' THEN 'PREPARE_REBUY_QUOTE' WHEN 'REBUY_TRANCHE_1' THEN 'SHADOW_REBUY_TRANCHE_1' WHEN 'REBUY_COMPLETE' THEN 'SHADOW_REBUY_TRANCHE_2' WHEN 'REBUY_INACTIVE' THEN 'NO_ACTION' ELSE 'WATCH' END AS action FROM e""",
)
def rebuy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = staged.evaluate_rebuy(
        _judged(spark, sf_dir), ((0, Decimal("-0.1")), (2, Decimal("-0.3"))), F.lit("REPLAY"), F.lit("POSITIVE_EV_NOT_PROVEN"), S_RULES
    )
    return out.select(
        "as_of_ms", "stage", "no_new_low", "open_interest_flush", "flow_recovery", "market_stability", "passed", "action"
    )
