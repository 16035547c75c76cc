"""Staged decisions whose inputs come from news, quotes, readings of open interest and prices."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans import inputs, staged
from tidewatch.session import checkpointed
from tidewatch.workload.decisions import (
    FIXED, FRESH, ITEM_STEP, JUDGED_SQL, S_RULES, START, WINDOW, _fall, news_items, timed_snapshots,
)
from tidewatch.workload.market import tick_grid
from tidewatch.workload.registry import number, query
from tidewatch.workload.tables import HOUR, TARGET, TICKS_SQL, grid_sql, table, ticks

ARMED, SILENT, DAMAGE = 2 * HOUR, 6 * HOUR, HOUR
WINDOWS = inputs.InputWindows(armed_ms=ARMED, silent_ms=SILENT, damage_ms=DAMAGE, quote_ms=FRESH, interest_ms=WINDOW)
STABLE = ((0, Decimal("-0.1")), (2, Decimal("-0.3")))
NO_NEW_LOW, DECLINE = S_RULES.no_new_low_seconds, S_RULES.open_interest_decline
MODE, ECONOMIC = "REPLAY", "POSITIVE_EV_NOT_PROVEN"

# Sign-ups stand for quotes of the target, errors for readings of open interest.
INPUTS_SQL = f"""news AS (SELECT {START} + d.doc_id * {ITEM_STEP} + d.doc_id % 5 * {ITEM_STEP} AS ms, coalesce(l.toxic = 1 OR l.quality = 0, false) AS armed, coalesce(l.toxic = 1 AND d.lang = 'en', false) AS damaging
  FROM documents d LEFT JOIN labels l USING (doc_id)),
quotes AS (SELECT received_ms AS ms, arg_max(quantity IS NOT NULL AND side <> 'UNKNOWN', id) AS ok FROM ticks WHERE asset = 'signup' GROUP BY ALL),
interest AS (SELECT received_ms AS ms, arg_max(struct_pack(oi := price), id).oi AS oi FROM ticks WHERE asset = 'error' GROUP BY ALL),
instants AS (SELECT DISTINCT as_of_ms FROM grid),
lows AS (SELECT as_of_ms, arg_min(event_ms, (price, event_ms)) AS low_ms FROM instants JOIN ticks ON asset = '{TARGET}' AND price IS NOT NULL AND received_ms <= as_of_ms GROUP BY ALL),
inputs AS (SELECT t.as_of_ms, CASE WHEN coalesce(a.ms >= t.as_of_ms - {ARMED}, false) THEN 'NEWS_ARMED' WHEN coalesce(i.ms >= t.as_of_ms - {SILENT}, false) THEN 'NO_NEWS' ELSE 'UNKNOWN' END AS news_context,
  CASE WHEN coalesce(d.ms >= t.as_of_ms - {DAMAGE}, false) THEN 'FAIL' ELSE 'PASS' END AS permanent_damage, coalesce(q.ms >= t.as_of_ms - {FRESH}, false) AND coalesce(q.ok, false) AS executable,
  CASE WHEN b.oi > 0 THEN CAST(n.oi - b.oi AS DOUBLE) / CAST(b.oi AS DOUBLE) END AS open_interest_change, (t.as_of_ms - low_ms) // 1000 AS seconds_since_low
  FROM instants t LEFT JOIN lows USING (as_of_ms)
  ASOF LEFT JOIN (SELECT DISTINCT ms FROM news WHERE armed) a ON t.as_of_ms >= a.ms
  ASOF LEFT JOIN (SELECT DISTINCT ms FROM news) i ON t.as_of_ms >= i.ms
  ASOF LEFT JOIN (SELECT DISTINCT ms FROM news WHERE damaging) d ON t.as_of_ms >= d.ms
  ASOF LEFT JOIN quotes q ON t.as_of_ms >= q.ms
  ASOF LEFT JOIN interest n ON t.as_of_ms >= n.ms
  ASOF LEFT JOIN interest b ON t.as_of_ms - {WINDOW} >= b.ms)"""


def decision_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "toxic", "quality")
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang")
    sent = news_items(spark, sf_dir).select("item_id", "received_ms").join(langs, "item_id").join(labels, "item_id", "left")
    toxic = F.col("toxic") == 1
    news = sent.select(
        "received_ms", (toxic | (F.col("quality") == 0)).alias("armed"), (toxic & (F.col("lang") == "en")).alias("damaging")
    )
    quoted = F.col("quantity").isNotNull() & (F.col("side") != "UNKNOWN")
    quotes = t.filter("asset = 'signup'").select("received_ms", "id", quoted.alias("executable"))
    interest = t.filter("asset = 'error'").select("received_ms", "id", F.col("price").alias("open_interest"))
    trades = t.filter(F.col("asset") == TARGET).select("received_ms", "event_ms", "price")
    return inputs.decision_inputs(news, quotes, interest, trades, tick_grid(t), WINDOWS)


@query(
    "decision_inputs",
    f"""WITH {TICKS_SQL}, {grid_sql(HOUR)}, {INPUTS_SQL} SELECT as_of_ms, news_context, permanent_damage, executable, round(open_interest_change, 7) AS open_interest_change, seconds_since_low FROM inputs""",
)
def inputs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decision_inputs(spark, sf_dir)
    return found.withColumn("open_interest_change", number("open_interest_change", 7))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(timed_snapshots(spark, sf_dir).join(decision_inputs(spark, sf_dir), "as_of_ms"))


def sells(snapshots: DataFrame) -> DataFrame:
    return staged.evaluate_sell(snapshots, FIXED, (0, 2, 3), F.lit(MODE), F.lit(ECONOMIC), S_RULES)


def _all_pass(parts: str) -> str:
    return f"CASE WHEN list_unique({parts}) = 1 AND {parts}[1] = 'PASS' THEN 'PASS' WHEN list_contains({parts}, 'UNKNOWN') THEN 'UNKNOWN' ELSE 'FAIL' END"


def _held(value: str, test: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'UNKNOWN' WHEN {test} THEN 'PASS' ELSE 'FAIL' END"


SELL_SQL = f"""{JUDGED_SQL}, {INPUTS_SQL}, k AS (SELECT * FROM j JOIN inputs USING (as_of_ms)),
sc AS (SELECT *, coalesce(breadth >= 2 AND volume >= 1, false) AS armed, breadth IS NOT NULL AND volume IS NOT NULL AS arm_known,
  [{_fall(0, 0.1)}, {_fall(2, 0.3)}, {_fall(3, 0.25)}] AS falls, [{_held('ratio', 'ratio <= 0.8')}, {_held('pressure', 'pressure >= 3600')}] AS flow FROM k),
sd AS (SELECT *, CASE WHEN news_context = 'UNKNOWN' AND NOT arm_known THEN 'UNKNOWN' WHEN news_context = 'NEWS_ARMED' OR armed THEN 'PASS' ELSE 'FAIL' END AS risk, {_all_pass('falls')} AS shock, {_all_pass('flow')} AS sf FROM sc),
sell AS (SELECT *, CASE WHEN health <> 'PASS' THEN 'DATA_BLOCKED' WHEN risk <> 'PASS' THEN 'SELL_IDLE' WHEN shock <> 'PASS' THEN CASE WHEN news_context = 'NEWS_ARMED' THEN 'NEWS_ARMED' ELSE 'MARKET_ARMED' END
  WHEN sf <> 'PASS' THEN 'SELL_PRETRIGGER' ELSE 'SELL_CONFIRMED' END AS sell_stage FROM sd),
sold AS (SELECT *, CAST(CASE WHEN executable AND sell_stage = 'SELL_PRETRIGGER' THEN 0.25 WHEN executable AND sell_stage = 'SELL_CONFIRMED' THEN 0.75 ELSE 0 END AS DOUBLE) AS fraction FROM sell)"""


@query(
    "staged_sell_inputs",
    f"""WITH {SELL_SQL} SELECT as_of_ms, sell_stage AS stage, risk AS risk_context, shock AS market_shock, sf AS sell_flow, fraction,
  CASE WHEN sell_stage = 'DATA_BLOCKED' OR sell_stage IN ('SELL_PRETRIGGER', 'SELL_CONFIRMED') AND NOT executable THEN 'BLOCKED' WHEN sell_stage = 'SELL_PRETRIGGER' THEN 'SHADOW_SELL_TRANCHE_1'
    WHEN sell_stage = 'SELL_CONFIRMED' THEN 'SHADOW_SELL_TRANCHE_2' WHEN sell_stage <> 'SELL_IDLE' THEN 'WATCH' ELSE 'NO_ACTION' END AS action FROM sold""",
)
def sell_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sells(judged(spark, sf_dir)).select(
        "as_of_ms", "stage", "risk_context", "market_shock", "sell_flow", F.col("fraction").cast("double").alias("fraction"), "action"
    )


def _stage_sql(name: str, source: str, first: str) -> str:
    return f"""{name} AS (SELECT *, CASE WHEN sold_ms IS NULL THEN 'REBUY_INACTIVE' WHEN permanent_damage = 'FAIL' THEN 'REBUY_VETOED' WHEN health <> 'PASS' THEN 'REBUY_WAIT'
  WHEN m < 4 THEN CASE WHEN {first} IS NULL AND m >= 3 THEN 'REBUY_ARMED' ELSE 'REBUY_WAIT' END WHEN NOT executable THEN 'REBUY_ARMED' WHEN {first} IS NULL THEN 'REBUY_TRANCHE_1'
  WHEN (as_of_ms - {first}) / 1000.0 >= 300 THEN 'REBUY_COMPLETE' ELSE 'REBUY_TRANCHE_2_WAIT' END AS {name}_stage FROM {source})"""


EARLIER = "OVER (ORDER BY as_of_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "staged_rebuy_inputs",
    f"""WITH {SELL_SQL}, facts AS (SELECT *, min(CASE WHEN fraction > 0 THEN as_of_ms END) {EARLIER} AS sold_ms,
  {_held('seconds_since_low', f'seconds_since_low >= {NO_NEW_LOW}')} AS b1, {_held('open_interest_change', f'open_interest_change <= {DECLINE}')} AS b2,
  {_all_pass(f"[{_held('ratio', 'ratio >= 1.1')}, {_held('recovery', 'recovery >= 7200')}]")} AS b3,
  {_all_pass(f"[{_held('r0', 'r0 >= -0.1')}, {_held('r2', 'r2 >= -0.3')}, {_held('stability', 'stability >= 7200')}]")} AS b4 FROM sold),
counted AS (SELECT *, (b1 = 'PASS')::INT + (b2 = 'PASS')::INT + (b3 = 'PASS')::INT + (b4 = 'PASS')::INT AS m FROM facts),
{_stage_sql('alone', 'counted', 'NULL')}, tranches AS (SELECT *, min(CASE WHEN alone_stage = 'REBUY_TRANCHE_1' THEN as_of_ms END) {EARLIER} AS first_ms FROM alone), {_stage_sql('whole', 'tranches', 'first_ms')}
SELECT as_of_ms, whole_stage AS stage, b1 AS no_new_low, b2 AS open_interest_flush, b3 AS flow_recovery, b4 AS market_stability, first_ms AS first_tranche_ms, CAST(m + executable::INT AS BIGINT) AS passed FROM whole""",
)
def rebuy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = judged(spark, sf_dir)
    grid = tick_grid(ticks(spark, sf_dir))
    known = checkpointed(inputs.with_sell_facts(snapshots, sells(snapshots), grid))
    out = inputs.rebuy_in_order(
        known, grid, lambda s: staged.evaluate_rebuy(s, STABLE, F.lit(MODE), F.lit(ECONOMIC), S_RULES)
    )
    return out.select(
        "as_of_ms", "stage", "no_new_low", "open_interest_flush", "flow_recovery", "market_stability", "first_tranche_ms", "passed"
    )
