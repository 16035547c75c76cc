"""Arrival labels, stream quality and poll logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import to_ms
from tidewatch.operators import arrivals as ops
from tidewatch.operators import news
from tidewatch.operators.grid import grid_over
from tidewatch.operators.running import fixed_segments
from tidewatch.workload.registry import number, numbers, query
from tidewatch.workload.tables import ASSETS, DAY, HOUR, table

# Arrivals: every event arrives up to an hour late, every fifth one arrives twice.
ARRIVALS_SQL = """arrivals AS (
  SELECT event_type AS symbol, event_id * 2 + copy AS id, event_id AS sequence, epoch_us(ts) // 1000 AS event_ms,
    epoch_us(ts) // 1000 + (event_id % 7) * 600000 + copy * 900000 AS received_ms
  FROM events, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR event_id % 5 = 0),
scanned AS (SELECT *, max(sequence) OVER (PARTITION BY symbol ORDER BY received_ms, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM arrivals),
accepted AS (SELECT symbol, sequence FROM scanned WHERE previous IS NULL OR sequence > previous),
labelled AS (SELECT s.*, CASE WHEN s.previous IS NULL OR s.sequence > s.previous THEN 'ACCEPTED'
    WHEN a.sequence IS NOT NULL THEN 'DUPLICATE' ELSE 'OUT_OF_ORDER' END AS arrival_state,
    CASE WHEN s.sequence > s.previous + 1 AND symbol <> 'error' THEN s.sequence - s.previous - 1 ELSE 0 END AS missing
  FROM scanned s LEFT JOIN accepted a USING (symbol, sequence))"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    copies = F.when(F.pmod("event_id", F.lit(5)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    event_ms = to_ms(F.col("ts"))
    return e.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("sequence"), event_ms.alias("event_ms"),
        F.explode(copies).alias("copy"),
    ).select(
        "symbol", (F.col("sequence") * 2 + F.col("copy")).alias("id"), "sequence", "event_ms",
        (F.col("event_ms") + F.pmod("sequence", F.lit(7)) * 600_000 + F.col("copy") * 900_000).alias("received_ms"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``error`` stands for a stream without contiguous numbers: it is never gapped."""
    return ops.classify_arrivals(
        arrivals(spark, sf_dir), ["symbol"], ["received_ms", "id"], "sequence", F.col("symbol") != "error"
    )


@query("classify_arrivals", f"WITH {ARRIVALS_SQL} SELECT symbol, id, sequence, arrival_state FROM labelled")
def classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("symbol", "id", "sequence", "arrival_state")


@query(
    "detect_gaps",
    f"""WITH {ARRIVALS_SQL} SELECT symbol, id, received_ms, missing, symbol || ':trade:' || (previous + 1) || '-' || (sequence - 1) AS gap
FROM labelled WHERE missing > 0""",
)
def gaps_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labelled(spark, sf_dir).withColumn("gap", ops.gap_label(F.col("symbol"), F.lit("trade")))
    return found.filter(F.col("gap").isNotNull()).select("symbol", "id", "received_ms", "missing", "gap")


NOW = 1706745600000  # the end of the event month
EXPECTED = (*ASSETS, "error", "refund")  # refund never arrives


def expected_streams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in EXPECTED], "symbol string")


METRICS_SQL = f"""{ARRIVALS_SQL},
counts AS (SELECT symbol, count(*) AS received, count(*) FILTER (arrival_state = 'ACCEPTED') AS accepted,
    count(*) FILTER (arrival_state = 'DUPLICATE') AS duplicates, count(*) FILTER (arrival_state = 'OUT_OF_ORDER') AS out_of_order,
    count(*) FILTER (missing > 0) AS gap_events, CAST(sum(missing) AS BIGINT) AS missing_ids, min(received_ms) AS first_received_ms,
    max(received_ms) AS last_received_ms, max(received_ms) FILTER (arrival_state = 'ACCEPTED') AS last_accepted_ms
  FROM labelled GROUP BY ALL),
sampled AS (SELECT symbol, greatest(0, received_ms - event_ms) AS l FROM labelled WHERE arrival_state = 'ACCEPTED'),
lat AS (SELECT symbol, count(*) AS latency_samples, quantile_disc(l, 0.5) AS latency_p50, quantile_disc(l, 0.95) AS latency_p95,
  quantile_disc(l, 0.99) AS latency_p99, max(l) AS latency_max FROM sampled GROUP BY ALL),
expected AS (SELECT * FROM (VALUES {", ".join(f"('{s}')" for s in EXPECTED)}) v(symbol)),
metrics AS (SELECT e.symbol, coalesce(received, 0) AS received, coalesce(accepted, 0) AS accepted, coalesce(duplicates, 0) AS duplicates,
    coalesce(out_of_order, 0) AS out_of_order, coalesce(gap_events, 0) AS gap_events, coalesce(missing_ids, 0) AS missing_ids,
    first_received_ms, last_received_ms,
    CASE WHEN first_received_ms IS NULL THEN 0.0 ELSE accepted / greatest(0.001, ({NOW} - first_received_ms) / 1000.0) END AS rate_per_second,
    CASE WHEN e.symbol <> 'error' AND accepted + missing_ids > 0 THEN CAST(accepted AS DOUBLE) / (accepted + missing_ids) END AS completeness,
    CASE WHEN coalesce(latency_samples, 0) = 0 THEN 'NOT_AVAILABLE' ELSE 'EXCHANGE_EVENT_TIME' END AS latency_basis,
    coalesce(latency_samples, 0) AS latency_samples, latency_p50, latency_p95, latency_p99, latency_max,
    CASE WHEN last_accepted_ms IS NULL THEN 'UNKNOWN' WHEN {NOW} - last_accepted_ms <= {HOUR} THEN 'FRESH' ELSE 'STALE' END AS freshness
  FROM expected e LEFT JOIN counts USING (symbol) LEFT JOIN lat USING (symbol))"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stream_metrics(
        labelled(spark, sf_dir), expected_streams(spark), ["symbol"], NOW, HOUR, F.col("symbol") != "error"
    )


@query(
    "stream_metrics",
    f"""WITH {METRICS_SQL} SELECT * EXCLUDE (rate_per_second, completeness), CAST(round(CAST(rate_per_second AS DOUBLE), 8) AS DOUBLE) AS rate_per_second,
  round(completeness, 8) AS completeness FROM metrics""",
)
def stream_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers(metrics(spark, sf_dir), "rate_per_second", "completeness")


@query("stream_freshness", f"WITH {METRICS_SQL} SELECT symbol, freshness FROM metrics")
def stream_freshness_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).filter("arrival_state = 'ACCEPTED'")
    last = rows.groupBy("symbol").agg(F.max("received_ms").alias("last_accepted_ms"))
    graded = ops.stream_freshness(last, expected_streams(spark), ["symbol"], F.lit(NOW), HOUR)
    return graded.select("symbol", "freshness")


@query(
    "market_source_health",
    f"""WITH {METRICS_SQL}, g AS (SELECT CASE WHEN symbol IN ('view', 'click', 'signup') THEN 'reference' WHEN symbol = 'refund' THEN 'silent' ELSE 'other' END AS source,
  freshness FROM metrics),
s AS (SELECT source, count(*) AS streams, count(*) FILTER (freshness = 'UNKNOWN') AS missing_streams, count(*) FILTER (freshness = 'STALE') AS stale_streams FROM g GROUP BY ALL)
SELECT *, CASE WHEN missing_streams = streams THEN 'WARMING_UP' WHEN stale_streams > 0 THEN 'STALE' WHEN missing_streams > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM s""",
)
def market_health_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = (
        F.when(F.col("symbol").isin("view", "click", "signup"), "reference")
        .when(F.col("symbol") == "refund", "silent")
        .otherwise("other")
    )
    streams = metrics(spark, sf_dir).select(source.alias("source"), "freshness")
    health = ops.market_source_health(streams, ["source"], F.bool_or(F.lit(False)), F.max(F.lit(0)))
    return health.select("source", "streams", "missing_streams", "stale_streams", "status")


MEMBERS = (("view", "reference"), ("click", "reference"), ("signup", "reference"), ("purchase", "other"), ("refund", "other"), ("gift", "silent"))


@query(
    "market_health_at",
    f"""WITH {ARRIVALS_SQL}, members AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in MEMBERS)}) v(symbol, source)),
bounds AS (SELECT min(received_ms) // {HOUR} * {HOUR} AS s, max(received_ms) AS e FROM arrivals),
instants AS (SELECT unnest(generate_series(s, e, {HOUR})) AS as_of_ms FROM bounds),
errors AS (SELECT DISTINCT CASE WHEN sequence % 2 = 0 THEN 'reference' ELSE 'other' END AS source, received_ms AS ms FROM arrivals WHERE symbol = 'error'),
st AS (SELECT m.source, i.as_of_ms, a.ms AS accepted_ms, g.ms AS gap_ms, CASE WHEN a.ms IS NULL THEN 'UNKNOWN' WHEN i.as_of_ms - a.ms <= {HOUR} THEN 'FRESH' ELSE 'STALE' END AS freshness
  FROM members m CROSS JOIN instants i
  ASOF LEFT JOIN (SELECT DISTINCT symbol, received_ms AS ms FROM labelled WHERE arrival_state = 'ACCEPTED') a ON a.symbol = m.symbol AND i.as_of_ms >= a.ms
  ASOF LEFT JOIN (SELECT DISTINCT symbol, received_ms AS ms FROM labelled WHERE missing > 40) g ON g.symbol = m.symbol AND i.as_of_ms >= g.ms),
s AS (SELECT source, as_of_ms, count(*) AS streams, count(*) FILTER (freshness = 'UNKNOWN') AS missing_streams, count(*) FILTER (freshness = 'STALE') AS stale_streams,
  max(accepted_ms) AS last_ms, count(*) FILTER (gap_ms >= as_of_ms - {HOUR}) AS active_gaps FROM st GROUP BY ALL),
x AS (SELECT s.*, coalesce(e.ms > coalesce(last_ms, -1), false) AS disconnected FROM s ASOF LEFT JOIN errors e ON e.source = s.source AND s.as_of_ms >= e.ms)
SELECT * EXCLUDE (last_ms), CASE WHEN disconnected THEN 'ERROR' WHEN missing_streams = streams THEN 'WARMING_UP' WHEN stale_streams > 0 THEN 'STALE' WHEN missing_streams > 0 OR active_gaps > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM x""",
)
def market_health_at_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market sources hour by hour; error events are the log of lost connections, long gaps count for an hour."""
    rows = labelled(spark, sf_dir)
    streams = rows.select(
        F.col("symbol").alias("stream"), "received_ms", (F.col("arrival_state") == "ACCEPTED").alias("accepted"),
        (F.col("missing") > 40).alias("gapped"),
    )
    errors = arrivals(spark, sf_dir).filter("symbol = 'error'").select(
        F.when(F.pmod("sequence", F.lit(2)) == 0, "reference").otherwise("other").alias("source"), "received_ms"
    )
    grid = grid_over(arrivals(spark, sf_dir), "received_ms", HOUR)
    members = spark.createDataFrame(MEMBERS, "stream string, source string")
    return ops.market_health_at(streams, errors, members, grid, HOUR, HOUR)


@query(
    "coverage_summary",
    """WITH t AS (SELECT event_type, event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS step FROM events)
SELECT event_type, count(*) AS records, count(*) FILTER (step <> 1) AS gap_events, CAST(coalesce(sum(step - 1) FILTER (step <> 1), 0) AS BIGINT) AS missing_ids FROM t GROUP BY ALL""",
)
def coverage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "event_id", to_ms(F.col("ts")).alias("at_ms"))
    return ops.coverage_summary(e, ["event_type"], ["at_ms", "event_id"], "event_id")


# --- polls ---------------------------------------------------------------------------------
# Orders are polls of a source (the priority); their line items are the listed items.

POLLS_SQL = """polls AS (SELECT o_orderpriority AS source, o_orderkey AS poll_no, epoch_us(o_orderdate) // 1000 AS polled_ms,
    CASE o_orderstatus WHEN 'F' THEN 'ERROR' WHEN 'P' THEN 'NOT_MODIFIED' ELSE 'OK' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN 'E' || (o_orderkey % 3) END AS error_code FROM orders),
listed AS (SELECT source, poll_no, polled_ms, l_partkey AS item_id, max(l_suppkey) AS content, min(epoch_us(l_shipdate) // 1000) AS occurred_ms
  FROM lineitem JOIN polls ON poll_no = l_orderkey WHERE status = 'OK' GROUP BY ALL),
first_poll AS (SELECT source, min(poll_no) AS first_no FROM polls WHERE status = 'OK' GROUP BY ALL),
marked AS (SELECT *, lag(content) OVER (PARTITION BY source, item_id ORDER BY poll_no) AS before FROM listed),
items AS (SELECT m.*, before IS NULL OR before <> content AS is_new, poll_no = first_no AS bootstrap FROM marked m JOIN first_poll USING (source)),
per_poll AS (SELECT source, poll_no, max(item_id) AS maximum_id FROM listed GROUP BY ALL),
seen AS (SELECT *, max(maximum_id) OVER (PARTITION BY source ORDER BY poll_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seen_id FROM per_poll),
coverage AS (SELECT source, poll_no, last_seen_id, maximum_id, 'CURSOR_NOT_VISIBLE:' || last_seen_id || '->' || maximum_id AS coverage_gap FROM seen s
  WHERE maximum_id > last_seen_id AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.source = s.source AND l.poll_no = s.poll_no AND l.item_id = s.last_seen_id))"""


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ERROR").when(F.col("o_orderstatus") == "P", "NOT_MODIFIED").otherwise("OK")
    return o.select(
        F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("poll_no"),
        to_ms(F.col("o_orderdate")).alias("polled_ms"), status.alias("status"),
        F.when(status == "ERROR", F.concat(F.lit("E"), F.pmod("o_orderkey", F.lit(3)))).alias("error_code"),
    )


TASK_ROWS = 500_000


def listed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger tables are dealt by poll to tasks of about ``TASK_ROWS`` items: they are joined, grouped and ranked where they lie."""
    li = table(spark, sf_dir, "lineitem")
    ok = polls(spark, sf_dir).filter("status = 'OK'")
    tasks = -(-li.count() // TASK_ROWS)
    if tasks > spark.sparkContext.defaultParallelism:
        li, ok = li.repartition(tasks, "l_orderkey"), ok.repartition(tasks, "poll_no")
    joined = li.join(ok, li["l_orderkey"] == ok["poll_no"])
    return joined.groupBy("source", "poll_no", "polled_ms", F.col("l_partkey").alias("item_id")).agg(
        F.max("l_suppkey").alias("content"), F.min(to_ms(F.col("l_shipdate"))).alias("occurred_ms")
    )


def coverage_gaps(listed: DataFrame) -> DataFrame:
    return news.poll_coverage_gaps(listed, "source", "poll_no", "item_id", fixed_segments(F.col("poll_no"), 1_000_000))


@query("poll_coverage_gaps", f"WITH {POLLS_SQL} SELECT * FROM coverage")
def poll_gaps_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_gaps(listed_items(spark, sf_dir))


@query(
    "poll_metrics",
    f"""WITH {POLLS_SQL},
c AS (SELECT source, count(*) AS attempts, count(*) FILTER (status <> 'ERROR') AS successes, count(*) FILTER (status = 'NOT_MODIFIED') AS not_modified,
  count(coverage_gap) AS gaps, min(polled_ms) AS first_attempt_ms, max(polled_ms) AS last_attempt_ms, max(polled_ms) FILTER (status <> 'ERROR') AS last_success_ms
  FROM polls LEFT JOIN coverage USING (source, poll_no) GROUP BY ALL),
er AS (SELECT source, string_agg(error_code || '=' || n, ',' ORDER BY error_code) AS errors FROM (SELECT source, error_code, count(*) AS n FROM polls WHERE error_code IS NOT NULL GROUP BY ALL) GROUP BY ALL),
i AS (SELECT source, count(*) AS messages, count(*) FILTER (is_new) AS unique_items, count(*) FILTER (is_new AND bootstrap) AS bootstrap_items, count(*) FILTER (NOT is_new) AS duplicates FROM items GROUP BY ALL),
s AS (SELECT source, greatest(0, polled_ms - occurred_ms) AS l FROM items WHERE is_new AND NOT bootstrap),
lat AS (SELECT source, count(*) AS latency_samples, quantile_disc(l, 0.5) AS latency_p50, quantile_disc(l, 0.95) AS latency_p95, quantile_disc(l, 0.99) AS latency_p99, max(l) AS latency_max FROM s GROUP BY ALL)
SELECT c.*, errors, messages, unique_items, bootstrap_items, duplicates, latency_samples, latency_p50, latency_p95, latency_p99, latency_max,
  round(CAST(successes AS DOUBLE) / attempts, 8) AS success_rate, round(CAST(duplicates AS DOUBLE) / messages, 8) AS duplicate_rate
FROM c JOIN i USING (source) JOIN lat USING (source) JOIN er USING (source)""",
)
def poll_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = listed_items(spark, sf_dir)
    revised = news.revisions(
        listed.withColumn("key", F.concat_ws("|", "source", "item_id")), "key", ["poll_no"], "content",
        fixed_segments(F.col("poll_no"), 1_000_000),
    )
    first = polls(spark, sf_dir).filter("status = 'OK'").groupBy("source").agg(F.min("poll_no").alias("first_no"))
    items = revised.join(first, "source").select(
        "source", "poll_no", "polled_ms", "item_id", "occurred_ms", (~F.col("is_duplicate")).alias("is_new"),
        (F.col("poll_no") == F.col("first_no")).alias("bootstrap"),
    )
    logged = polls(spark, sf_dir).join(coverage_gaps(listed).select("source", "poll_no", "coverage_gap"), ["source", "poll_no"], "left")
    found = ops.poll_metrics(logged, items, "source")
    errors = F.array_join(
        F.transform(F.map_entries("errors_by_code"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ","
    )
    return numbers(found.withColumn("errors", errors).drop("errors_by_code"), "success_rate", "duplicate_rate")


@query(
    "poll_source_health",
    f"""WITH {POLLS_SQL}, last AS (SELECT source, arg_max(status, (polled_ms, poll_no)) AS status, max(polled_ms) FILTER (status <> 'ERROR') AS ok_ms FROM polls GROUP BY ALL)
SELECT source, ok_ms, CASE WHEN {1000000000000} - ok_ms > {DAY} THEN 'STALE' WHEN status = 'ERROR' THEN 'ERROR' ELSE 'HEALTHY' END AS health FROM last""",
)
def poll_health_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = polls(spark, sf_dir).groupBy("source").agg(
        F.max(F.struct("polled_ms", "poll_no", "status"))["status"].alias("status"),
        F.max(F.when(F.col("status") != "ERROR", F.col("polled_ms"))).alias("ok_ms"),
    )
    health = ops.poll_source_health(F.col("status"), F.lit(None).cast("string"), F.col("ok_ms"), F.lit(1_000_000_000_000), DAY)
    return last.select("source", "ok_ms", health.alias("health"))


@query(
    "poll_health_log",
    f"""WITH {POLLS_SQL}, p AS (SELECT source, poll_no, polled_ms, status, coverage_gap,
  max(CASE WHEN status <> 'ERROR' THEN polled_ms END) OVER (PARTITION BY source ORDER BY polled_ms, poll_no ROWS UNBOUNDED PRECEDING) AS last_success_ms FROM polls LEFT JOIN coverage USING (source, poll_no))
SELECT source, poll_no, polled_ms, last_success_ms, polled_ms - last_success_ms AS data_age_ms, CASE WHEN polled_ms - last_success_ms > {DAY} THEN 'STALE' WHEN status = 'ERROR' THEN 'ERROR'
  WHEN coverage_gap IS NOT NULL THEN 'DEGRADED' ELSE 'HEALTHY' END AS health FROM p""",
)
def poll_health_log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = coverage_gaps(listed_items(spark, sf_dir)).select("source", "poll_no", "coverage_gap")
    return ops.poll_health_log(polls(spark, sf_dir).join(gaps, ["source", "poll_no"], "left"), "source", DAY)


@query(
    "poll_head",
    f"""WITH {POLLS_SQL} SELECT source, poll_no, item_id, row_number() OVER (PARTITION BY source, poll_no ORDER BY occurred_ms DESC, item_id DESC) AS position
FROM listed QUALIFY position <= 2""",
)
def poll_head_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = news.poll_head(listed_items(spark, sf_dir), ["source", "poll_no"], "occurred_ms", "item_id", 2)
    return head.select("source", "poll_no", "item_id", F.col("position").cast("long").alias("position"))


@query(
    "quote_run_stats",
    """WITH a AS (SELECT o_orderpriority AS run, epoch_us(o_orderdate) // 1000 AS started_ms, o_orderkey % 5000 AS latency_ms, o_orderkey % 17 <> 0 AS ok, o_orderstatus AS s, o_custkey % 4 AS passed FROM orders),
g AS (SELECT run, count(*) AS attempts, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (ok AND s = 'O') AS pass_snapshots,
  count(*) FILTER (ok AND s = 'P') AS partial_snapshots, count(*) FILTER (ok AND s = 'F') AS blocked_snapshots, CAST(sum(CASE WHEN ok THEN 3 END) AS BIGINT) AS scenarios,
  CAST(sum(CASE WHEN ok THEN least(passed, 3) END) AS BIGINT) AS checks_passed, CAST(sum(CASE WHEN ok THEN 3 - least(passed, 3) END) AS BIGINT) AS checks_stale,
  max(started_ms + latency_ms) - min(started_ms) AS duration_ms, quantile_disc(latency_ms, 0.5) FILTER (ok) AS latency_p50, quantile_disc(latency_ms, 0.95) FILTER (ok) AS latency_p95,
  quantile_disc(latency_ms, 0.99) FILTER (ok) AS latency_p99, max(latency_ms) FILTER (ok) AS latency_max FROM a GROUP BY ALL)
SELECT *, round(successes * 100.0 / attempts, 8)::DOUBLE AS attempt_coverage_pct, round(checks_passed * 100.0 / scenarios, 8)::DOUBLE AS cross_check_coverage_pct, duration_ms >= 3600000 AS sixty_minutes FROM g""",
)
def quote_run_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.quotes import quote_run_stats

    o = table(spark, sf_dir, "orders")
    ok = F.pmod("o_orderkey", F.lit(17)) != 0
    passed = F.least(F.pmod("o_custkey", F.lit(4)), F.lit(3))
    at, latency = to_ms(F.col("o_orderdate")), F.pmod("o_orderkey", F.lit(5000))
    state = F.when(F.col("o_orderstatus") == "O", "PASS").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("BLOCKED")
    attempts = o.select(
        F.col("o_orderpriority").alias("run"), at.alias("started_ms"), (at + latency).alias("ended_ms"),
        latency.alias("latency_ms"), ok.alias("ok"), F.when(ok, state).alias("quote_state"),
        F.when(ok, 3).alias("scenarios"), F.when(ok, passed).alias("checks_passed"), F.when(ok, 3 - passed).alias("checks_stale"),
    )
    return numbers(quote_run_stats(attempts, "run"), "attempt_coverage_pct", "cross_check_coverage_pct")
