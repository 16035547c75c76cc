"""Line items as provider quotes, gates and economics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import to_ms
from tidewatch.operators import quotes as ops
from tidewatch.workload.registry import number, numbers, query
from tidewatch.workload.tables import table

D20 = "decimal(20,8)"

# One quote per part (snapshot), quantity (amount) and line status (provider).
QUOTES_SQL = """raw AS (SELECT l_partkey AS snapshot_id, l_quantity AS amount_in, CASE WHEN l_linestatus = 'O' THEN 'AGGREGATOR' ELSE 'CANONICAL_POOL' END AS provider_kind,
  CAST(max(l_extendedprice) AS DECIMAL(20,8)) AS expected_out, max(l_orderkey) AS provider_block, max(l_orderkey) + max(l_suppkey) % 5 AS latest_block, max(epoch_us(l_shipdate) // 1000) AS observed_ms
  FROM lineitem GROUP BY ALL),
priced AS (SELECT *, CAST(expected_out AS DOUBLE) / amount_in AS p, CASE WHEN latest_block - provider_block <= 2 THEN 'FRESH' ELSE 'STALE' END AS freshness, latest_block - provider_block AS block_lag, observed_ms + 5000 AS expires_ms FROM raw),
pairs AS (SELECT snapshot_id, amount_in, max(p) FILTER (provider_kind = 'AGGREGATOR') AS a, max(p) FILTER (provider_kind = 'CANONICAL_POOL') AS c,
  max(freshness) FILTER (provider_kind = 'AGGREGATOR') AS fa, max(freshness) FILTER (provider_kind = 'CANONICAL_POOL') AS fc,
  max(expires_ms) FILTER (provider_kind = 'AGGREGATOR') AS ea, max(expires_ms) FILTER (provider_kind = 'CANONICAL_POOL') AS ec FROM priced GROUP BY ALL),
checked AS (SELECT *, CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN abs(a - c) / c * 10000 END AS dev FROM pairs),
states AS (SELECT *, CASE WHEN dev IS NULL THEN 'UNKNOWN' WHEN fa = 'STALE' OR fc = 'STALE' THEN 'STALE' WHEN dev <= 2000 THEN 'PASS' ELSE 'FAIL' END AS cross_check FROM checked)"""


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linestatus") == "O", "AGGREGATOR").otherwise("CANONICAL_POOL")
    grouped = li.groupBy(
        F.col("l_partkey").alias("snapshot_id"), F.col("l_quantity").cast(D20).alias("amount_in"), kind.alias("provider_kind")
    ).agg(
        F.max("l_extendedprice").cast(D20).alias("expected_out"), F.max("l_orderkey").alias("provider_block"),
        F.max("l_suppkey").alias("s"), F.max(to_ms(F.col("l_shipdate"))).alias("observed_ms"),
    )
    return grouped.select(
        "snapshot_id", "amount_in", "provider_kind", "expected_out", "provider_block",
        (F.col("provider_block") + F.pmod("s", F.lit(5))).alias("latest_block"), "observed_ms",
        F.concat_ws("-", "snapshot_id", "amount_in", "provider_kind").alias("observation_id"),
    )


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.provider_quotes(raw_quotes(spark, sf_dir), Decimal("50"), 6, 5000, 2)


@query(
    "provider_quotes",
    f"""WITH {QUOTES_SQL} SELECT snapshot_id, amount_in, provider_kind, round(p, 8) AS effective_price, round(CAST(expected_out AS DOUBLE) * 0.995, 6) AS minimum_out, block_lag, freshness, expires_ms FROM priced""",
)
def provider_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = priced(spark, sf_dir).select(
        "snapshot_id", F.col("amount_in").cast("double").alias("amount_in"), "provider_kind", "effective_price",
        number("minimum_out", 6).alias("minimum_out"), "block_lag", "freshness", "expires_ms",
    )
    return numbers(q, "effective_price")


@query(
    "quote_cross_check",
    f"""WITH {QUOTES_SQL} SELECT snapshot_id, amount_in, round(a, 8) AS aggregator_price, round(c, 8) AS pool_price, round(dev, 5) AS deviation_bps, cross_check, CASE WHEN dev IS NOT NULL THEN least(ea, ec) END AS cross_expires_ms FROM states""",
)
def cross_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = ops.cross_check(ops.pair_providers(priced(spark, sf_dir)), Decimal("2000"))
    return checked.select(
        "snapshot_id", F.col("amount_in").cast("double").alias("amount_in"), number("aggregator.effective_price").alias("aggregator_price"),
        number("pool.effective_price").alias("pool_price"), number("deviation_bps", 5).alias("deviation_bps"), "cross_check", "cross_expires_ms",
    )


@query(
    "quote_snapshot_state",
    f"""WITH {QUOTES_SQL} SELECT snapshot_id, CASE WHEN bool_and(cross_check = 'PASS') THEN 'PASS' WHEN bool_or(a IS NOT NULL OR c IS NOT NULL) THEN 'PARTIAL' ELSE 'BLOCKED' END AS quote_state, min(least(ea, ec)) AS expires_ms,
  count(*) AS scenarios, count(a) AS aggregator_known, count(c) AS pool_known, count(*) FILTER (cross_check = 'PASS') AS checks_passed, count(*) FILTER (cross_check = 'STALE') AS checks_stale FROM states GROUP BY ALL""",
)
def snapshot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.snapshot_state(ops.cross_check(ops.pair_providers(priced(spark, sf_dir)), Decimal("2000")))


@query(
    "relative_size_impact",
    f"""WITH {QUOTES_SQL}, m AS (SELECT snapshot_id, min(amount_in) AS first_amount FROM priced GROUP BY ALL),
b AS (SELECT p.snapshot_id, provider_kind, p AS base FROM priced p JOIN m ON m.snapshot_id = p.snapshot_id AND m.first_amount = p.amount_in)
SELECT p.snapshot_id, p.amount_in, p.provider_kind, round(CASE WHEN base IS NOT NULL THEN greatest(0, (base - p) / base * 10000) END, 4) AS size_impact_bps FROM priced p LEFT JOIN b USING (snapshot_id, provider_kind)""",
)
def impact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = priced(spark, sf_dir)
    smallest = q.groupBy("snapshot_id").agg(F.min("amount_in").alias("first_amount"))
    found = ops.relative_size_impact(q.join(smallest, "snapshot_id"))
    return found.select(
        "snapshot_id", F.col("amount_in").cast("double").alias("amount_in"), "provider_kind", number("size_impact_bps", 4).alias("size_impact_bps")
    )


@query(
    "validate_quotes",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, concat_ws(',', CASE WHEN l_returnflag <> 'A' THEN 'WRONG_SOURCE_TOKEN' END, CASE WHEN l_linestatus <> 'O' THEN 'WRONG_DESTINATION_TOKEN' END,
  CASE WHEN l_quantity > 40 THEN 'DIFFERENT_SOURCE_AMOUNT' END, CASE WHEN l_discount > 0.08 THEN 'IMPACT_LIMIT_REACHED' END, CASE WHEN l_extendedprice <= 2000 THEN 'ZERO_OUTPUT' END) AS violations FROM lineitem""",
)
def validate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    raw = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_returnflag").alias("token_in"), F.col("l_linestatus").alias("token_out"),
        q.alias("amount_in"), F.least(q, F.lit(40.0)).alias("quoted_amount"), (F.col("l_discount") > 0.08).alias("max_impact_reached"),
        (F.col("l_extendedprice") - 2000).alias("expected_out"),
    )
    checked = ops.validate_quotes(raw, F.lit("a"), F.lit("o"))
    return checked.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.array_join("violations", ",").alias("violations"))


@query(
    "route_details",
    """WITH x AS (SELECT l_orderkey AS quote_id, 'venue-' || l_returnflag AS exchange, CASE WHEN l_suppkey % 9 = 0 THEN 'pool ' || l_suppkey ELSE '0x' || lpad(CASE WHEN l_linenumber % 2 = 0 THEN 'AB' ELSE 'ab' END || l_suppkey, 40, '0') END AS pool FROM lineitem),
g AS (SELECT DISTINCT quote_id, CASE WHEN starts_with(pool, '0x') THEN lower(pool) END AS good, CASE WHEN NOT starts_with(pool, '0x') THEN 'route-metadata-filtered-' || substr(sha256(pool), 1, 24) END AS bad FROM x)
SELECT quote_id, (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT exchange AS e FROM x WHERE x.quote_id = o.quote_id)) AS exchanges, string_agg(good, ',' ORDER BY good) AS pools, string_agg(bad, ',' ORDER BY bad) AS filtered_evidence FROM g o GROUP BY quote_id""",
)
def route_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    mixed = F.when(F.pmod("l_linenumber", F.lit(2)) == 0, "AB").otherwise("ab")
    pool = F.when(F.pmod("l_suppkey", F.lit(9)) == 0, F.concat(F.lit("pool "), "l_suppkey")).otherwise(
        F.concat(F.lit("0x"), F.lpad(F.concat(mixed, "l_suppkey"), 40, "0"))
    )
    hop = F.struct(F.concat(F.lit("venue-"), "l_returnflag").alias("exchange"), F.array(pool).alias("pools"))
    # one branch with one swap per line item; an order has a handful of lines
    nested = li.groupBy(F.col("l_orderkey").alias("quote_id")).agg(F.collect_list(F.array(F.array(hop))).alias("branches"))
    found = ops.route_details(nested.select("quote_id", F.flatten("branches").alias("swaps")).select("quote_id", F.array("swaps").alias("route")), "quote_id")
    text = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return found.select("quote_id", text("exchanges").alias("exchanges"), text("pools").alias("pools"), text("filtered_evidence").alias("filtered_evidence"))


@query(
    "quote_requests_by_chain",
    """SELECT c_custkey AS chain, CASE WHEN n = 0 THEN 'UNSUPPORTED' WHEN done = 0 THEN 'ERROR' ELSE 'KNOWN' END AS state, CASE WHEN n = 0 THEN 'No quote request for this chain' WHEN done = 0 THEN 'quote timeout' END AS reason FROM (
  SELECT c_custkey, count(o_orderkey) AS n, count(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS done FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000 GROUP BY ALL)""",
)
def chain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").filter("o_totalprice > 350000")
    requests = asked.select(F.col("o_custkey").alias("chain")).distinct()
    results = asked.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("chain")).distinct().select(
        "chain", F.lit("KNOWN").alias("state"), F.lit(None).cast("string").alias("reason")
    )
    chains = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chain"))
    return ops.quotes_by_chain(chains, requests, results, "chain")


@query(
    "quote_gate",
    """SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'SIGNAL_NOT_READY' WHEN o_custkey % 10 = 1 THEN 'UNSUPPORTED' WHEN o_custkey % 10 = 2 THEN 'BLOCKED_DATA' WHEN o_custkey % 10 = 3 THEN 'QUOTE_PENDING'
  WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'BLOCKED_DATA' WHEN o_orderpriority = '5-LOW' THEN 'BLOCKED_IDENTITY' WHEN o_orderkey % 7 = 0 THEN 'BLOCKED_IDENTITY' WHEN o_orderkey % 11 = 0 THEN 'BLOCKED_LIQUIDITY'
  WHEN o_orderkey % 13 = 0 THEN 'BLOCKED_DATA' WHEN o_orderkey % 17 = 0 THEN 'BLOCKED_LIQUIDITY' WHEN o_totalprice > 450000 THEN 'BLOCKED_COST' WHEN o_orderstatus = 'F' THEN 'ACTIONABLE_WITH_EVIDENCE' ELSE 'SHADOW_CANDIDATE' END AS action_state FROM orders""",
)
def gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.pmod("o_custkey", F.lit(10)), F.col("o_orderkey")

    def unless(modulus: int, bad: str):
        return F.when(F.pmod(k, F.lit(modulus)) == 0, bad).otherwise("PASS")

    at = to_ms(F.col("o_orderdate"))
    q = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.when(c == 1, "UNSUPPORTED").when(c == 2, "ERROR").when(c == 3, "UNKNOWN").otherwise("KNOWN").alias("quote_state"),
        (c != 0).alias("ready"), at.alias("knowledge_expires_ms"), at.alias("expires_ms"),
        F.when(F.col("o_orderpriority") == "5-LOW", "BUY").otherwise("SELL").alias("side"), unless(7, "FAIL").alias("identity_state"),
        unless(11, "UNKNOWN").alias("route_state"), unless(13, "UNKNOWN").alias("balance_state"), unless(17, "FAIL").alias("simulation_state"),
        F.col("o_totalprice").alias("price_impact_bps"), F.lit(0.0).alias("total_cost"), F.lit(0.0).alias("estimated_gas"),
    )
    gated = ops.quote_gate(
        q, F.col("ready"), "SELL", F.lit(820454400000), F.lit("LIVE_READ_ONLY"), F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("UNKNOWN"),
        F.lit(450000.0), F.lit(1.0), F.lit(1.0),
    )
    return gated.select("o_orderkey", "action_state")


@query(
    "effective_prices",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(CASE WHEN l_extendedprice >= 5000 THEN (l_extendedprice - 5000) / l_quantity END, 6) AS sell_price, round((l_extendedprice + 5000) / l_quantity, 6) AS buy_price,
  round(l_quantity - l_suppkey, 6) AS round_trip FROM lineitem""",
)
def prices_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount, out, cost = F.col("l_quantity").cast(D20), F.col("l_extendedprice").cast(D20), F.lit(Decimal(5000)).cast(D20)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", number(ops.effective_sell_price(amount, out, cost), 6).alias("sell_price"),
        number(ops.effective_buy_price(out, cost, amount), 6).alias("buy_price"),
        number(ops.round_trip_delta(F.col("l_suppkey"), amount), 6).alias("round_trip"),
    )


@query(
    "economic_gate",
    """WITH g AS (SELECT o_custkey, count(*) AS samples, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd, count(DISTINCT o_orderstatus) >= 2 AS ok FROM orders GROUP BY ALL)
SELECT o_custkey, samples, round(m, 6) AS mean_delta, CASE WHEN samples >= 5 AND ok THEN round(m - 1.96 * sd / sqrt(samples), 6) END AS lower_bound,
  CASE WHEN samples < 5 OR NOT ok THEN 'POSITIVE_EV_NOT_PROVEN' WHEN m - 1.96 * sd / sqrt(samples) > 180000 THEN 'PASS' ELSE 'FAIL' END AS economic_state FROM g""",
)
def economic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.economic_gate(
        table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", 1.96, 180000.0, 5, F.size(F.collect_set("o_orderstatus")) >= 2
    )
    return numbers(found, "mean_delta", "lower_bound", places=6).drop("sd_delta")
