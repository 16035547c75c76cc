"""Two-provider quotes: pairing, cross-check, size impact, executability and economics."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.decimals import RATIO, price_ratio, ratio, round_down
from tidewatch.functions.hashing import sha256

BPS = 10_000
QUOTE_FIELDS = ("expected_out", "effective_price", "freshness", "expires_ms", "block_lag", "observation_id")


def effective_price(out: Column, amount_in: Column) -> Column:
    return ratio(out, amount_in)


def research_minimum_out(out: Column, slippage_bps: Decimal, places: int) -> Column:
    """Output less the slippage, rounded down."""
    keep = F.lit(Decimal(1) - Decimal(slippage_bps) / BPS)
    return round_down((out * keep).cast("decimal(38,12)"), places)


def block_freshness(provider_block: Column, latest_block: Column, limit: int) -> Column:
    return F.when(F.abs(provider_block - latest_block) <= limit, "FRESH").otherwise("STALE")


def provider_quotes(raw: DataFrame, slippage_bps: Decimal, places: int, expiry_ms: int, block_limit: int) -> DataFrame:
    """Landed provider answers to priced quotes.

    ``raw``: ``snapshot_id``, ``provider_kind`` (AGGREGATOR, CANONICAL_POOL), ``amount_in``,
    ``expected_out``, ``provider_block``, ``latest_block``, ``observed_ms``, ``observation_id``.
    """
    return raw.select(
        "*",
        research_minimum_out(F.col("expected_out"), slippage_bps, places).alias("minimum_out"),
        effective_price(F.col("expected_out"), F.col("amount_in")).alias("effective_price"),
        F.abs(F.col("provider_block") - F.col("latest_block")).alias("block_lag"),
        block_freshness(F.col("provider_block"), F.col("latest_block"), block_limit).alias("freshness"),
        (F.col("observed_ms") + F.lit(expiry_ms)).alias("expires_ms"),
    )


def validate_quotes(raw: DataFrame, token_in: Column, token_out: Column) -> DataFrame:
    """Reasons to reject a landed quote; an empty list means usable."""
    return raw.withColumn(
        "violations",
        F.array_compact(
            F.array(
                F.when(F.lower("token_in") != F.lower(token_in), "WRONG_SOURCE_TOKEN"),
                F.when(F.lower("token_out") != F.lower(token_out), "WRONG_DESTINATION_TOKEN"),
                F.when(F.col("quoted_amount") != F.col("amount_in"), "DIFFERENT_SOURCE_AMOUNT"),
                F.when(F.coalesce("max_impact_reached", F.lit(False)), "IMPACT_LIMIT_REACHED"),
                F.when(F.col("expected_out") <= 0, "ZERO_OUTPUT"),
            )
        ),
    )


def pair_providers(quotes: DataFrame, fields: Sequence[str] = QUOTE_FIELDS) -> DataFrame:
    """Both providers of one (snapshot, amount) on one row; a missing side stays null.

    One grouped pass instead of a full outer join, so each quote is shuffled once.
    """
    def side(kind: str, name: str) -> Column:
        # one quote per provider and amount; the id decides if a provider repeats itself
        return F.max(F.when(F.col("provider_kind") == kind, F.struct("observation_id", *[f for f in fields if f != "observation_id"]))).alias(name)

    return quotes.groupBy("snapshot_id", "amount_in").agg(
        side("AGGREGATOR", "aggregator"), side("CANONICAL_POOL", "pool")
    )


def relative_size_impact(quotes: DataFrame, start: str = "first_amount") -> DataFrame:
    """Bps lost against the provider's own price for the smallest configured amount.

    ``start`` is the smallest requested amount of the snapshot; without that quote the impact is
    UNKNOWN.  A snapshot has one quote per provider and configured amount.
    """
    w = Window.partitionBy("snapshot_id", "provider_kind")
    base = F.max(F.when(F.col("amount_in") == F.col(start), F.col("effective_price"))).over(w)
    drop = price_ratio(base - F.col("effective_price"), base)
    return quotes.withColumn(
        "size_impact_bps",
        F.when(base.isNotNull(), F.greatest(F.lit(0).cast(RATIO), (drop * BPS).cast(RATIO))),
    )


def cross_check(pairs: DataFrame, limit_bps: Decimal) -> DataFrame:
    """Deviation of the two prices and PASS, FAIL, STALE or UNKNOWN."""
    a, c = F.col("aggregator"), F.col("pool")
    both = a.isNotNull() & c.isNotNull()
    # both sides quote the same amount, so the outputs differ by the same share as the prices
    gap = F.abs(a["expected_out"] - c["expected_out"])
    deviation = F.when(both, (ratio(gap, c["expected_out"]) * BPS).cast(RATIO))
    return pairs.select(
        "*",
        deviation.alias("deviation_bps"),
        F.when(~both, "UNKNOWN")
        .when((a["freshness"] == "STALE") | (c["freshness"] == "STALE"), "STALE")
        .when(deviation <= F.lit(limit_bps), "PASS")
        .otherwise("FAIL")
        .alias("cross_check"),
        F.when(both, F.least(a["expires_ms"], c["expires_ms"])).alias("cross_expires_ms"),
    )


def snapshot_state(scenarios: DataFrame) -> DataFrame:
    """All PASS: PASS; any known quote: PARTIAL; else BLOCKED.  Expiry is the earliest known."""
    known = F.col("aggregator").isNotNull() | F.col("pool").isNotNull()
    return scenarios.groupBy("snapshot_id").agg(
        F.when(F.bool_and(F.col("cross_check") == "PASS"), "PASS")
        .when(F.bool_or(known), "PARTIAL")
        .otherwise("BLOCKED")
        .alias("quote_state"),
        F.min(F.least(F.col("aggregator.expires_ms"), F.col("pool.expires_ms"))).alias("expires_ms"),
        F.count(F.lit(1)).alias("scenarios"),
        F.count("aggregator").alias("aggregator_known"),
        F.count("pool").alias("pool_known"),
        F.count_if(F.col("cross_check") == "PASS").alias("checks_passed"),
        F.count_if(F.col("cross_check") == "STALE").alias("checks_stale"),
    )


def quote_run_stats(attempts: DataFrame, run: str) -> DataFrame:
    """Attempts, outcomes, coverage and latency quantiles per run.

    ``attempts``: run, ``started_ms``, ``ended_ms``, ``latency_ms``, ``ok``, ``quote_state``, ``scenarios``,
    ``checks_passed``, ``checks_stale``.
    """
    from tidewatch.operators.arrivals import quantiles

    ok = F.col("ok")
    counted = attempts.groupBy(run).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("errors"),
        *[F.count_if(F.col("quote_state") == s).alias(f"{s.lower()}_snapshots") for s in ("PASS", "PARTIAL", "BLOCKED")],
        F.coalesce(F.sum("scenarios"), F.lit(0)).alias("scenarios"),
        F.coalesce(F.sum("checks_passed"), F.lit(0)).alias("checks_passed"),
        F.coalesce(F.sum("checks_stale"), F.lit(0)).alias("checks_stale"),
        (F.max("ended_ms") - F.min("started_ms")).alias("duration_ms"),
    )
    latency = attempts.filter(ok).groupBy(run).agg(*quantiles("latency_ms", "latency"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) * 100.0 / F.col(whole)).otherwise(0.0)
    return counted.join(latency, run, "left").select(
        "*",
        share("successes", "attempts").alias("attempt_coverage_pct"),
        share("checks_passed", "scenarios").alias("cross_check_coverage_pct"),
        (F.col("duration_ms") >= 3_600_000).alias("sixty_minutes"),
    )


def route_details(quotes: DataFrame, key: str, route: str = "route") -> DataFrame:
    """Venues and pools of nested route branches.

    ``route``: array of branches, each an array of swaps, each an array of
    ``struct<exchange, pools array<string>>``.  Pools are distinct without case; malformed pool
    ids become a hash in the evidence list.
    """
    exchanges = quotes.select(key, F.explode(F.flatten(F.flatten(F.col(route)))).alias("x"))
    venues = exchanges.select(key, F.col("x.exchange").alias("exchange")).distinct()
    pools = exchanges.select(key, F.explode("x.pools").alias("pool"))
    good = F.col("pool").rlike("^0x[0-9a-fA-F]{40}$")
    graded = pools.select(
        key,
        F.when(good, F.lower("pool")).alias("good"),
        F.when(~good, F.concat(F.lit("route-metadata-filtered-"), F.substring(sha256(F.col("pool")), 1, 24))).alias("bad"),
    ).distinct()
    names = venues.groupBy(key).agg(F.array_sort(F.collect_list("exchange")).alias("exchanges"))
    lists = graded.groupBy(key).agg(
        F.array_sort(F.collect_set("good")).alias("pools"), F.array_sort(F.collect_set("bad")).alias("filtered_evidence")
    )
    return quotes.select(key).join(names, key, "left").join(lists, key, "left")


def quotes_by_chain(chains: DataFrame, requests: DataFrame, results: DataFrame, chain: str) -> DataFrame:
    """State per chain: UNSUPPORTED without a request, else the landed result or ERROR."""
    asked = requests.select(chain, F.lit(True).alias("__asked"))
    joined = chains.join(asked, chain, "left").join(results, chain, "left")
    missing = F.col("__asked").isNull()
    return joined.select(
        chain,
        F.when(missing, "UNSUPPORTED").otherwise(F.coalesce("state", F.lit("ERROR"))).alias("state"),
        F.when(missing, "No quote request for this chain")
        .otherwise(F.when(F.col("state").isNull(), "quote timeout").otherwise(F.col("reason")))
        .alias("reason"),
    )


# --- executability ------------------------------------------------------------------------


def quote_gate(
    quotes: DataFrame, signal_ready: Column, expected_side: str, at: Column, mode: Column, economic: Column,
    maximum_impact_bps: Column | None, maximum_cost: Column | None, maximum_gas: Column | None,
) -> DataFrame:
    """Ordered checks from signal to cost; the first that fails names the action state.

    Limits of ``None`` mean they are unset, which blocks on cost.
    """
    state = F.col("quote_state")
    expired = (F.col("knowledge_expires_ms") < at) | (F.col("expires_ms") < at)
    unset = maximum_impact_bps is None or maximum_cost is None or maximum_gas is None
    beyond = F.lit(False)
    if not unset:
        beyond = (
            (F.col("price_impact_bps") > maximum_impact_bps)
            | (F.col("total_cost") > maximum_cost)
            | (F.col("estimated_gas") > maximum_gas)
        )
    steps = [
        (~signal_ready, "SIGNAL_NOT_READY", "SIGNAL"),
        (state == "UNSUPPORTED", "UNSUPPORTED", "QUOTE_UNSUPPORTED"),
        (state == "ERROR", "BLOCKED_DATA", "QUOTE_ERROR"),
        (state == "UNKNOWN", "QUOTE_PENDING", "QUOTE_UNKNOWN"),
        (F.coalesce(expired, F.lit(False)), "BLOCKED_DATA", "EXPIRED"),
        (F.col("side") != expected_side, "BLOCKED_IDENTITY", "WRONG_SIDE"),
        (F.col("identity_state") != "PASS", "BLOCKED_IDENTITY", "IDENTITY"),
        (F.col("route_state") != "PASS", "BLOCKED_LIQUIDITY", "ROUTE"),
        (F.col("balance_state") != "PASS", "BLOCKED_DATA", "BALANCE"),
        (F.col("simulation_state") == "FAIL", "BLOCKED_LIQUIDITY", "SIMULATION"),
        (F.lit(unset), "BLOCKED_COST", "LIMITS_UNSET"),
        (beyond, "BLOCKED_COST", "LIMIT_EXCEEDED"),
        ((mode == "LIVE_READ_ONLY") & (economic == "PASS"), "ACTIONABLE_WITH_EVIDENCE", "EVIDENCE_PASSES"),
    ]
    action = reason = None
    for hit, name, why in steps:
        action = F.when(hit, name) if action is None else action.when(hit, name)
        reason = F.when(hit, why) if reason is None else reason.when(hit, why)
    return quotes.withColumn("action_state", action.otherwise("SHADOW_CANDIDATE")).withColumn(
        "action_reason", reason.otherwise("SHADOW_OR_UNPROVEN")
    )


# --- economics ----------------------------------------------------------------------------


def effective_sell_price(amount_in: Column, settlement_out: Column, costs: Column) -> Column:
    """(out - costs) / in; null when costs exceed the output or the input is not positive."""
    net = settlement_out - costs
    return F.when((net >= 0) & (amount_in > 0), ratio(net, amount_in))


def effective_buy_price(settlement_in: Column, costs: Column, amount_out: Column) -> Column:
    return F.when(amount_out > 0, ratio(settlement_in + costs, amount_out))


def round_trip_delta(sold: Column, rebought: Column) -> Column:
    return rebought - sold


def economic_gate(
    samples: DataFrame, keys: Sequence[str], delta: str, z_score: float, margin: float, minimum_events: int,
    guards: Column,
) -> DataFrame:
    """Lower bound ``mean - z sd / sqrt(n)`` against a margin, once every guard holds.

    ``guards`` is an aggregate: hold-out kept apart, enough shadow days, enough risk windows.
    """
    grouped = samples.groupBy(*keys).agg(
        F.count(delta).alias("samples"),
        F.avg(delta).alias("mean_delta"),
        F.stddev_samp(delta).alias("sd_delta"),
        guards.alias("guards_hold"),
    )
    bound = F.col("mean_delta") - F.lit(z_score) * F.col("sd_delta") / F.sqrt(F.col("samples"))
    open_gate = (F.col("samples") < minimum_events) | ~F.col("guards_hold")
    usable = F.col("samples") > 1
    return grouped.select(
        *keys, "samples", "mean_delta", "sd_delta",
        F.when(~open_gate & usable, bound).alias("lower_bound"),
        F.when(open_gate, "POSITIVE_EV_NOT_PROVEN")
        .when(~usable, "UNKNOWN")
        .when(bound > margin, "PASS")
        .otherwise("FAIL")
        .alias("economic_state"),
    )
