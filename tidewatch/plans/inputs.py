"""What decisions take from news, quotes, open interest and lows, and from earlier decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.times import whole_seconds
from tidewatch.operators.features import oi_change
from tidewatch.operators.grid import Grid, extremes_at
from tidewatch.operators.running import Measure, running


@dataclass(frozen=True)
class InputWindows:
    """How long a source speaks for later instants, in milliseconds."""

    armed_ms: int
    silent_ms: int
    damage_ms: int
    quote_ms: int
    interest_ms: int


def decision_inputs(
    news: DataFrame, quotes: DataFrame, interest: DataFrame, trades: DataFrame, grid: Grid, windows: InputWindows
) -> DataFrame:
    """News context, damage, quotes, open interest and low of every instant, from what was received by then.

    ``news``: ``received_ms``, ``armed``, ``damaging``.  ``quotes``: ``received_ms``, ``id``, ``executable``.
    ``interest``: ``received_ms``, ``id``, ``open_interest``.  ``trades``: ``received_ms``, ``event_ms``, ``price``.

    An item in a window is there exactly when the newest one is, so every input is a running extreme.  All sources
    share the cells of the grid: one grouping with map-side sums, then one running pass over cells, whatever their
    number.  Rows without a receive time, and prices that are missing, are never seen.

    NEWS_ARMED follows an armed item within ``armed_ms``; without any item within ``silent_ms`` the context is UNKNOWN.
    A missing or old quote is not executable.  The change of open interest compares the newest reading with the one
    that was newest ``interest_ms`` before.  The low is the lowest price so far, at its first time.
    """
    at = F.col("received_ms")
    reading = F.struct("received_ms", "id", "open_interest")
    sources = [
        news.select(at.alias("seen"), F.when(F.col("armed"), at).alias("armed"), F.when(F.col("damaging"), at).alias("damaged"), at.alias("item")),
        quotes.select(at.alias("seen"), F.struct("received_ms", "id", "executable").alias("quote")),
        interest.select(at.alias("seen"), reading.alias("reading")),
        interest.select((at + windows.interest_ms).alias("seen"), reading.alias("earlier")),
        trades.filter(F.col("price").isNotNull()).select(at.alias("seen"), F.struct("price", "event_ms").alias("low")),
    ]
    together = sources[0]
    for source in sources[1:]:
        together = together.unionByName(source, allowMissingColumns=True)
    names = ("armed", "damaged", "item", "quote", "reading", "earlier", "low")
    instants = grid.instants(news.sparkSession)
    known = extremes_at(together, instants, [], grid, F.col("seen"), {n: F.col(n) for n in names}, smallest=["low"])
    now = F.col("as_of_ms")

    def within(ms: Column, span: int) -> Column:
        return F.coalesce(ms >= now - F.lit(span), F.lit(False))

    return known.select(
        "as_of_ms",
        F.when(within(F.col("armed"), windows.armed_ms), "NEWS_ARMED")
        .when(within(F.col("item"), windows.silent_ms), "NO_NEWS").otherwise("UNKNOWN").alias("news_context"),
        F.when(within(F.col("damaged"), windows.damage_ms), "FAIL").otherwise("PASS").alias("permanent_damage"),
        (within(F.col("quote.received_ms"), windows.quote_ms) & F.coalesce(F.col("quote.executable"), F.lit(False))).alias("executable"),
        oi_change(F.col("earlier.open_interest"), F.col("reading.open_interest")).alias("open_interest_change"),
        whole_seconds(now - F.col("low.event_ms")).cast("long").alias("seconds_since_low"),
    )


def first_before(df: DataFrame, grid: Grid, condition: Column, name: str) -> DataFrame:
    """``as_of_ms`` and the first strictly earlier instant at which ``condition`` held, or null."""
    found = running(
        df, [], ["as_of_ms"], {name: Measure("min", F.when(condition, F.col("as_of_ms")))}, inclusive=False,
        segment=grid.segment(),
    )
    return found.select("as_of_ms", name)


def with_sell_facts(snapshots: DataFrame, sells: DataFrame, grid: Grid) -> DataFrame:
    """``has_sell_fact``: a tranche was sold at an earlier instant."""
    first = first_before(sells.select("as_of_ms", "fraction"), grid, F.col("fraction") > 0, "__sold_ms")
    joined = snapshots.join(first, "as_of_ms")
    return joined.withColumn("has_sell_fact", F.col("__sold_ms").isNotNull()).drop("__sold_ms")


def rebuy_in_order(snapshots: DataFrame, grid: Grid, evaluate) -> DataFrame:
    """``evaluate`` (snapshots with ``first_tranche_ms`` to decisions) along a run, one cycle a run.

    Whether an instant buys the first tranche depends on earlier instants only through an earlier first tranche.
    So a pass without any finds the right first one, and a second pass knows it at all later instants.
    """
    nothing = snapshots.withColumn("first_tranche_ms", F.lit(None).cast("long"))
    tranches = evaluate(nothing).select("as_of_ms", "stage")
    first = first_before(tranches, grid, F.col("stage") == "REBUY_TRANCHE_1", "first_tranche_ms")
    return evaluate(snapshots.join(first, "as_of_ms"))
