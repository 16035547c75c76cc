"""Decision inputs and source health against plain loops."""

import random
from decimal import Decimal

import pytest

from tidewatch.operators import arrivals
from tidewatch.operators.grid import Grid
from tidewatch.plans import inputs

WINDOWS = inputs.InputWindows(armed_ms=70, silent_ms=150, damage_ms=40, quote_ms=60, interest_ms=100)


def draws(count, top, seed):
    r = random.Random(seed)
    return [r.randrange(-50, top) for _ in range(count)]


@pytest.mark.parametrize("points", [40, 700])
def test_decision_inputs_match_loops(spark, points):
    """Rows before the grid, at instants, of one time, without a time or a price; short and segmented grids."""
    top = points * 10
    grid = Grid(0, top - 10, 10)
    r = random.Random(points)
    news = [(t, r.random() < 0.2, r.choice([True, False, False, None])) for t in draws(30, top, 1)] + [(None, True, True)]
    quotes = [(t, i, r.choice([True, False, None])) for i, t in enumerate(draws(60, top, 2) + [20, 20])]
    interest = [(t, i, Decimal(r.randrange(-1, 9))) for i, t in enumerate(draws(40, top, 3))]
    trades = [(t, t - r.randrange(5), r.choice([None, Decimal(r.randrange(40, 60))])) for t in draws(50, top, 4)]
    got = {
        x["as_of_ms"]: x for x in inputs.decision_inputs(
            spark.createDataFrame(news, "received_ms long, armed boolean, damaging boolean"),
            spark.createDataFrame(quotes, "received_ms long, id long, executable boolean"),
            spark.createDataFrame(interest, "received_ms long, id long, open_interest decimal(20,8)"),
            spark.createDataFrame(trades, "received_ms long, event_ms long, price decimal(20,8)"), grid, WINDOWS,
        ).collect()
    }
    assert len(got) == points
    items = [n for n in news if n[0] is not None]
    for at, row in got.items():
        armed = any(a and at - 70 <= t <= at for t, a, _ in items)
        heard = any(at - 150 <= t <= at for t, _, _ in items)
        assert row["news_context"] == ("NEWS_ARMED" if armed else "NO_NEWS" if heard else "UNKNOWN")
        assert row["permanent_damage"] == ("FAIL" if any(d and at - 40 <= t <= at for t, _, d in items) else "PASS")
        quote = max(((t, i, e) for t, i, e in quotes if t <= at), key=lambda q: q[:2], default=None)
        assert row["executable"] == bool(quote and quote[0] >= at - 60 and quote[2])
        now = max(((t, i, v) for t, i, v in interest if t <= at), default=None)
        earlier = max(((t, i, v) for t, i, v in interest if t <= at - 100), default=None)
        change = (now[2] - earlier[2]) / earlier[2] if now and earlier and earlier[2] > 0 else None
        assert (row["open_interest_change"] is None) == (change is None)
        assert change is None or abs(row["open_interest_change"] - change) < Decimal("1e-9")
        low = min(((p, e) for t, e, p in trades if p is not None and t <= at), default=None)
        assert row["seconds_since_low"] == (None if low is None else (at - low[1]) // 1000)


def test_no_source_says_anything(spark):
    empty = {
        "news": "received_ms long, armed boolean, damaging boolean", "quotes": "received_ms long, id long, executable boolean",
        "interest": "received_ms long, id long, open_interest decimal(20,8)", "trades": "received_ms long, event_ms long, price decimal(20,8)",
    }
    frames = {n: spark.createDataFrame([], schema) for n, schema in empty.items()}
    rows = inputs.decision_inputs(**frames, grid=Grid(0, 20, 10), windows=WINDOWS).collect()
    assert [tuple(x)[1:] for x in rows] == [("UNKNOWN", "PASS", False, None, None)] * 3


def test_rebuy_knows_its_own_first_tranche(spark):
    """Two passes give what a loop over the run gives."""
    from pyspark.sql import functions as F

    r = random.Random(5)
    ready = [r.random() < 0.3 for _ in range(60)]
    df = spark.createDataFrame([(i * 10, x) for i, x in enumerate(ready)], "as_of_ms long, ready boolean")

    def evaluate(s):
        first = F.col("first_tranche_ms")
        stage = F.when(~F.col("ready"), "REBUY_WAIT").when(first.isNull(), "REBUY_TRANCHE_1").when(
            F.col("as_of_ms") - first >= 100, "REBUY_COMPLETE").otherwise("REBUY_TRANCHE_2_WAIT")
        return s.withColumn("stage", stage)

    got = {x["as_of_ms"]: x["stage"] for x in inputs.rebuy_in_order(df, Grid(0, 590, 10), evaluate).collect()}
    first = None
    for i, x in enumerate(ready):
        want = "REBUY_WAIT" if not x else "REBUY_TRANCHE_1" if first is None else "REBUY_COMPLETE" if i * 10 - first >= 100 else "REBUY_TRANCHE_2_WAIT"
        assert got[i * 10] == want
        if want == "REBUY_TRANCHE_1":
            first = i * 10


def test_market_health_branches(spark):
    rows = [("a", 5, True, False), ("a", 31, True, True), ("b", 12, True, False), ("b", 13, False, False), ("x", 1, True, True), ("a", 95, True, False)]
    streams = spark.createDataFrame(rows, "stream string, received_ms long, accepted boolean, gapped boolean")
    errors = spark.createDataFrame([("s", 50), ("other", 3)], "source string, received_ms long")
    members = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t")], "stream string, source string")
    found = arrivals.market_health_at(streams, errors, members, Grid(0, 100, 10), 60, 10).collect()
    got = {(x["source"], x["as_of_ms"]): x["status"] for x in found}
    assert [got["s", t] for t in range(0, 101, 10)] == [
        "WARMING_UP", "DEGRADED", "HEALTHY", "HEALTHY", "DEGRADED", "ERROR", "ERROR", "ERROR", "ERROR", "ERROR", "STALE",
    ]
    assert {got["t", t] for t in range(0, 101, 10)} == {"WARMING_UP"} and len(got) == 22


def test_poll_health_log(spark):
    polls = [("a", 1, 0, "ERROR", None), ("a", 2, 10, "OK", None), ("a", 3, 20, "NOT_MODIFIED", "g"), ("a", 4, 30, "ERROR", None), ("a", 5, 90, "ERROR", None), ("a", 6, 95, "OK", None), (None, 7, 1, "OK", None)]
    df = spark.createDataFrame(polls, "source string, poll_no long, polled_ms long, status string, coverage_gap string")
    got = {x["poll_no"]: x["health"] for x in arrivals.poll_health_log(df, "source", 50).collect()}
    assert got == {1: "ERROR", 2: "HEALTHY", 3: "DEGRADED", 4: "ERROR", 5: "STALE", 6: "HEALTHY", 7: "HEALTHY"}
