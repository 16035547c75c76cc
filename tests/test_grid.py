"""Grid windows against plain loops, with short buckets so that boundaries are crossed."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import tidewatch.operators.grid as grid_module
from tidewatch.operators import features
from tidewatch.operators.grid import Grid, asof_any_age, asof_latest
from tidewatch.plans.panels import grid_timers

SCHEMA = "asset string, id long, event_ms long, received_ms long, price decimal(20,8), quantity decimal(20,8), side string"
START, STEP, WINDOW = 100_000, 1_000, 7_000


def observations(seed=5, n=500, late=True):
    r = random.Random(seed)
    out = []
    for i in range(n):
        e = r.choice([r.randrange(90_000, 140_000), 1000 * r.randrange(90, 140)])
        out.append((
            r.choice(["hot"] * 3 + ["b"]), i, e, e + (r.choice([0, 0, 400, 1000, 5500, 9000]) if late else 0),
            Decimal(r.randrange(50, 150)), None if r.random() < 0.1 else Decimal(r.randrange(1, 5)), r.choice(["BUY", "SELL", "UNKNOWN"]),
        ))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    data = observations()
    return data, spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.fixture(params=[None, 9_000, 16_000])
def grid(request):
    return Grid(START, START + 45_000, STEP, request.param)


def instants(grid):
    return range(grid.start_ms, grid.end_ms + 1, grid.step_ms)


def test_asof_latest_and_lagged(spark, frame, grid):
    data, df = frame
    found = asof_latest(
        df, grid.rows(spark, "asset", ["hot", "b"]), ["asset"], grid,
        {"received_ms": F.col("received_ms"), "id": F.col("id"), "price": F.col("price")}, F.col("received_ms"), {"now": 0, "before": 3000}, 6000,
    )
    got = {(x["asset"], x["as_of_ms"]): (x["now"] and x["now"]["id"], x["before"] and x["before"]["id"]) for x in found.collect()}
    for a in ("hot", "b"):
        for t in instants(grid):
            def newest(cut):
                rows = [d for d in data if d[0] == a and t - 6000 <= d[3] <= cut]
                return max(rows, key=lambda d: (d[3], d[1]))[1] if rows else None
            assert got[a, t] == (newest(t), newest(t - 3000))


@pytest.mark.parametrize("points", [4096, 6])
def test_asof_any_age(spark, frame, monkeypatch, points):
    monkeypatch.setattr(grid_module, "SEGMENT_POINTS", points)
    data, df = frame
    grid = Grid(START, START + 45_000, STEP)
    found = asof_any_age(
        df, grid.rows(spark, "asset", ["hot", "b"]), ["asset"], grid,
        {"event_ms": F.col("event_ms"), "received_ms": F.col("received_ms"), "id": F.col("id")}, {"row": F.greatest("event_ms", "received_ms")},
    )
    got = {(x["asset"], x["as_of_ms"]): x["row"] and x["row"]["id"] for x in found.collect()}
    for a in ("hot", "b"):
        for t in instants(grid):
            rows = [d for d in data if d[0] == a and d[2] <= t and d[3] <= t]
            assert got[a, t] == (max(rows, key=lambda d: (d[2], d[3], d[1]))[1] if rows else None)


def visible(data, asset, t):
    return sorted([d for d in data if d[0] == asset and t - WINDOW <= d[2] <= t and d[3] <= t], key=lambda d: (d[2], d[3], d[1]))


def test_order_flow(spark, frame, grid):
    data, df = frame
    got = {(x["asset"], x["as_of_ms"]): x for x in features.order_flow(df, grid.rows(spark, "asset", ["hot", "b"]), "asset", grid, WINDOW).collect()}
    for a in ("hot", "b"):
        for t in instants(grid):
            rows = visible(data, a, t)
            usable = [d for d in rows if d[5] is not None and d[6] != "UNKNOWN"]
            x = got[a, t]
            assert (x["trades"], x["eligible"]) == (len(rows), len(usable))
            if usable:
                assert x["buy_notional"] == sum((d[4] * d[5] for d in usable if d[6] == "BUY"), Decimal(0))
                assert x["sell_notional"] == sum((d[4] * d[5] for d in usable if d[6] == "SELL"), Decimal(0))
            else:
                assert x["buy_notional"] is None


def test_max_drawdown_without_price_or_too_late(spark):
    """No price, received when every window is over, and a key without any row: UNKNOWN, never 0."""
    grid = Grid(START, START + 20_000, STEP, None)
    rows = [
        ("nothing", 1, START + 500, START + 500, None, None, "BUY"), ("late", 2, START + 500, START + 500 + WINDOW, Decimal(9), None, "BUY"),
        ("old", 3, START - WINDOW - 1, START - WINDOW - 1, Decimal(9), None, "BUY"), ("one", 4, START + 20_000, START + 20_000, Decimal(9), None, "BUY"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ["nothing", "late", "old", "one", "never"]
    for source, known in ((df, {("one", START + 20_000): Decimal(0)}), (df.limit(0), {})):
        got = features.max_drawdown(source, grid.rows(spark, "asset", names), "asset", grid, WINDOW).collect()
        assert len(got) == 21 * len(names)
        assert {(x["asset"], x["as_of_ms"]): x["max_drawdown"] for x in got if x["max_drawdown_state"] == "KNOWN"} == known
        assert all(x["max_drawdown"] is None for x in got if x["max_drawdown_state"] == "UNKNOWN")


def test_max_drawdown_with_late_rows(spark, frame, grid):
    data, df = frame
    got = {(x["asset"], x["as_of_ms"]): x["max_drawdown"] for x in features.max_drawdown(df, grid.rows(spark, "asset", ["hot", "b"]), "asset", grid, WINDOW).collect()}
    for a in ("hot", "b"):
        for t in instants(grid):
            high, worst, rows = None, Decimal(0), visible(data, a, t)
            for d in rows:
                high = d[4] if high is None else max(high, d[4])
                worst = min(worst, (d[4] - high) / high)
            if not rows:
                assert got[a, t] is None
            else:
                assert abs(got[a, t] - worst) < Decimal("1e-15")


def test_received_flow_states(spark):
    t0 = START
    data = [("x", 1, t0 - 7000, t0 - 7000, Decimal(2), Decimal(3), "BUY"), ("x", 2, t0 + 500, t0 + 500, Decimal(1), Decimal(4), "SELL")]
    df = spark.createDataFrame(data, SCHEMA)
    gaps = spark.createDataFrame([("x", t0 + 9_000)], "asset string, received_ms long")
    grid = Grid(t0, t0 + 18_000, STEP)
    got = {x["as_of_ms"] - t0: x for x in features.order_flow_received(df, gaps, grid.rows(spark, "asset", ["x"]), "asset", grid, WINDOW, 5_000).collect()}
    assert got[0]["flow_state"] == "STALE" and got[0]["flow_age_ms"] == 7000  # both ends of the window count
    assert got[1000]["flow_state"] == "KNOWN" and got[1000]["buy_notional"] == 0 and got[1000]["buy_sell_ratio"] == 0
    assert got[5000]["flow_state"] == "KNOWN" and got[6000]["flow_state"] == "STALE"
    assert got[8000]["flow_state"] == "NO_TRADES" and got[8000]["coverage"] is None
    assert got[9000]["flow_state"] == "GAP" and got[16_000]["flow_state"] == "GAP" and got[17_000]["flow_state"] == "NO_TRADES"


def test_received_flow_ignores_trades_without_quantity(spark):
    df = spark.createDataFrame([("x", 1, START, START, Decimal(2), None, "SELL"), ("x", 2, START, START, Decimal(2), Decimal(1), "UNKNOWN")], SCHEMA)
    grid = Grid(START, START, STEP)
    got = features.order_flow_received(df, None, grid.rows(spark, "asset", ["x"]), "asset", grid, WINDOW, 5_000).first()
    assert (got["flow_state"], got["buy_notional"], got["sell_notional"]) == ("NO_TRADES", None, None)


def test_return_boundaries(spark):
    """Two-point market: a fresh price now and one exactly a window ago."""
    points = {"r1": ("100", "99.8"), "r2": ("100", "99.7"), "r3": ("100", "99"), "t": ("1", "0.99")}
    data = [(a, i, START + dt, START + dt, Decimal(p), None, "UNKNOWN") for a, ps in points.items() for i, (dt, p) in enumerate(zip((0, 60_000), ps))]
    df = spark.createDataFrame(data, SCHEMA)
    grid = Grid(START + 60_000, START + 60_000, STEP)
    returns = features.event_return(df, grid.rows(spark, "asset", list(points)), "asset", grid, 60_000)
    cross = features.cross_asset(returns, "asset", ["r1", "r2", "r3"], "t", {"r1": Decimal("-0.002"), "r2": Decimal("-0.0031"), "r3": Decimal("-0.01")}).first()
    assert cross["shock_breadth"] == 2  # equal counts, just above does not
    assert abs(cross["excess_return"] - Decimal("-0.005")) < Decimal("1e-15")
    late = features.asset_state(df, grid.rows(spark, "asset", ["t"]), "asset", grid, 5_000, 60_000, 600_000).first()
    assert late["freshness"] == "FRESH" and late["ret"] == Decimal("-0.01") and late["age_ms"] == 0


@pytest.mark.parametrize("points", [4096, 5])
def test_grid_timers(spark, monkeypatch, points):
    monkeypatch.setattr(grid_module, "SEGMENT_POINTS", points)
    grid = Grid(0, 19_000, 1000)
    pattern = [True, True, None, True, True, True, False, True] + [True] * 12
    df = spark.createDataFrame([(i * 1000, v) for i, v in enumerate(pattern)], "as_of_ms long, ok boolean")
    got = [x["s"] for x in grid_timers(df, [], grid, {"s": F.col("ok")}).orderBy("as_of_ms").collect()]
    assert got == [0, 1, 0, 0, 1, 2, 0, *range(13)]


def test_mad_and_zscore(spark):
    history = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 7, 11)] + [("b", 1.0)] * 4, "k string, x double")
    got = {x["k"]: x["sigma"] for x in features.mad_scale(history, ["k"], "x", Decimal("1.4826"), 5).collect()}
    assert got["a"] == pytest.approx(1.4826 * 3) and got["b"] is None
