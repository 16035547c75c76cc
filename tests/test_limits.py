"""Large amounts, long runs, repeated records and null keys."""

from decimal import Decimal

from pyspark.sql import functions as F

from tidewatch.functions import decimals
from tidewatch.operators import features, lookups, ordered
from tidewatch.operators.arrivals import approximate_quantiles
from tidewatch.operators.grid import Grid
from tidewatch.operators.running import Measure, fixed_segments, running
from tidewatch.sources import journals

TRADES = "asset string, id long, event_ms long, received_ms long, price decimal(20,8), quantity decimal(20,8), side string"
D = Decimal


def test_quotients_of_large_amounts(spark):
    df = spark.createDataFrame([(D("2e12"), D("1e12")), (D("1"), D("3")), (D("5"), D("0")), (D("9e20"), D("3e20"))], "a decimal(38,8), b decimal(38,8)")
    got = [r[0] for r in df.select(decimals.ratio(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 2 and got[1] == D("0.333333333333333333") and got[2] is None and got[3] == 3


def test_flow_of_large_windows(spark):
    trades = [("k", i, 1_000, 1_000, D(10**6), D(5 * 10**5), "SELL" if i % 2 else "BUY") for i in range(40)]
    trades += [("b", 100 + i, 1_000, 1_000, D(10**5), D(10**4), "BUY") for i in range(2)]
    t = spark.createDataFrame(trades, TRADES)
    grid = Grid(1_000, 3_000, 1_000)
    rows = grid.rows(spark, "asset", ["k", "b"])
    flow = {(r["asset"], r["as_of_ms"]): r for r in features.order_flow(t, rows, "asset", grid, 2_000).collect()}
    assert flow["k", 2_000]["buy_notional"] == D(10) * 10**12 and flow["k", 2_000]["buy_sell_ratio"] == 1
    assert flow["b", 2_000]["buy_notional"] == D(2) * 10**9 and flow["b", 2_000]["buy_sell_ratio"] == D(2) * 10**21
    seen = {(r["asset"], r["as_of_ms"]): r for r in features.order_flow_received(t, None, rows, "asset", grid, 2_000, 2_000).collect()}
    assert seen["k", 2_000]["sell_notional"] == D(10) * 10**12 and seen["k", 2_000]["buy_sell_ratio"] == 1


def test_manifest_of_more_events_than_the_levels_hold(spark):
    rows = [("r", f"e{i}", 100 + i, i + 1, "K", "{}") for i in range(10)]
    df = spark.createDataFrame(rows, "run string, event_id string, received_ms long, ingestion_sequence long, kind string, payload string")
    got = journals.replay_manifest(df, ["run"], "sha256:c", "1", fan_in=2, levels=2).collect()
    assert [(r["run"], r["event_count"]) for r in got] == [("r", 10)]


def test_identical_rows_are_appended_once(spark):
    stored = spark.createDataFrame([("a", "h1")], "id string, h string")
    batch = spark.createDataFrame([("b", "x", 1), ("b", "x", 1), ("a", "h1", 2), ("a", "h1", 2)], "id string, h string, n long")
    states = sorted((r["id"], r["append_state"]) for r in journals.label_appends(stored, batch, "id", "h", "n").collect())
    assert states == [("a", "NO_OP"), ("a", "NO_OP"), ("b", "APPEND"), ("b", "NO_OP")]


def test_first_quote_of_a_batch_is_stored(spark):
    batch = spark.createDataFrame([("s1", 5, "x"), ("s1", 5, "y"), ("s2", 5, "z")], "snapshot string, at long, note string")
    old = batch.filter("snapshot = 's2'").select(journals.quote_record_id(F.col("snapshot"), F.col("at")).alias("record_id"))
    got = {r["note"]: r["is_duplicate"] for r in journals.append_quote_records(old, batch, "snapshot", "at").collect()}
    assert got == {"x": False, "y": True, "z": True}


def test_later_user_record_replaces_the_first(spark):
    rows = [("k", 1, False, False), ("k", 2, True, False), ("k", 3, False, True), ("k", 4, False, False), ("k", 5, False, True)]
    df = spark.createDataFrame(rows, "k string, t long, ready boolean, rec boolean")
    got = ordered.latched_context(df, ["k"], ["t"], F.col("ready"), fixed_segments(F.col("t"), 2), F.col("rec"))
    assert [(r["context"], r["context_ms"]) for r in got.orderBy("t").collect()] == [
        ("NONE", None), ("SHADOW_REFERENCE", 2), ("USER_RECORDED", 3), ("USER_RECORDED", 3), ("USER_RECORDED", 5)
    ]


def test_null_keys_carry_over_segments(spark):
    df = spark.createDataFrame([(None, i) for i in range(8)] + [("a", i) for i in range(3)], "k string, t long")
    got = running(df, ["k"], ["t"], {"n": Measure("sum", F.lit(1))}, segment=fixed_segments(F.col("t"), 2))
    assert [r["n"] for r in got.filter("k IS NULL").orderBy("t").collect()] == list(range(1, 9))


def test_equal_arming_instants_do_not_multiply(spark):
    events = spark.createDataFrame([("t", 10, 20)] * 3, "asset string, armed_ms long, later_ms long")
    series = spark.createDataFrame([("t", 1, 9, 9, D(1)), ("t", 2, 19, 19, D(2))], "asset string, id long, observed_ms long, received_ms long, value decimal(20,8)")
    assert lookups.counterfactual_baseline(events, series, ["asset"], "armed_ms", "later_ms", 100).count() == 3


def test_sketch_stays_near(spark):
    df = spark.range(10_000).withColumn("v", F.col("id").cast("double"))
    got = df.agg(approximate_quantiles("v").alias("q")).first()["q"]
    assert all(abs(a - b) <= 2 for a, b in zip(got, (4_999, 9_499, 9_899)))
