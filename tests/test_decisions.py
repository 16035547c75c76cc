"""Open-interest baseline, quotes, staged stages and stream/batch agreement."""

from decimal import Decimal

from pyspark.sql import functions as F

from tidewatch.operators import lookups, quotes
from tidewatch.operators.arrivals import classify_arrivals
from tidewatch.operators.features import order_flow_received
from tidewatch.operators.grid import Grid
from tidewatch.streaming import streams

# Open interest every five minutes from 03:40, contracts to one decimal.
START, FIVE = 1787370000000, 300_000
SERIES = [
    "24008321.6", "24009953.0", "24000784.8", "23998774.4", "24006171.9", "23982900.0", "23978263.4", "24075249.2",
    "24137264.3", "24176032.6", "24233152.7", "24533835.0", "24598389.0", "24612022.6", "24609980.7", "24615660.8",
    "24633571.0", "24628070.2", "24301344.1", "23531546.4", "22998988.0", "22876213.7", "23122109.2", "23141794.5",
]


def series(spark):
    rows = [("t", i, START + i * FIVE, START + i * FIVE, Decimal(v)) for i, v in enumerate(SERIES)]
    return spark.createDataFrame(rows, "asset string, id long, observed_ms long, received_ms long, value decimal(20,8)")


def test_open_interest_golden(spark):
    armed, later = START + 225_000, START + 17 * FIVE + 6_999
    events = spark.createDataFrame([("t", armed, later)], "asset string, armed_ms long, later_ms long")
    frozen = lookups.freeze_baseline(events, series(spark), ["asset"], "armed_ms", 360_000)
    assert frozen.first()["baseline_ms"] == START
    change = lookups.baseline_changes(frozen, series(spark), ["asset"], "armed_ms", "observed_ms", "value", Decimal("-0.05")).first()
    assert abs(change["minimum_change"] - Decimal("-0.047154812354729536779")) < Decimal("1e-12")
    assert change["minimum_ms"] == START + 21 * FIVE and not change["limit_reached"]
    cheat = lookups.counterfactual_baseline(events, series(spark), ["asset"], "armed_ms", "later_ms", 360_000).first()
    assert cheat["differs"] and cheat["illegal_baseline_ms"] == START + 17 * FIVE
    at = Decimal(SERIES[20])
    assert abs((at - cheat["illegal_baseline"]) / cheat["illegal_baseline"] - Decimal("-0.066147375201163751758")) < Decimal("1e-12")


def test_baseline_boundaries(spark):
    rows = [("t", 1, 0, 0, Decimal(1)), ("t", 2, 100, 151, Decimal(2)), ("t", 3, 120, 120, None), ("t", 4, 90, 95, Decimal(4))]
    s = spark.createDataFrame(rows, "asset string, id long, observed_ms long, received_ms long, value decimal(20,8)")
    events = spark.createDataFrame([("t", a) for a in (150, 151, 190, 200, 201, 89)], "asset string, armed_ms long")
    got = {r["armed_ms"]: r["baseline_id"] for r in lookups.freeze_baseline(events, s, ["asset"], "armed_ms", 100).collect()}
    # not yet received, received, still fresh, exactly at the tolerance, beyond it, only the first
    assert got == {150: 4, 151: 2, 190: 2, 200: 2, 201: None, 89: 1}


def test_flow_without_a_known_quantity_is_unknown(spark):
    rows = [("x", 1, 1000, Decimal(2), None, "SELL"), ("x", 2, 9000, Decimal(2), Decimal(3), "BUY"), ("x", 3, 9500, Decimal(2), None, "SELL")]
    trades = spark.createDataFrame(rows, "asset string, id long, at long, price decimal(20,8), quantity decimal(20,8), side string")
    got = {r["id"]: (r["buy_notional"], r["sell_notional"], r["records"]) for r in lookups.flow_at(trades.select("asset", "id", "at"), trades, ["asset"], "at", "at", 2000).collect()}
    assert got == {1: (None, None, 1), 2: (6, 0, 1), 3: (6, 0, 2)}


def test_quote_states(spark):
    rows = [
        ("s1", "AGGREGATOR", "1", "100", 5), ("s1", "CANONICAL_POOL", "1", "101", 5), ("s2", "AGGREGATOR", "1", "100", 5), ("s2", "CANONICAL_POOL", "1", "102", 5),
        ("s3", "AGGREGATOR", "1", "100", 5), ("s4", "AGGREGATOR", "1", "100", 5), ("s4", "CANONICAL_POOL", "1", "100", 9),
    ]
    raw = spark.createDataFrame(
        [(s, k, Decimal(a), Decimal(o), b, 6, 1000, f"{s}{k}") for s, k, a, o, b in rows],
        "snapshot_id string, provider_kind string, amount_in decimal(20,8), expected_out decimal(20,8), provider_block long, latest_block long, observed_ms long, observation_id string",
    )
    checked = quotes.cross_check(quotes.pair_providers(quotes.provider_quotes(raw, Decimal("50"), 6, 5000, 2)), Decimal("100"))
    assert {r["snapshot_id"]: r["cross_check"] for r in checked.collect()} == {"s1": "PASS", "s2": "FAIL", "s3": "UNKNOWN", "s4": "STALE"}
    assert {r["snapshot_id"]: r["quote_state"] for r in quotes.snapshot_state(checked).collect()} == {"s1": "PASS", "s2": "PARTIAL", "s3": "PARTIAL", "s4": "PARTIAL"}


def arrivals(spark):
    rows = [("T", i, i * 10, s) for i, s in enumerate([10, 10, 9, 13, 14, 13, 20, 19, 21])]
    return spark.createDataFrame(rows, "symbol string, id long, received_ms long, sequence long")


def test_stream_arrivals_agree_with_batch_over_triggers(spark, tmp_path):
    """One file per trigger: the state carries the last sequence from file to file."""
    data = arrivals(spark)
    for n in range(3):
        data.filter(F.floor(F.col("id") / 3) == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    labelled = streams.classify_arrivals(source, ["symbol"], ["received_ms", "id"], "sequence")
    got = {r["id"]: (r["arrival_state"], r["missing"]) for r in streams.run_to_table(labelled, str(tmp_path / "out")).collect()}
    batch = classify_arrivals(data, ["symbol"], ["received_ms", "id"], "sequence", F.lit(True), 3)
    assert got == {r["id"]: (r["arrival_state"], r["missing"]) for r in batch.collect()}


def test_stream_features_restart(spark, tmp_path):
    """Stop after the first half, restart from the checkpoint: equal to one batch run."""
    rows = [("x", i, t, Decimal(1 + i % 3), Decimal(1), "BUY" if i % 2 else "SELL") for i, t in enumerate(range(1000, 30_000, 700))]
    df = spark.createDataFrame(rows, "asset string, id long, received_ms long, price decimal(20,8), quantity decimal(20,8), side string")
    folder = str(tmp_path / "f")

    def evaluate(recent, start, end):
        grid = Grid(start, end, 1000)
        return order_flow_received(recent, None, grid.rows(spark, "asset", ["x"]), "asset", grid, 5000, 2000)

    for half in (F.col("received_ms") < 15_000, F.col("received_ms") >= 15_000):
        df.filter(half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        streams.run_batches(source, streams.feature_sink(folder, "received_ms", evaluate, 1000, 10_000), f"{folder}/checkpoint")
    got = {r["as_of_ms"]: (r["flow_state"], r["buy_notional"], r["sell_notional"]) for r in spark.read.parquet(f"{folder}/features").collect()}
    grid = Grid(1000, max(got), 1000)
    whole = order_flow_received(df, None, grid.rows(spark, "asset", ["x"]), "asset", grid, 5000, 2000)
    assert got == {r["as_of_ms"]: (r["flow_state"], r["buy_notional"], r["sell_notional"]) for r in whole.collect()}


def test_journal_sink_appends_once(spark, tmp_path):
    folder = str(tmp_path / "j")
    for n, rows in enumerate([[("a", "h1", 1), ("b", "h2", 2)], [("a", "h1", 3), ("b", "other", 4), ("c", "h3", 5)]]):
        spark.createDataFrame(rows, "id string, h string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id string, h string, n long").parquet(str(tmp_path / "in"))
        streams.run_batches(source, streams.journal_sink(folder, "id", "h", "n"), f"{folder}/checkpoint")
    assert {(r["id"], r["n"]) for r in spark.read.parquet(f"{folder}/journal").collect()} == {("a", 1), ("b", 2), ("c", 5)}
    assert [(r["id"], r["n"]) for r in spark.read.parquet(f"{folder}/conflicts").collect()] == [("b", 4)]
