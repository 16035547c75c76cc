"""Keyed stream state over several triggers against the batch operators."""

import random
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators.arrivals import classify_arrivals
from tidewatch.operators.ordered import latched_context
from tidewatch.operators.running import fixed_segments
from tidewatch.session import ship
from tidewatch.streaming import state, streams

ARRIVAL = "symbol string, id long, received_ms long, sequence long"


def run(spark, tmp_path, name, parts, schema, build):
    """Land each part and run the stream after it; returns the rows told and the progress of every trigger."""
    folder, progress = str(tmp_path / name), []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        progress.append(query.recentProgress)
    return spark.read.schema(stream.schema).parquet(f"{folder}/data").collect(), progress


def labels(rows):
    return sorted((r["symbol"], r["id"], r["arrival_state"], r["previous_sequence"], r["missing"]) for r in rows)


def random_arrivals(seed, n):
    r = random.Random(seed)
    numbers = {"a": 0, "b": 1 << 20}
    rows = []
    for i in range(n):
        symbol = r.choice("aab")
        step = r.choice([0, 1, 1, 1, 1, 3, 70_000])
        numbers[symbol] += step
        rows.append((symbol, i, i * 10, numbers[symbol] - r.choice([0, 0, 0, 1, 2, 70_001])))
    return rows


def test_block_sets_round_trip():
    r = np.random.default_rng(1)
    for members in ([0], [65_535], [0, 1, 2, 65_534, 65_535], range(65_536), r.choice(65_536, 30_000, replace=False), r.choice(65_536, 500, replace=False)):
        data = state.packed(np.array(sorted(members), np.int64))
        assert np.flatnonzero(state.unpacked(data)).tolist() == sorted(members) and len(data) <= 8192
    assert not state.unpacked(None).any()
    assert len(state.packed(np.arange(65_536))) == 4


def test_labels_equal_batch_over_triggers(spark, tmp_path):
    ship(spark)
    rows = random_arrivals(3, 240)
    build = lambda s: state.arrival_labels(s, ["symbol"], ["received_ms", "id"], "sequence", ("b",))
    got, _ = run(spark, tmp_path, "labels", [rows[:90], rows[90:100], rows[100:]], ARRIVAL, build)
    batch = classify_arrivals(spark.createDataFrame(rows, ARRIVAL), ["symbol"], ["received_ms", "id"], "sequence", F.col("symbol") != "b", 3)
    assert labels(got) == labels(batch.collect())
    assert {r["arrival_state"] for r in got} == {"ACCEPTED", "DUPLICATE", "OUT_OF_ORDER"}


def test_repeat_after_a_million_rows_is_a_duplicate(spark, tmp_path):
    ship(spark)
    many = spark.range(1, 1_000_001).select(F.lit("a").alias("symbol"), F.col("id"), F.col("id").alias("received_ms"), (F.col("id") + F.when(F.col("id") > 3, 1).otherwise(0)).alias("sequence"))
    folder = str(tmp_path / "many")
    many.coalesce(1).write.parquet(f"{folder}/in")
    spark.createDataFrame([("a", 2_000_001, 2_000_001, 2), ("a", 2_000_002, 2_000_002, 4), ("a", 2_000_003, 2_000_003, 1_000_002)], ARRIVAL).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(ARRIVAL).parquet(f"{folder}/in")
    told = streams.run_to_table(state.arrival_labels(source, ["symbol"], ["received_ms", "id"], "sequence"), f"{folder}/out")
    last = {r.id: (r.arrival_state, r.missing) for r in told.filter("id > 1000000").collect()}
    assert last == {2_000_001: ("DUPLICATE", 0), 2_000_002: ("OUT_OF_ORDER", 0), 2_000_003: ("ACCEPTED", 0)}
    assert told.filter("arrival_state = 'ACCEPTED'").count() == 1_000_001 and told.agg(F.sum("missing")).first()[0] == 1


def test_new_checkpoint_starts_from_the_journal(spark, tmp_path):
    ship(spark)
    rows = random_arrivals(4, 200)
    build = lambda s: state.arrival_labels(s, ["symbol"], ["received_ms", "id"], "sequence")
    whole, _ = run(spark, tmp_path, "whole", [rows], ARRIVAL, build)
    first, _ = run(spark, tmp_path, "first", [rows[:120]], ARRIVAL, build)
    journal = spark.createDataFrame([tuple(r) for r in first], f"{ARRIVAL}, arrival_state string, previous_sequence long, missing long")
    start = state.accepted_state(journal, ["symbol"], "sequence")
    second, _ = run(spark, tmp_path, "second", [rows[120:150], rows[150:]], ARRIVAL, lambda s: state.arrival_labels(s, ["symbol"], ["received_ms", "id"], "sequence", initial=start))
    assert labels([*first, *second]) == labels(whole)


def test_journal_appends_each_record_once(spark, tmp_path):
    ship(spark)
    schema = "id string, h string, n long, note string"
    parts = [
        [("a", "h1", 2, "x"), ("a", "h1", 1, "y"), ("a", "h1", 1, "x"), ("b", "h2", 2, "x"), ("b", "h9", 3, "x"), (None, "h", 1, "x")],
        [("a", "h1", 0, "x"), ("a", "other", 1, "x"), ("c", "h3", 5, "x"), ("c", "h3", 5, "x")],
        [("c", "h3", 1, "x"), ("b", "h2", 9, "x"), ("d", None, 1, "x"), ("d", None, 2, "x"), ("d", "h", 3, "x")],
    ]
    got, progress = run(spark, tmp_path, "journal", parts, schema, lambda s: state.journal_labels(s, "id", "h", "n"))
    told = sorted(((r.id, r.h, r.n, r.note, r.append_state) for r in got), key=repr)
    assert [t[:4] for t in told if t[4] == "APPEND"] == [("a", "h1", 1, "x"), ("b", "h2", 2, "x"), ("c", "h3", 5, "x"), ("d", None, 1, "x"), (None, "h", 1, "x")]
    assert [t[:3] for t in told if t[4] == "CONFLICT"] == [("a", "other", 1), ("b", "h9", 3), ("d", "h", 3)]
    assert len(told) == 15
    assert [sum(p["numInputRows"] for p in trigger) for trigger in progress] == [6, 4, 5]
    # A new checkpoint that starts from the journal knows all of its records.
    stored = spark.createDataFrame([t[:4] for t in told if t[4] == "APPEND"], schema)
    again, _ = run(spark, tmp_path, "again", [parts[0]], schema, lambda s: state.journal_labels(s, "id", "h", "n", initial=state.journal_state(stored, "id", "h")))
    assert sorted(r.append_state for r in again) == ["CONFLICT"] + ["NO_OP"] * 5


def test_gaps_expire_without_a_later_row_of_their_stream(spark, tmp_path):
    ship(spark)
    parts = [
        [("a", 1, 1000, 5), ("a", 2, 1100, 9), ("a", 3, 1100, 12)],  # two gaps found at one instant
        [("b", 4, 3000, 1), ("b", 5, 3100, 2)],  # nothing of a; the watermark passes 2100
        [("b", 6, 9000, 7)], [("b", 7, 9500, 8)],
    ]
    schema = f"{ARRIVAL}, received_at timestamp"
    build = lambda s: state.gap_events(s.withColumn("received_at", F.timestamp_millis("received_ms")), ["symbol"], ["received_ms", "id"], "sequence", "received_ms", "received_at", 1000, "0 seconds")
    got, _ = run(spark, tmp_path, "gaps", [[(*r, None) for r in p] for p in parts], schema, build)
    assert sorted(map(tuple, got)) == [
        ("a", 1100, "OPENED", 6, 8), ("a", 1100, "OPENED", 10, 11), ("a", 2100, "EXPIRED", 6, 8), ("a", 2100, "EXPIRED", 10, 11), ("b", 9000, "OPENED", 3, 6),
    ]


def test_panes_equal_plain_windows_and_forget(spark, tmp_path):
    ship(spark)
    r = random.Random(8)
    rows = sorted((r.randrange(0, 60_000) // 250 * 250, r.choice(["hot", "hot", "hot", "cold"]), Decimal(r.randint(1, 9))) for _ in range(400))
    rows += [(200_000 + 500 * k, "hot", Decimal(1)) for k in range(20)]  # a long pause, in which instants go on
    rows = [(key, at, v, None) for at, key, v in rows]
    schema = "key string, received_ms long, price decimal(20,8), received_at timestamp"
    build = lambda s: state.rolling_panes(s.withColumn("received_at", F.timestamp_millis("received_ms")), ["key"], "received_at", "received_ms", {"total": F.col("price")}, 1000, 5000, "0 seconds")
    cut = [0, 100, 250, 400, len(rows)]
    parts = [rows[a:b] for a, b in zip(cut, cut[1:])]
    got, progress = run(spark, tmp_path, "panes", parts, schema, build)
    end = max(x[1] for x in rows) - 1000
    wanted = set()
    for key in ("hot", "cold"):
        own = [(at, v) for k, at, v, _ in rows if k == key]
        for instant in range(own[0][0] // 1000 * 1000, end + 1, 1000):
            inside = [(at, v) for at, v in own if instant - 5000 <= at <= instant]
            wanted.add((key, instant, len(inside), max((at for at, _ in inside), default=None), sum((v for _, v in inside), Decimal(0))))
    assert {tuple(x) for x in got} == wanted and len(got) == len(wanted)
    # A trigger reads its own rows only, and the state does not grow with the history.
    assert [sum(p["numInputRows"] for p in trigger) for trigger in progress] == [len(p) for p in parts]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress[-1]) < 40


def test_latched_context_equals_batch_over_triggers(spark, tmp_path):
    """Ready and recorded rows, ties, a key that is never set, null flags; every trigger of one row and of many."""
    ship(spark)
    schema = "k string, at long, id long, ready boolean, recorded boolean"
    r = random.Random(7)
    rows = [(r.choice("aab"), i // 3, i, r.choice([True, False, False, None]), r.random() < 0.03) for i in range(10, 150)]
    rows = [("c", 0, 0, False, None), *rows, ("b", 60, 200, True, True)]
    got, _ = run(spark, tmp_path, "latch", [rows[:2], rows[2:61], rows[61:]], schema, lambda s: state.latched_context(s, ["k"], ["at", "id"], "ready", "recorded"))
    batch = latched_context(spark.createDataFrame(rows, schema), ["k"], ["at", "id"], F.col("ready"), fixed_segments(F.col("at"), 10), F.col("recorded"))
    told = lambda found: sorted((x["k"], x["id"], x["context"], x["context_ms"] or -1) for x in found)
    assert told(got) == told(batch.collect())
    assert {x["context"] for x in got} == {"NONE", "SHADOW_REFERENCE", "USER_RECORDED"}
