"""Whole results of the registered streams on small tables of their own."""

import datetime as dt

import duckdb
import pytest

from tidewatch.workload import registry, streaming

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def land(spark, folder, rows):
    """``(event_id, seconds, user, type, value)`` as the table of events."""
    start = dt.datetime(2024, 1, 1)
    found = [(i, None if s is None else start + dt.timedelta(seconds=s), u, e, v, '{"k": 1}') for i, s, u, e, v in rows]
    spark.createDataFrame(found, EVENT).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def told_and_wanted(spark, folder, name):
    found = registry.QUERIES[name](spark, folder)
    told = [tuple(r) for r in found.collect()]
    sql = registry.ORACLES[name].replace("FROM events", f"FROM read_parquet('{folder}/events.parquet/*.parquet')")
    wanted = duckdb.sql(f"SELECT {', '.join(found.columns)} FROM ({sql})").fetchall()
    return sorted(told, key=repr), sorted(wanted, key=repr)


@pytest.mark.parametrize("last", [6 * 3600, 6 * 3600 + 1800])
def test_features_tell_every_key_at_every_instant(spark, tmp_path, last):
    """From the first row of all to the last one, an instant that is the last row's time too; signup and error come late, click never."""
    rows = [(n, 600 * n + 60, n, "view" if n % 3 else "purchase", float(n)) for n in range(30)]
    rows += [(100, 4 * 3600, 1, "signup", 2.0), (101, 4 * 3600 + 5, 1, "error", 2.0), (102, last, 1, "view", 3.0)]
    told, wanted = told_and_wanted(spark, land(spark, tmp_path, rows), "stream_features")
    assert told == wanted
    assert {(key, at) for key, at, *_ in told} == {(key, 1704067200000 + 3_600_000 * h) for key in ("view", "click", "signup", "purchase", "error") for h in range(7)}


@pytest.mark.parametrize("name", ["stream_gap_expiry", "stream_restart_from_journal", "stream_streak_seconds", "stream_journal_sink", "stream_features"])
def test_a_trigger_has_a_bounded_number_of_rows(spark, tmp_path, monkeypatch, name):
    """However long the table, no trigger orders more than about PART_ROWS rows; the results are those of the SQL."""
    monkeypatch.setattr(streaming, "PART_ROWS", 40)
    monkeypatch.setattr(streaming, "RECORD_ROWS", 40)
    rows = [(3 * n - 2 * (n % 5), 700 * n, n % 60, "view" if n % 4 else "error", float(n % 30)) for n in range(300)]
    landed = []
    parts = streaming.landed_parts

    def counted(df, by, folder, least=4, **options):
        before = 0
        for source in parts(df, by, folder, least, **options):
            now = spark.read.parquet(f"{folder}/in").count()
            landed.append(now - before)
            before = now
            yield source

    monkeypatch.setattr(streaming, "landed_parts", counted)
    told, wanted = told_and_wanted(spark, land(spark, tmp_path, rows), name)
    assert told == wanted
    assert len(landed) >= 7 and max(landed) <= 80 and sum(landed) >= 300


def test_gaps_end_at_the_watermark_itself(spark, tmp_path):
    """Gaps of one block of ends: one ends with the last row, one before it, one stays open."""
    rows = [(0, 0, 1, "view", 1.0), (7, 1, 1, "view", 1.0), (14, 1800, 1, "view", 1.0), (21, 1810, 1, "view", 1.0), (28, 1801 + 6 * 3600 - 1, 1, "view", 1.0)]
    told, wanted = told_and_wanted(spark, land(spark, tmp_path, rows), "stream_gap_expiry")
    assert told == wanted and sum(r[2] == "EXPIRED" for r in told) == 2 and sum(r[2] == "OPENED" for r in told) > 3


def test_listed_items_are_dealt_to_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    from tidewatch.workload import arrivals

    start = dt.datetime(2024, 1, 1)
    orders = [(n, start, "OFP"[n % 3], f"{n % 5}") for n in range(2000)]
    items = [(n % 2000, n // 2000 * 7 + n % 3, n % 11, start + dt.timedelta(days=n % 13)) for n in range(9000)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    sf = str(tmp_path)
    plain = sorted(map(tuple, arrivals.poll_head_query(spark, sf).collect()))
    monkeypatch.setattr(arrivals, "TASK_ROWS", 200)
    dealt = arrivals.listed_items(spark, sf)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, arrivals.poll_head_query(spark, sf).collect())) == plain
