"""Readers, writers, pages, journals."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.hashing import sha256
from tidewatch.operators.ordered import sequence_audit
from tidewatch.sources import evidence, journals, market, pages


def landed(spark, day="2024-03-01", n=5):
    rows = [("feed", f"{day} 05:00:0{i}", f"{day} 05:00:0{i}", json.dumps({"z": 0 if i else None, "a": i})) for i in range(n)]
    return spark.createDataFrame(rows, "source_id string, event_time string, received_at string, payload string")


def test_evidence_round_trip(spark, tmp_path):
    root = str(tmp_path / "evidence")
    evidence.write_evidence(landed(spark), root, "1.0.0", "run-1")
    back = evidence.read_evidence(spark, root)
    assert back.count() == 5
    first = back.filter(F.get_json_object("payload_json", "$.a") == "0").first()
    assert first["payload_json"] == '{"a":0,"z":null}' and first["payload_hash"].startswith("sha256:")
    assert back.filter(F.get_json_object("payload_json", "$.z") == "0").count() == 4  # zero is not missing
    with pytest.raises(FileExistsError):
        evidence.write_evidence(landed(spark), root, "1.0.0", "run-1")
    evidence.write_evidence(landed(spark, "2023-01-01", 2), root, "1.0.0", "run-2")
    assert evidence.read_evidence(spark, root).count() == 7
    old = evidence.retention_candidates(spark, root, dt.date(2024, 3, 2), 180).collect()
    assert {r["run"] for r in old} == {"run-2"}
    listed = evidence.manifest(spark, root)
    assert sum(r["record_count"] for r in listed.collect()) == 7
    saved = spark.createDataFrame(listed.collect(), listed.schema)
    assert evidence.verify_files(spark, saved, root).count() == 0
    broken = saved.withColumn("sha256", F.lit("sha256:0"))
    assert {r["problem"] for r in evidence.verify_files(spark, broken, root).collect()} == {"HASH"}


@pytest.mark.parametrize("run", ["../x", "a/b", ""])
def test_evidence_refuses_unsafe_names(spark, tmp_path, run):
    with pytest.raises(ValueError):
        evidence.write_evidence(landed(spark), str(tmp_path), "1.0.0", run)


def test_evidence_refuses_empty(spark, tmp_path):
    with pytest.raises(ValueError):
        evidence.write_evidence(landed(spark).limit(0), str(tmp_path), "1.0.0", "r")


def test_klines_trades_derivatives(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps([[1000, "1", "3", "1", "2.5", "7", 1999, "0", 3, "0", "0", "0"]]))
    (tmp_path / "t.json").write_text(json.dumps([{"a": 1, "p": "2", "q": "3", "T": 5, "m": True}, {"a": 2, "p": "2", "q": "3", "T": 6, "m": False}]))
    (tmp_path / "d.json").write_text(json.dumps([{"symbol": "S", "sumOpenInterest": "10.5", "timestamp": 9}]))
    k = market.read_klines(spark, str(tmp_path / "k.json"), "A").first()
    assert (k["event_ms"], float(k["price"]), k["side"], k["sequence"]) == (1999, 2.5, "UNKNOWN", 1000)
    assert [r["side"] for r in market.read_agg_trades(spark, str(tmp_path / "t.json"), "A").orderBy("sequence").collect()] == ["SELL", "BUY"]
    assert float(market.read_derivatives(spark, str(tmp_path / "d.json")).first()["open_interest"]) == 10.5


def test_stream_messages(spark):
    trade = {"e": "aggTrade", "E": 9, "s": "AAA", "a": 7, "p": "2", "q": "3", "T": 5, "m": True, "M": False}
    quote = {"u": 4, "s": "AAA", "b": "1", "B": "9", "a": "2", "A": "9"}
    texts = [json.dumps({"stream": "x", "data": trade}), json.dumps(quote), json.dumps({**trade, "s": "ZZZ"}), "not json"]
    df = spark.createDataFrame([(i, 100, t) for i, t in enumerate(texts)], "n long, received_ms long, message string")
    got = market.parse_stream_messages(df, {"AAA": "asset-a"}).orderBy("n").collect()
    assert (got[0]["kind"], got[0]["side"], float(got[0]["quote_notional"]), got[0]["event_ms"]) == ("AGG_TRADE", "SELL", 6.0, 5)
    assert (got[1]["kind"], float(got[1]["mid_price"]), got[1]["event_ms"], got[1]["latency_measurable"]) == ("BOOK_TICKER", 1.5, 100, False)
    assert [g["tick_error"] for g in got] == [None, None, "INVALID_MESSAGE", "INVALID_MESSAGE"]


def page(items):
    return "<script>self.__next_f.push(" + json.dumps([1, "x:" + items]) + ")</script>"


def test_page_items(spark):
    one = {"id": 11, "title": 'a "quoted" {brace}', "abstract": "t", "created_at": "2024-01-01T00:00:00Z", "category": None}
    two = {"id": "12", "title": "b", "created_at": "2024-01-01T00:00:00Z", "category": {"id": 1, "name": "c"}}
    newer = {**one, "title": "changed"}
    text = json.dumps([one, two, newer], separators=(",", ":"))
    rows = [(1, page(text), "https://h/newsletter/12"), (2, "请先登录 " + page(text), "https://h/newsletter/x"), (3, "<html></html>", "https://h/newsletter/9?q=1")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string")
    items = pages.extract_page_items(df)
    got = {(r["page_id"], r["item_id"]): r for r in items.collect()}
    assert got[1, "11"]["title"] == "changed" and got[1, "12"]["category"] == "c" and got[1, "12"]["abstract"] == ""
    assert got[2, None]["page_error"] == "LOGIN_WALL" and got[3, None]["page_error"] == "SCHEMA_DRIFT_OR_EMPTY_LIST"
    detail = {r["page_id"]: r for r in pages.page_item_detail(df, items).collect()}
    assert detail[1]["title"] == "b" and detail[2]["detail_error"] == "DETAIL_URL_INVALID" and detail[3]["detail_error"] == "DETAIL_ITEM_MISSING"


def test_journal_lines(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"sequence":1,"kind":"A"}\n\n  \n{broken\n{"sequence":2,"kind":"B"}\n')
    got = journals.read_journal(spark, str(tmp_path / "j.jsonl"), "sequence long, kind string").collect()
    assert len(got) == 3 and sum(r["_corrupt_record"] is not None for r in got) == 1


def test_appended_journal_passes_its_audit(spark):
    batch = spark.createDataFrame([("j", i * 10, "K", json.dumps({"i": i})) for i in range(20)], "journal string, at long, kind string, payload string")
    written = journals.append_sequenced(batch, ["journal"], ["at"], "kind", "at", "payload", "rec", segments=4)
    assert [r["sequence"] for r in written.orderBy("at").collect()] == list(range(1, 21))
    checks = lambda df: sequence_audit(df, ["journal"], "sequence", "record_id", "payload_hash", "payload", "at", "at")
    assert checks(written).count() == 0
    tampered = written.withColumn("payload", F.when(F.col("sequence") == 3, "{}").otherwise(F.col("payload")))
    assert [(r["sequence"], r["violation"]) for r in checks(tampered).collect()] == [(3, "HASH_MISMATCH")]
    missing = written.filter("sequence <> 5")
    assert checks(missing).filter("violation = 'SEQUENCE_GAP'").count() == 15


def test_append_idempotent(spark):
    stored = spark.createDataFrame([("a", "h1")], "id string, h string")
    batch = spark.createDataFrame([("a", "h1", 1), ("a", "h2", 2), ("b", "x", 3), ("b", "x", 4), ("b", "y", 5)], "id string, h string, n long")
    got = {r["n"]: r["append_state"] for r in journals.label_appends(stored, batch, "id", "h", "n").collect()}
    assert got == {1: "NO_OP", 2: "CONFLICT", 3: "APPEND", 4: "NO_OP", 5: "CONFLICT"}
    fresh, conflicts = journals.append_idempotent(stored, batch, "id", "h", "n")
    assert fresh.count() == 1 and conflicts.count() == 2


def test_replay_manifest_is_stable(spark):
    rows = [("r", f"e{i}", 100 + i // 2, i + 1, "K", "{}") for i in range(50)]
    df = spark.createDataFrame(rows, "run string, event_id string, received_ms long, ingestion_sequence long, kind string, payload string")
    build = lambda d, parts: journals.replay_manifest(d.repartition(parts), ["run"], "sha256:c", "1", fan_in=8, segments=parts).first()
    one, other = build(df, 3), build(df, 7)
    assert one == other and one["event_count"] == 50
    changed = df.withColumn("payload", F.when(F.col("event_id") == "e9", "{ }").otherwise(F.col("payload")))
    assert build(changed, 3)["input_hash"] != one["input_hash"]
    assert sha256 is not None
