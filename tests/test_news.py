"""Text rules, gate boundaries, clusters, search."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text as rules
from tidewatch.operators import lookups, news

CASES = [
    # text, type, direction, severity, countries
    ("加拿大与美国贸易谈判暂停，双方拟加征 50% 关税并反制", "TRADE_SANCTIONS", "RISK_OFF", "HIGH", ["US", "CA"]),
    ("欧洲央行紧急降息以支持经济复苏", "MONETARY_MACRO", "RISK_ON", "HIGH", ["EU"]),
    ("中国人民银行维持利率不变", "MONETARY_MACRO", "UNKNOWN", "MEDIUM", ["CN"]),
    ("以色列与伊朗冲突升级为全面战争", "GEOPOLITICS", "RISK_OFF", "SYSTEMIC", ["IL", "IR"]),
    ("日本发生重大灾害，能源供应链中断", "ENERGY_SUPPLY", "RISK_OFF", "HIGH", ["JP"]),
    ("美联储QE政策", "MONETARY_MACRO", "UNKNOWN", "MEDIUM", ["US"]),
    ("新的QE计划", "MONETARY_MACRO", "UNKNOWN", "MEDIUM", []),
    ("SEQEL release", "OTHER", "UNKNOWN", "UNKNOWN", []),
    ("every SECond counts", "CRYPTO_POLICY", "UNKNOWN", "MEDIUM", ["US"]),
    ("opec 原油会议", "ENERGY_SUPPLY", "UNKNOWN", "MEDIUM", []),
    ("某交易所发布产品更新", "OTHER", "UNKNOWN", "UNKNOWN", []),
    (" 　\n", "UNKNOWN", "UNKNOWN", "UNKNOWN", []),
]


def test_labelled_texts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i long, t string")
    for r in news.classify(df, F.col("t")).collect():
        want = CASES[r["i"]]
        assert (r["event_type"], r["direction"], r["severity"], r["countries"]) == want[1:], want[0]


def test_attribution(spark):
    df = spark.createDataFrame([(" 社 ", "据某报报道，x"), ("", "据 某通讯社 报道，x"), ("", "无来源"), (None, "据，报道")], "s string, a string")
    got = [r[0] for r in df.select(rules.attribution(F.col("s"), F.col("a"))).collect()]
    assert got == ["社", "某通讯社", None, None]


W, NOW = 7_200_000, 100_000_000


@pytest.mark.parametrize(
    "occurred,received,outcome",
    [
        (NOW - W, NOW - W, "ENTERED_RISK_OBSERVATION"), (NOW - W - 1, NOW, "NOT_TRIGGERED"), (NOW, NOW, "ENTERED_RISK_OBSERVATION"),
        (NOW + 1, NOW, "REVIEW_REQUIRED"), (NOW, NOW + 1, "REVIEW_REQUIRED"), (None, NOW, "REVIEW_REQUIRED"),
    ],
)
def test_gate_window(spark, occurred, received, outcome):
    df = spark.createDataFrame([(True, "RISK_OFF", "HIGH", occurred, received)], "macro_relevant boolean, direction string, severity string, occurred_ms long, received_ms long")
    assert news.news_gate(df, F.lit(NOW), W).first()["outcome"] == outcome


def test_gate_fail_beats_review(spark):
    df = spark.createDataFrame([(True, "UNKNOWN", "MEDIUM", NOW, NOW), (False, "RISK_OFF", "HIGH", NOW, NOW)], "macro_relevant boolean, direction string, severity string, occurred_ms long, received_ms long")
    got = news.news_gate(df, F.lit(NOW), W).collect()
    assert [r["outcome"] for r in got] == ["NOT_TRIGGERED"] * 2
    assert [c["state"] for c in got[1]["checks"]] == ["FAIL", "NOT_APPLICABLE", "NOT_APPLICABLE", "NOT_APPLICABLE"]
    assert got[1]["window_ends_ms"] is None


def test_gate_texts_and_versions(spark):
    schema = "macro_relevant boolean, event_type string, direction string, severity string, occurred_ms long, received_ms long"
    rows = [
        (True, "GEOPOLITICS", "RISK_OFF", "SYSTEMIC", NOW, NOW), (True, "ENERGY_SUPPLY", "NEUTRAL", "LOW", NOW - W - 1, NOW),
        (True, "TRADE_SANCTIONS", "UNKNOWN", "UNKNOWN", None, NOW), (False, "OTHER", "RISK_ON", "HIGH", NOW, NOW), (True, None, "RISK_ON", "MEDIUM", NOW + 1, NOW),
    ]
    got = news.news_gate(spark.createDataFrame(rows, schema), F.lit(NOW), W, model_version="m", config_version="c").collect()
    assert [[c["current"] for c in r["checks"]] for r in got] == [
        ["地缘政治", "风险偏高", "系统性影响", "处于 120 分钟观察窗口内"], ["能源供给", "影响中性", "低影响", "首次判断时已超过 120 分钟窗口"],
        ["贸易与制裁", "方向无法确认", "影响程度无法确认", "新闻发生时间无法确认"], ["普通快讯", *["无需继续判断"] * 3], [None, "风险缓和", "中等影响", "时间顺序异常"],
    ]
    assert [c["label"] for c in got[0]["checks"]] == ["属于宏观风险", "风险正在上升", "达到高影响", "仍在观察窗口"]
    assert {(r["rule_version"], r["model_version"], r["config_version"]) for r in got} == {("news-gate-v1", "m", "c")}


def test_cluster(spark):
    rows = [
        ("o1", 0, "f", "s1", "T0", "VERIFIED", 30), ("o2", 0, "f", "s2", "T1", "UNVERIFIED", 10), ("o2", 1, "f", "s2", "T1", "UNVERIFIED", 20),
        ("o3", 0, "f", "relay", "T2", "UNKNOWN", 40), ("o4", 0, "f", "s5", "T4", "UNKNOWN", 50), ("o5", 0, None, "s6", "T0", "VERIFIED", 5),
    ]
    df = spark.createDataFrame(rows, "observation_id string, revision int, fingerprint string, source_id string, source_tier string, credibility string, received_ms long")
    c = news.cluster_news(df, spark.createDataFrame([("relay",)], "source_id string")).collect()
    assert len(c) == 1
    c = c[0]
    assert (c["observations"], c["independent_sources"], c["amplification"], c["source_count"], c["revision"]) == (4, 2, 2, 4, 4)
    assert (c["fact_confidence"], c["attention_state"], c["official_ms"], c["first_received_ms"], c["last_updated_ms"]) == ("VERIFIED", "TRENDING", 30, 20, 50)


def test_revisions_a_b_a(spark):
    df = spark.createDataFrame([("i", n, h) for n, h in enumerate("ABAAB")], "item string, poll long, h string")
    got = news.revisions(df, "item", ["poll"], "h", F.floor(F.col("poll") / 2)).orderBy("poll").collect()
    assert [(r["revision"], r["is_duplicate"]) for r in got] == [(0, False), (1, False), (2, False), (2, True), (3, False)]


def test_poll_coverage_gap(spark):
    polls = {1: [1, 2], 2: [2, 3], 3: [8, 9], 4: [9], 5: [4]}
    df = spark.createDataFrame([("s", p, i) for p, ids in polls.items() for i in ids], "source string, poll long, item long")
    got = news.poll_coverage_gaps(df, "source", "poll", "item", F.col("poll") % 1).collect()
    assert [(r["poll"], r["coverage_gap"]) for r in got] == [(3, "CURSOR_NOT_VISIBLE:3->9")]


def test_search_pages_cover_the_list(spark):
    rows = [(str(i), f"rec-{i}", "Text" if i % 2 else "other", "NOT_TRIGGERED", 1000 + i // 3) for i in range(25)]
    df = spark.createDataFrame(rows, "item_id string, record_id string, headline string, outcome string, first_received_ms long")
    seen, cursor = [], None
    while True:
        page = news.search_audit(df, ["headline"], 5, text=" TEXT ", cursor=cursor).orderBy("position").collect()
        seen += [int(r["item_id"]) for r in page]
        assert page[0]["total"] == 25 and page[0]["filtered_total"] == 12
        cursor = page[0]["next_cursor"]
        if cursor is None:
            break
    assert seen == sorted([i for i in range(25) if i % 2], key=lambda i: (-(i // 3), -i))
    unknown = news.search_audit(df, ["headline"], 5, cursor="rec-none").orderBy("position").collect()
    assert int(unknown[0]["item_id"]) == 24
    with pytest.raises(ValueError):
        news.search_audit(df, ["headline"], 101)


def test_illegal_transitions(spark):
    allowed = [("SELL", "A", "B"), ("SELL", "*", "X")]
    df = spark.createDataFrame([("SELL", "A", "B"), ("SELL", "B", "A"), ("SELL", "B", "X"), ("SELL", "B", "B"), ("REBUY", "A", "B")], "model string, from_stage string, to_stage string")
    assert {(r["model"], r["from_stage"], r["to_stage"]) for r in lookups.illegal_transitions(df, allowed).collect()} == {("SELL", "B", "A"), ("REBUY", "A", "B")}
