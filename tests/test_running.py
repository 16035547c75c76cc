"""Running state in segments against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ordered
from tidewatch.operators.arrivals import classify_arrivals, coverage_summary
from tidewatch.operators.grid import stabbing_max
from tidewatch.operators.running import Measure, fixed_segments, newest_rows, numbered, running, segmented, with_segments


def rows(seed=1, n=400, keys=3):
    """One key holds most rows; times repeat."""
    r = random.Random(seed)
    return [(r.choice(["hot"] * 6 + [f"k{i}" for i in range(keys)]), r.randrange(0, 300), i, r.randrange(0, 50)) for i in range(n)]


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("mode", ["quantiles", "fixed", "one"])
def test_running_matches_loop(spark, inclusive, mode):
    data = rows()
    df = spark.createDataFrame(data, "k string, t long, id long, v long").repartition(5)
    value = F.when(F.col("v") > 10, F.col("v"))
    measures = {"mx": Measure("max", value), "mn": Measure("min", value), "sm": Measure("sum", value), "lt": Measure("last", value)}
    segment = None
    if mode == "quantiles":
        df = with_segments(df, "t", 7)
    elif mode == "fixed":
        segment = fixed_segments(F.col("t"), 23)
    got = {r["id"]: (r["mx"], r["mn"], r["sm"], r["lt"]) for r in running(df, ["k"], ["t", "id"], measures, inclusive, segment).collect()}
    want, seen = {}, {}
    for k, _t, i, v in sorted(data, key=lambda x: (x[0], x[1], x[2])):
        before = list(seen.get(k, []))
        if v > 10:
            seen.setdefault(k, []).append(v)
        vs = seen.get(k, []) if inclusive else before
        want[i] = (max(vs), min(vs), sum(vs), vs[-1]) if vs else (None,) * 4
    assert got == want


def test_running_without_keys(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(100)], "t long, v long")
    got = running(df, [], ["t"], {"s": Measure("sum", F.col("v"))}, segment=fixed_segments(F.col("t"), 9)).orderBy("t").collect()
    total = 0
    for r in got:
        total += r["v"]
        assert r["s"] == total


def test_numbered_and_newest(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "k string, t long, id long, v long")
    got = {r["id"]: r["n"] for r in numbered(with_segments(df, "t", 5), ["k"], ["t", "id"], "n").collect()}
    for k in {d[0] for d in data}:
        for n, d in enumerate(sorted([d for d in data if d[0] == k], key=lambda x: (x[1], x[2])), 1):
            assert got[d[2]] == n
    kept = newest_rows(df, ["k"], [F.desc("t"), F.desc("id")], 5, F.col("id"), 8).collect()
    for k in {d[0] for d in data}:
        want = sorted([d for d in data if d[0] == k], key=lambda x: (-x[1], -x[2]))[:5]
        assert {r["id"] for r in kept if r["k"] == k} == {d[2] for d in want}


def test_one_crowded_instant_is_cut_by_the_tie(spark):
    """Most rows share one instant: still several segments, in order, and right numbers."""
    r = random.Random(6)
    data = [(("k", 50 if r.random() < 0.7 else r.randrange(0, 100), i)) for i in range(2000)]
    df = segmented(spark.createDataFrame(data, "k string, t long, id long").repartition(4), ["t", "id"], 8)
    cut = df.groupBy("__segment").agg(F.count("*").alias("n"), F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", "id")).alias("hi")).orderBy("__segment").collect()
    assert max(x["n"] for x in cut) < 600
    assert all(a["hi"] < b["lo"] for a, b in zip(cut, cut[1:]))
    got = {x["id"]: x["n"] for x in numbered(df, ["k"], ["t", "id"], "n").collect()}
    assert all(got[d[2]] == n for n, d in enumerate(sorted(data, key=lambda x: (x[1], x[2])), 1))


def test_arrivals_known_case(spark):
    df = spark.createDataFrame([("T", i, s) for i, s in enumerate([10, 10, 9, 13])], "symbol string, t long, seq long")
    got = classify_arrivals(df, ["symbol"], ["t"], "seq", F.lit(True), 3).orderBy("t").collect()
    assert [r["arrival_state"] for r in got] == ["ACCEPTED", "DUPLICATE", "OUT_OF_ORDER", "ACCEPTED"]
    assert (got[3]["gap_from"], got[3]["gap_to"], got[3]["missing"]) == (11, 12, 2)


def test_arrivals_match_loop(spark):
    r = random.Random(4)
    data = [("hot" if r.random() < 0.7 else "b", i // 3, i, max(0, i + r.randrange(-15, 15))) for i in range(1500)]
    df = spark.createDataFrame(data, "symbol string, t long, id long, seq long").repartition(6)
    got = {x["id"]: (x["arrival_state"], x["missing"]) for x in classify_arrivals(df, ["symbol"], ["t", "id"], "seq", F.lit(True), 6).collect()}
    last, seen = {}, {}
    for s, _t, i, q in data:
        prev, known = last.get(s), seen.setdefault(s, set())
        if q in known:
            want = ("DUPLICATE", 0)
        elif prev is not None and q < prev:
            want = ("OUT_OF_ORDER", 0)
        else:
            want = ("ACCEPTED", 0 if prev is None else q - prev - 1)
            last[s] = q
            known.add(q)
        assert got[i] == want


def test_coverage(spark):
    df = spark.createDataFrame([("x", 1, 5), ("x", 2, 6), ("x", 3, 9), ("x", 4, 12)], "k string, t long, a long")
    r = coverage_summary(df, ["k"], ["t", "a"], "a", 2).first()
    assert (r["records"], r["gap_events"], r["missing_ids"]) == (4, 2, 4)


def test_stabbing_max_matches_brute_force(spark):
    r = random.Random(3)
    span = 37
    intervals = [(r.choice("ab"), lo := r.randrange(-60, 300), lo + r.randrange(0, span + 1), i) for i in range(300)]
    points = [(r.choice("ab"), r.randrange(-80, 360), i) for i in range(400)]
    left = spark.createDataFrame(points, "k string, p long, id long")
    right = spark.createDataFrame(intervals, "k string, lo long, hi long, v long")
    got = {x["id"]: x["hit"] for x in stabbing_max(left, right, ["k"], "p", F.col("lo"), F.col("hi"), F.col("v"), span).collect()}
    for k, p, i in points:
        assert got[i] == max((v for kk, lo, hi, v in intervals if kk == k and lo <= p <= hi), default=None)


@pytest.mark.parametrize("every,segment", [(10, 10), (10, 50), (37, 40)])
def test_sample_every_matches_loop(spark, every, segment):
    r = random.Random(every)
    data = sorted({(k, r.randrange(0, 2000)) for k in "ab" for _ in range(150)} | {("c", t) for t in range(0, 400, 3)})
    df = spark.createDataFrame(data, "run string, at long").repartition(4)
    got = {(x["run"], x["at"]) for x in ordered.sample_every(df, "run", "at", every, segment).collect()}
    want, last = set(), {}
    for k, t in data:
        if k not in last or t - last[k] >= every:
            want.add((k, t))
            last[k] = t
    assert got == want


def test_sample_every_over_many_levels(spark):
    """One run with nearly all rows over 3,000 segments and gaps, a short one, one instant, rows without run or time."""
    r = random.Random(8)
    times = sorted({r.randrange(-40_000, 20_000) for _ in range(4000)} | set(range(60_000, 61_000)))
    data = [("hot", t, i) for i, t in enumerate(times)] + [("hot", times[0], -1), ("short", 5, 0), ("short", 40, 1), ("one", -7, 0)]
    df = spark.createDataFrame([*data, (None, 3, 0), ("hot", None, 0)], "run string, at long, id long").repartition(4)
    got = {(x["run"], x["at"], x["id"]) for x in ordered.sample_every(df, "run", "at", 33, 34, fan_in=4).collect()}
    kept, last = set(), {}
    for k, t in sorted({(k, t) for k, t, _ in data}):
        if k not in last or t - last[k] >= 33:
            kept.add((k, t))
            last[k] = t
    assert got == {row for row in data if row[:2] in kept}
    assert ordered.sample_every(df.limit(0), "run", "at", 33, 34).count() == 0


def test_streak_low_stage_latch(spark):
    data = [("a", t * 1000, t not in (3, 4, 9), [5, 4, 4, 6, 3, 3, 7, 2, 8, 9, 1, 1][t], "xxyyyxxzzzzz"[t]) for t in range(12)]
    df = spark.createDataFrame(data, "k string, t long, ok boolean, p long, s string")
    segment = lambda: fixed_segments(F.col("t"), 5000)
    held = {x["t"] // 1000: x["held_seconds"] for x in ordered.persistence(df, ["k"], ["t"], F.col("ok"), segment()).collect()}
    assert [held[i] for i in range(12)] == [0, 1, 2, None, None, 0, 1, 2, 3, None, 0, 1]
    lows = {x["t"] // 1000: (x["low"], x["low_ms"] // 1000) for x in ordered.running_low(df, ["k"], ["t"], F.col("p"), segment()).collect()}
    assert lows[2] == (4, 1) and lows[5] == (3, 4) and lows[11] == (1, 10)
    changes = [(x["t"] // 1000, x["from_stage"], x["s"]) for x in ordered.stage_changes(df, ["k"], ["t"], "s", segment()).orderBy("t").collect()]
    assert changes == [(0, None, "x"), (2, "x", "y"), (5, "y", "x"), (7, "x", "z")]
    entered = {x["t"] // 1000: x["stage_entered"] // 1000 for x in ordered.stage_entered(df, ["k"], ["t"], "s", segment()).collect()}
    assert [entered[i] for i in range(12)] == [0, 0, 2, 2, 2, 5, 5, 7, 7, 7, 7, 7]
    latched = {x["t"] // 1000: x["context"] for x in ordered.latched_context(df, ["k"], ["t"], F.col("p") == 3, segment()).collect()}
    assert [latched[i] for i in (3, 4, 11)] == ["NONE", "SHADOW_REFERENCE", "SHADOW_REFERENCE"]
