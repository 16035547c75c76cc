"""Exact order statistics against sorted lists, with one key that holds nearly all rows."""

import math
import random
from decimal import Decimal
from statistics import median

from pyspark.sql import functions as F

from tidewatch.operators import features, selection


def rows(seed, n):
    r = random.Random(seed)
    keys = ["hot"] * 18 + ["cold", None]
    return [(r.choice(keys), r.choice([None, float(r.randint(-5, 5)), r.gauss(0, 1000), 1e300, -1e300, 0.1])) for _ in range(n)]


def values(data):
    found = {}
    for key, v in data:
        if v is not None:
            found.setdefault(key, []).append(v)
    return {k: sorted(v) for k, v in found.items()}


def test_ranks_and_medians(spark):
    data = [*rows(1, 3000), ("one", 4.0), ("two", 4.0), ("two", 7.0), ("none", None)]
    counts = selection.counted(spark.createDataFrame(data, "k string, v double"), ["k"], "v")
    ranks = {f"p{round(100 * p)}": selection.nearest(p) for p in (0.01, 0.5, 0.95, 1.0)}
    got = {x.k: x for x in selection.at_ranks(counts, ["k"], "v", ranks, 7).collect()}
    wanted = values(data)
    assert set(got) == set(wanted)
    for key, xs in wanted.items():
        assert got[key].samples == len(xs) and got[key].greatest == xs[-1]
        assert [got[key][n] for n in ranks] == [xs[max(0, math.ceil(p * len(xs)) - 1)] for p in (0.01, 0.5, 0.95, 1.0)]
    middle = {x.k: (x.samples, x.m) for x in selection.medians(counts, ["k"], "v", "m", 5).collect()}
    assert middle == {k: (len(xs), median(xs)) for k, xs in wanted.items()}
    assert selection.at_ranks(counts.limit(0), ["k"], "v", ranks).count() == 0


def test_no_task_holds_the_hot_key(spark):
    """The values of the hot key are dealt over the segments: none has more than a small part of them."""
    data = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("k"), F.col("id").cast("double").alias("v"))
    counts = selection.counted(data, ["k"], "v")
    sizes = [x["count"] for x in selection.segmented(counts, ["v"], 16).filter("k = 'hot'").groupBy("__segment").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 18_000 / 6
    assert {x.k: x.p50 for x in selection.at_ranks(counts, ["k"], "v", {"p50": selection.nearest(0.5)}, 16).collect()} == {"hot": 9_999.0, "cold": 9_990.0}


def test_mad_scale(spark):
    data = [(k, v) for k, v in rows(2, 800) if v is None or abs(v) < 1e299] + [("few", 1.0)] * 3
    got = {x.k: x for x in features.mad_scale(spark.createDataFrame(data, "k string, v double"), ["k"], "v", Decimal("1.4826"), 5).collect()}
    for key, xs in values(data).items():
        away = median(abs(x - median(xs)) for x in xs)
        assert got[key].samples == len(xs)
        assert got[key].sigma is None if len(xs) < 5 else math.isclose(got[key].sigma, away * 1.4826, rel_tol=1e-12)
        assert got[key].sigma_state == ("KNOWN" if len(xs) >= 5 else "UNKNOWN")
