"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

MOST_ROUNDS = 60


def _apart(column: Column | str) -> Column:
    """The same value under another expression: a join on it is exchanged for it on both sides, so Spark can split a hot key."""
    return F.bitwise_not(F.col(column) if isinstance(column, str) else column)


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs ``u, v`` with the least of u and all its v; minima are combined before the exchange."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least")).select(_apart("u").alias("of_u"), "least")
    return pairs.join(least, _apart("u") == F.col("of_u")).select("u", "v", "least")


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of every id in the long columns ``a, b``; the root is the least id of its component.

    Each round is stored in the shared folder; it ends when a round changes nothing.  No pair of a component is made
    beyond the star around its root.
    """
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(pairs)
    for _ in range(MOST_ROUNDS):
        if mark[0] == 0:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        joined = _with_least(large)
        small = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(joined.select("u", F.col("least").alias("v")))
        pairs = stored(small.where("u <> v").distinct())
        before, mark = mark, _mark(pairs)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _mark(pairs: DataFrame) -> tuple:
    found = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    return tuple(found)
