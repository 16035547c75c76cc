"""Exact order statistics of all keys at once, without the values of a key in one place.

Equal values are counted before they are dealt; counts then run up along the values in segments (``running``), and the
value at a rank is the least whose running count reaches it.  A key with nearly all rows is spread over all segments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.running import Measure, running, segmented
from tidewatch.session import checkpointed

Rank = Callable[[Column], Column]


def nearest(p: float) -> Rank:
    """Nearest rank ``ceil(p n)``, counted from 1."""
    return lambda n: F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(p) * n))


def counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, value, n)``: how often each known value occurs; kept in the checkpoint folder, as it is read several times."""
    return checkpointed(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))


def at_ranks(counts: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Rank], segments: int | None = None) -> DataFrame:
    """``(keys, samples, greatest, <rank names>)`` of counted values; ``ranks`` give the rank for a number of samples."""
    keys = list(keys)
    upto = running(segmented(counts, [value], segments), keys, [value], {"__upto": Measure("sum", F.col("n"))})
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("__samples"), F.max(value).alias("__greatest"))
    renamed = totals.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys] or [F.lit(True)]
    placed = upto.join(renamed, same)
    found = placed.groupBy(*keys).agg(
        F.max("__samples").alias("samples"), F.max("__greatest").alias("greatest"),
        *(F.min(F.when(F.col("__upto") >= rank(F.col("__samples")), F.col(value))).alias(name) for name, rank in ranks.items()),
    )
    return found


def medians(counts: DataFrame, keys: Sequence[str], value: str, name: str, segments: int | None = None) -> DataFrame:
    """``(keys, samples, <name>)``: the middle value, or the mean of the two."""
    middle = {"__low": lambda n: F.floor((n + 1) / 2), "__high": lambda n: F.floor(n / 2) + 1}
    found = at_ranks(counts, keys, value, middle, segments)
    return found.select(*keys, "samples", ((F.col("__low").cast("double") + F.col("__high").cast("double")) / 2).alias(name))
