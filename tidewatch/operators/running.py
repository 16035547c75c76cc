"""Ordered running state that never needs a whole key in one task.

A key (asset, stream, journal) may hold a third of all rows, so a plain
``PARTITION BY key ORDER BY time`` window would put a third of the data into one task.
:func:`running` splits each key into consecutive *segments*, computes the running value
inside every segment, the total of every segment, and carries the totals forward.  A
segment is a bounded piece of work; the carry table has one row per key and segment.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, NumericType, StringType

SEGMENT = "__segment"


@dataclass(frozen=True)
class Measure:
    """A running aggregate: ``max``, ``min``, ``sum`` or ``last`` (newest non-null)."""

    kind: str
    value: Column


def fixed_segments(column: Column, width: int) -> Column:
    """Segments of equal width over an integer order column."""
    w = F.lit(width).cast("long")
    return ((column - F.pmod(column, w)) / w).cast("long")


def with_segments(
    df: DataFrame, order_ms: str, segments: int | None = None, sample: DataFrame | None = None, tie: str | None = None
) -> DataFrame:
    """Add ``__segment`` from quantiles of the order column, so bursts spread evenly.

    Like Spark's own range sort this looks at the order column first; the bounds are a short
    list of numbers, one per segment, whatever the data size.  ``sample`` names a cheaper
    DataFrame with the same columns (a plain scan instead of a derived result).  A single
    instant that fills several segments is cut further by ``tie``, the next order column, when
    that is a number.
    """
    if segments is None:
        segments = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    source = df if sample is None else sample
    if segments <= 1:
        return df.withColumn(SEGMENT, F.lit(0).cast("long"))
    quantiles = [i / segments for i in range(1, segments)]
    found = source.select(F.col(order_ms).cast("double").alias("o")).approxQuantile("o", quantiles, 1 / (4 * segments))
    bounds = sorted(set(found))
    if not bounds:
        return df.withColumn(SEGMENT, F.lit(0).cast("long"))
    splits = [float("-inf"), *bounds, float("inf")]
    marked = Bucketizer(splits=splits, inputCol="__segment_order", outputCol="__segment_bucket").transform(
        df.withColumn("__segment_order", F.col(order_ms).cast("double"))
    )
    segment = F.col("__segment_bucket").cast("long")
    crowded = [v for v in bounds if found.count(v) > 1]
    if crowded and tie is not None and isinstance(df.schema[tie].dataType, (LongType, IntegerType)):
        segment = segment * (segments + 2) + _within_instant(source, order_ms, tie, crowded, segments)
    return marked.withColumn(SEGMENT, segment).drop("__segment_order", "__segment_bucket")


def _within_instant(source: DataFrame, order_ms: str, tie: str, crowded: list[float], segments: int) -> Column:
    """Position inside the bucket that starts with a crowded instant.

    Rows of the instant come first, cut by quantiles of ``tie``; later rows of the bucket follow.
    """
    order = F.col(order_ms).cast("double")
    cuts = (
        source.filter(order.isin(crowded))
        .groupBy(order.alias("o"))
        .agg(F.percentile_approx(tie, [i / segments for i in range(1, segments)], 10 * segments).alias("cuts"))
        .collect()
    )
    position = F.lit(0)
    for row in cuts:
        inside = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(row["cuts"]))]), lambda c: c <= F.col(tie)))
        start = bisect_right(crowded_bounds := sorted(crowded), row["o"])
        after = crowded_bounds[start] if start < len(crowded_bounds) else float("inf")
        position = F.when(order == row["o"], inside).when(
            (order > row["o"]) & (order < after), segments + 1
        ).otherwise(position)
    return position


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, Measure],
    inclusive: bool = True,
    segment: Column | None = None,
) -> DataFrame:
    """Add running aggregates per key in ``order``; ``inclusive=False`` leaves the row out.

    ``df`` holds ``__segment`` (see :func:`with_segments`) or ``segment`` is given; segments
    must not decrease along ``order``.  ``order`` should end in a unique id.  Without either the
    caller states that a key is bounded (a short grid) and one plain window does the work.
    """
    keys = list(keys)
    if segment is None and SEGMENT not in df.columns:
        return _bounded(df, keys, order, measures, inclusive)
    work = df if segment is None else df.withColumn(SEGMENT, segment)
    # Null keys are a key of their own.  Keys without nulls are made once: windows, totals and the join share them, so
    # the join finds all rows dealt as it needs them.
    plain = {f"__key_{i}": _without_null(work, k) for i, k in enumerate(keys)}
    missing = {f"__null_{i}": F.col(k).isNull() for i, k in enumerate(keys) if work.schema[k].nullable}
    work = work.withColumns({**plain, **missing, SEGMENT: F.coalesce(F.col(SEGMENT), F.lit(-1)) if work.schema[SEGMENT].nullable else F.col(SEGMENT)})
    keys = [*plain, *missing]
    by = [*keys, SEGMENT]
    ordered = F.struct(*order)

    def source(m: Measure) -> Column:
        if m.kind == "last":
            return F.when(m.value.isNotNull(), F.struct(ordered.alias("o"), m.value.alias("v")))
        return m.value

    def function(m: Measure):
        return {"max": F.max, "last": F.max, "min": F.min, "sum": F.sum}[m.kind]

    window = (
        Window.partitionBy(*by)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = work.select(
        "*", *[function(m)(source(m)).over(window).alias(f"__local_{n}") for n, m in measures.items()]
    )
    totals = work.groupBy(*by).agg(
        *[function(m)(source(m)).alias(f"__total_{n}") for n, m in measures.items()]
    )
    previous = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(SEGMENT)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *by,
        *[
            function(m)(F.col(f"__total_{n}")).over(previous).alias(f"__carry_{n}")
            for n, m in measures.items()
        ],
    )
    joined = local.join(carry, by, "left")
    columns = [F.col(c) for c in df.columns if c != SEGMENT]
    for name, m in measures.items():
        here, before = F.col(f"__local_{name}"), F.col(f"__carry_{name}")
        if m.kind == "sum":
            both = F.when(
                here.isNotNull() | before.isNotNull(),
                F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)),
            )
        elif m.kind == "min":
            both = F.least(here, before)
        else:
            both = F.greatest(here, before)
        columns.append((both["v"] if m.kind == "last" else both).alias(name))
    if segment is None:
        columns.append(F.col(SEGMENT))
    return joined.select(*columns)


def _without_null(df: DataFrame, key: str) -> Column:
    """A key column with some value of its type for null."""
    kind = df.schema[key].dataType
    if not df.schema[key].nullable:
        return F.col(key)
    if isinstance(kind, (StringType, NumericType, BooleanType)):
        return F.coalesce(F.col(key), F.lit("" if isinstance(kind, StringType) else False if isinstance(kind, BooleanType) else 0).cast(kind))
    return F.coalesce(F.to_json(F.struct(F.col(key))), F.lit(""))


def _bounded(
    df: DataFrame, keys: list[str], order: Sequence[str], measures: dict[str, Measure], inclusive: bool
) -> DataFrame:
    window = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    columns = []
    for name, m in measures.items():
        if m.kind == "last":
            row = F.when(m.value.isNotNull(), F.struct(F.struct(*order).alias("o"), m.value.alias("v")))
            columns.append(F.max(row).over(window)["v"].alias(name))
        else:
            function = {"max": F.max, "min": F.min, "sum": F.sum}[m.kind]
            columns.append(function(m.value).over(window).alias(name))
    return df.select("*", *columns)


def segmented(df: DataFrame, order: Sequence[str], segments: int | None = None) -> DataFrame:
    """:func:`with_segments` for an order of columns: the first, and the next as the tie-break."""
    return with_segments(df, order[0], segments, tie=order[1] if len(order) > 1 else None)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_number",
    segment: Column | None = None,
) -> DataFrame:
    """``row_number`` per key without gathering a key in one task."""
    return running(df, keys, order, {name: Measure("sum", F.lit(1).cast("long"))}, segment=segment)


def newest_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt: Column, salts: int = 64
) -> DataFrame:
    """Exact newest ``n`` rows per key: first per salted slice of the key, then per key."""
    keys = list(keys)
    sliced = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    return (
        sliced.withColumn("__rank", F.row_number().over(first))
        .filter(F.col("__rank") <= n)
        .withColumn("__rank", F.row_number().over(second))
        .filter(F.col("__rank") <= n)
        .drop("__rank", "__salt")
    )
