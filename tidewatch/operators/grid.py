"""Evaluation grid, as-of lookups and rolling windows.

The scheme behind every grid operator:

1. Each tick falls into a *cell*: the resolution step that ends at the first grid point at
   or after it.  A tick exactly on a grid point gets its own cell, so a window that is
   closed on both ends is a whole number of cells.  Cell number ``2i`` is the open step
   before point ``i``, ``2i+1`` the point itself.
2. Ticks are summarised per (key, cell) with an ordinary ``groupBy``.  Partial aggregation
   runs before the shuffle, so a key holding a third of all ticks shuffles no more rows than
   it has cells.
3. Windows run over cells and grid rows in time buckets.  A bucket holds a fixed number of
   cells whatever the tick volume; cells within the look-back of the next bucket are sent
   there as well.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.times import int_div
from tidewatch.operators.running import Measure, running


SEGMENT_POINTS = 4096
ROWS_BLOCK = 10_000


@dataclass(frozen=True)
class Grid:
    """Regular evaluation instants from ``start_ms`` to ``end_ms`` (both included)."""

    start_ms: int
    end_ms: int
    step_ms: int
    bucket_ms: int | None = None

    @property
    def points(self) -> int:
        return max(0, (self.end_ms - self.start_ms) // self.step_ms + 1)

    def segment(self, at: str = "as_of_ms") -> Column | None:
        """Segments of 4,096 instants; none when the whole grid is that short."""
        if self.points <= SEGMENT_POINTS:
            return None
        return int_div(F.col(at) - F.lit(self.start_ms), SEGMENT_POINTS * self.step_ms)

    def bucket(self, lookback_ms: int, resolution_ms: int) -> int:
        """Bucket width in resolution steps: at least the look-back and 4,096 grid steps."""
        width = self.bucket_ms or max(lookback_ms, SEGMENT_POINTS * self.step_ms)
        return max(1, math.ceil(max(width, lookback_ms) / resolution_ms))

    def instants(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.start_ms, self.end_ms + 1, self.step_ms).select(
            F.col("id").alias("as_of_ms")
        )

    def rows(self, spark: SparkSession, key: str | None = None, values: Sequence[str] = ()) -> DataFrame:
        """Instants, once per configured key value."""
        instants = self.instants(spark)
        if key is None:
            return instants
        listed = F.explode(F.array(*[F.lit(v) for v in values]))
        return instants.select("as_of_ms", listed.alias(key))


    def rows_of(self, keys: DataFrame, key: str) -> DataFrame:
        """Instants, once per distinct key of the data.  They are made block by block, so a long grid is no large row."""
        found = keys.select(key).distinct()
        if self.end_ms < self.start_ms:
            return found.select(F.lit(0).cast("long").alias("as_of_ms"), key).limit(0)
        step, block = self.step_ms, self.step_ms * ROWS_BLOCK
        starts = F.explode(F.sequence(F.lit(self.start_ms).cast("long"), F.lit(self.end_ms).cast("long"), F.lit(block).cast("long")))
        last = F.least(F.col("__start") + block - step, F.lit(self.end_ms).cast("long"))
        instants = F.explode(F.sequence(F.col("__start"), last, F.lit(step).cast("long")))
        return found.select(key, starts.alias("__start")).select(instants.alias("as_of_ms"), key)


def grid_over(df: DataFrame, time_ms: str, step_ms: int, bucket_ms: int | None = None) -> Grid:
    """Grid spanning the data, starting on a multiple of the step."""
    low, high = df.agg(F.min(time_ms), F.max(time_ms)).first()
    low, high = (low, high) if low is not None else (0, -1)
    return Grid((low // step_ms) * step_ms, high, step_ms, bucket_ms)


def resolution(grid: Grid, *spans_ms: int) -> int:
    return reduce(math.gcd, [s for s in spans_ms if s], grid.step_ms)


def cell(ms: Column, grid: Grid, res: int) -> Column:
    """Cell number of an instant (see the module text)."""
    offset = ms - F.lit(grid.start_ms).cast("long")
    rest = F.pmod(offset, F.lit(res).cast("long"))
    point = int_div(offset, res)
    return F.when(rest == 0, point * 2 + 1).otherwise(point * 2 + 2).cast("long")


def summarise(
    ticks: DataFrame, keys: Sequence[str], time_ms: Column, grid: Grid, res: int, measures: dict[str, Column]
) -> DataFrame:
    """One row per (key, cell)."""
    return (
        ticks.filter(time_ms <= grid.end_ms)
        .withColumn("cell", cell(time_ms, grid, res))
        .groupBy(*keys, "cell")
        .agg(*[m.alias(n) for n, m in measures.items()])
    )


class Timeline:
    """Cells and grid rows of one key side by side, in time buckets."""

    def __init__(self, cells: DataFrame, grid_rows: DataFrame, keys: Sequence[str], grid: Grid,
                 res: int, lookback_ms: int):
        self.keys, self.res, self.grid = list(keys), res, grid
        steps = grid.bucket(lookback_ms, res)
        reach = math.ceil(lookback_ms / res)
        point = int_div(F.col("cell"), 2)
        bucket = int_div(point, steps)
        # the first point of the next bucket looks back as far as `reach` steps
        next_one = F.when((bucket + 1) * steps - reach <= point, bucket + 1)
        copies = cells.withColumn("bucket", F.explode(F.array_compact(F.array(bucket, next_one))))
        rows = grid_rows.withColumn("cell", cell(F.col("as_of_ms"), grid, res))
        rows = rows.withColumn("bucket", int_div(int_div(F.col("cell"), 2), steps))
        self.frame = copies.unionByName(rows, allowMissingColumns=True)

    def window(self, lookback_ms: int, lag_ms: int = 0):
        """Frame over ``[t - lookback, t - lag]``, closed on both ends."""
        return (
            Window.partitionBy(*self.keys, "bucket")
            .orderBy("cell")
            .rangeBetween(-2 * (lookback_ms // self.res), -2 * (lag_ms // self.res))
        )

    def select(self, columns: dict[str, Column]) -> DataFrame:
        """Evaluate window columns at the grid rows."""
        return (
            self.frame.select(*self.keys, "as_of_ms", *[c.alias(f"__{n}") for n, c in columns.items()])
            .filter(F.col("as_of_ms").isNotNull())
            .select(*self.keys, "as_of_ms", *[F.col(f"__{n}").alias(n) for n in columns])
        )


def newest(fields: dict[str, Column]) -> Column:
    """Aggregate: the row with the greatest leading fields, as a struct."""
    return F.max(F.struct(*[c.alias(n) for n, c in fields.items()]))


def asof_latest(
    ticks: DataFrame,
    grid_rows: DataFrame,
    keys: Sequence[str],
    grid: Grid,
    fields: dict[str, Column],
    visible_ms: Column,
    lags_ms: dict[str, int],
    retention_ms: int,
) -> DataFrame:
    """Newest row visible at or before ``as_of - lag`` within the retention, per lag name.

    ``fields`` orders the rows: its leading entries are the time and the id tie-break.
    """
    res = resolution(grid, retention_ms, *lags_ms.values())
    cells = summarise(ticks, keys, visible_ms, grid, res, {"__newest": newest(fields)})
    timeline = Timeline(cells, grid_rows, keys, grid, res, retention_ms)
    return timeline.select(
        {
            name: F.max("__newest").over(timeline.window(retention_ms, lag))
            for name, lag in lags_ms.items()
        }
    )


def asof_any_age(
    ticks: DataFrame,
    grid_rows: DataFrame,
    keys: Sequence[str],
    grid: Grid,
    fields: dict[str, Column],
    visible_ms: dict[str, Column],
) -> DataFrame:
    """Newest row ever visible at each instant, for one or more visibility times.

    A row becomes visible for ``name`` at ``visible_ms[name]`` and stays so; with
    ``greatest(event, received)`` this is the event-ordered lookup that ignores rows not yet
    received.  Unlimited look-back: bucket totals are carried forward.
    """
    out = None
    for name, visible in visible_ms.items():
        # all that was visible before the grid is one cell a key
        before = F.lit(grid.start_ms - grid.step_ms)
        clamped = F.when(visible < before, before).otherwise(visible)
        cells = summarise(ticks, keys, clamped, grid, grid.step_ms, {name: newest(fields)})
        rows = grid_rows.withColumn("cell", cell(F.col("as_of_ms"), grid, grid.step_ms))
        merged = cells.unionByName(rows, allowMissingColumns=True).withColumn(
            "__grid", F.when(F.col("as_of_ms").isNull(), 0).otherwise(1)
        )
        # earlier cells all fall into the first segment, later ones follow the grid
        segment = None
        if grid.points > SEGMENT_POINTS:
            segment = F.greatest(F.lit(0).cast("long"), int_div(int_div(F.col("cell"), 2), SEGMENT_POINTS))
        result = (
            running(
                merged.withColumnRenamed(name, "__row"),
                keys,
                ["cell", "__grid"],
                {name: Measure("max", F.col("__row"))},
                segment=segment,
            )
            .filter("__grid = 1")
            .select(*keys, "as_of_ms", name)
        )
        out = result if out is None else out.join(result, [*keys, "as_of_ms"])
    return out


def extremes_at(
    df: DataFrame, grid_rows: DataFrame, keys: Sequence[str], grid: Grid, seen_ms: Column, values: dict[str, Column],
    smallest: Sequence[str] = (),
) -> DataFrame:
    """Greatest value of each name (least of those in ``smallest``) among all rows seen at or before every grid row.

    All names share one grouping into cells and one running pass over them.  Rows that were never seen (null) are left out.
    """
    # all that was seen before the grid is one cell a key
    before = F.lit(grid.start_ms - grid.step_ms).cast("long")
    seen = F.when(seen_ms < before, before).otherwise(seen_ms)
    cells = summarise(df, keys, seen, grid, grid.step_ms, {f"__{n}": (F.min if n in smallest else F.max)(v) for n, v in values.items()})
    rows = grid_rows.withColumn("cell", cell(F.col("as_of_ms"), grid, grid.step_ms))
    merged = cells.unionByName(rows, allowMissingColumns=True).withColumn("__grid", F.col("as_of_ms").isNotNull().cast("int"))
    segment = None
    if grid.points > SEGMENT_POINTS:
        segment = F.greatest(F.lit(0).cast("long"), int_div(int_div(F.col("cell"), 2), SEGMENT_POINTS))
    measures = {n: Measure("min" if n in smallest else "max", F.col(f"__{n}")) for n in values}
    found = running(merged, keys, ["cell", "__grid"], measures, segment=segment)
    return found.filter("__grid = 1").select(*keys, "as_of_ms", *values)


def visible_sums(
    ticks: DataFrame,
    grid_rows: DataFrame,
    keys: Sequence[str],
    grid: Grid,
    event_ms: Column,
    received_ms: Column,
    window_ms: int,
    sums: dict[str, Column],
) -> DataFrame:
    """Sums over rows with event time in ``[t - window, t]`` that were received by ``t``.

    A row counts from the later of its two times until its event leaves the window, so it
    enters as a plus at its first instant and a minus at the first instant without it; a
    running sum inside the bucket then gives the window value.  Exact for decimals and counts.
    """
    step = grid.step_ms
    offset = F.greatest(event_ms, received_ms) - F.lit(grid.start_ms).cast("long")
    first = int_div(offset + (step - 1), step)
    beyond = int_div(event_ms + F.lit(window_ms - grid.start_ms).cast("long"), step) + 1
    steps = grid.bucket(window_ms, step)
    entering = ticks.withColumn("__first", first).withColumn("__beyond", beyond)
    entering = entering.filter((F.col("__first") < F.col("__beyond")) & (F.col("__beyond") > 0))
    bucket = int_div(F.col("__first"), steps)
    reaches_next = F.when((bucket + 1) * steps < F.col("__beyond"), bucket + 1)
    moves = F.array(
        F.struct(F.col("__first").alias("point"), F.lit(1).alias("sign")),
        F.struct(F.col("__beyond").alias("point"), F.lit(-1).alias("sign")),
    )
    deltas = (
        entering.withColumn("bucket", F.explode(F.array_compact(F.array(bucket, reaches_next))))
        .withColumn("__move", F.explode(moves))
        .withColumn("point", F.greatest(F.col("__move.point"), F.col("bucket") * steps))
        .groupBy(*keys, "bucket", "point")
        .agg(*[F.sum(v * F.col("__move.sign")).alias(n) for n, v in sums.items()])
    )
    rows = grid_rows.withColumn(
        "point", int_div(F.col("as_of_ms") - F.lit(grid.start_ms).cast("long"), step)
    ).withColumn("bucket", int_div(F.col("point"), steps))
    window = (
        Window.partitionBy(*keys, "bucket").orderBy("point").rangeBetween(Window.unboundedPreceding, 0)
    )
    return (
        deltas.unionByName(rows, allowMissingColumns=True)
        .select(*keys, "as_of_ms", *[F.sum(n).over(window).alias(n) for n in sums])
        .filter(F.col("as_of_ms").isNotNull())
    )


def stabbing_max(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    point: str,
    low: Column,
    high: Column,
    value: Column,
    span: int,
    name: str = "hit",
) -> DataFrame:
    """For every point the greatest ``value`` among intervals ``[low, high]`` that hold it.

    Intervals are at most ``span`` long.  Each is cut into aligned power-of-two blocks (about
    two per level) and reduced to one value per block; a point looks its blocks up by equality.
    No pair of point and interval is ever built, so many intervals over one point stay cheap.
    """
    levels = max(1, math.ceil(math.log2(span + 1)) + 1)
    ks = F.sequence(F.lit(0), F.lit(levels - 1))

    def blocks(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k).cast("long")
        left = ((low + size - 1 - F.pmod(low + size - 1, size)) / size).cast("long")
        right = ((high + 1 - F.pmod(high + 1, size)) / size).cast("long")
        inside = left < right
        # the top level takes every block left; lower levels only those without a full parent
        top = k == levels - 1
        return F.array_compact(
            F.array(
                F.when(inside & (top | (F.pmod(left, F.lit(2)) == 1)),
                       F.struct(k.alias("k"), left.alias("b"))),
                F.when(inside & (top | (F.pmod(right - 1, F.lit(2)) == 0)),
                       F.struct(k.alias("k"), (right - 1).alias("b"))),
            )
        )

    tree = (
        intervals.filter(low <= high)
        .select(*keys, value.alias("__value"), F.explode(F.flatten(F.transform(ks, blocks))).alias("__block"))
        .groupBy(*keys, F.col("__block.k").alias("__k"), F.col("__block.b").alias("__b"))
        .agg(F.max("__value").alias("__value"))
    )
    instants = points.select(*keys, point).distinct()
    lookups = instants.select(*keys, point, F.explode(ks).alias("__k"))
    size = F.pow(F.lit(2.0), F.col("__k")).cast("long")
    lookups = lookups.withColumn("__b", ((F.col(point) - F.pmod(F.col(point), size)) / size).cast("long"))
    best = (
        lookups.join(tree, [*keys, "__k", "__b"])
        .groupBy(*keys, point)
        .agg(F.max("__value").alias(name))
    )
    return points.join(best, [*keys, point], "left")
