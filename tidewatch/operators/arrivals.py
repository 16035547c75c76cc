"""Arrival labels, sequence gaps and stream quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.knowledge import freshness
from tidewatch.functions.times import age_ms
from tidewatch.operators.grid import Grid, extremes_at
from tidewatch.operators.running import Measure, newest_rows, running, segmented


def classify_arrivals(
    arrivals: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sequence: str,
    gapped: Column,
    segments: int | None = None,
) -> DataFrame:
    """Label every arrival ACCEPTED, DUPLICATE or OUT_OF_ORDER and find sequence gaps.

    Accepted means above every earlier sequence of the stream.  A repeat of an accepted
    sequence is a duplicate; other late rows are out of order.  An accepted row of a
    ``gapped`` stream that skips numbers carries the missing range.
    """
    keys = list(keys)
    staged = arrivals.select("*", F.col(sequence).alias("__seq"))
    scanned = running(
        segmented(staged, order, segments),
        keys,
        order,
        {"previous_sequence": Measure("max", F.col("__seq"))},
        inclusive=False,
    ).drop("__segment")
    previous, seq = F.col("previous_sequence"), F.col(sequence)
    accepted = previous.isNull() | (seq > previous)
    # accepted sequences are unique per stream, so the lookup never multiplies rows
    seen = scanned.filter(accepted).select(*keys, "__seq", F.lit(True).alias("__seen"))
    labelled = scanned.join(seen, [*keys, "__seq"], "left")
    gap = accepted & gapped & (seq > previous + 1)
    return labelled.select(
        *arrivals.columns,
        F.when(accepted, "ACCEPTED")
        .when(F.col("__seen"), "DUPLICATE")
        .otherwise("OUT_OF_ORDER")
        .alias("arrival_state"),
        "previous_sequence",
        F.when(gap, previous + 1).alias("gap_from"),
        F.when(gap, seq - 1).alias("gap_to"),
        F.when(gap, seq - previous - 1).otherwise(0).cast("long").alias("missing"),
    )


def gap_label(key: Column, stream: Column) -> Column:
    """``KEY:stream:from-to`` for rows with a gap, else null."""
    return F.when(
        F.col("gap_from").isNotNull(),
        F.concat(key, F.lit(":"), stream, F.lit(":"), F.col("gap_from"), F.lit("-"), F.col("gap_to")),
    )


def nearest_rank(value: str, p: float) -> Column:
    """Exact nearest-rank quantile ``sorted[ceil(p n) - 1]``.

    Values are held as counts per distinct value, so millisecond latencies stay small.
    """
    return F.expr(f"percentile_disc({p}) within group (order by `{value}`)")


def quantiles(value: str, prefix: str = "", kind: str = "long") -> list[Column]:
    name = f"{prefix}_" if prefix else ""
    return [
        nearest_rank(value, 0.5).cast(kind).alias(f"{name}p50"),
        nearest_rank(value, 0.95).cast(kind).alias(f"{name}p95"),
        nearest_rank(value, 0.99).cast(kind).alias(f"{name}p99"),
        F.max(value).alias(f"{name}max"),
    ]


def approximate_quantiles(value: str, accuracy: int = 10_000) -> Column:
    """Sketch-based p50/p95/p99 for groups with very many distinct values."""
    return F.percentile_approx(value, [0.5, 0.95, 0.99], accuracy)


def stream_metrics(
    labelled: DataFrame, expected: DataFrame, keys: Sequence[str], now_ms: int, freshness_ms: int,
    gapped: Column, latency_samples: int | None = None,
) -> DataFrame:
    """Counters, rate, completeness, latency quantiles and freshness per expected stream.

    ``labelled`` comes from :func:`classify_arrivals` with ``received_ms``, ``event_ms``
    (null when latency is not measurable) and a unique ``id``.  Silent streams appear too.  Latencies are
    those of all accepted rows; with ``latency_samples`` only of so many newest rows per stream.
    """
    keys = list(keys)
    state = F.col("arrival_state")
    accepted = state == "ACCEPTED"
    counts = labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(state == "DUPLICATE").alias("duplicates"),
        F.count_if(state == "OUT_OF_ORDER").alias("out_of_order"),
        F.count("gap_from").alias("gap_events"),
        F.sum("missing").alias("missing_ids"),
        F.min("received_ms").alias("first_received_ms"),
        F.max("received_ms").alias("last_received_ms"),
        F.max(F.when(accepted, F.col("received_ms"))).alias("last_accepted_ms"),
    )
    measured = labelled.filter(accepted & F.col("event_ms").isNotNull()).withColumn(
        "latency_ms", age_ms(F.col("received_ms"), F.col("event_ms"))
    )
    if latency_samples is not None:
        measured = newest_rows(
            measured, keys, [F.col("received_ms").desc(), F.col("id").desc()], latency_samples, F.col("id")
        )
    latency = measured.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("latency_samples"), *quantiles("latency_ms", "latency")
    )
    joined = expected.join(counts, keys, "left").join(latency, keys, "left")
    elapsed = F.greatest(F.lit(0.001), (F.lit(now_ms) - F.col("first_received_ms")) / 1000.0)
    zero = F.lit(0).cast("long")
    total = F.coalesce(F.col("accepted") + F.col("missing_ids"), zero)
    counters = ["received", "accepted", "duplicates", "out_of_order", "gap_events", "missing_ids"]
    return joined.select(
        *keys,
        *[F.coalesce(c, zero).alias(c) for c in counters],
        "first_received_ms",
        "last_received_ms",
        F.when(F.col("first_received_ms").isNull(), 0.0)
        .otherwise(F.col("accepted") / elapsed)
        .alias("rate_per_second"),
        F.when(gapped & (total > 0), F.col("accepted") / total).alias("completeness"),
        F.when(F.coalesce("latency_samples", zero) == 0, "NOT_AVAILABLE")
        .otherwise("EXCHANGE_EVENT_TIME")
        .alias("latency_basis"),
        F.coalesce("latency_samples", zero).alias("latency_samples"),
        "latency_p50",
        "latency_p95",
        "latency_p99",
        "latency_max",
        freshness(F.col("last_accepted_ms"), F.lit(now_ms), freshness_ms).alias("freshness"),
    )


def stream_freshness(last_received: DataFrame, expected: DataFrame, keys: Sequence[str],
                     at: Column, freshness_ms: int) -> DataFrame:
    """UNKNOWN, FRESH or STALE for every expected stream."""
    return expected.join(last_received, list(keys), "left").withColumn(
        "freshness", freshness(F.col("last_accepted_ms"), at, freshness_ms)
    )


def market_source_health(streams: DataFrame, by: Sequence[str], disconnected: Column, active_gaps: Column) -> DataFrame:
    """ERROR > WARMING_UP (all missing) > STALE > DEGRADED (some missing or a gap) > HEALTHY.

    ``disconnected`` (error and not connected) and ``active_gaps`` (count) are aggregates
    over the group of streams.
    """
    grouped = streams.groupBy(*by).agg(
        F.count(F.lit(1)).alias("streams"),
        F.count_if(F.col("freshness") == "UNKNOWN").alias("missing_streams"),
        F.count_if(F.col("freshness") == "STALE").alias("stale_streams"),
        disconnected.alias("disconnected"),
        active_gaps.alias("active_gaps"),
    )
    return grouped.withColumn(
        "status",
        F.when(F.col("disconnected"), "ERROR")
        .when(F.col("missing_streams") == F.col("streams"), "WARMING_UP")
        .when(F.col("stale_streams") > 0, "STALE")
        .when((F.col("missing_streams") > 0) | (F.col("active_gaps") > 0), "DEGRADED")
        .otherwise("HEALTHY"),
    )


def coverage_summary(trades: DataFrame, keys: Sequence[str], order: Sequence[str], sequence: str,
                     segments: int | None = None) -> DataFrame:
    """Records, gap events and missing ids between neighbours in time order."""
    scanned = running(
        segmented(trades, order, segments),
        keys,
        order,
        {"previous": Measure("last", F.col(sequence))},
        inclusive=False,
    )
    step = F.col(sequence) - F.col("previous")
    gap = step.isNotNull() & (step != 1)
    return scanned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(gap).alias("gap_events"),
        F.coalesce(F.sum(F.when(gap, step - 1)), F.lit(0)).alias("missing_ids"),
    )


def last_n_samples(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt: Column) -> DataFrame:
    return newest_rows(df, keys, order, n, salt)


def poll_metrics(polls: DataFrame, items: DataFrame, source: str, samples: int | None = None) -> DataFrame:
    """Poll counters per source; latencies of all new items, or of the ``samples`` newest.

    ``polls``: source, ``poll_no``, ``polled_ms``, ``status`` (OK, NOT_MODIFIED, ERROR),
    ``error_code``, ``coverage_gap`` (label or null).  ``items``: source, ``poll_no``,
    ``polled_ms``, ``item_id``, ``occurred_ms``, ``is_new`` (new or changed content), ``bootstrap`` (from
    the very first poll).
    """
    ok = F.col("status") != "ERROR"
    counted = polls.groupBy(source).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(ok).alias("successes"),
        F.count_if(F.col("status") == "NOT_MODIFIED").alias("not_modified"),
        F.count("coverage_gap").alias("gaps"),
        F.min("polled_ms").alias("first_attempt_ms"),
        F.max("polled_ms").alias("last_attempt_ms"),
        F.max(F.when(ok, F.col("polled_ms"))).alias("last_success_ms"),
    )
    errors = (
        polls.filter(F.col("error_code").isNotNull())
        .groupBy(source, "error_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(source)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_code", "n")))).alias("errors_by_code"))
    )
    seen = items.groupBy(source).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if("is_new").alias("unique_items"),
        F.count_if(F.col("is_new") & F.col("bootstrap")).alias("bootstrap_items"),
        F.count_if(~F.col("is_new")).alias("duplicates"),
    )
    live = items.filter("is_new and not bootstrap and occurred_ms is not null").withColumn(
        "latency_ms", age_ms(F.col("polled_ms"), F.col("occurred_ms"))
    )
    if samples is not None:
        live = newest_rows(live, [source], [F.col("polled_ms").desc(), F.col("item_id").desc()], samples, F.col("item_id"))
    latency = live.groupBy(source).agg(F.count(F.lit(1)).alias("latency_samples"), *quantiles("latency_ms", "latency"))
    joined = counted.join(seen, source, "left").join(latency, source, "left").join(errors, source, "left")
    zero = F.lit(0).cast("long")
    messages = F.coalesce("messages", zero)
    return joined.select(
        source, "attempts", "successes",
        (F.col("successes") / F.col("attempts")).alias("success_rate"),
        "not_modified",
        messages.alias("messages"),
        F.coalesce("unique_items", zero).alias("unique_items"),
        F.coalesce("bootstrap_items", zero).alias("bootstrap_items"),
        F.coalesce("duplicates", zero).alias("duplicates"),
        F.when(messages > 0, F.col("duplicates") / messages).otherwise(0.0).alias("duplicate_rate"),
        "gaps", "first_attempt_ms", "last_attempt_ms", "last_success_ms",
        "errors_by_code",
        F.coalesce("latency_samples", zero).alias("latency_samples"),
        "latency_p50", "latency_p95", "latency_p99", "latency_max",
    )


def poll_source_health(status: Column, coverage_gap: Column, last_success_ms: Column, at: Column,
                       freshness_ms: int) -> Column:
    """STALE once the last success is too old, else ERROR, DEGRADED (coverage gap) or HEALTHY."""
    stale = last_success_ms.isNotNull() & (at - last_success_ms > freshness_ms)
    return (
        F.when(stale, "STALE")
        .when(status.isNull(), "WARMING_UP")
        .when(status == "ERROR", "ERROR")
        .when(coverage_gap.isNotNull(), "DEGRADED")
        .otherwise("HEALTHY")
    )


def poll_health_log(polls: DataFrame, source: str, freshness_ms: int, segments: int | None = None) -> DataFrame:
    """Health of a source right after each of its polls (columns as in :func:`poll_metrics`).

    A failed poll is STALE rather than ERROR once the last success before it is too old.
    """
    order = ["polled_ms", "poll_no"]
    found = running(
        segmented(polls, order, segments), [source], order,
        {"last_success_ms": Measure("max", F.when(F.col("status") != "ERROR", F.col("polled_ms")))},
    )
    health = poll_source_health(
        F.col("status"), F.col("coverage_gap"), F.col("last_success_ms"), F.col("polled_ms"), freshness_ms
    )
    return found.select(
        source, "poll_no", "polled_ms", "last_success_ms",
        (F.col("polled_ms") - F.col("last_success_ms")).alias("data_age_ms"), health.alias("health"),
    )


def market_health_at(
    arrivals: DataFrame, errors: DataFrame, members: DataFrame, grid: Grid, freshness_ms: int, gap_window_ms: int
) -> DataFrame:
    """:func:`market_source_health` of every source at every instant, from what was received by then.

    ``arrivals``: ``stream``, ``received_ms``, ``accepted``, ``gapped`` (the row tells of a gap).  ``errors``: ``source``,
    ``received_ms``.  ``members``: ``stream``, ``source``, a row per expected stream, a short list.  A source is
    disconnected from an error on until a stream of it accepts a row, and a gap counts for ``gap_window_ms``.
    Newest times are enough for all of it, so arrivals are reduced to cells of the grid before they are dealt.
    """
    at, now = F.col("received_ms"), F.col("as_of_ms")
    listed = [F.struct(F.lit(r["stream"]).alias("stream"), F.lit(r["source"]).alias("source")) for r in members.collect()]
    expected = grid.instants(arrivals.sparkSession).select("as_of_ms", F.explode(F.array(*listed)).alias("m")).select("as_of_ms", "m.*")
    streams = extremes_at(
        arrivals, expected, ["stream"], grid, at,
        {"accepted_ms": F.when(F.col("accepted"), at), "gap_ms": F.when(F.col("gapped"), at)},
    )
    broken = extremes_at(errors, expected.select("as_of_ms", "source").distinct(), ["source"], grid, at, {"error_ms": at})
    graded = streams.join(expected, ["stream", "as_of_ms"]).select(
        "source", "as_of_ms", "accepted_ms", freshness(F.col("accepted_ms"), now, freshness_ms).alias("freshness"),
        F.coalesce(F.col("gap_ms") >= now - F.lit(gap_window_ms), F.lit(False)).alias("gapped"),
    ).join(broken, ["source", "as_of_ms"])
    last_error, last_accepted = F.max("error_ms"), F.max("accepted_ms")
    disconnected = F.coalesce(last_error > F.coalesce(last_accepted, F.lit(-(2**62))), F.lit(False))
    return market_source_health(graded, ["source", "as_of_ms"], disconnected, F.count_if("gapped"))
