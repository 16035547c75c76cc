"""Streams over the given tables, each run to the end and read back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.times import to_ms
from tidewatch.streaming import state, streams
from tidewatch.workload.arrivals import ARRIVALS_SQL, arrivals
from tidewatch.workload.registry import number, numbers, query
from tidewatch.workload.tables import ASSETS, HOUR, table

FLOW = 6 * HOUR
# A trigger orders the rows of a key in memory.
PART_ROWS = 1_000_000
# Records are ordered a bucket of ids at a time, so their triggers can be larger.
RECORD_ROWS = 4_000_000


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = streams.read_table_stream(spark, sf_dir, "events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("event_ms", to_ms(F.col("ts")))


def landed_parts(df: DataFrame, by: str, folder: str, least: int = 4, rows: int | None = None) -> Iterator[DataFrame]:
    """Land a table part by part in the order of ``by``: at least so many parts, and more where one had over ``rows`` (``PART_ROWS``) rows.

    Yields the stream over what has landed.  The table is read twice and written in parts once, however many there are.
    Rows of one value of ``by`` stay together.
    """
    spark = df.sparkSession
    parts = max(least, -(-df.count() // (rows or PART_ROWS)))
    dealt = df.filter(F.col(by).isNotNull()).repartitionByRange(parts, by).withColumn("__part", F.spark_partition_id())
    dealt.write.partitionBy("__part").parquet(f"{folder}/parts")
    stored = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType())])).parquet(f"{folder}/parts")
    found = sorted(r[0] for r in stored.select("__part").distinct().collect())
    for part in found or [-1]:
        stored.filter(F.col("__part") == part).drop("__part").write.mode("append").parquet(f"{folder}/in")
        yield spark.readStream.schema(df.schema).parquet(f"{folder}/in")


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """A trigger of bounded rows needs no more partitions of state than there are cores."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), max(8, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_parts(df: DataFrame, by: str, build: Callable[[DataFrame], DataFrame], least: int = 4, folder: str | None = None) -> DataFrame:
    """Land a table part by part in the order of ``by`` and run the stream after each, from its checkpoint."""
    folder, told = folder or streams.shared_folder(df.sparkSession), None
    for source in landed_parts(df, by, folder, least):
        with state_partitions(df.sparkSession):
            told = streams.run_to_table(build(source), folder)
    return told


def landed_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals(spark, sf_dir).drop("event_ms").withColumn("received_at", F.timestamp_millis("received_ms"))


def arrival_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = F.when(F.pmod("event_id", F.lit(5)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    e = event_stream(spark, sf_dir).select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("sequence"), "event_ms", F.explode(copies).alias("copy")
    )
    received = F.col("event_ms") + F.pmod("sequence", F.lit(7)) * 600_000 + F.col("copy") * 900_000
    return e.select(
        "symbol", (F.col("sequence") * 2 + F.col("copy")).alias("id"), "sequence", received.alias("received_ms"),
        F.timestamp_millis(received).alias("received_at"),
    )


@query("stream_deduplicate", "SELECT event_type AS symbol, event_id AS sequence FROM events")
def dedupe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = streams.deduplicate(arrival_stream(spark, sf_dir), ["symbol", "sequence"], "received_at", "2 hours")
    return streams.run_to_table(unique.select("symbol", "sequence"))


@query("stream_classify_arrivals", f"WITH {ARRIVALS_SQL} SELECT symbol, id, sequence, arrival_state, missing FROM labelled")
def classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels over several triggers; repeats are known at any distance."""
    found = in_parts(
        landed_arrivals(spark, sf_dir).drop("received_at"), "received_ms",
        lambda s: state.arrival_labels(s, ["symbol"], ["received_ms", "id"], "sequence", ("error",)),
    )
    return found.select("symbol", "id", "sequence", "arrival_state", "missing")


@query("stream_restart_from_journal", f"WITH {ARRIVALS_SQL} SELECT symbol, id, sequence, arrival_state, missing FROM labelled")
def restart_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped half-way, its checkpoint lost, and started anew from the journal of what it had told."""
    whole = landed_arrivals(spark, sf_dir).drop("received_at")
    middle = whole.agg(F.percentile_approx("received_ms", 0.5, 1000)).first()[0]
    journal = None
    for part in (whole.filter(F.col("received_ms") < middle), whole.filter(F.col("received_ms") >= middle)):
        start = None if journal is None else state.accepted_state(journal, ["symbol"], "sequence")
        told = in_parts(
            part, "received_ms",
            lambda s, start=start: state.arrival_labels(s, ["symbol"], ["received_ms", "id"], "sequence", ("error",), start), least=1,
        )
        journal = told if journal is None else journal.unionByName(told)
    return journal.select("symbol", "id", "sequence", "arrival_state", "missing")


@query(
    "stream_gap_expiry",
    f"""WITH {ARRIVALS_SQL}, gaps AS (SELECT symbol, received_ms, previous + 1 AS gap_from, sequence - 1 AS gap_to FROM scanned WHERE sequence > previous + 1)
SELECT symbol, received_ms AS at_ms, 'OPENED' AS event, gap_from, gap_to FROM gaps
UNION ALL SELECT symbol, received_ms + {FLOW}, 'EXPIRED', gap_from, gap_to FROM gaps WHERE received_ms + {FLOW} <= (SELECT max(received_ms) FROM arrivals)""",
)
def gap_expiry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of every stream as they open and as their impact of six hours ends."""
    return in_parts(
        landed_arrivals(spark, sf_dir), "received_ms",
        lambda s: state.gap_events(s, ["symbol"], ["received_ms", "id"], "sequence", "received_ms", "received_at", FLOW, "0 seconds"),
    )


@query(
    "stream_rolling_flow",
    f"""WITH t AS (SELECT event_type, epoch_us(ts) AS us, CAST(value AS DECIMAL(20,8)) AS v FROM events), last AS (SELECT max(us) // 1000 AS m FROM t),
x AS (SELECT event_type, unnest(generate_series(us // 1000 // {HOUR} + 1, us // 1000 // {HOUR} + 6)) * {HOUR} AS as_of_ms, v FROM t)
SELECT event_type, as_of_ms, round(CAST(sum(v) AS DOUBLE), 6) AS total, count(*) AS n FROM x WHERE as_of_ms <= (SELECT m FROM last) - {HOUR} GROUP BY ALL""",
)
def rolling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = streams.rolling_flow(
        event_stream(spark, sf_dir), ["event_type"], "ts", "6 hours", "1 hour", "1 hour",
        {"total": F.sum(F.col("value").cast("decimal(20,8)")), "n": F.count(F.lit(1))},
    )
    return numbers(streams.run_to_table(flow), "total", places=6)


@query(
    "stream_poll_revisions",
    """WITH a AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, CAST(sum(CASE WHEN b <> text THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revision, coalesce(b = text, false) AS is_duplicate FROM a""",
)
def revisions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = streams.read_table_stream(spark, sf_dir, "conversations.parquet").select("conv_id", "turn", F.sha2("text", 256).alias("content_hash"))
    return streams.run_to_table(streams.poll_revisions(c, "conv_id", "turn", "content_hash"))


@query(
    "stream_streak_seconds",
    """WITH a AS (SELECT event_type, epoch_us(ts) // 1000 AS event_ms, value >= 15 AS ok FROM events), b AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY event_ms ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT event_type, event_ms, CASE WHEN ok THEN (event_ms - min(event_ms) FILTER (ok) OVER (PARTITION BY event_type, island)) // 1000 END AS held_seconds FROM b""",
)
def streak_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", to_ms(F.col("ts")).alias("event_ms"), (F.col("value") >= 15).alias("ok"))
    held = in_parts(e, "event_ms", lambda s: streams.streak_seconds(s, "event_type", "event_ms", "ok"), least=1)
    untimed = e.filter(F.col("event_ms").isNull()).select("event_type", "event_ms", F.lit(None).cast("long").alias("held_seconds"))
    return held.unionByName(untimed)


@query(
    "stream_latched_context",
    """WITH t AS (SELECT event_type, event_id, epoch_us(ts) // 1000 AS event_ms, value FROM events),
a AS (SELECT *, min(CASE WHEN value >= 90 THEN event_ms END) OVER w AS ready, max(CASE WHEN event_id % 499 = 0 THEN event_ms END) OVER w AS recorded
  FROM t WINDOW w AS (PARTITION BY event_type ORDER BY event_ms, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_type, event_id, event_ms, CASE WHEN recorded IS NOT NULL THEN 'USER_RECORDED' WHEN ready IS NOT NULL THEN 'SHADOW_REFERENCE' ELSE 'NONE' END AS context,
  coalesce(recorded, ready) AS context_ms FROM a""",
)
def latch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts that stay set, over several triggers."""
    t = table(spark, sf_dir, "events").select(
        "event_type", "event_id", to_ms(F.col("ts")).alias("event_ms"),
        (F.col("value") >= 90).alias("ready"), (F.pmod("event_id", F.lit(499)) == 0).alias("recorded"),
    )
    return in_parts(t, "event_ms", lambda s: state.latched_context(s, ["event_type"], ["event_ms", "event_id"], "ready", "recorded"))


@query("stream_live_metrics", "SELECT event_type, count(*) AS received, max(event_id) AS last_sequence FROM events GROUP BY ALL")
def metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters in update mode; each trigger replaces the changed counters."""
    folder = streams.shared_folder(spark)
    counted = streams.live_metrics(
        event_stream(spark, sf_dir), ["event_type"], {"received": F.count(F.lit(1)), "last_sequence": F.max("event_id")}
    )
    writer = counted.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    writer.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/data/batch_id={i}")).trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(f"{folder}/data")
    newest = updates.groupBy("event_type").agg(F.max(F.struct("batch_id", "received", "last_sequence")).alias("m"))
    return newest.select("event_type", "m.received", "m.last_sequence")


@query(
    "stream_live_counters",
    f"""WITH {ARRIVALS_SQL} SELECT symbol, count(*) AS received, count(*) FILTER (arrival_state = 'ACCEPTED') AS accepted,
  count(*) FILTER (arrival_state = 'DUPLICATE') AS duplicates, count(*) FILTER (arrival_state = 'OUT_OF_ORDER') AS out_of_order,
  count(*) FILTER (missing > 0) AS gap_events, CAST(sum(missing) AS BIGINT) AS missing_ids, min(received_ms) AS first_received_ms, max(received_ms) AS last_received_ms,
  max(received_ms) FILTER (arrival_state = 'ACCEPTED') AS last_accepted_ms,
  CASE WHEN symbol <> 'error' THEN round(CAST(count(*) FILTER (arrival_state = 'ACCEPTED') AS DOUBLE) / (count(*) FILTER (arrival_state = 'ACCEPTED') + sum(missing)), 8) END AS completeness
FROM labelled GROUP BY symbol""",
)
def counters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of every stream from its labels, in update mode: a second stream follows the rows the first one told."""
    folder = streams.shared_folder(spark)
    labelled = in_parts(
        landed_arrivals(spark, sf_dir).drop("received_at"), "received_ms",
        lambda s: state.arrival_labels(s, ["symbol"], ["received_ms", "id"], "sequence", ("error",)), folder=folder,
    )
    told = spark.readStream.schema(labelled.schema).parquet(f"{folder}/data")
    of = F.col("arrival_state")
    counted = streams.live_metrics(told, ["symbol"], {
        "received": F.count(F.lit(1)), "accepted": F.count_if(of == "ACCEPTED"), "duplicates": F.count_if(of == "DUPLICATE"),
        "out_of_order": F.count_if(of == "OUT_OF_ORDER"), "gap_events": F.count_if(F.col("missing") > 0), "missing_ids": F.sum("missing"),
        "first_received_ms": F.min("received_ms"), "last_received_ms": F.max("received_ms"),
        "last_accepted_ms": F.max(F.when(of == "ACCEPTED", F.col("received_ms"))),
    })
    writer = counted.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/counted-checkpoint")
    writer.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/counted/batch_id={i}")).trigger(availableNow=True).start().awaitTermination()
    names = [c for c in counted.columns if c != "symbol"]
    newest = spark.read.parquet(f"{folder}/counted").groupBy("symbol").agg(F.max(F.struct("batch_id", *names)).alias("m")).select("symbol", "m.*")
    share = F.col("accepted").cast("double") / (F.col("accepted") + F.col("missing_ids"))
    return newest.select("symbol", *names, F.when(F.col("symbol") != "error", number(share)).alias("completeness"))


@query("stream_journal_sink", "SELECT user_id AS record_id, arg_min(event_id, event_id) AS ord FROM events GROUP BY ALL")
def journal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once, over several triggers that read nothing but their own rows."""
    folder = streams.shared_folder(spark)
    records = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record_id"), F.sha2(F.col("user_id").cast("string"), 256).alias("record_hash"), F.col("event_id").alias("ord")
    )
    journal = None
    for source in landed_parts(records, "ord", folder, rows=RECORD_ROWS):
        with state_partitions(spark):
            journal = streams.journal_stream(source, folder, "record_id", "record_hash", "ord")
    return journal.select("record_id", "ord")


@query(
    "stream_features",
    f"""WITH ticks AS (SELECT event_type AS asset, event_id AS id, epoch_us(ts) // 1000 AS received_ms, CAST(value AS DECIMAL(20,8)) AS price, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM events),
b AS (SELECT min(received_ms) // {HOUR} * {HOUR} AS s, max(received_ms) // {HOUR} * {HOUR} AS e FROM ticks),
g AS (SELECT asset, unnest(generate_series(s, e, {HOUR})) AS as_of_ms FROM b, (SELECT asset FROM ticks UNION SELECT asset FROM (VALUES {", ".join(f"('{a}')" for a in ASSETS)}) w(asset)) v),
f AS (SELECT g.asset, g.as_of_ms, count(t.id) AS n, max(t.received_ms) AS last_ms, coalesce(sum(t.price) FILTER (side = 'BUY'), 0) AS buy, coalesce(sum(t.price) FILTER (side = 'SELL'), 0) AS sell
  FROM g LEFT JOIN ticks t ON t.asset = g.asset AND t.received_ms BETWEEN g.as_of_ms - {FLOW} AND g.as_of_ms GROUP BY ALL)
SELECT asset, as_of_ms, CASE WHEN n = 0 THEN 'NO_TRADES' WHEN as_of_ms - last_ms > {HOUR} THEN 'STALE' ELSE 'KNOWN' END AS flow_state,
  CASE WHEN n > 0 AND as_of_ms - last_ms <= {HOUR} AND sell <> 0 THEN round(CAST(buy AS DOUBLE) / CAST(sell AS DOUBLE), 8) END AS buy_sell_ratio FROM f""",
)
def features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling flow of every key, and of the assets without rows, at every instant from the first row of all to the last."""
    t = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("asset"), to_ms(F.col("ts")).alias("received_ms"), F.col("value").cast("decimal(20,8)").alias("price"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "BUY").otherwise("SELL").alias("side"),
    ).withColumn("received_at", F.timestamp_millis("received_ms"))
    sides = {name.lower(): F.when(F.col("side") == name, F.col("price")) for name in ("BUY", "SELL")}
    low = t.agg(F.min("received_ms")).first()[0]
    assets = t.select("asset").union(spark.createDataFrame([(a,) for a in ASSETS], "asset string")).distinct()
    initial = None if low is None else assets.select("asset", F.lit(low // HOUR * HOUR).cast("long").alias("next_ms"))
    found = in_parts(
        t, "received_ms",
        lambda s: state.rolling_panes(s, ["asset"], "received_at", "received_ms", sides, HOUR, FLOW, "0 seconds", lag_ms=0, initial=initial),
    )
    flow_state = F.when(F.col("n") == 0, "NO_TRADES").when(F.col("as_of_ms") - F.col("last_ms") > HOUR, "STALE").otherwise("KNOWN")
    ratio = F.when((flow_state == "KNOWN") & (F.col("sell") != 0), number(F.col("buy").cast("double") / F.col("sell").cast("double")))
    return found.select("asset", "as_of_ms", flow_state.alias("flow_state"), ratio.alias("buy_sell_ratio"))
