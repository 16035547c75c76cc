"""Streaks, lows, stages, sampling, journals and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import DEFAULT, STAGED_TRANSITIONS
from tidewatch.functions.hashing import sha256
from tidewatch.functions.times import to_ms, to_text
from tidewatch.operators import lookups, ordered
from tidewatch.operators.running import fixed_segments
from tidewatch.plans import reports
from tidewatch.sources import journals
from tidewatch.workload.registry import numbers, query
from tidewatch.workload.tables import DAY, HOUR, TICKS_SQL, table, ticks

WEEK = 7 * DAY


def tick_days():
    """Segments of one day of event time."""
    return fixed_segments(F.col("event_ms"), DAY)


def order_blocks():
    """Segments of a million order keys."""
    return fixed_segments(F.col("o_orderkey"), 1_000_000)


@query(
    "persistence_seconds",
    f"""WITH {TICKS_SQL},
a AS (SELECT *, price >= 15 AS ok FROM ticks),
b AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY event_ms, id ROWS UNBOUNDED PRECEDING) AS island FROM a),
c AS (SELECT asset, id, event_ms, CASE WHEN ok THEN min(event_ms) FILTER (ok) OVER (PARTITION BY asset, island) END AS held_since FROM b)
SELECT asset, id, held_since, (event_ms - held_since) // 1000 AS held_seconds FROM c""",
)
def persistence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ordered.persistence(
        ticks(spark, sf_dir), ["asset"], ["event_ms", "id"], F.col("price") >= 15, tick_days()
    )
    return held.select("asset", "id", "held_since", "held_seconds")


@query(
    "running_low",
    f"""WITH {TICKS_SQL}, s AS (SELECT * FROM ticks WHERE event_ms >= 1704326400000),
m AS (SELECT asset, id, min(price) OVER w AS low, arg_min(event_ms, (price, event_ms)) OVER w AS low_ms, event_ms FROM s
  WINDOW w AS (PARTITION BY asset ORDER BY event_ms, id ROWS UNBOUNDED PRECEDING))
SELECT t.asset, t.id, CAST(m.low AS DOUBLE) AS low, m.low_ms, (t.event_ms - m.low_ms) // 1000 AS seconds_since_low
FROM ticks t LEFT JOIN m USING (asset, id)""",
)
def running_low_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk event starts on the fourth day; earlier prices do not count."""
    lows = ordered.running_low(
        ticks(spark, sf_dir), ["asset"], ["event_ms", "id"], F.col("price"), tick_days(),
        started_ms=F.lit(1704326400000),
    )
    return numbers(lows, "low").select("asset", "id", "low", "low_ms", "seconds_since_low")


@query(
    "no_new_low_seconds",
    f"""WITH {TICKS_SQL}, m AS (SELECT asset, event_ms // {HOUR} * {HOUR} + {HOUR} AS at_ms, min(price) AS p FROM ticks GROUP BY ALL),
g AS (SELECT asset, unnest(generate_series(s, e, {HOUR})) AS at_ms FROM (SELECT min(at_ms) AS s, max(at_ms) AS e FROM m) b, (SELECT DISTINCT asset FROM m) d),
j AS (SELECT asset, at_ms, arg_min(CASE WHEN p IS NOT NULL THEN at_ms END, (p, at_ms)) FILTER (p IS NOT NULL) OVER (PARTITION BY asset ORDER BY at_ms ROWS UNBOUNDED PRECEDING) AS low_ms FROM g LEFT JOIN m USING (asset, at_ms))
SELECT at_ms, max(low_ms) AS last_low_ms, coalesce((at_ms - max(low_ms)) // 1000, 0) AS no_new_low_seconds FROM j GROUP BY at_ms""",
)
def no_new_low_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.grid import grid_over

    t = ticks(spark, sf_dir)
    at = (F.floor(F.col("event_ms") / HOUR) * HOUR + HOUR).cast("long")
    prices = t.groupBy("asset", at.alias("at_ms")).agg(F.min("price").alias("p"))
    grid = grid_over(prices, "at_ms", HOUR)
    rows = grid.rows(spark, "asset", ("view", "click", "signup", "purchase", "error")).withColumnRenamed("as_of_ms", "at_ms")
    joined = rows.join(prices, ["asset", "at_ms"], "left")
    lows = ordered.running_low(joined, ["asset"], ["at_ms"], F.col("p"), fixed_segments(F.col("at_ms"), WEEK))
    return ordered.shared_low_clock(lows, "at_ms")


# --- stages: orders of a customer in key order ----------------------------------------------


def order_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("stage"), to_ms(F.col("o_orderdate")).alias("at_ms"))


@query(
    "stage_changes",
    """SELECT o_custkey, o_orderkey, before AS from_stage, o_orderstatus AS stage FROM (
  SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE before IS NULL OR before <> o_orderstatus""",
)
def stage_changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = ordered.stage_changes(order_stages(spark, sf_dir), ["o_custkey"], ["o_orderkey"], "stage", order_blocks())
    return changes.select("o_custkey", "o_orderkey", "from_stage", "stage")


@query(
    "stage_entered_at",
    """WITH a AS (SELECT *, coalesce(lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), '') <> o_orderstatus AS enters FROM orders)
SELECT o_custkey, o_orderkey, max(CASE WHEN enters THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS stage_entered FROM a""",
)
def stage_entered_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    entered = ordered.stage_entered(order_stages(spark, sf_dir), ["o_custkey"], ["o_orderkey"], "stage", order_blocks())
    return entered.select("o_custkey", "o_orderkey", "stage_entered")


@query(
    "first_hit",
    """SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'F') AS first_failed, min(o_orderkey) FILTER (o_totalprice >= 400000) AS first_large,
  min(o_orderkey) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS first_urgent_open FROM orders GROUP BY ALL""",
)
def first_hit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return ordered.first_hits(
        table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey",
        {
            "first_failed": status == "F",
            "first_large": F.col("o_totalprice") >= 400000,
            "first_urgent_open": (F.col("o_orderpriority") == "1-URGENT") & (status == "O"),
        },
    )


@query(
    "latched_context",
    """WITH a AS (SELECT o_custkey, o_orderkey, min(CASE WHEN o_totalprice >= 400000 THEN o_orderkey END) OVER w AS ready,
    max(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN o_orderkey END) OVER w AS rec
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT o_custkey, o_orderkey, CASE WHEN rec IS NOT NULL THEN 'USER_RECORDED' WHEN ready IS NOT NULL THEN 'SHADOW_REFERENCE' ELSE 'NONE' END AS context, coalesce(rec, ready) AS context_ms FROM a""",
)
def latched_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    latched = ordered.latched_context(
        o, ["o_custkey"], ["o_orderkey"], F.col("o_totalprice") >= 400000, order_blocks(),
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"),
    )
    return latched.select("o_custkey", "o_orderkey", "context", "context_ms")


@query(
    "contiguous_observed",
    f"""WITH {TICKS_SQL}, g AS (SELECT asset, event_ms - lag(event_ms) OVER (PARTITION BY asset ORDER BY event_ms) AS gap FROM ticks)
SELECT asset, count(*) AS samples, CAST(coalesce(sum(gap) FILTER (gap BETWEEN 0 AND 900000), 0) AS BIGINT) AS observed_ms FROM g GROUP BY ALL""",
)
def contiguous_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.contiguous_observed(ticks(spark, sf_dir), ["asset"], "event_ms", 900_000, tick_days())


@query(
    "sample_grid",
    f"""WITH {TICKS_SQL} SELECT * FROM (SELECT asset, event_ms // {HOUR} * {HOUR} AS at_ms, count(*) AS n FROM ticks GROUP BY 1, 2) WHERE (at_ms - 1704067200000) % {6 * HOUR} = 0""",
)
def sample_grid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = ticks(spark, sf_dir).groupBy("asset", (F.floor(F.col("event_ms") / HOUR) * HOUR).cast("long").alias("at_ms")).agg(F.count(F.lit(1)).alias("n"))
    return ordered.sample_grid(hourly, "at_ms", 1704067200000, 6 * HOUR)


@query(
    "sample_every",
    f"""WITH RECURSIVE {TICKS_SQL}, t AS (SELECT DISTINCT asset, event_ms FROM ticks),
kept AS (SELECT asset, min(event_ms) AS event_ms FROM t GROUP BY ALL
  UNION ALL SELECT k.asset, (SELECT min(x.event_ms) FROM t x WHERE x.asset = k.asset AND x.event_ms >= k.event_ms + {HOUR}) FROM kept k WHERE k.event_ms IS NOT NULL)
SELECT ticks.asset, ticks.id, ticks.event_ms FROM ticks JOIN kept USING (asset, event_ms)""",
)
def sample_every_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.sample_every(ticks(spark, sf_dir), "asset", "event_ms", HOUR, DAY).select("asset", "id", "event_ms")


@query(
    "timeline",
    """WITH d AS (SELECT o_orderpriority AS run, 'c' || o_custkey || o_orderstatus AS event_id, min(epoch_us(o_orderdate) // 1000) AS at_ms FROM orders GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY run ORDER BY at_ms DESC, event_id DESC) AS position FROM d QUALIFY position <= 100""",
)
def timeline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    events = o.select(
        F.col("o_orderpriority").alias("run"), F.concat(F.lit("c"), "o_custkey", "o_orderstatus").alias("event_id"),
        to_ms(F.col("o_orderdate")).alias("at_ms"),
    )
    return ordered.timeline(events, "run", "event_id", "at_ms", 100).withColumn("position", F.col("position").cast("long"))


# --- journals ------------------------------------------------------------------------------
# Orders as one journal per priority.  Some records are broken by a fixed formula so that the
# audit has something to find.

JOURNAL_SQL = """journal AS (SELECT o_orderpriority AS journal, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) + CASE WHEN o_orderkey % 101 = 7 THEN 1 ELSE 0 END AS sequence,
  'r' || CASE WHEN o_orderkey % 211 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS record_id, '{"k":' || o_custkey || '}' AS payload,
  'sha256:' || sha256('{"k":' || CASE WHEN o_orderkey % 307 = 5 THEN o_custkey + 1 ELSE o_custkey END || '}') AS payload_hash,
  epoch_us(o_orderdate) // 1000 + CASE WHEN o_orderkey % 401 = 9 THEN 5000 ELSE 0 END AS event_ms, epoch_us(o_orderdate) // 1000 AS observed_ms FROM orders)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.running import numbered

    o = table(spark, sf_dir, "orders")
    ranked = numbered(o, ["o_orderpriority"], ["o_orderkey"], "n", segment=order_blocks())
    key = F.col("o_orderkey")

    def planted(modulus: int, rest: int, broken, fine):
        return F.when(F.pmod(key, F.lit(modulus)) == rest, broken).otherwise(fine)

    at = to_ms(F.col("o_orderdate"))
    payload = lambda c: F.concat(F.lit('{"k":'), c, F.lit("}"))
    return ranked.select(
        F.col("o_orderpriority").alias("journal"),
        (F.col("n") + planted(101, 7, F.lit(1), F.lit(0))).alias("sequence"),
        F.concat(F.lit("r"), planted(211, 3, key - 1, key)).alias("record_id"),
        payload(F.col("o_custkey")).alias("payload"),
        F.concat(F.lit("sha256:"), sha256(payload(planted(307, 5, F.col("o_custkey") + 1, F.col("o_custkey"))))).alias("payload_hash"),
        (at + planted(401, 9, F.lit(5000), F.lit(0))).alias("event_ms"),
        at.alias("observed_ms"),
    )


@query(
    "sequence_audit",
    f"""WITH {JOURNAL_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY journal ORDER BY sequence, record_id) AS position, count(*) OVER (PARTITION BY journal, record_id) AS copies FROM journal)
SELECT journal, sequence, record_id, 'SEQUENCE_GAP' AS violation FROM p WHERE sequence <> position
UNION ALL SELECT journal, sequence, record_id, 'DUPLICATE_ID' FROM p WHERE copies > 1
UNION ALL SELECT journal, sequence, record_id, 'HASH_MISMATCH' FROM p WHERE 'sha256:' || sha256(payload) <> payload_hash
UNION ALL SELECT journal, sequence, record_id, 'EVENT_AFTER_OBSERVATION' FROM p WHERE event_ms > observed_ms""",
)
def sequence_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.sequence_audit(
        journal(spark, sf_dir), ["journal"], "sequence", "record_id", "payload_hash", "payload", "event_ms", "observed_ms"
    )


@query(
    "append_idempotent",
    """WITH stored AS (SELECT o_orderkey AS record_id, max(o_custkey) AS record_hash FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
batch AS (SELECT l_orderkey AS record_id, CASE WHEN l_returnflag = 'A' THEN o_custkey ELSE l_suppkey END AS record_hash, l_linenumber * 1000000000000 + l_partkey * 1000000 + CAST(floor(l_extendedprice) AS BIGINT) AS ord
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
twice AS (SELECT * FROM batch UNION ALL SELECT * FROM batch WHERE record_id % 5 = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY record_id, record_hash, ord) AS copy FROM twice),
f AS (SELECT record_id, min(ord) AS first_ord, arg_min(record_hash, (ord, record_hash)) AS first_hash FROM batch GROUP BY ALL)
SELECT b.record_id, b.record_hash, b.ord, CASE WHEN b.record_hash <> coalesce(s.record_hash, first_hash) THEN 'CONFLICT' WHEN s.record_hash IS NULL AND b.ord = first_ord AND copy = 1 THEN 'APPEND' ELSE 'NO_OP' END AS append_state
FROM numbered b JOIN f USING (record_id) LEFT JOIN stored s USING (record_id)""",
)
def append_idempotent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    stored = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("record_hash"))
    li = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    batch = li.select(
        F.col("l_orderkey").alias("record_id"),
        F.when(F.col("l_returnflag") == "A", F.col("o_custkey")).otherwise(F.col("l_suppkey")).alias("record_hash"),
        (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * 1_000_000 + F.floor("l_extendedprice")).alias("ord"),
    )
    twice = batch.unionByName(batch.filter(F.col("record_id") % 5 == 0))  # a source that repeats some of its rows
    return journals.label_appends(stored, twice, "record_id", "record_hash", "ord")


@query(
    "append_sequenced",
    """WITH n AS (SELECT o_orderpriority AS journal, o_orderkey, o_orderstatus AS kind, epoch_us(o_orderdate) // 1000 AS recorded_ms, '{"c":' || o_custkey || '}' AS payload,
  100 + row_number() OVER (PARTITION BY o_orderpriority ORDER BY epoch_us(o_orderdate) // 1000, o_orderkey) AS sequence, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS t FROM orders)
SELECT journal, o_orderkey, sequence, 'sha256:' || sha256(payload) AS payload_hash,
  'shadow-' || sequence || '-' || substr(sha256('{"kind":"' || kind || '","payloadDigest":"' || sha256(payload) || '","recordedAt":"' || t || '","sequence":' || sequence || '}'), 1, 16) AS record_id FROM n""",
)
def append_sequenced_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    batch = o.select(
        F.col("o_orderpriority").alias("journal"), to_ms(F.col("o_orderdate")).alias("recorded_ms"), "o_orderkey",
        F.col("o_orderstatus").alias("kind"), F.concat(F.lit('{"c":'), "o_custkey", F.lit("}")).alias("payload"),
    )
    last = o.select(F.col("o_orderpriority").alias("journal")).distinct().withColumn("sequence", F.lit(100))
    appended = journals.append_sequenced(
        batch, ["journal"], ["recorded_ms", "o_orderkey"], "kind", "recorded_ms", "payload", "shadow", last
    )
    return appended.select("journal", "o_orderkey", F.col("sequence").cast("long").alias("sequence"), "payload_hash", "record_id")


@query(
    "append_quote_records",
    """WITH b AS (SELECT 'snap-' || o_custkey AS snapshot_id, epoch_us(o_orderdate) // 1000 AS recorded_ms, 'quote-record-' || substr(sha256('snap-' || o_custkey || ':' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'), 1, 24) AS record_id, o_orderstatus FROM orders),
s AS (SELECT DISTINCT record_id FROM b WHERE o_orderstatus = 'F'), n AS (SELECT * FROM b WHERE o_orderstatus <> 'F')
SELECT n.snapshot_id, n.recorded_ms, n.record_id, s.record_id IS NOT NULL OR row_number() OVER (PARTITION BY n.record_id ORDER BY n.snapshot_id, n.recorded_ms) > 1 AS is_duplicate FROM n LEFT JOIN s USING (record_id)""",
)
def append_quote_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("snap-"), "o_custkey").alias("snapshot_id"), to_ms(F.col("o_orderdate")).alias("recorded_ms"), "o_orderstatus"
    )
    stored = o.filter("o_orderstatus = 'F'").select(journals.quote_record_id(F.col("snapshot_id"), F.col("recorded_ms")).alias("record_id"))
    return journals.append_quote_records(stored, o.filter("o_orderstatus <> 'F'").drop("o_orderstatus"), "snapshot_id", "recorded_ms")


@query("prune_by_age", f"SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS judged_ms FROM orders WHERE epoch_us(o_orderdate) // 1000 >= {996537600000 - 180 * DAY}")
def prune_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", to_ms(F.col("o_orderdate")).alias("judged_ms"))
    return journals.prune_by_age(o, "judged_ms", 996537600000, 180)


@query("received_through", "SELECT event_id, epoch_us(ts) // 1000 AS received_ms FROM events WHERE epoch_us(ts) // 1000 <= 1705276800000")
def received_through_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.sources.market import received_through

    e = table(spark, sf_dir, "events").select("event_id", to_ms(F.col("ts")).alias("received_ms"))
    return received_through(e, 1705276800000, "received_ms", "event_id")


@query("latest_of_kind", "SELECT o_orderpriority AS journal, arg_max(o_custkey, o_orderkey) AS o_custkey, max(o_orderkey) AS sequence FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL")
def latest_of_kind_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("journal"), F.col("o_orderkey").alias("sequence"), F.col("o_orderstatus").alias("kind"), "o_custkey"
    )
    return journals.latest_of_kind(o, ["journal"], "P").drop("kind")


@query(
    "orphan_events",
    """WITH e AS (SELECT l_orderkey * 8 + l_linenumber AS event_id, l_partkey * 8 + l_linenumber AS parent_id, l_orderkey AS seq FROM lineitem), f AS (SELECT event_id, min(seq) AS s FROM e GROUP BY ALL)
SELECT e.* FROM e LEFT JOIN f ON f.event_id = e.parent_id WHERE f.s IS NULL OR f.s >= e.seq""",
)
def orphans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("parent_id"),
        F.col("l_orderkey").alias("seq"),
    )
    return lookups.orphans(li, "event_id", "parent_id", "seq")


# Order states read as stages of the staged sell model.
STAGE_OF = {"O": "SELL_IDLE", "P": "NEWS_ARMED", "F": "SELL_PRETRIGGER"}
_STAGE_SQL = "CASE {c} WHEN 'O' THEN 'SELL_IDLE' WHEN 'P' THEN 'NEWS_ARMED' ELSE 'SELL_PRETRIGGER' END"


@query(
    "illegal_transitions",
    f"""WITH a AS (SELECT o_custkey, o_orderkey, {_STAGE_SQL.format(c='o_orderstatus')} AS to_stage, {_STAGE_SQL.format(c='b')} AS from_stage FROM (
  SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL AND b <> o_orderstatus)
SELECT o_custkey, o_orderkey, from_stage, to_stage, 'UNDEFINED_TRANSITION' AS violation FROM a
WHERE (from_stage, to_stage) NOT IN (('SELL_IDLE', 'NEWS_ARMED'), ('NEWS_ARMED', 'SELL_PRETRIGGER'), ('SELL_PRETRIGGER', 'SELL_IDLE'), ('NEWS_ARMED', 'SELL_IDLE'))""",
)
def illegal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = order_stages(spark, sf_dir).replace(STAGE_OF, subset=["stage"])
    changes = ordered.stage_changes(stages, ["o_custkey"], ["o_orderkey"], "stage", order_blocks()).filter(F.col("from_stage").isNotNull())
    judged = lookups.illegal_transitions(
        changes.withColumn("model", F.lit("SELL")).withColumnRenamed("stage", "to_stage"), STAGED_TRANSITIONS
    )
    return judged.select("o_custkey", "o_orderkey", "from_stage", "to_stage", "violation")


# --- reports -------------------------------------------------------------------------------

_KIND_SQL = """CASE WHEN o_orderkey % 2003 = 0 THEN 'RUNTIME_START' WHEN o_orderkey % 997 = 5 THEN 'SHADOW_SELL_CREATED' ELSE 'SOURCE_SNAPSHOT' END"""


@query(
    "shadow_report",
    f"""WITH j AS (SELECT o_orderpriority AS journal, o_orderkey AS sequence, {_KIND_SQL} AS kind, 1700000000000 + o_orderkey * 4000 AS recorded_ms FROM orders),
o AS (SELECT journal, arg_max(recorded_ms, sequence) FILTER (kind = 'RUNTIME_START') AS started_ms, arg_max(recorded_ms, sequence) AS last_ms, arg_max(kind, sequence) AS last_kind,
  count(*) FILTER (kind = 'SHADOW_SELL_CREATED') AS sell_signals, count(*) AS records, max(sequence) AS latest_sequence FROM j GROUP BY ALL),
g AS (SELECT journal, recorded_ms - lag(recorded_ms) OVER (PARTITION BY journal ORDER BY recorded_ms) AS gap FROM j WHERE kind = 'SOURCE_SNAPSHOT'),
ob AS (SELECT journal, CAST(coalesce(sum(gap) FILTER (gap <= 30000), 0) AS BIGINT) AS observed_ms FROM g GROUP BY ALL),
n AS (SELECT max(recorded_ms) + 10000 AS now FROM j),
s AS (SELECT o.*, observed_ms, started_ms IS NOT NULL AND last_kind <> 'RUNTIME_STOP' AND now - last_ms <= 30000 AS active, now FROM o JOIN ob USING (journal), n),
e AS (SELECT *, CASE WHEN started_ms IS NULL THEN 0 ELSE greatest(0, CASE WHEN active THEN now ELSE last_ms END - started_ms) END AS elapsed_ms FROM s)
SELECT journal, CASE WHEN started_ms IS NULL THEN 'NOT_STARTED' WHEN active THEN 'IN_PROGRESS' ELSE 'STOPPED_OR_STALE' END AS session_status, started_ms,
  CASE WHEN started_ms IS NOT NULL THEN last_ms END AS last_observed_ms, elapsed_ms, round(least(1.0, CAST(elapsed_ms AS DOUBLE) / 3600000), 8)::DOUBLE AS soak_progress, elapsed_ms >= 3600000 AS soak_met,
  observed_ms, round(least(1.0, CAST(observed_ms AS DOUBLE) / 1209600000), 8)::DOUBLE AS shadow_progress, observed_ms >= 1209600000 AS shadow_met, sell_signals, records, latest_sequence FROM e""",
)
def shadow_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = (
        F.when(F.pmod(key, F.lit(2003)) == 0, "RUNTIME_START")
        .when(F.pmod(key, F.lit(997)) == 5, "SHADOW_SELL_CREATED")
        .otherwise("SOURCE_SNAPSHOT")
    )
    j = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("journal"), key.alias("sequence"), kind.alias("kind"),
        (F.lit(1700000000000) + key * 4000).alias("recorded_ms"),
    )
    now = j.agg(F.max("recorded_ms")).first()[0] + 10_000
    return numbers(reports.shadow_report(j, ["journal"], F.lit(now), DEFAULT.report), "soak_progress", "shadow_progress")


@query(
    "soak_progress",
    """WITH a AS (SELECT o_custkey AS run, min(epoch_us(o_orderdate) // 1000) AS started_ms, max(epoch_us(o_orderdate) // 1000) AS now_ms FROM orders GROUP BY ALL)
SELECT run, now_ms - started_ms AS elapsed_ms, round(least(1.0, CAST(now_ms - started_ms AS DOUBLE) / 31536000000), 8)::DOUBLE AS progress,
  CASE WHEN now_ms - started_ms < 31536000000 THEN 'IN_PROGRESS' ELSE 'ELAPSED_NOT_YET_REVIEWED' END AS status FROM a""",
)
def soak_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(
        F.min(to_ms(F.col("o_orderdate"))).alias("started_ms"), F.max(to_ms(F.col("o_orderdate"))).alias("now_ms")
    )
    elapsed, progress, status = reports.soak_progress(F.col("started_ms"), F.col("now_ms"), 365 * DAY)
    return numbers(o.select("run", elapsed.alias("elapsed_ms"), progress.alias("progress"), status.alias("status")), "progress")


# --- replay --------------------------------------------------------------------------------

REPLAY_SQL = f"""{TICKS_SQL}, replay AS (SELECT asset, id AS event_id, received_ms, row_number() OVER (PARTITION BY asset ORDER BY received_ms, id) AS ingestion_sequence,
  'MARKET_OBSERVATION' AS kind, '{{"asset":"' || asset || '","id":' || id || ',"received_ms":' || received_ms || ',"side":"' || side || '"}}' AS payload FROM ticks)"""


def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).select("asset", "id", "received_ms", "side")
    return journals.to_replay_events(t, ["asset"], "received_ms", "id")


@query("replay_events", f"WITH {REPLAY_SQL} SELECT * FROM replay")
def replay_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_events(spark, sf_dir)


@query("replay_until", f"WITH {REPLAY_SQL} SELECT asset, event_id, ingestion_sequence FROM replay WHERE received_ms <= 1705276800000")
def replay_until_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = journals.replay_until(replay_events(spark, sf_dir), 1705276800000)
    return journals.replay_order(seen).select("asset", "event_id", "ingestion_sequence")


@query(
    "replay_step",
    f"""WITH {REPLAY_SQL} SELECT asset, event_id, row_number() OVER (PARTITION BY asset ORDER BY received_ms, ingestion_sequence, event_id) AS position FROM replay WHERE received_ms > 1705276800000 QUALIFY position <= 25""",
)
def replay_step_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journals.replay_step(replay_events(spark, sf_dir), ["asset"], 25, 1705276800000).select("asset", "event_id", "position")


@query(
    "replay_violations",
    """WITH e AS (SELECT event_type AS asset, user_id AS event_id, event_id // 3 AS ingestion_sequence FROM events)
SELECT asset, CAST(event_id AS VARCHAR) AS value, count(*) AS copies, 'DUPLICATE_ID' AS violation FROM e GROUP BY asset, event_id HAVING count(*) > 1
UNION ALL SELECT asset, CAST(ingestion_sequence AS VARCHAR), count(*), 'DUPLICATE_SEQUENCE' FROM e GROUP BY asset, ingestion_sequence HAVING count(*) > 1""",
)
def replay_violations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("asset"), F.col("user_id").alias("event_id"), F.floor(F.col("event_id") / 3).alias("ingestion_sequence")
    )
    return journals.replay_violations(e, ["asset"])


_LEVEL = """SELECT asset, n // 100 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h, CAST(sum(c) AS BIGINT) AS c, min(f) AS f, max(l) AS l FROM {p} GROUP BY asset, n // 100"""


@query(
    "replay_manifest",
    f"""WITH {REPLAY_SQL}, l0 AS (SELECT asset, ingestion_sequence - 1 AS n, sha256(concat_ws('|', received_ms, ingestion_sequence, event_id, kind, payload)) AS h, 1 AS c, received_ms AS f, received_ms AS l FROM replay),
l1 AS ({_LEVEL.format(p='l0')}), l2 AS ({_LEVEL.format(p='l1')}), l3 AS ({_LEVEL.format(p='l2')}), l4 AS ({_LEVEL.format(p='l3')})
SELECT asset, 'replay-' || substr(sha256('sha256:' || h || '|sha256:config|0.3.0'), 1, 24) AS replay_run_id, 'sha256:' || h AS input_hash, 'sha256:config' AS config_hash, '0.3.0' AS model_version,
  c AS event_count, f AS first_received_ms, l AS last_received_ms FROM l4""",
)
def replay_manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journals.replay_manifest(replay_events(spark, sf_dir), ["asset"], "sha256:config", "0.3.0", fan_in=100)
