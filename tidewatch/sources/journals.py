"""Append-only journals and replay order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.hashing import prefixed, sha256, sorted_json
from tidewatch.functions.times import to_text
from tidewatch.operators.running import numbered, segmented

BAD_LINE = "_corrupt_record"
COPIES_BLOCK = 10_000


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped and broken ones kept in ``_corrupt_record``."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.select(
        "value", F.from_json("value", f"{schema}, {BAD_LINE} string", {"columnNameOfCorruptRecord": BAD_LINE}).alias("r")
    )
    return parsed.select("r.*")


def prune_by_age(records: DataFrame, judged_ms: str, now_ms: int, days: int) -> DataFrame:
    return records.filter(F.col(judged_ms) >= now_ms - days * 86_400_000)


def label_appends(journal: DataFrame, batch: DataFrame, record_id: str, record_hash: str, order: str) -> DataFrame:
    """Batch rows with ``append_state``.

    A new id is APPEND (its first row in the batch; of identical first rows one), the same id with the
    same hash is NO_OP, with another hash CONFLICT.
    """
    first = batch.groupBy(record_id).agg(F.min(F.struct(order, record_hash, _row_key(batch).alias("__row"))).alias("__first"))
    stored = journal.groupBy(record_id).agg(F.max(record_hash).alias("__stored"))
    joined = _copies(batch).join(first, record_id).join(stored, record_id, "left")
    basis = F.coalesce("__stored", F.col(f"__first.{record_hash}"))
    opening = F.struct(order, record_hash, _row_key(batch).alias("__row")).eqNullSafe(F.col("__first"))
    state = (
        F.when(F.col(record_hash) != basis, "CONFLICT")
        .when(F.col("__stored").isNull() & opening & (F.col("__copy") == 1), "APPEND")
        .otherwise("NO_OP")
    )
    return joined.select(*batch.columns, state.alias("append_state"))


def _row_key(batch: DataFrame) -> Column:
    """All of a row, for ties."""
    return F.struct(*(F.col(f"`{c}`") for c in batch.columns))


def _copies(batch: DataFrame) -> DataFrame:
    """The rows with ``__copy``, 1 for the first of equal rows.

    Equal rows are counted before they are dealt, so a record that comes very often is one row on the way; they are
    made again in blocks, which AQE spreads.
    """
    counted = batch.groupBy(*(F.col(f"`{c}`") for c in batch.columns)).agg(F.count(F.lit(1)).alias("__n"))
    blocks = counted.withColumn("__from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"), F.lit(COPIES_BLOCK).cast("long"))))
    copies = F.sequence(F.col("__from"), F.least(F.col("__n"), F.col("__from") + COPIES_BLOCK - 1))
    return blocks.hint("rebalance").withColumn("__copy", F.explode(copies)).drop("__n", "__from")


def append_idempotent(
    journal: DataFrame, batch: DataFrame, record_id: str, record_hash: str, order: str
) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicting rows)."""
    labelled = label_appends(journal, batch, record_id, record_hash, order)
    return (
        labelled.filter("append_state = 'APPEND'").drop("append_state"),
        labelled.filter("append_state = 'CONFLICT'").drop("append_state"),
    )


def append_sequenced(
    batch: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str, recorded_ms: str, payload: str,
    prefix: str, last_sequences: DataFrame | None = None, segments: int | None = None,
) -> DataFrame:
    """Contiguous sequence per journal after its last one, payload hash and record id.

    The record id hashes (sequence, kind, time, payload digest).
    """
    keys = list(keys)
    ranked = numbered(segmented(batch, order, segments), keys, order, "__n").drop("__segment")
    if last_sequences is not None:
        ranked = ranked.join(last_sequences.select(*keys, F.col("sequence").alias("__last")), keys, "left")
    else:
        ranked = ranked.withColumn("__last", F.lit(0))
    numbered_rows = ranked.withColumn("sequence", F.coalesce("__last", F.lit(0)) + F.col("__n"))
    digest = sha256(F.col(payload))
    identity = sorted_json(
        {"sequence": F.col("sequence"), "kind": F.col(kind), "recordedAt": to_text(F.col(recorded_ms)), "payloadDigest": digest}
    )
    return numbered_rows.select(
        *batch.columns, "sequence", F.concat(F.lit("sha256:"), digest).alias("payload_hash"),
        F.concat(F.lit(f"{prefix}-"), F.col("sequence"), F.lit("-"), F.substring(sha256(identity), 1, 16)).alias("record_id"),
    )


def quote_record_id(snapshot_id: Column, recorded_ms: Column) -> Column:
    text = F.concat(snapshot_id, F.lit(":"), to_text(recorded_ms))
    return F.concat(F.lit("quote-record-"), F.substring(sha256(text), 1, 24))


def append_quote_records(journal: DataFrame, batch: DataFrame, snapshot: str, recorded_ms: str) -> DataFrame:
    """New quote records; an id that is stored already, or came earlier in the batch, is rejected.

    Of the rows of an id the first in the order of all columns is the new record.
    """
    named = batch.withColumn("record_id", quote_record_id(F.col(snapshot), F.col(recorded_ms)))
    first = named.groupBy("record_id").agg(F.min(_row_key(batch)).alias("__first"))
    stored = journal.select("record_id", F.lit(True).alias("__stored")).distinct()
    again = ~_row_key(batch).eqNullSafe(F.col("__first")) | (F.col("__copy") > 1)
    return (
        _copies(named).join(first, "record_id").join(stored, "record_id", "left")
        .select(*named.columns, (F.coalesce("__stored", F.lit(False)) | again).alias("is_duplicate"))
    )


def record_hash(item: Column, judgment: Column) -> Column:
    """Hash of item and judgment structs together."""
    return prefixed(F.to_json(F.struct(item.alias("item"), judgment.alias("judgment"))))


# --- replay -------------------------------------------------------------------------------


def to_replay_events(
    observations: DataFrame, keys: Sequence[str], received_ms: str, row_id: str, segments: int | None = None
) -> DataFrame:
    """Order by (received, id), number from 1 per run and wrap the payload."""
    rest = sorted(observations.columns)
    ranked = numbered(
        segmented(observations, [received_ms, row_id], segments), keys, [received_ms, row_id], "ingestion_sequence"
    ).drop("__segment")
    return ranked.select(
        *keys, F.col(row_id).alias("event_id"), F.col(received_ms).alias("received_ms"), "ingestion_sequence",
        F.lit("MARKET_OBSERVATION").alias("kind"), F.to_json(F.struct(*rest)).alias("payload"),
    )


REPLAY_ORDER = ("received_ms", "ingestion_sequence", "event_id")


def replay_order(events: DataFrame) -> DataFrame:
    return events.orderBy(*REPLAY_ORDER)


def replay_until(events: DataFrame, until_ms: int) -> DataFrame:
    """Rows visible once the clock reached the instant (seek is the same set)."""
    return events.filter(F.col("received_ms") <= until_ms)


def replay_step(events: DataFrame, keys: Sequence[str], n: int, after_ms: int | None = None, segments: int | None = None) -> DataFrame:
    """The next ``n`` events in replay order, after those visible at ``after_ms``."""
    if n <= 0:
        raise ValueError("step count must be positive")
    pending = events if after_ms is None else events.filter(F.col("received_ms") > after_ms)
    return numbered(
        segmented(pending, REPLAY_ORDER, segments), keys, list(REPLAY_ORDER), "position"
    ).drop("__segment").filter(F.col("position") <= n)


def replay_violations(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Event ids and sequence numbers that occur more than once in a run."""
    def repeated(column: str, rule: str) -> DataFrame:
        return (
            events.groupBy(*keys, F.col(column).cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("copies"))
            .filter("copies > 1")
            .withColumn("violation", F.lit(rule))
        )

    return repeated("event_id", "DUPLICATE_ID").unionByName(repeated("ingestion_sequence", "DUPLICATE_SEQUENCE"))


def replay_manifest(
    events: DataFrame, keys: Sequence[str], config_hash: str, model_version: str, fan_in: int = 10_000,
    levels: int = 4, segments: int | None = None,
) -> DataFrame:
    """Count, first and last receipt and an ordered content hash per run.

    Row hashes are combined in order, ``fan_in`` at a time, level by level, so no task joins a
    whole run's hashes.  It is a hash tree: stable for equal input, not the hash of one text.  There are
    ``levels`` levels, or as many more as the longest run needs to end in one row.
    """
    keys = list(keys)
    longest = events.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while fan_in**levels < longest:
        levels += 1
    row_hash = sha256(F.concat_ws("|", *[F.col(c) for c in ("received_ms", "ingestion_sequence", "event_id", "kind", "payload")]))
    ranked = numbered(
        segmented(events, REPLAY_ORDER, segments), keys, list(REPLAY_ORDER), "__n"
    ).select(*keys, (F.col("__n") - 1).alias("__n"), row_hash.alias("__h"), "received_ms")
    level = ranked.groupBy(*keys, F.floor(F.col("__n") / fan_in).cast("long").alias("__c")).agg(
        F.array_sort(F.collect_list(F.struct("__n", "__h"))).alias("__l"),
        F.count(F.lit(1)).alias("event_count"),
        F.min("received_ms").alias("first_received_ms"),
        F.max("received_ms").alias("last_received_ms"),
    )
    joined_hash = sha256(F.concat_ws("", F.transform("__l", lambda x: x["__h"])))
    for _ in range(levels - 1):
        level = level.select(
            *keys, F.col("__c").alias("__n"), joined_hash.alias("__h"), "event_count", "first_received_ms", "last_received_ms"
        ).groupBy(*keys, F.floor(F.col("__n") / fan_in).cast("long").alias("__c")).agg(
            F.array_sort(F.collect_list(F.struct("__n", "__h"))).alias("__l"),
            F.sum("event_count").alias("event_count"),
            F.min("first_received_ms").alias("first_received_ms"),
            F.max("last_received_ms").alias("last_received_ms"),
        )
    input_hash = F.concat(F.lit("sha256:"), joined_hash)
    identity = F.concat_ws("|", input_hash, F.lit(config_hash), F.lit(model_version))
    return level.select(
        *keys, F.concat(F.lit("replay-"), F.substring(sha256(identity), 1, 24)).alias("replay_run_id"),
        input_hash.alias("input_hash"), F.lit(config_hash).alias("config_hash"), F.lit(model_version).alias("model_version"),
        "event_count", "first_received_ms", "last_received_ms",
    )


def latest_of_kind(journal: DataFrame, keys: Sequence[str], kind: str, sequence: str = "sequence") -> DataFrame:
    """Last record of a kind per journal."""
    keys = list(keys)
    rest = [c for c in journal.columns if c not in (*keys, sequence)]
    picked = journal.filter(F.col("kind") == kind)
    return (
        picked.groupBy(*keys).agg(F.max(F.struct(F.col(sequence), *rest)).alias("__r"))
        .filter(F.col("__r").isNotNull())
        .select(*keys, "__r.*")
    )
