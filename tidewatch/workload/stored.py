"""Evidence and journals written to the shared folder and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources import evidence, journals
from tidewatch.streaming.streams import shared_folder
from tidewatch.workload.registry import query
from tidewatch.workload.tables import table


def written(spark: SparkSession, sf_dir: str) -> str:
    """Events as evidence of one run below a new folder, received in one batch a week."""
    root = f"{shared_folder(spark)}/evidence"
    payload = F.to_json(F.struct(F.col("value"), F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k")))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source_id"), F.col("ts").alias("event_time"), F.date_trunc("week", "ts").alias("received_at"), payload.alias("payload")
    )
    evidence.write_evidence(rows, root, "1.0.0", "run-1")
    return root


@query(
    "evidence_read_back",
    """SELECT event_type AS source_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS date, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, count(*) FILTER (regexp_extract(props, '([0-9]+)', 1) = '0') AS zero_values
FROM events WHERE date_trunc('week', ts) >= TIMESTAMP '2024-01-10' GROUP BY ALL""",
)
def read_back_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over the evidence view; the date filter prunes directories."""
    evidence.read_evidence(spark, written(spark, sf_dir), "raw_evidence")
    return spark.sql(
        """SELECT source_id, cast(date AS string) AS date, count(*) AS n, sum(cast(get_json_object(payload_json, '$.id') AS bigint)) AS ids,
        count_if(get_json_object(payload_json, '$.k') = '0') AS zero_values
        FROM raw_evidence WHERE date >= '2024-01-10' GROUP BY source_id, date"""
    )


@query(
    "evidence_manifest",
    """SELECT event_type AS source, strftime(date_trunc('week', ts), '%Y-%m-%d') AS date, '00' AS hour, 'run-1' AS run, count(*) AS record_count, true AS hashed FROM events GROUP BY ALL""",
)
def manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = evidence.manifest(spark, written(spark, sf_dir))
    return listed.groupBy("source", "date", "hour", "run").agg(
        F.sum("record_count").alias("record_count"), F.bool_and(F.col("sha256").rlike("^sha256:[0-9a-f]{64}$")).alias("hashed")
    )


@query(
    "evidence_verified_files",
    """SELECT CAST(0 AS INTEGER) AS problems, (SELECT count(*) FROM events) AS records""",
)
def verify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored manifest against the files: no difference."""
    root = written(spark, sf_dir)
    evidence.write_manifest(spark, root, f"{root}-manifest")
    stored = spark.read.json(f"{root}-manifest")
    problems = evidence.verify_files(spark, stored, root).select(F.lit(1).alias("problem"), F.lit(0).cast("long").alias("n"))
    counted = stored.select(F.lit(0).alias("problem"), F.col("record_count").alias("n"))
    both = problems.unionByName(counted)
    return both.agg(F.sum("problem").cast("int").alias("problems"), F.sum("n").alias("records"))


@query(
    "retention_candidates",
    """SELECT DISTINCT event_type AS source, strftime(date_trunc('week', ts), '%Y-%m-%d') AS date, '00' AS hour, 'run-1' AS run FROM events WHERE date_trunc('week', ts) < TIMESTAMP '2024-01-16'""",
)
def retention_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = evidence.retention_candidates(spark, written(spark, sf_dir), dt.date(2024, 7, 14), 180)
    return old.select("source", "date", "hour", "run").distinct()


@query(
    "read_journal",
    """SELECT o_orderkey AS sequence, CASE WHEN o_orderkey % 50 <> 7 THEN o_orderstatus END AS kind, o_orderkey % 50 = 7 AS corrupt FROM orders""",
)
def read_journal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines with blank and broken lines between them."""
    folder = f"{shared_folder(spark)}/journal"
    o = table(spark, sf_dir, "orders")
    whole = F.to_json(F.struct(F.col("o_orderkey").alias("sequence"), F.col("o_orderstatus").alias("kind")))
    line = F.when(F.pmod("o_orderkey", F.lit(50)) == 7, F.concat(F.lit('{"sequence":'), "o_orderkey")).otherwise(whole)
    o.select(F.explode(F.array(line, F.lit("  "))).alias("value")).write.text(folder)
    read = journals.read_journal(spark, folder, "sequence long, kind string")
    broken = F.regexp_extract(journals.BAD_LINE, "([0-9]+)", 1).cast("long")
    corrupt = F.col(journals.BAD_LINE).isNotNull()
    return read.select(
        F.when(corrupt, broken).otherwise(F.col("sequence")).alias("sequence"), F.when(~corrupt, F.col("kind")).alias("kind"), corrupt.alias("corrupt")
    )
