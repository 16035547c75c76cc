"""Immutable Parquet evidence, its manifest, read-back, retention listing and file checks."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.hashing import canonical_json, prefixed

# Partition columns and allowed segment text.
PARTITIONS = ("source", "date", "hour", "run")
SEGMENT_PATTERN = r"^[A-Za-z0-9._-]+$"
HOUR_PATTERN = r"^(?:[01][0-9]|2[0-3])$"


def evidence_rows(df: DataFrame, schema_version: str, run: str) -> DataFrame:
    """``source_id``, ``event_time``, ``received_at``, ``payload`` (JSON text) to evidence rows.

    The payload is rewritten with sorted keys before it is hashed.  Partition date and hour
    come from the receive time.
    """
    canonical = canonical_json(F.col("payload"))
    return df.select(
        "source_id",
        F.col("event_time").cast("timestamp").alias("event_time"),
        F.col("received_at").cast("timestamp").alias("received_at"),
        F.lit(schema_version).alias("schema_version"),
        F.lit(run).alias("ingestion_run_id"),
        canonical.alias("payload_json"),
        prefixed(canonical).alias("payload_hash"),
        F.col("source_id").alias("source"),
        F.date_format("received_at", "yyyy-MM-dd").alias("date"),
        F.date_format("received_at", "HH").alias("hour"),
        F.lit(run).alias("run"),
    )


def _runs(spark: SparkSession, root: str) -> DataFrame | None:
    """Partition values and files below the root (a listing, no data is read)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("basePath", root)
        .load(root)
        .select(
            "path", "length",
            F.col("source").cast("string").alias("source"),
            F.col("date").cast("string").alias("date"),
            F.lpad(F.col("hour").cast("string"), 2, "0").alias("hour"),
            F.col("run").cast("string").alias("run"),
        )
    )


def write_evidence(df: DataFrame, root: str, schema_version: str, run: str, rows_per_file: int = 5_000_000) -> None:
    """Write one new run; refuse unsafe names, an empty part and an existing run."""
    for label, value in (("schema version", schema_version), ("run", run)):
        if not re.fullmatch(SEGMENT_PATTERN, value):
            raise ValueError(f"unsafe {label} segment")
    spark = df.sparkSession
    rows = evidence_rows(df, schema_version, run)
    broken = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce(F.col("source").rlike(SEGMENT_PATTERN), F.lit(False))).alias("unsafe"),
        F.count_if(F.col("event_time").isNull() | F.col("received_at").isNull() | F.col("payload_json").isNull()).alias("missing"),
    ).first()
    if broken["n"] == 0:
        raise ValueError("an empty part is not evidence")
    if broken["unsafe"] or broken["missing"]:
        raise ValueError(f"rejected rows: {broken['unsafe']} unsafe sources, {broken['missing']} with missing fields")
    existing = _runs(spark, root)
    if existing is not None:
        here = rows.select(*PARTITIONS).distinct()
        if not here.join(existing.select(*PARTITIONS).distinct(), list(PARTITIONS), "left_semi").isEmpty():
            raise FileExistsError("this run already exists and is immutable")
    # rebalance: a busy hour is split into several files, quiet ones are merged
    (
        rows.hint("rebalance", "source", "date", "hour")
        .write.partitionBy(*PARTITIONS)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .mode("append")
        .parquet(root)
    )


def read_evidence(spark: SparkSession, root: str, view: str | None = "raw_evidence") -> DataFrame:
    """All parts by column name; filters on source, date and hour prune directories."""
    df = spark.read.option("mergeSchema", True).parquet(root)
    if view is not None:
        df.createOrReplaceTempView(view)
    return df


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """Path, bytes and sha256 of every part file, hashed where the file is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .load(root)
        .select("path", "length", prefixed(F.col("content")).alias("sha256"))
    )


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per part file: partition, records, bytes and sha256."""
    counted = (
        spark.read.parquet(root)
        .groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.count(F.lit(1)).alias("record_count"), F.first("schema_version").alias("schema_version"))
    )
    files = file_hashes(spark, root)
    name = lambda c: F.regexp_replace(F.url_decode(c), "^file:/+", "/")
    parts = _runs(spark, root).withColumn("__p", name(F.col("path"))).drop("path", "length")
    return (
        files.withColumn("__p", name(F.col("path")))
        .join(counted.withColumn("__p", name(F.col("path"))).drop("path"), "__p")
        .join(parts, "__p")
        .select(*PARTITIONS, "schema_version", "record_count", "length", "sha256", F.col("__p").alias("file"))
    )


def write_manifest(spark: SparkSession, root: str, target: str) -> None:
    manifest(spark, root).write.mode("errorifexists").json(target)


def verify_files(spark: SparkSession, expected: DataFrame, root: str) -> DataFrame:
    """Manifest rows whose file is missing or differs in bytes, sha256 or record count."""
    found = manifest(spark, root).select(
        "file", F.col("length").alias("found_length"), F.col("sha256").alias("found_sha256"),
        F.col("record_count").alias("found_records"),
    )
    joined = expected.join(found, "file", "left")
    problem = (
        F.when(F.col("found_sha256").isNull(), "MISSING")
        .when(F.col("sha256") != F.col("found_sha256"), "HASH")
        .when(F.col("length") != F.col("found_length"), "BYTES")
        .when(F.col("record_count") != F.col("found_records"), "RECORDS")
    )
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def retention_candidates(spark: SparkSession, root: str, as_of: date, days: int = 180) -> DataFrame:
    """Part files older than the cut-off date.  Nothing is read or deleted."""
    if days <= 0:
        raise ValueError("retention days must be positive")
    cutoff = (as_of - timedelta(days=days)).isoformat()
    return _runs(spark, root).filter(F.col("date") < cutoff).orderBy("path")
