"""Session set-up and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidewatch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once a context; they then need no installed copy."""
    context = spark.sparkContext
    if not any("tidewatch-package" in name for name in context._python_includes):
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="tidewatch-ship-"), "tidewatch-package.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder the cluster names; a local one only where none is set."""
    spark = df.sparkSession
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_KEY} to a shared folder")
            folder = tempfile.mkdtemp(prefix="tidewatch-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
