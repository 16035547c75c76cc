"""What the operators share: reading tables, bounded Arrow batches, tables stored in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.session import ship

BATCH_ROWS = 500
BATCH_BYTES = 8 << 20
SPACE = r"[\x20\x09-\x0D]+"


def prepared(spark: SparkSession) -> SparkSession:
    """Ship the package and bound the batches that Python workers get: long texts must not meet thousands of others."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only in local mode where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="tidewatch-llm-")
    return f"{root}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write as Parquet in the shared folder and read again: the lineage ends there, whoever is lost later."""
    folder = folder or work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made of them is stored itself."""
    for table in tables:
        folder = table.inputFiles()[0].rsplit("/", 1)[0]
        if not re.fullmatch(r"llm-[0-9a-f]{32}", folder.rsplit("/", 1)[1]):
            raise ValueError(f"not a stored table: {folder}")
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def keyed_rows(docs: DataFrame, key: str) -> DataFrame:
    """All rows, stored, with a long ``key`` of their own that ascends by ``doc_id``, then by the SHA-256 of the text.

    Null ids come last.  Copies go by their other columns; which of wholly equal rows comes first does not matter.  Rows are
    cut into ranges down to the single copy, so an id or a text that many rows share is spread over the tasks.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = {
        "order_null": F.col("doc_id").isNull(), "order_id": F.col("doc_id"), "order_text": F.sha2(text_of().cast("binary"), 256),
        "order_rest": F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0), "order_copy": F.monotonically_increasing_id(),
    }
    placed = docs.withColumns(order).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.select(*(F.col(f"`{c}`") for c in docs.columns), F.monotonically_increasing_id().alias(key)))


def map_rows(
    df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str, carry: Sequence[str] = ()
) -> DataFrame:
    """``mapInArrow`` over columns as Python lists, batch by batch; the function returns columns in schema order.

    Columns to carry are not turned into Python objects; they follow the others unchanged.  With them the function
    must return as many rows as it gets.
    """
    names = [c for c in df.columns if c not in carry]
    carried = [f for f in df.schema.fields if f.name in carry]
    out_schema = T.StructType([*T.StructType.fromDDL(schema).fields, *carried])
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = pa.RecordBatch.from_pydict(function({n: batch.column(n).to_pylist() for n in names}), schema=kinds)
                if carried:
                    columns = [*own.columns, *(batch.column(f.name) for f in carried)]
                    own = pa.RecordBatch.from_arrays(columns, names=[*own.schema.names, *(f.name for f in carried)])
                yield own

    return df.mapInArrow(run, out_schema)
