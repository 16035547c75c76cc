"""Bounded samples of labelled and unlabelled rows, and the split by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 20_000


def fold(id_column: str = "doc_id") -> Column:
    """CRC-32 of the id as text modulo 5; 0 marks held-out rows (a null id counts as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def bounded_sample(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """At most ``most`` rows, the first in the order of a hash: the same rows whatever the partitions."""
    if most > MOST_ROWS:
        raise ValueError(f"a sample has at most {MOST_ROWS} rows")
    return rows.orderBy(*order).limit(most)


def labelled_docs(docs: DataFrame, labels: DataFrame, label: str, most: int, where: Column | None = None, seed: int = 0) -> DataFrame:
    """``(doc_id, text…, label int)`` of at most ``most`` labelled documents, one row each.

    The sample has two longs a row and at most ``MOST_ROWS`` rows, so it is broadcast and only its texts are shuffled.
    Null labels and ids are left out; an id that is labelled twice counts with its larger label.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy(F.col("doc_id").alias("sample_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    picked = bounded_sample(known, most, F.xxhash64("sample_id", F.lit(seed)), "sample_id")
    return one_row_an_id(docs.join(F.broadcast(picked), F.col("doc_id") == F.col("sample_id")).drop("sample_id"))


def one_row_an_id(sample: DataFrame) -> DataFrame:
    """The row with the smallest text, then the smallest other columns, of every ``doc_id``; aggregated before it is dealt."""
    rest = [c for c in sample.columns if c not in ("doc_id", "text")]
    return sample.groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("row")).select("doc_id", "row.*")
