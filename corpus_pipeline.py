"""A corpus pipeline of five stages; each decides over all that the one before it kept.

``STAGES`` lists them; ``run`` applies them to ``documents``, each result written as Parquet in the shared folder and
read again as the documents of the next.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidewatch.llm import cotraining, minhash, packing, suffix, toxicity  # noqa: E402
from tidewatch.llm.common import prepared, table, work_folder  # noqa: E402
from tidewatch.workload.registry import query  # noqa: E402

ROW = "pipeline_row"
NEAR_PERCENT, NEAR_BANDS = 80, 96  # 96 bands of 8 miss a link at exactly 80 percent with odds of about 2e-8


def _whole(docs: DataFrame) -> DataFrame:
    """Documents with all of their columns once more in one struct, out of the way of the operators' names."""
    return docs.withColumn(ROW, F.struct(*(F.col(f"`{c}`") for c in docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier keeps."""
    scored = cotraining.score(_whole(docs), table(spark, sf_dir, "labels"), carry=(ROW,))
    return scored.where("kept").select(f"{ROW}.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    scored = toxicity.score(_whole(docs), table(spark, sf_dir, "labels"), carry=(ROW,))
    return scored.where("predicted = 0").select(f"{ROW}.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 80 percent), that with the smallest id; rows that repeat an id stay or go together."""
    gone = minhash.near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("gone_id"), "left_anti")


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that also start earlier; a letter cut by an edge of one goes too.

    Every row stays, its text may become empty; ``n_chars`` counts what is left.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    kept = suffix.remove_repeats(docs.select("doc_id", "text", rest.alias(ROW)), as_text=True, every_row=True, carry=(ROW,))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("kept_text").alias("text"))
        elif name == "n_chars":
            columns.append(F.length("kept_text").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars"))
        else:
            columns.append(F.col(f"{ROW}.`{name}`").alias(name))
    return kept.select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, one row a piece."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, public_tokenizers.PATTERN, added_tokens=True)


STAGES = [("quality", quality), ("toxicity", clean), ("near_dedup", distinct), ("repeats", unrepeated), ("packing", packed)]

# Learned classifiers and tokenizers have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepared(spark), sf_dir, "documents")
    folder = work_folder(spark)
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
