"""The corpus pipeline: raw documents to packed training batches, a stage at a time.

Each stage reads what the one before it wrote, works on all of it, and returns what stays, with the columns of documents; the last
one returns the batches. ORACLE_SQL is None: an isolation forest, fingerprints and a dynamic programme aren't SQL.

In every stage very long texts are whole, an empty table gives no row, other columns stay as they are whatever their names, and rows that agree in doc_id and text are one
document: what happens to one of them happens to all. n_chars, where there is such a column, is the length of the text as it is now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequenza.llm import lines, packing, quality, simhash, suffix
from sequenza.llm.common import read
from sequenza.llm.tokencount import vocabulary
from sequenza.operators.lineage import fresh_path, remove

ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text is now, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject. A null text is judged as an empty one; a null doc_id changes nothing; equal texts go or stay together. Without labels nothing goes."""
    return quality.drop_rejected(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the runs of lines that occurred earlier, by doc_id (nulls first), then by text; a document that this leaves no word of goes. Null and blank texts stay as they are."""
    return _measured(lines.drop_repeated_runs(docs, keep_emptied=False))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document of each group of near copies, the one of least doc_id. Rows of null doc_id or text are in no group and stay; empty texts are copies of each other."""
    return simhash.drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that occurred earlier, by doc_id (nulls first), then by text; a document that this leaves no word of goes. Null and blank texts stay as they are."""
    return _measured(suffix.drop_repeated_passages(docs, keep_emptied=False))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The length bucket and the batch of each row, by its tokens. Null and blank texts have none; ties in a bucket go by doc_id (nulls first), then by length."""
    return packing.pack(docs, vocabulary=vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of all documents.

    What each stage returns is written to the cluster's shared folder and read again; it is deleted once the next stage has written its own. The last
    one's stays, as it is what is returned.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
