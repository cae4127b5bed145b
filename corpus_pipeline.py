"""The corpus pipeline: documents through five corpus operators, each stage working on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefold.llm import decontaminate, mixing, neardup, quality, secrets
from pulsefold.llm.base import spread, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed rules or exceed a threshold of their language and source go.

    A null text has no words and goes; null languages and sources are groups of their own. Rows that are alike share one verdict, ids
    are not looked at, and columns other than those of documents are left out. An empty table stays empty.
    """
    counts = written(quality.measured(docs.select(*COLUMNS)))
    return quality.judge(counts).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of exact and near copies the document with the least doc_id stays (null first).

    Rows equal in id and text are one document; of rows equal in id alone the texts are told apart. Texts without a word are each a class
    of their own by id. Other columns are left out. An empty table stays empty.
    """
    return neardup.deduplicated(docs.select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    A null or empty text holds nothing and stays, as everything does if the benchmark has no item with a word. Rows with equal texts go or
    stay together, whatever their ids. Other columns are left out. An empty table stays empty.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.clean(docs.select(*COLUMNS), benchmark)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in its text is replaced by a mark, and n_chars follows.

    A null text stays null, and a text without a secret as it is, with the n_chars it came with. Repeated rows are changed alike. Other
    columns are left out. An empty table stays empty.
    """
    found = secrets.scan(docs.select(*COLUMNS))
    some = F.size("spans") > 0
    out = found.withColumn("text", F.when(some, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (copies) and the words this makes (taken).

    A null source is a source, the last in order; a null or empty text has no words and makes none. Rows with equal ids, null ones too, are taken alike.
    Other columns than those of documents are left out first, so none clashes with the new ones. An empty table stays empty.
    """
    return mixing.mix(docs.select(*COLUMNS)).filter("copies > 0")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark leaks", benchmark_leaks),
    ("secret scans", secret_scan),
    ("mixing", mix),
]

#: Signatures and fingerprints of the stages can't be expressed in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in turn, each one's rows written to the shared folder for the next."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
