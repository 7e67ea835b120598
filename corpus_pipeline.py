"""The corpus pipeline: quality rules, line dedup, near-duplicates, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and its rows are written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._blocks import scratch
from siltstone.llm.line_dedup import line_dedup
from siltstone.llm.near_dedup import near_duplicates
from siltstone.llm.packing import pack_documents
from siltstone.llm.quality_rules import fit_field, quality_rules
from siltstone.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with the text of another column and its length."""
    new = df.withColumn("text", F.expr(text))
    return new.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged. The field learns from the labels of the folder."""
    field = fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules(docs.select(*COLUMNS), field).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of earlier documents; each keeps its row, even where no line is left."""
    return _as_documents(line_dedup(docs.select(*COLUMNS)), "IF(n_dropped = 0, text, kept_text)")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component over 5-word shingles; rows without an id stay."""
    found = near_duplicates(docs, shingle=5, percent=80)
    gone = found.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of 20 words that start earlier; texts that lose none stay as they are."""
    return _as_documents(substring_dedup(docs.select(*COLUMNS), 20), "IF(n_removed = 0, text, kept_text)")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, 2048)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_copies),
    ("substring dedup", substrings),
    ("packing", packing),
]

#: SQL can express neither the fitted field nor the packing; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
