"""Corpus pipeline: quality rules, near-dedup, personal data, mixing, packing; each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenweave.llm import mixing, packing, pii, quality, simhash
from eigenweave.llm.common import scratch
from eigenweave.llm.queries import tokenizer_path
from eigenweave.sources.ship import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's fences, columns as they came.

    Null and empty texts go; null languages and sources are groups. Every row is judged by itself,
    whatever its id, so copies stay or go together. An empty table stays empty.
    """
    return quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id, columns as they came.

    Null, empty and wordless texts are one group. Of rows that share the smallest id and the group
    one stays, with the smallest fingerprint; a row without an id stays only where no row of its
    group has one. An empty table stays empty.
    """
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms generalised in text; n_chars follows the text.

    All rows and columns stay. Null texts stay null, with null n_chars; rows equal in id and text
    come out equal. An empty table stays empty.
    """
    clean = pii.sanitised(docs, everywhere=True)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times, columns as they came.

    A null source is a source, after the others. Documents without words cost nothing and go or
    stay by their hash; equal rows are taken alike. An empty table stays empty.
    """
    return mixing.mixed(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece, with its ids.

    A null or empty text is its end id. Each row is a document, whatever its id. Columns other than
    doc_id and text are left aside. An empty table gives no pieces.
    """
    return packing.pack_documents(docs, tokenizer_path(), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: SQL has neither SimHash with XXH64 nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's result written to the shared folder and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
