"""From raw documents to packed training sequences: the stages, and a run over all of them.

All stages but the last give the columns they get, whatever they are called, and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import lines, neardup, packing, quality, secrets
from tidegraph.llm.catalogue import vocabulary_path
from tidegraph.workspace import keep

#: Token chunks that a worker holds while it packs: fewer than alone, as executors still hold what earlier stages have grown to.
PACKING_CACHE = 200_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps.  A null or empty text has too few words and goes; repeated rows and rows without an id are judged each."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents share.  Null texts stay null, empty ones empty; rows of one id are one document to the counts."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.  Rows without an id or without words stay; rows of one id stay or go together."""
    return neardup.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked.  Null texts stay null; no row goes."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of 2048 tokens.  A null or empty text is its end token alone; rows without an id have pieces too."""
    return packing.packing_report(docs, vocabulary_path(), cached=PACKING_CACHE)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither similarity links by components nor packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
