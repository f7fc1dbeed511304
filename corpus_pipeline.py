"""A training corpus from raw documents: score, clean, deduplicate, mix and pack them.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows the one before kept; all but the last return the columns
of ``documents``. Stages are written as Parquet to the shared folder and read again, so each is recomputed at most once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillrank.llm.common import stage, table
from quillrank.llm.line_dedup import dedup_lines
from quillrank.llm.mixing import mix
from quillrank.llm.near_duplicates import one_of_each
from quillrank.llm.packing import pack_documents
from quillrank.llm.quality import classify_quality

#: The quality field is fitted and the packing searched in Python; SQL cannot express them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores as good."""
    scored = classify_quality(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that came earlier; every document stays, if with a shorter text."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets ask for."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
