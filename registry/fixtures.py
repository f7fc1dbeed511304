"""Inputs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators.retrieval import Index
from quillrank.plans.index_store import IndexOptions, create_index
from quillrank.session import index_buckets, input_bytes, new_folder

NUM_SHARDS = 8

_indexes: dict[tuple, Index] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with the first line as title, and vectors for those that have one."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("title_vector")
    )
    docs = table(spark, sf_dir, "documents").join(vectors, "doc_id", "left")
    return docs.select(
        F.concat(F.lit("wiki_"), "doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        "title_vector",
        "doc_id",
    )


def options(spark: SparkSession, sf_dir: str, **more) -> IndexOptions:
    buckets = index_buckets(spark, input_bytes(spark, f"{sf_dir}/documents.parquet"), more.get("positions", False))
    return IndexOptions(**{"num_shards": NUM_SHARDS, "num_buckets": buckets, "analyzer": "simple", **more})


def index(spark: SparkSession, sf_dir: str, **more) -> Index:
    """The index over all documents; written once per application and set of options."""
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(more.items()))
    if key not in _indexes:
        _indexes[key] = fresh_index(spark, sf_dir, **more)
    return _indexes[key]


def fresh_index(spark: SparkSession, sf_dir: str, **more) -> Index:
    docs = documents(spark, sf_dir).drop("doc_id")
    return create_index(spark, new_folder(spark, "index"), docs, options(spark, sf_dir, dim=64, **more))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark item: its whole text, and the vector of the same number."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector")
    )
    items = table(spark, sf_dir, "benchmark").join(vectors, "item_id", "left")
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("q"), "query_vector")


def marked_up(text: str = "text", title: str = "title"):
    """Text with markup and white space runs around it, as a dump would carry."""
    return F.concat(
        F.lit("'''"), F.col(title), F.lit("''' [[a|b]] {{c}}\t\t \u00a0\u3000 "), F.col(text), F.lit("  [x] \n")
    )


def write_dump(spark: SparkSession, sf_dir: str, prefix: str = "", broken: bool = False) -> str:
    """All documents as a wiki dump in document order; some pages lack a title or a text, and some are not well-formed if ``broken``."""
    docs = documents(spark, sf_dir)

    def escaped(column):
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            column = F.replace(column, F.lit(raw), F.lit(entity))
        return column

    titled = F.when(F.col("doc_id") % 10 == 3, F.lit("")).otherwise(F.concat(F.lit("  <title>"), escaped(F.col("title")), F.lit("</title>\n")))
    filled = F.when(F.col("doc_id") % 10 == 7, F.lit("")).otherwise(escaped(marked_up("body")))
    page = F.concat(
        F.lit("<page>\n"),
        titled,
        F.lit('  <revision><text xml:space="preserve">'),
        filled,
        F.lit("</text></revision>\n  <revision><text>older</text></revision>\n"),
        F.when((F.col("doc_id") % 10 == 5) & F.lit(broken), F.lit("  <id>5</page>")).otherwise(F.lit("</page>")),
    )
    if prefix:
        page = F.regexp_replace(page, "(</?)(page|title|revision|text)\\b", f"$1{prefix}:$2")
    path = new_folder(spark, "dump")
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(page).write.text(path)
    return path


def write_json_lines(spark: SparkSession, sf_dir: str) -> str:
    """All documents as JSON lines in document order, some of them damaged."""
    docs = documents(spark, sf_dir)
    kind = F.col("doc_id") % 10
    whole = F.to_json(F.struct("id", "title", "body", "title_vector"))
    line = (
        F.when(kind == 1, F.concat(F.lit("{bad "), "id"))
        .when(kind == 2, F.to_json(F.struct("id", "title")))
        .when(kind == 3, F.concat(F.lit("  \n"), whole))
        .when(kind == 4, F.lit("[1]"))
        .when(kind == 5, F.to_json(F.struct("title", "body")))
        .otherwise(whole)
    )
    path = new_folder(spark, "json")
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(line).write.text(path)
    return path
