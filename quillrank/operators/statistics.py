"""Index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.schemas import FIELDS


def term_stats(postings: DataFrame) -> DataFrame:
    """Documents and occurrences per (shard, field, term)."""
    return postings.groupBy("shard", "field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def term_counts(postings: DataFrame) -> DataFrame:
    """``term_stats`` with what bounds a term's weight: its largest frequency, and the least field length per frequency."""
    return postings.groupBy("shard", "field", "term").agg(
        F.count("*").alias("df"),
        F.sum("tf").alias("total_tf"),
        F.max("tf").alias("max_tf"),
        F.min(F.col("dl") / F.col("tf")).alias("min_ratio"),
    )


def sum_term_rows(counts: DataFrame) -> DataFrame:
    """One row per term of counts that may be split over rows or taken back by negative ones."""
    sums = [F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"), F.max("max_tf").alias("max_tf"), F.min("min_ratio").alias("min_ratio")]
    return counts.groupBy("shard", "field", "term").agg(*sums).where("df <> 0 OR total_tf <> 0")


def sum_term_bounds(counts: DataFrame) -> DataFrame:
    """``sum_term_counts`` with the bounds; those of documents that are gone may be wider than need be."""
    bounds = [F.max("max_tf").alias("max_tf"), F.min("min_ratio").alias("min_ratio")]
    return counts.groupBy("shard", "field", "term").agg(F.sum("df").alias("df"), *bounds).where("df > 0")


def sum_term_counts(counts: DataFrame) -> DataFrame:
    """Document frequency per (shard, field, term), from counts that may be split over rows."""
    return counts.groupBy("shard", "field", "term").agg(F.sum("df").alias("df")).where("df > 0")


def shard_stats(docs: DataFrame, num_shards: int = 0) -> DataFrame:
    """Live documents per shard; with ``num_shards`` also of shards that have none."""
    counts = docs.groupBy("shard").agg(F.count("*").alias("doc_count"))
    if not num_shards:
        return counts
    return all_shards(docs.sparkSession, num_shards).join(counts, "shard", "left").select("shard", F.coalesce("doc_count", F.lit(0)).alias("doc_count"))


def field_lengths(terms: DataFrame) -> DataFrame:
    """Total length per (shard, field), from term statistics."""
    return terms.groupBy("shard", "field").agg(F.sum("total_tf").alias("sum_dl"))


def field_stats(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Documents and total length per (shard, field); documents without words still count."""
    return combine_field_stats(shard_stats(docs), field_lengths(terms))


def combine_field_stats(doc_counts: DataFrame, lengths: DataFrame) -> DataFrame:
    every_field = F.explode(F.array(*[F.lit(name) for name in FIELDS])).alias("field")
    counts = doc_counts.select("shard", F.col("doc_count").alias("n_docs"), every_field)
    return counts.join(lengths, ["shard", "field"], "left").select(
        "shard", "field", "n_docs", F.coalesce("sum_dl", F.lit(0)).alias("sum_dl")
    )


def cluster_stats(docs: DataFrame, num_shards: int) -> DataFrame:
    """One row: shards, documents, and the list of shards with their counts, empty ones included."""
    return shard_stats(docs, num_shards).agg(
        F.count("*").alias("total_shards"),
        F.coalesce(F.sum("doc_count"), F.lit(0)).alias("total_documents"),
        F.array_sort(F.collect_list(F.struct("shard", "doc_count"))).alias("shards"),
    )


def all_shards(spark: SparkSession, num_shards: int) -> DataFrame:
    """The shards of an index, whether they hold documents or not."""
    return spark.range(num_shards).select(F.col("id").cast("int").alias("shard"))
