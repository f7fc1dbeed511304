"""Per-query reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators.requests import Requests, fusion_method
from quillrank.operators.retrieval import Index


def keyword_report(hits: DataFrame, shard_hits: DataFrame, requests: Requests, index: Index) -> DataFrame:
    """Hits returned and shards that had any, for every query, also those without hits."""
    returned = hits.groupBy("query_id").agg(F.count("*").alias("total_hits"))
    return _report(returned, shard_hits, requests, index, [])


def hybrid_report(hits: DataFrame, candidates: DataFrame, requests: Requests, index: Index) -> DataFrame:
    """Adds the candidate pool size, the fusion method used and its alpha (null for RRF)."""
    returned = hits.groupBy("query_id").agg(F.count("*").alias("total_hits"))
    method = fusion_method(F.col("fusion"), F.col("query_vector"))
    return _report(
        returned,
        candidates,
        requests,
        index,
        [method.alias("fusion_method"), F.when(method == "weighted", F.col("alpha")).alias("fusion_alpha")],
    )


def _report(returned: DataFrame, pool: DataFrame, requests: Requests, index: Index, extra: list) -> DataFrame:
    found = pool.groupBy("query_id").agg(
        F.count("*").alias("keyword_hits"), F.count_distinct("shard").alias("shards_responded")
    )
    joined = requests.rows.join(returned, "query_id", "left").join(found, "query_id", "left")

    def count_of(name):
        return F.coalesce(F.col(name), F.lit(0)).alias(name)

    return joined.select(
        "query_id",
        "q",
        count_of("total_hits"),
        count_of("keyword_hits"),
        F.lit(index.num_shards).alias("shards_queried"),
        count_of("shards_responded"),
        *extra,
    )
