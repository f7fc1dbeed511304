"""Fusion of keyword and semantic scores into one ranking per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.scoring import RRF_K, rrf_score, weighted_score
from quillrank.operators.joins import lookup_join
from quillrank.operators.requests import Requests, fusion_method

HYBRID_DIGITS = 9
_HIT_COLUMNS = ["query_id", "rank", "id", "title", "keyword_score", "semantic_score", "hybrid_score", "shard"]


def fuse(candidates: DataFrame, requests: Requests, *, rrf_k: int = RRF_K) -> DataFrame:
    """Rank candidates by the method each query asks for and keep its ``limit`` best.

    Reciprocal-rank fusion breaks ties by semantic rank, the weighted sum by arrival order
    (shard, then keyword rank inside it).
    """
    asked = requests.rows.select(
        "query_id", "limit", "alpha", fusion_method(F.col("fusion"), F.col("query_vector")).alias("method")
    )
    rows = lookup_join(candidates, asked, ["query_id"], bound=requests.n_queries)
    per_query = Window.partitionBy("query_id")
    is_rrf = F.col("method") == "rrf"
    ranked = (
        _with_defaults(rows)
        .withColumn(
            "keyword_rank", F.row_number().over(per_query.orderBy(F.desc("keyword_score"), "shard", "id"))
        )
        .withColumn(
            "semantic_rank", F.row_number().over(per_query.orderBy(F.desc("semantic_score"), "keyword_rank"))
        )
        .withColumn(
            "hybrid_score",
            F.when(is_rrf, rrf_score(F.col("keyword_rank"), F.col("semantic_rank"), rrf_k)).otherwise(
                weighted_score(F.col("keyword_score"), F.col("semantic_score"), F.col("alpha"))
            ),
        )
    )
    final = per_query.orderBy(
        F.desc("hybrid_score"), F.when(is_rrf, F.col("semantic_rank")), "shard", F.desc("keyword_score"), "id"
    )
    return (
        ranked.withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= F.col("limit"))
        .withColumn("hybrid_score", F.round("hybrid_score", HYBRID_DIGITS))
        .select(*_HIT_COLUMNS)
    )


def _with_defaults(rows: DataFrame) -> DataFrame:
    """Pools from other places may lack columns; take the plain score, or nothing, instead."""

    def first_of(*names):
        return [F.col(name) for name in names if name in rows.columns]

    return (
        rows.withColumn(
            "keyword_score", F.coalesce(*first_of("bm25_score", "score"), F.lit(0.0)).cast("double")
        )
        .withColumn("semantic_score", F.coalesce(*first_of("semantic_score"), F.lit(0.0)).cast("double"))
        .withColumn("title", F.coalesce(*first_of("title"), F.lit("")))
        .withColumn("shard", F.coalesce(*first_of("shard")) if "shard" in rows.columns else F.lit("unknown"))
    )
