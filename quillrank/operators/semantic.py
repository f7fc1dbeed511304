"""Semantic scores of keyword candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.scoring import rounded
from quillrank.functions.vectors import cosine
from quillrank.operators.joins import lookup_join, vector_row_bytes
from quillrank.operators.requests import Requests
from quillrank.operators.retrieval import Index, with_stored


def score_candidates(shard_hits: DataFrame, index: Index, requests: Requests) -> DataFrame:
    """Cosine of query vector and title vector for hits already found; 0 where a vector is missing."""
    bound = requests.n_queries * index.num_shards * requests.max_limit
    stored = with_stored(shard_hits, index, ["title", "title_vector"], bound=bound)
    vectors = requests.rows.select("query_id", "query_vector")
    both = lookup_join(stored, vectors, ["query_id"], bound=requests.n_queries, row_bytes=vector_row_bytes(vectors, "query_vector"))
    similarity = rounded(F.coalesce(cosine(F.col("query_vector"), F.col("title_vector")), F.lit(0.0)))
    return both.select(
        "query_id", "shard", "id", "title", "bm25_score", similarity.alias("semantic_score")
    )
