"""Searches over an index, for whole batches of queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.scoring import Bm25
from quillrank.operators.blocks import best_scores, fits_blocks
from quillrank.operators.fusion import fuse
from quillrank.operators.pruning import pays, pruned_scores
from quillrank.operators.reports import hybrid_report, keyword_report
from quillrank.operators.requests import Requests, prepare
from quillrank.operators.retrieval import (
    Index,
    bag_of_words,
    merge_shards,
    score_clauses,
    score_words,
    structured,
    top_per_shard,
    with_stored,
)
from quillrank.operators.semantic import score_candidates
from quillrank.session import stage


@dataclass(frozen=True)
class Search:
    """Result of one batch: final hits, the pool they were chosen from, a row per query."""

    hits: DataFrame
    pool: DataFrame
    report: DataFrame


def shard_hits(
    index: Index, requests: Requests, *, clauses: DataFrame | None = None, bm25: Bm25 = Bm25(), dedupe_terms: bool = True
) -> DataFrame:
    """Best hits of every shard, ``(query_id, shard, id, bm25_score, shard_rank)``.

    Queries are bags of words unless ``clauses`` says otherwise. Queries of similar limits are searched together, as each task
    keeps the largest limit for all of them. Batches of optional words that a task can hold are scored in blocks of documents.
    """

    def hits(part: Requests) -> DataFrame:
        if clauses is None:
            bag = bag_of_words(index, part, dedupe_terms=dedupe_terms)
            if fits_blocks(index, bag, part):
                return top_per_shard(best_scores(index, bag, part, bm25), part)
            scored = pruned_scores(index, bag, part, bm25).scores if pays(index, bag, part) else score_words(index, bag, bm25)
        else:
            valid = clauses.join(part.rows.select("query_id"), "query_id", "left_semi")
            asked = structured(index, valid)
            scored = best_scores(index, asked, part, bm25) if fits_blocks(index, asked, part) else score_clauses(index, asked, bm25)
        return top_per_shard(scored, part)

    return reduce(DataFrame.unionByName, [hits(part) for part in requests.by_limit()])


def keyword_search(index: Index, queries: DataFrame, **options) -> Search:
    """BM25 top-k per shard, merged to ``limit`` hits per query."""
    requests = prepare(queries)
    # Written once: the hits and the report both read it, and it is small.
    pool = stage(shard_hits(index, requests, **options), "pool")
    merged = merge_shards(pool, requests)
    named = with_stored(merged, index, ["title"], bound=requests.n_queries * requests.max_limit)
    hits = named.select("query_id", "rank", "id", F.col("bm25_score").alias("score"), "title", "shard")
    return Search(hits, pool, keyword_report(merged, pool, requests, index))


def scored_search(index: Index, requests: Requests, **options) -> DataFrame:
    """Best hits of every shard with their cosine to the query vector; not merged, not fused."""
    return score_candidates(shard_hits(index, requests, **options), index, requests)


def hybrid_search(index: Index, queries: DataFrame, **options) -> Search:
    """Keyword retrieval with a widened limit, semantic scores for the hits, fusion."""
    requests = prepare(queries, widen=True)
    pool = stage(scored_search(index, requests, **options), "pool")
    hits = fuse(pool, requests)
    return Search(hits, pool, hybrid_report(hits, pool, requests, index))
