"""Exact top-k of bags of words without scoring every pair that shares a word.

A word's weight in any document of a shard has an upper bound, which follows from statistics kept with the term. The words of a query
with the largest bounds are scored first; the k-th best document they give is a threshold for its shard. Words whose bounds together stay
below the threshold cannot lift a document that has none of the others, so only documents with one of the others are
candidates, and the postings of common words are joined to candidates alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.scoring import Bm25, inverse_document_frequency, rounded
from quillrank.operators.joins import lookup_join
from quillrank.operators.requests import Requests
from quillrank.operators.retrieval import HOT_TERM_SALTS, Clauses, Index, joined_uses
from quillrank.operators.statistics import sum_term_bounds
from quillrank.schemas import FIELDS
from quillrank.session import stage

#: Postings per hit asked for from which on pruning pays for its passes. Where each shard gives a good share of its documents as
#: hits, thresholds are low, and looking up what the candidates lack costs more than scoring all pairs.
PRUNE_ABOVE = 20_000
#: Documents met, per hit asked for, by the words that a threshold is taken from.
PROBE = 32
#: Scores are ranked with six digits; what is closer than this to a threshold is not below it.
SLACK = 2e-6

_SHARD = ["query_id", "shard"]
_PAIR = ["query_id", "shard", "id"]


@dataclass(frozen=True)
class Pruned:
    """``scores`` holds the best ``k`` of every query and shard, and few others; ``candidates`` are the pairs that were scored for it,
    ``probed`` those that the thresholds were taken from."""

    scores: DataFrame
    probed: DataFrame
    candidates: DataFrame


def upper_bound(bm25: Bm25, idf: Column, avg_dl: Column, max_tf: Column, min_ratio: Column) -> Column:
    """At least the weight of any posting whose frequency is at most ``max_tf`` and whose length is ``min_ratio`` frequencies or more."""
    # Stored lengths are rounded down by less than an eighth.
    ratio = min_ratio * F.lit(0.875) if bm25.length_norm == "quantized" else min_ratio
    inverse = F.lit(1.0) + F.lit(bm25.k1 * (1 - bm25.b)) / max_tf + F.lit(bm25.k1 * bm25.b) * ratio / avg_dl
    return F.coalesce(idf * F.lit(bm25.k1 + 1) / inverse, idf * F.lit(bm25.k1 + 1)) * F.lit(1 + 1e-9)


def _weights(index: Index, clauses: Clauses, bm25: Bm25) -> DataFrame:
    """``shard, field, term, idf, avg_dl, df, best`` of the query vocabulary."""
    vocabulary = clauses.rows.select("field", "term").distinct()
    found = sum_term_bounds(lookup_join(index.term_counts, vocabulary, ["field", "term"], bound=clauses.n_terms))
    found = lookup_join(found, index.field_stats, ["shard", "field"], bound=len(FIELDS) * index.num_shards)
    idf, avg_dl = inverse_document_frequency(F.col("n_docs"), F.col("df")), F.col("sum_dl") / F.col("n_docs")
    best = upper_bound(bm25, F.col("idf"), F.col("avg_dl"), F.col("max_tf"), F.col("min_ratio"))
    found = found.withColumns({"idf": idf, "avg_dl": avg_dl}).withColumn("best", best)
    return stage(found.select("shard", "field", "term", "idf", "avg_dl", "df", "best"), "weights")


def _postings(index: Index, clauses: Clauses, weights: DataFrame, bm25: Bm25) -> DataFrame:
    """``shard, id, field, term, best, weight`` of the postings of ``weights``."""
    rows = index.postings.select("shard", "field", "term", "id", "tf", "dl")
    rows = lookup_join(rows, weights.drop("df"), ["shard", "field", "term"], bound=clauses.n_terms * index.num_shards, salts=HOT_TERM_SALTS)
    weight = bm25.term_weight(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avg_dl"))
    return rows.select("shard", "id", "field", "term", "best", weight.alias("weight"))


def _summed(index: Index, clauses: Clauses, weights: DataFrame, uses: DataFrame, bm25: Bm25) -> DataFrame:
    """Scores by the words of ``uses`` alone, for every pair that shares one."""
    wanted = weights.join(uses.select("shard", "field", "term").distinct(), ["shard", "field", "term"], "left_semi")
    rows = _postings(index, clauses, stage(wanted, "wanted"), bm25)
    found = joined_uses(rows, uses.select("shard", "field", "term", "query_id", "boost"), ["shard", "field", "term"], clauses.n_rows * index.num_shards)
    return found.groupBy(*_PAIR).agg(F.sum(F.col("boost") * F.col("weight")).alias("score"))


def _completed(index: Index, clauses: Clauses, weights: DataFrame, candidates: DataFrame, below: Column, bm25: Bm25) -> DataFrame:
    """``candidates`` (a written table) with the words added whose bound ``below`` accepts; it may name columns of candidates.

    Postings stay in their buckets: candidates come to them by id. Sums per pair are what moves.
    """
    extra = [c for c in candidates.columns if c not in (*_PAIR, "score")]
    clause = clauses.rows.select("query_id", "field", "term", "boost")
    rows = lookup_join(_postings(index, clauses, weights, bm25), candidates.select(*_PAIR, *extra), ["shard", "id"], bound=candidates.count())
    rows = lookup_join(rows, clause, ["query_id", "field", "term"], bound=clauses.n_rows).where(below)
    more = rows.select(*_PAIR, (F.col("boost") * F.col("weight")).alias("score"))
    return candidates.select(*_PAIR, "score").unionByName(more).groupBy(*_PAIR).agg(F.sum("score").alias("score"))


def pruned_scores(index: Index, clauses: Clauses, requests: Requests, bm25: Bm25 = Bm25()) -> Pruned:
    """BM25 of every document that may be among the best ``k`` of its shard, for bags of words."""
    weights = _weights(index, clauses, bm25)
    clause = clauses.rows.select("query_id", "field", "term", "boost")
    wanted = requests.rows.select("query_id", "k")
    uses = lookup_join(weights, clause, ["field", "term"], bound=clauses.n_rows)
    uses = lookup_join(uses, wanted, ["query_id"], bound=requests.n_queries).withColumn("bound", F.col("boost") * F.col("best"))
    uses = stage(uses.select(*_SHARD, "field", "term", "boost", "df", "bound", "k"), "uses")

    # The words with the largest bounds, until they meet enough documents. Words of one bound go together.
    falling = Window.partitionBy(*_SHARD).orderBy(F.desc("bound"))
    met = F.sum("df").over(falling.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("df").over(Window.partitionBy(*_SHARD, "bound"))
    probed = uses.withColumn("before", met - own).where(F.col("before") < F.col("k") * PROBE)
    floors = stage(probed.groupBy(*_SHARD).agg(F.min("bound").alias("floor"), F.max("k").alias("k")), "floors")
    n_shards = requests.n_queries * index.num_shards
    probe = lookup_join(uses, floors.drop("k"), _SHARD, bound=n_shards).where(F.col("bound") >= F.col("floor"))
    first = _summed(index, clauses, weights, probe, bm25)
    first = lookup_join(_best(first, requests), floors, _SHARD, bound=n_shards).where(F.col("rank") <= F.col("k"))
    first = stage(first.select(*_PAIR, "score", "floor"), "probed")
    whole = _completed(index, clauses, weights, first, F.col("boost") * F.col("best") < F.col("floor"), bm25)
    whole = lookup_join(whole.groupBy(*_SHARD).agg(F.count("*").alias("n"), F.min("score").alias("least")), floors.drop("floor"), _SHARD, bound=n_shards)
    thresholds = whole.select(*_SHARD, F.when(F.col("n") >= F.col("k"), F.col("least") - SLACK).otherwise(0.0).alias("threshold"))
    thresholds = stage(thresholds, "thresholds")

    # The words with the smallest bounds, as long as they stay below the threshold together.
    rising = Window.partitionBy(*_SHARD).orderBy("bound").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = lookup_join(uses, thresholds, _SHARD, "left", bound=n_shards).withColumn("together", F.sum("bound").over(rising))
    low = F.col("together") < F.col("threshold")
    cuts = summed.groupBy(*_SHARD).agg(
        F.coalesce(F.max(F.when(low, F.col("bound"))), F.lit(-1.0)).alias("cut"),
        F.coalesce(F.max(F.when(low, F.col("together"))), F.lit(0.0)).alias("rest"),
        F.coalesce(F.max("threshold"), F.lit(0.0)).alias("threshold"),
    )
    cuts = stage(cuts, "cuts")
    essential = lookup_join(uses, cuts.select(*_SHARD, "cut"), _SHARD, bound=n_shards).where(F.col("bound") > F.col("cut"))
    partial = _summed(index, clauses, weights, essential, bm25)
    partial = lookup_join(partial, cuts, _SHARD, bound=n_shards).where(F.col("score") + F.col("rest") >= F.col("threshold"))
    candidates = stage(partial.select(*_PAIR, "score", "cut", "threshold"), "candidates")
    full = _completed(index, clauses, weights, candidates.drop("threshold"), F.col("boost") * F.col("best") <= F.col("cut"), bm25)
    full = lookup_join(full, cuts.select(*_SHARD, "threshold"), _SHARD, bound=n_shards).where(F.col("score") >= F.col("threshold"))
    return Pruned(full.select(*_PAIR, rounded(F.col("score")).alias("bm25_score")), first, candidates)


def _best(scored: DataFrame, requests: Requests) -> DataFrame:
    order = Window.partitionBy(*_SHARD).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= requests.max_limit)


def pays(index: Index, clauses: Clauses, requests: Requests) -> bool:
    """Whether a batch meets so many postings for the hits it asks for that pruning is worth its passes."""
    least = PRUNE_ABOVE * requests.total_limit * index.num_shards
    if index.n_docs is not None and clauses.n_rows * index.n_docs <= least:
        return False  # not even if every document had every word
    counts = clauses.rows.groupBy("field", "term").agg(F.count("*").alias("n"))
    found = lookup_join(index.term_counts, counts, ["field", "term"], bound=clauses.n_terms)
    return (found.agg(F.sum(F.col("df") * F.col("n"))).first()[0] or 0) > least
