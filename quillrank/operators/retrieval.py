"""BM25 retrieval for query batches.

Everything up to the per-shard top-k works on one document's rows at a time. With postings
bucketed by id it therefore runs without a shuffle, and the window's group limit cuts each
task's output to ``k`` rows per query and shard before the only exchange.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.scoring import Bm25, inverse_document_frequency, rounded
from quillrank.functions.text import MAX_TOKEN_BYTES
from quillrank.operators.analysis import analyzed, query_terms, terms
from quillrank.operators.joins import lookup_join, max_broadcast_rows
from quillrank.operators.phrases import distinct_phrases, phrase_counts
from quillrank.operators.requests import Requests
from quillrank.operators.statistics import sum_term_counts
from quillrank.schemas import FIELDS
from quillrank.session import stage

# Tasks a hot term is spread over when the query vocabulary is too large to broadcast.
HOT_TERM_SALTS = 64
POPULAR_DOC_SALTS = 16
# Words that are pushed to the scan one by one, and clauses up to which it is worth looking for so few.
MAX_PUSHED_TERMS = 32
PUSHED_CLAUSES = 1000
# Ranges of terms that a batch is cut into at most; beyond it their joins are shuffled with salt.
MAX_RANGES = 256

# Bytes of one use of a word by a query, as broadcast.
USE_BYTES = 64

_MASK_BITS = 62


@dataclass(frozen=True)
class Index:
    """The tables a search reads.

    ``term_counts`` may hold several rows per term, one for each commit that changed it; they
    are summed after the rows of other terms are gone. ``shards`` lists the shards that the index's last commit names,
    ``n_docs`` is the number of documents written, replaced ones included, if it is known.
    """

    docs: DataFrame
    postings: DataFrame
    field_stats: DataFrame
    term_counts: DataFrame
    num_shards: int
    analyzer: str = "simple"
    positions: bool = False
    max_token_bytes: int = MAX_TOKEN_BYTES
    shards: DataFrame | None = None
    n_docs: int | None = None

    @property
    def term_stats(self) -> DataFrame:
        """Document frequency per (shard, field, term)."""
        return sum_term_counts(self.term_counts)


@dataclass(frozen=True)
class Clauses:
    """Analyzed clauses, one row per (query, clause, field, term).

    ``must_no`` numbers the required clauses of a query from 0. ``is_plain`` says that all are optional single words of positive boost.
    """

    rows: DataFrame
    n_rows: int
    n_terms: int
    max_must: int
    has_phrases: bool
    is_plain: bool = False


def _every_field(field):
    return F.explode(F.when(field.isNull(), F.array(*[F.lit(f) for f in FIELDS])).otherwise(F.array(field)))


def bag_of_words(index: Index, requests: Requests, *, dedupe_terms: bool = True) -> Clauses:
    """Each word of the query, optional, in every field; the default meaning of a query."""
    found = query_terms(requests.rows, index.analyzer, dedupe=dedupe_terms, max_bytes=index.max_token_bytes)
    # A repeated word adds up to a boost, so every (query, term, field) stays one row.
    found = found.groupBy("query_id", "term").agg(F.count("*").cast("double").alias("boost"))
    rows = found.select(
        "query_id",
        F.col("term").alias("clause_id"),
        F.lit("should").alias("occur"),
        F.lit(None).cast("int").alias("must_no"),
        "boost",
        F.lit(0).alias("word_offset"),
        F.lit(1).alias("n_words"),
        "term",
        _every_field(F.lit(None).cast("string")).alias("field"),
    )
    return _staged(rows)


def structured(index: Index, clauses: DataFrame) -> Clauses:
    """Analyze ``clauses(query_id, clause_id, terms array, field, occur, boost)``.

    Several terms form a phrase. ``field`` null means every field, ``occur`` is should, must
    or must_not.
    """
    split = clauses.select(
        "query_id",
        F.col("clause_id").cast("string").alias("clause_id"),
        F.coalesce("occur", F.lit("should")).alias("occur"),
        F.coalesce(F.col("boost").cast("double"), F.lit(1.0)).alias("boost"),
        "field",
        terms(F.concat_ws(" ", "terms"), slots=True, max_bytes=index.max_token_bytes).alias("words"),
    )
    by_clause = Window.partitionBy("query_id", "occur").orderBy("clause_id")
    must_no = F.when(F.col("occur") == "must", F.dense_rank().over(by_clause) - 1)
    per_field = split.withColumn("must_no", must_no).select(
        "query_id", "clause_id", "occur", "must_no", "boost", "words", _every_field(F.col("field")).alias("field")
    )
    rows = per_field.select(
        "query_id",
        "clause_id",
        "occur",
        "must_no",
        "boost",
        F.size(F.array_compact("words")).alias("n_words"),
        # The gap of an over-long word stays between its neighbours, as it does in documents.
        F.posexplode_outer("words").alias("word_offset", "term"),
        "field",
    )
    return _staged(analyzed(rows.where("term IS NOT NULL OR n_words = 0"), index.analyzer))


def _staged(rows: DataFrame) -> Clauses:
    rows = stage(rows, "clauses")
    size = rows.agg(
        F.count("*").alias("n"),
        F.count_distinct("field", "term").alias("terms"),
        F.coalesce(F.max("must_no") + 1, F.lit(0)).alias("must"),
        F.coalesce(F.max(F.col("n_words") > 1), F.lit(False)).alias("phrases"),
        F.coalesce(F.min((F.col("occur") == "should") & (F.col("n_words") <= 1) & (F.col("boost") > 0)), F.lit(False)).alias("plain"),
    ).first()
    return Clauses(rows, size["n"], size["terms"], size["must"], size["phrases"], size["plain"])


def _parts(index: Index, clauses: Clauses) -> list[tuple[Clauses, Column | None]]:
    """The clauses in as many ranges of terms as it takes to broadcast each, with a condition on postings.

    Postings lie in order of terms, so a range reads its own pages only, all ranges together read the index once, and
    postings never leave their bucket however many words a batch has; between ranges only sums per query and document move.
    """
    n = -(-clauses.n_terms * index.num_shards // max(1, max_broadcast_rows()))
    # Ranges are cut by a sample; twice as many leave room for uneven ones.
    n = 2 * n if n > 1 else n
    if n <= 1:
        few = clauses.rows.select("term").where("term IS NOT NULL").distinct().limit(MAX_PUSHED_TERMS + 1)
        found = [r.term for r in few.collect()] if clauses.n_rows <= PUSHED_CLAUSES else []
        wanted = [F.col("term") == word for word in found]
        return [(clauses, reduce(or_, wanted) if 0 < len(wanted) <= MAX_PUSHED_TERMS else None)]
    counts = clauses.rows.where("term IS NOT NULL").groupBy("term")
    counts = counts.agg(F.count("*").alias("n"), F.count_distinct("field").alias("terms"))
    ranges = counts.repartitionByRange(min(n, MAX_RANGES), "term").groupBy(F.spark_partition_id().alias("part"))
    starts = ranges.agg(F.min("term").alias("start"), F.sum("n").alias("n"), F.sum("terms").alias("terms")).orderBy("start").collect()
    parts = []
    for i, row in enumerate(starts):
        inside = F.lit(True) if i == 0 else F.col("term") >= row.start
        if i + 1 < len(starts):
            inside = inside & (F.col("term") < starts[i + 1].start)
        parts.append((replace(clauses, rows=clauses.rows.where(inside), n_rows=row.n, n_terms=row.terms), inside))
    return parts or [(clauses, None)]


def _term_weights(index: Index, clauses: Clauses) -> DataFrame:
    """``shard, field, term, idf, avg_dl`` of the query vocabulary."""
    vocabulary = clauses.rows.select("field", "term").distinct()
    wanted = sum_term_counts(lookup_join(index.term_counts, vocabulary, ["field", "term"], bound=clauses.n_terms))
    return lookup_join(wanted, index.field_stats, ["shard", "field"], bound=len(FIELDS) * index.num_shards).select(
        "shard",
        "field",
        "term",
        inverse_document_frequency(F.col("n_docs"), F.col("df")).alias("idf"),
        (F.col("sum_dl") / F.col("n_docs")).alias("avg_dl"),
    )


def _weighted_postings(index: Index, clauses: Clauses, inside: Column | None = None) -> DataFrame:
    """Postings of the query vocabulary with their shard's idf and average length."""
    if inside is not None:
        index = replace(index, postings=index.postings.where(inside), term_counts=index.term_counts.where(inside))
    return lookup_join(
        index.postings.select("shard", "field", "term", "id", "tf", "dl"),
        _term_weights(index, clauses),
        ["shard", "field", "term"],
        bound=clauses.n_terms * index.num_shards,
        salts=HOT_TERM_SALTS,
    )


def joined_uses(rows: DataFrame, uses: DataFrame, on: list[str], n_uses: int) -> DataFrame:
    """``rows`` once for each of the ``n_uses`` uses of their word.

    The uses of a word are broadcast as one row, which takes a fraction of the room that a row for each would; beyond the
    bound both sides are shuffled, with salt.
    """
    columns = [c for c in uses.columns if c not in on]
    if n_uses > max_broadcast_rows(USE_BYTES):
        return lookup_join(rows, uses, on, bound=n_uses, salts=HOT_TERM_SALTS)
    listed = uses.groupBy(*on).agg(F.collect_list(F.struct(*columns)).alias("_uses"))
    return rows.join(F.broadcast(listed), on).select("*", F.inline("_uses")).drop("_uses")


def _term_matches(index: Index, clauses: Clauses, bm25: Bm25) -> DataFrame:
    found = [_range_matches(index, part, bm25, inside) for part, inside in _parts(index, clauses)]
    return reduce(DataFrame.unionByName, found)


def weighed_ranges(index: Index, clauses: Clauses, bm25: Bm25) -> list[DataFrame]:
    """``shard, id, field, term, weight`` of the postings of the query vocabulary, a table per range of terms."""
    return [_weighed(index, part, bm25, inside) for part, inside in _parts(index, clauses)]


def _weighed(index: Index, clauses: Clauses, bm25: Bm25, inside: Column | None) -> DataFrame:
    weight = bm25.term_weight(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avg_dl"))
    return _weighted_postings(index, clauses, inside).select("shard", "id", "field", "term", weight.alias("weight"))


def _range_matches(index: Index, clauses: Clauses, bm25: Bm25, inside: Column | None) -> DataFrame:
    # Weighed once per posting, before the fan-out to the queries that share the term.
    weighed = _weighed(index, clauses, bm25, inside)
    single = clauses.rows.where("n_words = 1").select("query_id", "occur", "must_no", "boost", "field", "term")
    return joined_uses(weighed, single, ["field", "term"], clauses.n_rows).select(
        "query_id", "occur", "must_no", "shard", "id", (F.col("boost") * F.col("weight")).alias("score")
    )


def _phrase_matches(index: Index, clauses: Clauses, bm25: Bm25) -> DataFrame:
    if not index.positions:
        raise ValueError("phrases need an index built with positions")
    rows = clauses.rows.where("n_words > 1")
    phrases, uses = distinct_phrases(rows)
    weights = _term_weights(index, replace(clauses, rows=rows))
    words = phrases.select("phrase", "field", F.explode("words.term").alias("term"))
    weights = lookup_join(weights, words, ["field", "term"], bound=clauses.n_rows)
    weights = weights.groupBy("phrase", "shard").agg(F.sum("idf").alias("idf"), F.max("avg_dl").alias("avg_dl"))
    hits = phrase_counts(index.postings, phrases, clauses.n_terms)
    hits = lookup_join(hits, weights, ["phrase", "shard"], bound=clauses.n_rows * index.num_shards)
    weight = bm25.term_weight(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avg_dl"))
    weighed = hits.select("phrase", "shard", "id", weight.alias("weight"))
    return joined_uses(weighed, uses, ["phrase"], clauses.n_rows).select(
        "query_id", "occur", "must_no", "shard", "id", (F.col("boost") * F.col("weight")).alias("score")
    )


def score_words(index: Index, clauses: Clauses, bm25: Bm25 = Bm25()) -> DataFrame:
    """BM25 per (query, document) of a bag of words."""
    matches = _term_matches(index, clauses, bm25)
    return matches.groupBy("query_id", "shard", "id").agg(rounded(F.sum("score")).alias("bm25_score"))


def score_clauses(index: Index, clauses: Clauses, bm25: Bm25 = Bm25()) -> DataFrame:
    """BM25 per (query, document) of structured clauses.

    Required and excluded clauses are checked in the aggregation that adds up the score, so
    neither costs another join or shuffle. A required clause may match in two fields; a bit
    per clause, in as many 62-bit masks as the batch needs, counts it once.
    """
    matches = _term_matches(index, clauses, bm25)
    if clauses.has_phrases:
        matches = matches.unionByName(_phrase_matches(index, clauses, bm25))
    masks = [f"found_{mask}" for mask in range(-(-clauses.max_must // _MASK_BITS))]
    found_bits = [
        F.coalesce(
            F.bit_or(
                F.when(
                    F.floor(F.col("must_no") / _MASK_BITS) == mask,
                    F.expr(f"shiftleft(1L, must_no % {_MASK_BITS})"),
                )
            ),
            F.lit(0).cast("bigint"),
        ).alias(name)
        for mask, name in enumerate(masks)
    ]
    scored = matches.groupBy("query_id", "shard", "id").agg(
        rounded(F.sum(F.when(F.col("occur") != "must_not", F.col("score")))).alias("bm25_score"),
        F.max(F.col("occur") == "must_not").alias("is_excluded"),
        *found_bits,
    )
    wanted = scored.where("NOT is_excluded AND bm25_score IS NOT NULL")
    if masks:
        # Clauses that analyze to nothing are required too, and never found.
        required = clauses.rows.groupBy("query_id").agg(
            F.coalesce(F.max("must_no") + 1, F.lit(0)).alias("n_must")
        )
        found = sum((F.bit_count(name) for name in masks), F.lit(0))
        wanted = lookup_join(wanted, required, ["query_id"], bound=clauses.n_rows).where(found == F.col("n_must"))
    return wanted.select("query_id", "shard", "id", "bm25_score")


def top_per_shard(scored: DataFrame, requests: Requests) -> DataFrame:
    """The best ``k`` documents of every shard for every query, ties by id."""
    order = Window.partitionBy("query_id", "shard").orderBy(F.desc("bm25_score"), "id")
    # The literal bound is what lets Spark cut groups before the shuffle; k is per query.
    ranked = scored.withColumn("shard_rank", F.row_number().over(order)).where(F.col("shard_rank") <= requests.max_limit)
    wanted = requests.rows.select("query_id", "k")
    return (
        lookup_join(ranked, wanted, ["query_id"], bound=requests.n_queries)
        .where(F.col("shard_rank") <= F.col("k"))
        .drop("k")
    )


def merge_shards(shard_hits: DataFrame, requests: Requests) -> DataFrame:
    """The best ``limit`` hits over all shards; scores of different shards are compared as they are."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bm25_score"), "shard", "id")
    ranked = shard_hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= requests.max_limit)
    wanted = requests.rows.select("query_id", "limit")
    return (
        lookup_join(ranked, wanted, ["query_id"], bound=requests.n_queries)
        .where(F.col("rank") <= F.col("limit"))
        .select("query_id", "rank", "shard", "id", "bm25_score")
    )


def with_stored(hits: DataFrame, index: Index, columns: list[str], *, bound: int) -> DataFrame:
    """Add stored document fields to hits, of which there are at most ``bound``.

    Hits that fit are broadcast to the documents. Otherwise the fields of each document hit
    are fetched once, on the documents' own bucketing, and joined back with salt: a popular
    document may be a hit of very many queries.
    """
    # An id may be held by several indexes that are searched as one; with the shard it names one document.
    stored = index.docs.select("shard", "id", *columns)
    if bound <= max_broadcast_rows():
        return lookup_join(stored, hits, ["shard", "id"], bound=bound)
    # Both uses read the same rows; without this the whole scoring would run twice.
    hits = stage(hits, "hits")
    found = stored.join(hits.select("id").distinct(), "id", "left_semi")
    return lookup_join(hits, found, ["shard", "id"], bound=bound, salts=POPULAR_DOC_SALTS, salt_by="query_id")
