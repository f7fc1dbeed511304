"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.routing import shard_of
from quillrank.functions.scoring import Bm25, retrieval_limit
from quillrank.functions.text import cache_key, clean_markup
from quillrank.functions.vectors import has_vector, normalize
from quillrank.operators.analysis import build_postings
from quillrank.operators.embedding import embed_missing_titles, embed_queries, embed_texts
from quillrank.operators.fusion import fuse
from quillrank.operators.ingest import ingest_counts, kept_documents, latest_versions, pages_to_documents
from quillrank.operators.requests import check_queries, prepare, rejected_queries
from quillrank.operators.statistics import cluster_stats, field_stats, shard_stats, term_stats
from quillrank.operators.vector_columns import decode_vectors, encode_vectors
from quillrank.plans.index_store import compact, create_index, open_index, write_documents
from quillrank.plans.ingest import index_counts, index_json, ingest_dump
from quillrank.plans.search import hybrid_search, keyword_search, scored_search, shard_hits
from quillrank.session import new_folder, stage
from quillrank.sources.dumps import quarantined_pages, read_pages
from quillrank.sources.jsonl import read_documents, read_numbered_documents, write_documents as write_json
from quillrank.streaming.index_stream import stream_index
from registry import fixtures as fx
from registry.models import hashing_model
from registry.fixtures import NUM_SHARDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# The engine's rule for where a word ends.
SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Ingest


@query
def clean_body(spark, sf):
    return fx.documents(spark, sf).select("id", clean_markup(fx.marked_up("body"), 2000).alias("body"))


@query
def clean_body_full(spark, sf):
    return fx.documents(spark, sf).select("id", clean_markup(fx.marked_up("body")).alias("body"))


@query
def shard_route(spark, sf):
    docs = fx.documents(spark, sf)
    return docs.select("id", *[shard_of(F.col("id"), n).alias(f"of_{n}") for n in (1, 3, 7, 8)])


@query
def xml_pages(spark, sf):
    return read_pages(spark, fx.write_dump(spark, sf)).select("title", "raw")


@query
def page_seq(spark, sf):
    return read_pages(spark, fx.write_dump(spark, sf), max_docs=500).select("seq", "title")


@query
def min_len_filter(spark, sf):
    pages = fx.documents(spark, sf).select(F.col("doc_id").alias("seq"), "title", F.col("body").alias("raw"))
    return kept_documents(pages_to_documents(pages, max_chars=2000, min_chars=50)).select("id", "title", F.length("body").alias("n_chars"))


@query
def ingest_report(spark, sf):
    return ingest_counts(pages_to_documents(read_pages(spark, fx.write_dump(spark, sf))))


@query
def jsonl_roundtrip(spark, sf):
    out = new_folder(spark, "shards")
    ingest_dump(spark, fx.write_dump(spark, sf), out, num_shards=NUM_SHARDS, max_docs=0)
    back = spark.read.schema("id string, title string, body string, title_vector array<float>, shard int").json(out)
    return back.select("id", "title", "body", F.size("title_vector").alias("dims"), "shard")


@query
def ingest_all_pages(spark, sf):
    out = new_folder(spark, "all")
    counts = ingest_dump(spark, fx.write_dump(spark, sf), out)
    written, skipped = counts.first()
    whole = spark.read.schema("body string").json(out).agg(F.sum(F.length("body")).alias("n_chars"))
    return whole.select(F.lit(written).cast("long").alias("written"), F.lit(skipped).cast("long").alias("skipped"), "n_chars")


@query
def xml_pages_bz2(spark, sf):
    plain = spark.read.text(fx.write_dump(spark, sf))
    packed = new_folder(spark, "dump-bz2")
    plain.write.option("compression", "bzip2").text(packed)
    return read_pages(spark, packed).select("title", "raw")


@query
def xml_pages_prefixed(spark, sf):
    """All tags have a prefix, which the reader takes from the first."""
    return read_pages(spark, fx.write_dump(spark, sf, prefix="mw")).select("title", "raw")


@query
def xml_quarantine(spark, sf):
    """Pages that are not taken by reason, and what is taken of the same dump."""
    dump = fx.write_dump(spark, sf, broken=True)
    left = quarantined_pages(spark, dump).groupBy("reason")
    left = left.agg(F.count("*").alias("n_pages"), F.coalesce(F.sum(F.length("title")), F.lit(0)).alias("n_chars"))
    taken = read_pages(spark, dump, on_error="skip").agg(F.count("*").alias("n_pages"), F.sum(F.length("raw")).alias("n_chars"))
    return left.unionByName(taken.select(F.lit("taken").alias("reason"), "n_pages", "n_chars"))


@query
def jsonl_single(spark, sf):
    out = new_folder(spark, "docs")
    ingest_dump(spark, fx.write_dump(spark, sf), out, max_docs=0)
    return read_documents(spark, out).docs.select("id", "title", F.length("body").alias("n_chars"))


@query
def jsonl_quarantine(spark, sf):
    lines = read_documents(spark, fx.write_json_lines(spark, sf))
    good = lines.docs.select(F.lit("indexed").alias("reason"), F.size("title_vector").alias("dims"))
    bad = lines.rejected.select("reason", F.lit(0).alias("dims"))
    rows = good.unionByName(bad).groupBy("reason")
    return rows.agg(F.count("*").alias("n_lines"), F.sum("dims").alias("n_dims"))


@query
def index_report(spark, sf):
    return index_counts(read_documents(spark, fx.write_json_lines(spark, sf)))


@query
def doc_cap(spark, sf):
    path = fx.write_json_lines(spark, sf)
    soft = read_numbered_documents(spark, path, max_docs=150, batch_size=100).docs
    return soft.select("id", "version")


# Index


@query
def tokenize_terms(spark, sf):
    docs = fx.documents(spark, sf).withColumn("shard", shard_of(F.col("id"), NUM_SHARDS))
    return build_postings(docs.repartition("id"))


@query
def tokenize_stemmed(spark, sf):
    docs = fx.documents(spark, sf).withColumn("shard", shard_of(F.col("id"), NUM_SHARDS))
    return build_postings(docs.repartition("id"), "en_stem")


@query
def term_df(spark, sf):
    return term_stats(fx.index(spark, sf).postings).drop("total_tf")


@query
def field_stats_by_shard(spark, sf):
    index = fx.index(spark, sf)
    return field_stats(index.docs, term_stats(index.postings))


@query
def shard_doc_counts(spark, sf):
    index = fx.index(spark, sf)
    return shard_stats(index.docs, index.num_shards)


@query
def cluster_totals(spark, sf):
    index = fx.index(spark, sf)
    totals = cluster_stats(index.docs, index.num_shards)
    return totals.select("total_shards", "total_documents", F.inline("shards"))


@query
def shard_list(spark, sf):
    return fx.index(spark, sf).shards


@query
def empty_shards(spark, sf):
    """An index of more shards than most tables have documents."""
    index = fx.index(spark, sf, num_shards=3000)
    return shard_stats(index.docs, index.num_shards)


def _two_versions(spark, sf):
    first = fx.documents(spark, sf).drop("doc_id").withColumn("version", F.lit(1))
    docs = fx.documents(spark, sf).where(F.col("doc_id") % 3 == 0).drop("doc_id")
    second = docs.select(
        "id", F.concat("title", F.lit(" revised")).alias("title"), F.reverse("body").alias("body"), "title_vector"
    ).withColumn("version", F.lit(2))
    return first, second


@query
def upsert_latest(spark, sf):
    first, second = _two_versions(spark, sf)
    return latest_versions(first.unionByName(second), ["version"]).select("id", "title", "body", "version")


@query
def upsert_index_docs(spark, sf):
    first, second = _two_versions(spark, sf)
    root = new_folder(spark, "index")
    create_index(spark, root, first, fx.options(spark, sf))
    write_documents(spark, root, second)
    return open_index(spark, root).docs.select("id", "title", "body", "shard")


@query
def upsert_index_terms(spark, sf):
    first, second = _two_versions(spark, sf)
    root = new_folder(spark, "index")
    create_index(spark, root, first, fx.options(spark, sf))
    write_documents(spark, root, second)
    return open_index(spark, root).term_stats


@query
def upsert_index_fields(spark, sf):
    first, second = _two_versions(spark, sf)
    root = new_folder(spark, "index")
    create_index(spark, root, first, fx.options(spark, sf))
    write_documents(spark, root, second)
    return compact(spark, root).field_stats


@query
def upsert_repeated_ids(spark, sf):
    """Both versions in one batch and no version column: the later row of an id wins."""
    first, second = (part.drop("version") for part in _two_versions(spark, sf))
    root = new_folder(spark, "index")
    create_index(spark, root, first.unionByName(second), fx.options(spark, sf))
    return open_index(spark, root).docs.select("id", "title", "body", "shard")


@query
def upsert_many_commits(spark, sf):
    """Ten commits, each with a tenth of the documents and a part of those before."""
    docs = fx.documents(spark, sf)
    root = new_folder(spark, "index")
    for n in range(10):
        part = docs.where((F.col("doc_id") % 10 == n) | ((F.col("doc_id") % 10 < n) & (F.col("doc_id") % 7 == n % 7)))
        part = part.withColumn("title", F.concat("title", F.lit(f" v{n}"))).drop("doc_id")
        write_documents(spark, root, part, fx.options(spark, sf))
    return open_index(spark, root).term_stats


@query
def index_jsonl(spark, sf):
    index, _ = index_json(spark, fx.write_json_lines(spark, sf), new_folder(spark, "index"), fx.options(spark, sf))
    return index.docs.select("id", "shard", F.length("body").alias("n_chars"))


@query
def stream_index_terms(spark, sf):
    first, second = _two_versions(spark, sf)
    source = new_folder(spark, "stream")
    # Two sets of files, the older one first: the later line of an id wins.
    write_json(first.withColumn("indexed_at", F.lit("1")), source)
    write_json(second.withColumn("indexed_at", F.lit("2")), source, mode="append")
    root = new_folder(spark, "index")
    stream_index(spark, source, root, new_folder(spark, "progress"), fx.options(spark, sf)).awaitTermination()
    return open_index(spark, root).term_stats


# Keyword search


@query
def bm25_topk(spark, sf):
    return shard_hits(fx.index(spark, sf), prepare(fx.queries(spark, sf)))


@query
def bm25_quantized(spark, sf):
    requests = prepare(fx.queries(spark, sf))
    return shard_hits(fx.index(spark, sf), requests, bm25=Bm25(length_norm="quantized"))


@query
def bm25_repeated(spark, sf):
    return shard_hits(fx.index(spark, sf), prepare(fx.queries(spark, sf)), dedupe_terms=False)


@query
def bm25_merge(spark, sf):
    return keyword_search(fx.index(spark, sf), fx.queries(spark, sf)).hits


@query
def bm25_stemmed(spark, sf):
    return keyword_search(fx.index(spark, sf, analyzer="en_stem"), fx.queries(spark, sf)).hits


@query
def search_report(spark, sf):
    report = keyword_search(fx.index(spark, sf), fx.queries(spark, sf)).report
    return report.drop("q")


def _clauses(spark, sf, occur, field=None, boost=None):
    """A clause per word of the benchmark text; ``i`` is the word's place, ``n`` their number."""
    words = F.filter(F.split("text", SPLIT), lambda w: w != "")
    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("words"))
    placed = items.select("query_id", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    return placed.select(
        "query_id",
        F.col("i").alias("clause_id"),
        F.array("word").alias("terms"),
        (F.lit(None).cast("string") if field is None else field).alias("field"),
        occur.alias("occur"),
        (F.lit(1.0) if boost is None else boost).alias("boost"),
    )


def _clause_hits(spark, sf, clauses, **index_options):
    index = fx.index(spark, sf, **index_options)
    return shard_hits(index, prepare(fx.queries(spark, sf)), clauses=clauses)


@query
def bool_must(spark, sf):
    occur = F.when(F.col("i") < 2, F.lit("must")).otherwise(F.lit("should"))
    return _clause_hits(spark, sf, _clauses(spark, sf, occur))


@query
def bool_must_not(spark, sf):
    occur = F.when(F.col("i") == F.col("n") - 1, F.lit("must_not")).otherwise(F.lit("should"))
    return _clause_hits(spark, sf, _clauses(spark, sf, occur))


@query
def field_scoped(spark, sf):
    field = F.when(F.col("i") < 3, F.lit("title")).otherwise(F.lit("body"))
    return _clause_hits(spark, sf, _clauses(spark, sf, F.lit("should"), field))


@query
def boosted(spark, sf):
    boost = F.when(F.col("i") % 2 == 0, F.lit(2.5)).otherwise(F.lit(1.0))
    return _clause_hits(spark, sf, _clauses(spark, sf, F.lit("should"), boost=boost))


@query
def phrase_match(spark, sf):
    words = F.filter(F.split("text", SPLIT), lambda w: w != "")
    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("words"))
    whole = items.select("query_id", F.lit(0).alias("clause_id"), F.col("words").alias("terms"))
    places = F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1)))
    pairs = items.select("query_id", "words", F.explode(places).alias("clause_id"))
    pairs = pairs.select("query_id", "clause_id", F.slice("words", F.col("clause_id"), 2).alias("terms"))
    clauses = whole.unionByName(pairs).select(
        "*", F.lit(None).cast("string").alias("field"), F.lit("should").alias("occur"), F.lit(1.0).alias("boost")
    )
    return _clause_hits(spark, sf, clauses, positions=True)


@query
def phrase_gap(spark, sf):
    """Phrases over a word too long to be indexed: each document's words around such a word."""
    docs = fx.table(spark, sf, "documents")
    words = F.filter(F.split("text", SPLIT), lambda w: w != "")
    long = docs.select("doc_id", "text", F.posexplode(words).alias("at", "word"), words.alias("words"))
    long = long.where((F.octet_length("word") >= 40) & (F.col("at") > 0) & (F.col("at") < F.size("words") - 1))
    first = long.groupBy("doc_id").agg(F.min_by("words", "at").alias("words"), F.min("at").alias("at"))
    clauses = first.select(
        F.col("doc_id").alias("query_id"),
        F.lit(0).alias("clause_id"),
        F.slice("words", F.col("at"), 3).alias("terms"),
        F.lit("body").alias("field"),
        F.lit("should").alias("occur"),
        F.lit(1.0).alias("boost"),
    )
    requests = prepare(clauses.select("query_id", F.array_join("terms", " ").alias("q")))
    return shard_hits(fx.index(spark, sf, positions=True), requests, clauses=clauses)


# Semantic and hybrid search


@query
def vector_normalize(spark, sf):
    unit = fx.table(spark, sf, "embeddings").select("vec_id", F.posexplode(normalize(F.col("embedding"))).alias("pos", "x"))
    return unit.select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


@query
def vector_codec(spark, sf):
    rows = encode_vectors(fx.table(spark, sf, "embeddings"), "embedding", "raw_bytes")
    is_json = F.col("label") % 2 == 0
    stored = rows.select(
        "vec_id",
        F.when(is_json, F.lit("json")).otherwise(F.lit("float32")).alias("kind"),
        F.when(is_json, F.to_json("embedding").cast("binary")).otherwise(F.col("raw_bytes")).alias("raw"),
    )
    decoded = decode_vectors(stored, "raw", F.col("kind"), "vector")
    return decoded.select("vec_id", F.posexplode("vector").alias("pos", "x"))


@query
def candidate_cosine(spark, sf):
    requests = prepare(fx.queries(spark, sf), widen=True)
    return scored_search(fx.index(spark, sf), requests).drop("title")


@query
def hybrid_rrf(spark, sf):
    return hybrid_search(fx.index(spark, sf), fx.queries(spark, sf)).hits


@query
def hybrid_weighted(spark, sf):
    queries = fx.queries(spark, sf).withColumn("fusion", F.lit("weighted")).withColumn("alpha", F.lit(0.3))
    return hybrid_search(fx.index(spark, sf), queries).hits


@query
def hybrid_stemmed(spark, sf):
    return hybrid_search(fx.index(spark, sf, analyzer="en_stem"), fx.queries(spark, sf)).hits


def _two_roots(spark, sf):
    """An index of the documents with even numbers and one of the others, opened as one."""
    docs, roots = fx.documents(spark, sf), []
    for rest in (0, 1):
        roots.append(new_folder(spark, "index"))
        create_index(spark, roots[-1], docs.where(F.col("doc_id") % 2 == rest).drop("doc_id"), fx.options(spark, sf))
    return open_index(spark, *roots)


@query
def hybrid_two_roots(spark, sf):
    return hybrid_search(_two_roots(spark, sf), fx.queries(spark, sf)).hits


@query
def cluster_totals_two_roots(spark, sf):
    index = _two_roots(spark, sf)
    totals = cluster_stats(index.docs, index.num_shards)
    return totals.select("total_shards", "total_documents", F.inline("shards"))


def _mixed_queries(spark, sf):
    """Every third query has no vector, every fourth asks for the weighted sum, limits differ."""
    n = F.col("query_id")
    return fx.queries(spark, sf).select(
        "query_id",
        "q",
        F.when(n % 3 != 0, F.col("query_vector")).alias("query_vector"),
        (n % 30 + 1).cast("int").alias("limit"),
        (n % 5 / 4).alias("alpha"),
        F.when(n % 4 == 0, F.lit("weighted")).otherwise(F.lit("rrf")).alias("fusion"),
    )


@query
def hybrid_fallback(spark, sf):
    return hybrid_search(fx.index(spark, sf), _mixed_queries(spark, sf)).hits


@query
def hybrid_report(spark, sf):
    return hybrid_search(fx.index(spark, sf), _mixed_queries(spark, sf)).report.drop("q")


@query
def fuse_defaults(spark, sf):
    """A pool of plain keyword scores: no vectors, titles or shards."""
    pool = keyword_search(fx.index(spark, sf), fx.queries(spark, sf)).hits.select("query_id", "id", "score")
    return fuse(pool, prepare(fx.queries(spark, sf).drop("query_vector")))


@query
def validate_queries(spark, sf):
    n = F.col("query_id")
    odd = fx.queries(spark, sf).select(
        "query_id",
        F.when(n % 7 == 1, F.lit("")).when(n % 7 == 2, F.lit(None)).otherwise(F.col("q")).alias("q"),
        F.when(n % 7 == 3, F.lit(0)).when(n % 7 == 4, F.lit(1001)).alias("limit"),
        F.when(n % 7 == 5, F.lit(1.5)).alias("alpha"),
        F.when(n % 7 == 6, F.lit("sum")).alias("fusion"),
    )
    kept = check_queries(odd).where("reason IS NULL").select("query_id", F.lit("ok").alias("reason"), "limit", "alpha", "fusion")
    return kept.unionByName(rejected_queries(odd), allowMissingColumns=True)


@query
def validate_query_ids(spark, sf):
    """Every fifth id is missing, and every seventh query comes twice."""
    queries = fx.queries(spark, sf).select("query_id", "q")
    n = F.col("query_id")
    odd = queries.select(F.when(n % 5 != 0, n).alias("query_id"), "q").unionByName(queries.where(n % 7 == 1))
    counts = check_queries(odd).groupBy("query_id", F.coalesce("reason", F.lit("ok")).alias("reason"))
    return counts.agg(F.count("*").alias("n_rows"))


@query
def limits_widened(spark, sf):
    n = F.col("item_id").cast("int")
    limits = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (n * 7 + 1).alias("limit"))
    return limits.withColumn("retrieval_limit", retrieval_limit(F.col("limit")))


# Embedding


def _nonzero(rows, key, vector):
    return rows.select(key, F.posexplode(vector).alias("pos", "x")).where("x <> 0").select(
        key, "pos", F.round(F.col("x").cast("double"), 6).alias("x")
    )


@query
def embed_titles(spark, sf):
    docs = fx.documents(spark, sf).select("id", "title")
    rows = embed_texts(docs, "title", hashing_model(), into="title_vector", salt_by="id")
    return _nonzero(rows, "id", "title_vector")


@query
def embed_missing(spark, sf):
    docs = fx.documents(spark, sf).select("id", "title", "title_vector")
    return _nonzero(embed_missing_titles(docs, hashing_model()), "id", "title_vector")


@query
def embed_query_texts(spark, sf):
    rows = embed_queries(fx.queries(spark, sf), hashing_model())
    return _nonzero(rows, "query_id", "query_vector")


@query
def embed_dedup(spark, sf):
    docs = fx.documents(spark, sf)
    other = docs.select(F.concat("id", F.lit("b")).alias("id"), F.concat(F.lit("  "), F.lower("title")).alias("title"))
    both = docs.select("id", "title").unionByName(other)
    rows = embed_texts(both, "title", hashing_model(), into="v", salt_by="id")
    keyed = rows.groupBy(cache_key(F.col("title")).alias("text_key"))
    return keyed.agg(F.count("*").alias("n_texts"), F.count_distinct("v").alias("n_vectors"))
