import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.functions.scoring import Bm25, quantized_length, retrieval_limit
from quillrank.functions.vectors import cosine, normalize
from quillrank.operators import blocks, embedding, phrases
from quillrank.operators.embedding import embed_missing_titles, embed_queries, embed_texts
from quillrank.operators.fusion import fuse
from quillrank.operators.pruning import pays, pruned_scores
from quillrank.operators.requests import Requests, prepare, rejected_queries
from quillrank.operators.retrieval import bag_of_words, score_words, structured, top_per_shard
from quillrank.operators.vector_columns import check_dimension, decode_vectors, encode_vectors
from quillrank.plans.index_store import IndexOptions, build_index
from quillrank.plans.search import hybrid_search, keyword_search, scored_search, shard_hits
from registry.models import hashing_model
from tests.brute import bm25, shard_of, stored_length

SHARDS = 3
DOC = "id string, title string, body string, title_vector array<float>"
ASK = "query_id long, q string, query_vector array<float>, limit int, alpha double, fusion string"
CLAUSE = "query_id long, clause_id int, terms array<string>, field string, occur string, boost double"

_words = random.Random(5)
VOCABULARY = ["red", "green", "blue", "running", "runner", "runs", "cat", "cats", "the", "of", "tree", "trees"]
# "the" is in every document, copies give equal scores, lengths pass the exact range.
DOCS = [
    (
        f"d{n}",
        "The " + " ".join(_words.choices(VOCABULARY, k=n % 4)),
        " ".join(["the", *_words.choices(VOCABULARY, k=(n * 7) % 90)]),
        None if n % 4 == 0 else [float(n % 5), 1.0, float(n % 3)],
    )
    for n in range(60)
]
DOCS += [(f"copy{n}", *DOCS[n][1:]) for n in range(10)] + [("empty", "", "", [])]
QUERIES = [(1, "the red cat"), (2, "running trees"), (3, "red RED red"), (4, "absent"), (5, "tree of blue green")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, DOC)


@pytest.fixture(scope="module")
def index(spark, docs):
    return build_index(docs, IndexOptions(num_shards=SHARDS, positions=True, analyzer="simple"))


def ask(spark, rows):
    filled = [(*r, *[None] * (6 - len(r))) for r in rows]
    return spark.createDataFrame(filled, ASK)


def by_shard(hits):
    found = {}
    for r in hits.orderBy("query_id", "shard", "shard_rank").collect():
        found.setdefault((r.query_id, r.shard), []).append((-r.bm25_score, r.id))
    return found


@pytest.mark.parametrize("analyzer,length_norm,dedupe", [("simple", "exact", True), ("en_stem", "quantized", False)])
def test_bm25_equals_brute_force(spark, docs, analyzer, length_norm, dedupe):
    built = build_index(docs, IndexOptions(num_shards=SHARDS, analyzer=analyzer))
    queries = ask(spark, [(n, q, None, 7) for n, q in QUERIES])
    hits = shard_hits(built, prepare(queries), bm25=Bm25(length_norm=length_norm), dedupe_terms=dedupe)
    expected = bm25([d[:3] for d in DOCS], QUERIES, SHARDS, analyzer, length_norm == "quantized", dedupe)
    assert by_shard(hits) == {key: found[:7] for key, found in expected.items()}


def test_keyword_search(spark, index):
    result = keyword_search(index, ask(spark, [(n, q, None, 5) for n, q in QUERIES]))
    expected = bm25([d[:3] for d in DOCS], QUERIES, SHARDS)
    for n, _ in QUERIES:
        pool = [(s, shard, i) for (q, shard), found in expected.items() if q == n for s, i in found[:5]]
        hits = result.hits.where(F.col("query_id") == n).orderBy("rank").collect()
        assert [(-h.score, h.shard, h.id) for h in hits] == sorted(pool)[:5]
    titles = {d[0]: d[1] for d in DOCS}
    assert all(titles[h.id] == h.title for h in result.hits.collect())
    report = {r.query_id: r for r in result.report.collect()}
    assert (report[4].total_hits, report[4].keyword_hits, report[4].shards_responded) == (0, 0, 0)
    assert (report[1].total_hits, report[1].keyword_hits, report[1].shards_queried) == (5, 15, SHARDS)


def test_quantized_length(spark):
    lengths = [*range(300), 1000, 4096, 123_456]
    found = spark.createDataFrame([(n,) for n in lengths], "n int").select("n", quantized_length(F.col("n")).alias("q"))
    assert {r.n: r.q for r in found.collect()} == {n: stored_length(n) for n in lengths}


def clause_ids(spark, index, clauses, query_ids=(1,)):
    queries = ask(spark, [(n, "any", None, 1000) for n in query_ids])
    hits = shard_hits(index, prepare(queries), clauses=spark.createDataFrame(clauses, CLAUSE))
    return {r.id for r in hits.collect()}


def holding(*wanted, field=None, none=()):
    found = set()
    for doc_id, title, body, _ in DOCS:
        text = {"title": title.lower().split(), "body": body.lower().split()}
        have = set(text[field] if field else text["title"] + text["body"])
        if all(w in have for w in wanted) and not any(w in have for w in none):
            found.add(doc_id)
    return found


def test_required_and_excluded(spark, index):
    must = [(1, 1, ["red"], None, "must", 1.0), (1, 2, ["cat"], None, "must", 1.0), (1, 3, ["the"], None, "should", 1.0)]
    assert clause_ids(spark, index, must) == holding("red", "cat")
    assert clause_ids(spark, index, must + [(1, 4, ["blue"], None, "must_not", 1.0)]) == holding("red", "cat", none=["blue"])
    assert clause_ids(spark, index, must + [(1, 5, ["absent"], None, "must", 1.0)]) == set()
    assert clause_ids(spark, index, must + [(1, 5, ["--"], None, "must", 1.0)]) == set()
    assert clause_ids(spark, index, [(1, 1, ["blue"], None, "must_not", 1.0)]) == set()
    assert clause_ids(spark, index, [(1, 1, ["red"], "title", None, None)]) == holding("red", field="title")


def test_more_required_clauses_than_bits_in_a_mask(spark, docs):
    many = [f"w{n}" for n in range(130)]
    rows = [("all", "", " ".join(many), None), ("most", "", " ".join(many[:-1]), None)]
    built = build_index(spark.createDataFrame(rows, DOC), IndexOptions(num_shards=1))
    clauses = [(1, n, [w], None, "must", 1.0) for n, w in enumerate(many)]
    assert clause_ids(spark, built, clauses) == {"all"}
    assert clause_ids(spark, built, clauses[:-1]) == {"all", "most"}


def test_phrases(spark, index):
    def with_phrase(phrase):
        return {d[0] for d in DOCS if any(f" {phrase} " in f" {text.lower()} " for text in d[1:3])}

    for phrase in ("red cat", "the the", "tree of blue", "runs"):
        assert clause_ids(spark, index, [(1, 1, phrase.split(), None, "must", 1.0)]) == with_phrase(phrase)
    rows = [("gap", "", "one " + "x" * 40 + " two", None), ("near", "", "one two", None)]
    built = build_index(spark.createDataFrame(rows, DOC), IndexOptions(num_shards=1, positions=True))
    assert clause_ids(spark, built, [(1, 1, ["one", "two"], None, "must", 1.0)]) == {"near"}
    without = build_index(spark.createDataFrame(rows, DOC), IndexOptions(num_shards=1))
    with pytest.raises(ValueError):
        clause_ids(spark, without, [(1, 1, ["one", "two"], None, "must", 1.0)])


def test_boost_scales_the_score(spark, index):
    requests = prepare(ask(spark, [(1, "x", None, 1000), (2, "x", None, 1000)]))
    clauses = [(1, 1, ["red"], None, "should", 1.0), (2, 1, ["red"], None, "should", 3.0)]
    hits = shard_hits(index, requests, clauses=spark.createDataFrame(clauses, CLAUSE)).collect()
    one, three = ({h.id: h.bm25_score for h in hits if h.query_id == n} for n in (1, 2))
    assert one.keys() == three.keys() and all(abs(three[i] - 3 * one[i]) < 1e-5 for i in one)


def test_scored_search_only_rescores_keyword_hits(spark, index):
    vector = [1.0, 2.0, 0.5]
    requests = prepare(ask(spark, [(1, "red", vector, 4), (2, "red", [0.0, 0.0, 0.0], 4), (3, "red", None, 4)]), widen=True)
    assert requests.max_limit == 8
    pool = scored_search(index, requests).collect()
    keyword = {(h.query_id, h.id) for h in shard_hits(index, requests).collect()}
    assert {(h.query_id, h.id) for h in pool} == keyword
    stored = {d[0]: d[3] for d in DOCS}
    for h in pool:
        expected = 0.0
        if h.query_id == 1 and stored[h.id]:
            a, b = np.array(vector), np.array(stored[h.id])
            expected = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
        assert h.semantic_score == pytest.approx(expected, abs=1e-6)


POOL = [
    # id, shard, bm25, semantic
    ("a", 0, 3.0, 0.1),
    ("b", 0, 2.0, 0.9),
    ("c", 1, 3.0, 0.0),
    ("d", 1, 1.0, 0.9),
    ("e", 2, 0.5, 0.0),
]


def fused(spark, queries, pool=POOL):
    rows = [(q[0], i, s, b, v, i.upper()) for q in queries for i, s, b, v in pool]
    candidates = spark.createDataFrame(rows, "query_id long, id string, shard int, bm25_score double, semantic_score double, title string")
    requests = prepare(ask(spark, queries), widen=True)
    hits = fuse(candidates, requests).orderBy("query_id", "rank").collect()
    return {q[0]: [(h.id, h.hybrid_score) for h in hits if h.query_id == q[0]] for q in queries}


def test_fusion_by_rank(spark):
    # Keyword ranks a1 c2 b3 d4 e5; semantic ranks b1 d2 a3 c4 e5.
    score = {i: round(1 / (60 + k) + 1 / (60 + s), 9) for i, k, s in [("a", 1, 3), ("b", 3, 1), ("c", 2, 4), ("d", 4, 2), ("e", 5, 5)]}
    found = fused(spark, [(1, "q", [1.0], 20, 0.5, "rrf"), (2, "q", [1.0], 3, 0.5, "rrf")])
    # a and b tie, as do c and d: the better semantic rank goes first.
    order = ["b", "a", "d", "c", "e"]
    assert found[1] == [(i, score[i]) for i in order]
    assert found[2] == found[1][:3]


def test_fusion_by_weight(spark):
    queries = [(1, "q", [1.0], 20, 1.0, "weighted"), (2, "q", [1.0], 20, 0.0, "weighted"), (3, "q", [1.0], 20, 0.5, "weighted")]
    found = fused(spark, queries)
    assert [i for i, _ in found[1]] == ["a", "c", "b", "d", "e"]
    assert [i for i, _ in found[2]] == ["b", "d", "a", "c", "e"]
    assert dict(found[3]) == pytest.approx({"a": 1.55, "b": 1.45, "c": 1.5, "d": 0.95, "e": 0.25})


def test_rank_fusion_needs_a_query_vector(spark):
    found = fused(spark, [(1, "q", None, 20, 0.5, "rrf"), (2, "q", [], 20, 0.5, None), (3, "q", [1.0], 20, 0.5, "weighted")])
    assert found[1] == found[2] == found[3]


def test_fusion_of_an_empty_pool(spark):
    candidates = spark.createDataFrame([], "query_id long, id string, shard int, bm25_score double, semantic_score double, title string")
    assert fuse(candidates, prepare(ask(spark, [(1, "q", [1.0])]))).collect() == []


def test_hybrid_search_stays_within_the_keyword_pool(spark, index):
    queries = ask(spark, [(1, "red cat", [1.0, 0.0, 1.0], 5), (2, "absent", [1.0, 0.0, 1.0], 5)])
    result = hybrid_search(index, queries)
    pool = {(r.query_id, r.id) for r in result.pool.collect()}
    hits = result.hits.collect()
    assert len(hits) == 5 and {(h.query_id, h.id) for h in hits} <= pool
    report = {r.query_id: r for r in result.report.collect()}
    assert (report[1].fusion_method, report[1].fusion_alpha, report[1].keyword_hits) == ("rrf", None, 30)
    assert (report[2].total_hits, report[2].keyword_hits) == (0, 0)


def test_validation(spark):
    rows = [
        (1, "ok"), (2, ""), (3, None), (4, "q", None, 0), (5, "q", None, 1001), (6, "q", None, 1000),
        (7, "q", None, 5, -0.1), (8, "q", None, 5, float("nan")), (9, "q", None, 5, 1.0, "sum"),
    ]
    reasons = {r.query_id: r.reason for r in rejected_queries(ask(spark, rows)).collect()}
    assert reasons == {
        2: "q missing", 3: "q missing", 4: "limit out of range", 5: "limit out of range",
        7: "alpha out of range", 8: "alpha out of range", 9: "unknown fusion",
    }
    kept = prepare(ask(spark, rows))
    assert isinstance(kept, Requests) and (kept.n_queries, kept.max_limit) == (2, 1000)
    first = kept.rows.where("query_id = 1").first()
    assert (first.limit, first.alpha, first.fusion) == (20, 0.5, "rrf")


def test_retrieval_limit(spark):
    found = spark.createDataFrame([(20,), (100,), (150,), (300,), (1,)], "n int").select("n", retrieval_limit(F.col("n")).alias("k"))
    assert {r.n: r.k for r in found.collect()} == {20: 40, 100: 200, 150: 200, 300: 300, 1: 2}


def test_vectors(spark):
    rows = [
        (1, [1.0, 0.0], [2.0, 0.0]), (2, [1.0, 0.0], [0.0, 3.0]), (3, [1.0, 1.0], [-1.0, -1.0]),
        (4, [0.0, 0.0], [1.0, 0.0]), (5, None, [1.0, 0.0]), (6, [1.0], [1.0, 0.0]), (7, [], []),
    ]
    df = spark.createDataFrame(rows, "n int, a array<float>, b array<float>")
    found = {r.n: r.c for r in df.select("n", cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    assert found == {1: 1.0, 2: 0.0, 3: pytest.approx(-1.0), 4: None, 5: None, 6: None, 7: None}
    unit = {r.n: r.u for r in df.select("n", normalize(F.col("a")).alias("u")).collect()}
    assert unit[3] == pytest.approx([0.5**0.5] * 2) and unit[4] is None and unit[5] is None and unit[7] is None
    with pytest.raises(Exception, match="expected 2 values, got 1"):
        check_dimension(df, 2, "a").collect()
    assert check_dimension(df, 2, "b").count() == 7


def test_vector_decoding(spark):
    # The second float's first byte in storage is that of '['.
    bracket = np.frombuffer(b"[abc", dtype="<f4")[0].item()
    df = spark.createDataFrame([(1, [1.5, -2.0]), (2, [bracket, 1.0]), (3, []), (4, None)], "n int, v array<float>")
    raw = encode_vectors(df, "v", "raw").withColumn("kind", F.lit("float32"))
    text = spark.createDataFrame([(5, b"[0.5, 2]"), (6, b"{oops"), (7, b"")], "n int, raw binary").withColumn("kind", F.lit("json"))
    odd = spark.createDataFrame([(8, b"abc")], "n int, raw binary").withColumn("kind", F.lit("float32"))
    stored = raw.select("n", "raw", "kind").unionByName(text).unionByName(odd)
    found = {r.n: r.out for r in decode_vectors(stored, "raw", F.col("kind"), "out").collect()}
    assert found == {1: [1.5, -2.0], 2: [bracket, 1.0], 3: None, 4: None, 5: [0.5, 2.0], 6: None, 7: None, 8: None}


def test_embedding(spark):
    rows = [("a", "Red Cat", None), ("b", " red cat ", []), ("c", "blue", [9.0]), ("d", None, None)]
    docs = spark.createDataFrame(rows, "id string, title string, title_vector array<float>")
    found = {r.id: r.title_vector for r in embed_missing_titles(docs, hashing_model(4)).collect()}
    assert found["a"] == found["b"] and sum(found["a"]) == 2 and found["c"] == [9.0] and sum(found["d"]) == 0
    queries = spark.createDataFrame([(1, "red cat")], "query_id long, q string")
    assert embed_queries(queries, hashing_model(4)).first().query_vector == found["a"]


def test_failing_model_leaves_documents_without_vectors(spark):
    def make():
        def embed(texts):
            raise RuntimeError("no model")

        return embed

    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, title string")
    found = embed_texts(docs, "title", make, into="v", salt_by="id").collect()
    assert {r.id: r.v for r in found} == {"a": [], "b": []}


def test_documents_are_spread_as_expected(index):
    found = {r.id: r.shard for r in index.docs.select("id", "shard").collect()}
    assert found == {d[0]: shard_of(d[0], SHARDS) for d in DOCS}


def test_pruned_scores_have_the_same_best(spark, docs, index, monkeypatch):
    """Thresholds from any number of probed documents, limits below and above what a shard has, repeated words."""
    asked = [(n, q, None, limit) for n, (q, limit) in enumerate([(q, k) for _, q in QUERIES for k in (1, 2, 5, 60)])]
    requests = prepare(ask(spark, asked))
    for built, dedupe, probe, norm in [(index, True, 1, "exact"), (index, False, 32, "quantized")]:
        monkeypatch.setattr("quillrank.operators.pruning.PROBE", probe)
        bag = bag_of_words(built, requests, dedupe_terms=dedupe)
        bm25_model = Bm25(length_norm=norm)
        pruned = pruned_scores(built, bag, requests, bm25_model)
        assert by_shard(top_per_shard(pruned.scores, requests)) == by_shard(top_per_shard(score_words(built, bag, bm25_model), requests))


def test_pruning_leaves_common_words_to_candidates(spark):
    """Words in every document cannot lift one into the hits of a rare word."""
    rows = [(f"d{n}", "", "common words " + ("rare " * 3 if n % 50 == 0 else "") + "filler " * (n % 7), None) for n in range(400)]
    built = build_index(spark.createDataFrame(rows, DOC), IndexOptions(num_shards=1, analyzer="simple"))
    requests = prepare(ask(spark, [(1, "common rare words", None, 3)]))
    bag = bag_of_words(built, requests)
    assert not pays(built, bag, requests)
    pruned = pruned_scores(built, bag, requests)
    assert pruned.candidates.count() <= 8 < score_words(built, bag).count() == 400
    assert by_shard(top_per_shard(pruned.scores, requests)) == by_shard(top_per_shard(score_words(built, bag), requests))


def test_parts_of_similar_limits(spark, docs, index):
    def parts(limits):
        requests = prepare(ask(spark, [(n, "the", None, k) for n, k in enumerate(limits)]))
        found = requests.by_limit()
        assert sum(p.n_queries for p in found) == len(limits)
        assert sum(p.rows.count() for p in found) == len(limits)
        assert sum(p.n_queries * p.max_limit for p in found) <= 2 * sum(limits)
        return [(p.n_queries, p.max_limit) for p in found]

    assert parts([20] * 5) == [(5, 20)]
    assert parts(range(1, 31)) == [(30, 30)]
    assert parts([1000, 1, 2, 3, 3, 2, 1]) == [(1, 1000), (6, 3)]
    queries = ask(spark, [(1, "the red cat", None, 1000), (2, "the red cat", None, 2), (3, "the cats", None, 1)])
    expected = bm25([d[:3] for d in DOCS], [(1, "the red cat"), (2, "the red cat"), (3, "the cats")], SHARDS)
    limits = {1: 1000, 2: 2, 3: 1}
    assert by_shard(shard_hits(index, prepare(queries))) == {key: found[: limits[key[0]]] for key, found in expected.items()}


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_blocks_have_the_same_best(spark, monkeypatch, block):
    """Equal documents in number, so that ties by id matter, and queries whose words repeat."""
    monkeypatch.setattr(blocks, "BLOCK_NUMBERS", block)
    some = [(f"d{i}", "red cat" if i % 3 else "blue tree", "the cat sat " * (i % 4), None) for i in range(60)]
    built = build_index(spark.createDataFrame(some, DOC), IndexOptions(num_shards=SHARDS, analyzer="simple"))
    queries = spark.createDataFrame([(7, "the cat the tree"), (3, "red"), (5, "nothing here"), (4, "blue blue sat")], "query_id long, q string")
    requests = prepare(queries.withColumn("limit", F.lit(4)))
    for dedupe in (True, False):
        bag = bag_of_words(built, requests, dedupe_terms=dedupe)
        assert blocks.fits_blocks(built, bag, requests)
        expected = by_shard(top_per_shard(score_words(built, bag), requests))
        assert by_shard(top_per_shard(blocks.best_scores(built, bag, requests), requests)) == expected and expected


def test_blocks_take_optional_words_alone(spark, index):
    requests = prepare(spark.createDataFrame([(1, "cat")], "query_id long, q string"))

    def fits(*clauses):
        return blocks.fits_blocks(index, structured(index, spark.createDataFrame(clauses, CLAUSE)), requests)

    assert fits((1, 1, ["cat"], None, "should", 2.5), (1, 2, ["tree"], "body", "should", 1.0))
    for other in ((["cat"], "must", 1.0), (["cat"], "must_not", 1.0), (["red", "cat"], "should", 1.0), (["cat"], "should", 0.0)):
        assert not fits((1, 1, ["tree"], None, "should", 1.0), (1, 2, other[0], None, *other[1:]))


def test_only_texts_of_many_rows_are_salted(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i}" if i % 4 else "Hot") for i in range(4000)], "id long, title string")
    usual = {r.id: r.v for r in embed_texts(rows, "title", hashing_model(), into="v", salt_by="id").collect()}
    monkeypatch.setattr("quillrank.operators.joins.MAX_BROADCAST_BYTES", 0)
    dealt = []
    salted = embedding._salted
    monkeypatch.setattr(embedding, "_salted", lambda vectors: dealt.append(salted(vectors)) or dealt[0])
    assert {r.id: r.v for r in embed_texts(rows, "title", hashing_model(), into="v", salt_by="id").collect()} == usual
    assert [r._key for r in dealt[0][0].collect()] == ["hot"] and dealt[0][1].count() == 3000 + 64


@pytest.mark.parametrize("places,words", [(1, 1), (1 << 20, 1 << 20)])
def test_phrase_counts(spark, monkeypatch, places, words):
    """Phrases that overlap themselves, share their first words, have a gap, or are asked for by several queries."""
    monkeypatch.setattr(phrases, "BLOCK_PLACES", places)
    monkeypatch.setattr(phrases, "MAX_WORDS", words)
    texts = ["a a a a b", "a b c a b d", "c a xx b a b c", "b a", "a b c", "", "d"]
    built = build_index(spark.createDataFrame([(f"d{i}", "", t, None) for i, t in enumerate(texts)], DOC), IndexOptions(num_shards=SHARDS, analyzer="simple", positions=True))
    asked = [["a", "a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c"], ["a", "w" * 50, "b"], ["c", "a", "b", "d"], ["b", "zz"]]
    clauses = structured(built, spark.createDataFrame([(i, 0, t, "body", "should", 1.0) for i, t in enumerate(asked)], CLAUSE))
    known, uses = phrases.distinct_phrases(clauses.rows.where("n_words > 1"))
    found = phrases.phrase_counts(built.postings, known, clauses.n_terms).join(uses, "phrase").select("query_id", "id", "tf").collect()
    expected = {}
    for q, phrase in enumerate(asked):
        for i, text in enumerate(texts):
            held = text.split()
            runs = [held[n : n + len(phrase)] for n in range(len(held) - len(phrase) + 1)]
            if tf := sum(all(len(p) >= 40 or p == w for p, w in zip(phrase, run, strict=True)) for run in runs):
                expected[q, f"d{i}"] = tf
    assert {(r.query_id, r.id): r.tf for r in found} == expected and len(found) == len(expected)
