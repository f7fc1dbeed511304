import json
import shutil
from dataclasses import replace
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import quillrank.plans.index_store as store

from quillrank.operators import retrieval
from quillrank.operators.requests import prepare
from quillrank.operators.statistics import cluster_stats
from quillrank.operators.retrieval import bag_of_words, score_words, top_per_shard
from quillrank.plans.index_store import (
    IndexOptions,
    build_index,
    compact,
    create_index,
    open_index,
    vacuum,
    write_documents,
)
from quillrank.plans.search import hybrid_search, scored_search
from quillrank.streaming.index_stream import stream_index

STEMMED = IndexOptions(num_shards=3, num_buckets=4, positions=True)
OPTIONS = replace(STEMMED, analyzer="simple")


def documents(spark, numbers, mark=""):
    rows = [(f"d{n}", f"Title {n} {mark}", f"common word{n % 7} body{n} {mark}") for n in numbers]
    return spark.createDataFrame(rows, "id string, title string, body string")


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def assert_same(found, expected):
    assert rows(found.docs.drop("indexed_at", "title_vector")) == rows(expected.docs.drop("indexed_at", "title_vector"))
    columns = expected.postings.columns
    assert rows(found.postings.select(*columns)) == rows(expected.postings)
    assert rows(found.term_stats) == rows(expected.term_stats)
    assert rows(found.field_stats) == rows(expected.field_stats)


def exchanges(df):
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    return [line.strip(" :+-") for line in text.splitlines() if "Exchange hashpartitioning" in line], text


def test_rewritten_documents_equal_a_fresh_index(spark, folder):
    root = folder("index")
    create_index(spark, root, documents(spark, range(40)), STEMMED)
    before = open_index(spark, root)
    write_documents(spark, root, documents(spark, range(10, 20), "second"))
    after = write_documents(spark, root, documents(spark, range(15, 50), "third"))
    newest = documents(spark, range(10)).unionByName(documents(spark, range(10, 15), "second"))
    newest = newest.unionByName(documents(spark, range(15, 50), "third"))
    expected = build_index(newest, STEMMED)
    assert_same(after, expected)
    assert_same(open_index(spark, root), expected)
    # A reader that opened the index earlier keeps what it saw.
    assert_same(before, build_index(documents(spark, range(40)), STEMMED))
    assert_same(compact(spark, root), expected)
    with pytest.raises(ValueError):
        create_index(spark, root, documents(spark, range(3)), STEMMED)


def test_last_version_in_a_batch_wins(spark, folder):
    docs = documents(spark, range(5), "old").withColumn("version", F.lit(1))
    docs = docs.unionByName(documents(spark, range(3), "new").withColumn("version", F.lit(2)))
    found = create_index(spark, folder("index"), docs, OPTIONS)
    expected = documents(spark, range(3), "new").unionByName(documents(spark, range(3, 5), "old"))
    assert_same(found, build_index(expected, OPTIONS))


def test_same_documents_again_change_nothing(spark, folder):
    docs = documents(spark, range(12))
    create_index(spark, folder("index"), docs, OPTIONS)
    assert_same(write_documents(spark, folder("index"), docs), build_index(docs, OPTIONS))


def test_segments_are_merged_by_size(spark, folder, monkeypatch):
    monkeypatch.setattr("quillrank.plans.index_store.SMALL_SEGMENT", 10)
    written = []
    real = store._Segment.write_docs
    monkeypatch.setattr(store._Segment, "write_docs", lambda self, session, docs, **o: written.append(self.folder) or real(self, session, docs, **o))
    root = folder("index")
    options = IndexOptions(num_shards=2, num_buckets=2, analyzer="simple")
    big = documents(spark, range(60), "big")
    index = write_documents(spark, root, big, options)
    expected = {n: "big" for n in range(60)}
    for n in range(9):
        index = write_documents(spark, root, documents(spark, [n, 100 + n], f"v{n}"), options)
        expected.update({n: f"v{n}", 100 + n: f"v{n}"})
    by_mark = {mark: [n for n, m in expected.items() if m == mark] for mark in expected.values()}
    rows_of = [documents(spark, numbers, mark) for mark, numbers in by_mark.items()]
    assert_same(index, build_index(reduce(DataFrame.unionByName, rows_of), options))
    last = store._newest(spark, root)
    # The big segment stands as it was first written; small ones were merged.
    assert last.segments[0].folder == written[0] and len(last.segments) <= 5 and 10 < len(written) < 16
    before = rows(open_index(spark, root).docs.select("id", "title"))
    assert vacuum(spark, root) and not vacuum(spark, root)
    assert rows(open_index(spark, root).docs.select("id", "title")) == before


def test_commit_of_new_ids_does_not_read_postings(spark, folder, monkeypatch):
    root = folder("index")
    create_index(spark, root, documents(spark, range(20)), OPTIONS)
    monkeypatch.setattr(store, "_live_postings", lambda *_: pytest.fail("postings were read"))
    monkeypatch.setattr(store, "_open", lambda *_: None)
    write_documents(spark, root, documents(spark, range(20, 24)))
    write_documents(spark, root, documents(spark, range(3), "again"))


def test_two_writers_with_one_number(spark, folder, monkeypatch):
    root = folder("index")
    create_index(spark, root, documents(spark, range(6)), OPTIONS)
    real = store._commit
    raced = []

    def late(session, at, number, *rest):
        if not raced:
            raced.append(number)
            write_documents(session, at, documents(session, range(2), "first"))
        return real(session, at, number, *rest)

    monkeypatch.setattr(store, "_commit", late)
    with pytest.raises(Exception):
        write_documents(spark, root, documents(spark, range(4), "second"))
    expected = documents(spark, range(2, 6)).unionByName(documents(spark, range(2), "first"))
    assert_same(open_index(spark, root), build_index(expected, OPTIONS))


def test_repeated_and_missing_ids(spark, folder):
    docs = documents(spark, range(4), "old").unionByName(documents(spark, range(2), "new")).coalesce(1)
    found = create_index(spark, folder("index"), docs, OPTIONS)
    expected = documents(spark, range(2), "new").unionByName(documents(spark, range(2, 4), "old"))
    assert_same(found, build_index(expected, OPTIONS))
    with pytest.raises(Exception, match="no id"):
        write_documents(spark, folder("index"), spark.createDataFrame([(None, "t", "b")], docs.schema))


def test_first_vectors_decide_on_the_size(spark, folder):
    rows_of = lambda *sizes: spark.createDataFrame(
        [(f"v{n}", "t", "b", [1.0] * n) for n in sizes], "id string, title string, body string, title_vector array<float>"
    )
    with pytest.raises(ValueError, match="sizes"):
        create_index(spark, folder("mixed"), rows_of(2, 3), OPTIONS)
    create_index(spark, folder("index"), rows_of(2), OPTIONS)
    with pytest.raises(Exception, match="expected 2"):
        write_documents(spark, folder("index"), rows_of(3))


def test_few_words_read_few_pages(spark, folder):
    docs = spark.range(6000).selectExpr("concat('d', id) id", "concat('w', id) title", "concat('common b', id) body")
    index = create_index(spark, folder("index"), docs, IndexOptions(num_shards=1, num_buckets=1, analyzer="simple"))
    requests = prepare(spark.createDataFrame([(1, "w77")], "query_id long, q string"))
    scored = score_words(index, bag_of_words(index, requests))
    assert scored.count() == 1
    plan = scored._jdf.queryExecution().executedPlan()
    scored.collect()
    text = plan.toString()
    assert "PushedFilters: [" in text and "EqualTo(term,w77)" in text


def test_failed_commit_is_invisible_and_can_be_repeated(spark, folder, monkeypatch):
    root = folder("index")
    create_index(spark, root, documents(spark, range(6)), OPTIONS)

    def fail(*_):
        raise OSError("lost before the commit")

    with monkeypatch.context() as patch:
        patch.setattr("quillrank.plans.index_store._commit", fail)
        with pytest.raises(OSError):
            write_documents(spark, root, documents(spark, range(3), "lost"))
    assert_same(open_index(spark, root), build_index(documents(spark, range(6)), OPTIONS))
    for table in spark.catalog.listTables():
        if table.name.startswith("quillrank_"):
            spark.sql(f"DROP TABLE {table.name}")
    expected = documents(spark, range(2, 6)).unionByName(documents(spark, range(2), "kept"))
    found = write_documents(spark, root, documents(spark, range(2), "kept"))
    assert_same(found, build_index(expected, OPTIONS))


def test_missing_index(spark, folder):
    with pytest.raises(ValueError):
        open_index(spark, folder("nothing"))


def test_another_session_finds_the_index(spark, folder):
    docs = documents(spark, range(8))
    create_index(spark, folder("index"), docs, OPTIONS)
    for table in spark.catalog.listTables():
        if table.name.startswith("quillrank_"):
            spark.sql(f"DROP TABLE {table.name}")
    found = open_index(spark, folder("index"))
    assert_same(found, build_index(docs, OPTIONS))
    hashed, _ = exchanges(found.postings.groupBy("id").count())
    assert hashed == []


def test_scoring_does_not_shuffle_postings(spark, folder):
    root = folder("index")
    indexes = [
        create_index(spark, root, documents(spark, range(30)), OPTIONS),
        write_documents(spark, root, documents(spark, range(5, 9), "again")),
    ]
    queries = spark.createDataFrame([(1, "common word1"), (2, "body7 again")], "query_id long, q string")
    for index in indexes:
        requests = prepare(queries)
        hashed, plan = exchanges(top_per_shard(score_words(index, bag_of_words(index, requests)), requests))
        # The query vocabulary and the term counts aside, only the per-shard top-k moves.
        assert [e for e in hashed if "query_id" in e and "shard" in e] and len(hashed) <= 5
        assert not [e for e in hashed if "id#" in e.replace("query_id#", "") and "term" not in e]
        assert plan.count("WindowGroupLimit") == 2
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stream_equals_one_batch(spark, tmp_path, folder):
    source = tmp_path / "in"
    source.mkdir()

    def put(name, numbers, mark):
        lines = [json.dumps({"id": f"d{n}", "title": f"Title {n} {mark}", "body": f"common body{n} {mark}"}) for n in numbers]
        (source / name).write_text("\n".join([*lines, "{bad"]))

    put("a.json", range(10), "one")
    args = (spark, f"file:{source}", folder("index"), folder("progress"), OPTIONS)
    stream_index(*args, rejected_path=folder("rejected")).awaitTermination()
    put("b.json", range(5, 15), "two")
    stream_index(*args, rejected_path=folder("rejected")).awaitTermination()
    # Nothing new: nothing changes.
    stream_index(*args).awaitTermination()

    def expected(numbers, mark):
        rows = [(f"d{n}", f"Title {n} {mark}", f"common body{n} {mark}") for n in numbers]
        return spark.createDataFrame(rows, "id string, title string, body string")

    newest = expected(range(5), "one").unionByName(expected(range(5, 15), "two"))
    assert_same(open_index(spark, folder("index")), build_index(newest, OPTIONS))
    assert spark.read.json(folder("rejected")).count() == 2


def test_replayed_batch_is_not_written_twice(spark, folder):
    root = folder("index")
    write_documents(spark, root, documents(spark, range(4)), OPTIONS, source="s", source_batch=0)
    write_documents(spark, root, documents(spark, range(4), "replay"), source="s", source_batch=0)
    other = write_documents(spark, root, documents(spark, range(4, 6), "other"), source="t", source_batch=0)
    expected = documents(spark, range(4)).unionByName(documents(spark, range(4, 6), "other"))
    assert_same(other, build_index(expected, OPTIONS))


def test_several_indexes_as_one(spark, folder):
    """Each document scores as in its own index; an id that two indexes hold is two documents."""
    roots = [folder("a"), folder("b")]
    indexes = [create_index(spark, roots[0], documents(spark, range(20), "left"), OPTIONS)]
    indexes.append(create_index(spark, roots[1], documents(spark, range(15, 40), "right"), replace(OPTIONS, num_shards=2, num_buckets=3)))
    both = open_index(spark, *roots)
    assert both.num_shards == 5 and rows(both.shards) == [(str(n),) for n in range(5)]
    queries = spark.createDataFrame([(1, "common word1", [1.0], 1000), (2, "body17 left right", [1.0], 1000)], "query_id long, q string, query_vector array<float>, limit int")
    alone = []
    for index, offset in zip(indexes, (0, 3), strict=True):
        hits = scored_search(index, prepare(queries)).collect()
        alone += [(str(h.query_id), str(h.shard + offset), h.id, h.title, str(h.bm25_score)) for h in hits]
    found = scored_search(both, prepare(queries)).select("query_id", "shard", "id", "title", "bm25_score")
    assert rows(found) == sorted(alone)
    totals = cluster_stats(both.docs, both.num_shards).first()
    assert (totals.total_shards, totals.total_documents) == (5, 45)
    create_index(spark, folder("c"), documents(spark, range(2)), STEMMED)
    with pytest.raises(ValueError):
        open_index(spark, roots[0], folder("c"))


def test_stems_are_kept_with_the_index(spark, folder):
    root = folder("index")
    create_index(spark, root, documents(spark, range(3), "running"), STEMMED)
    stems = lambda: sorted(r.word for r in store._stems(spark, root, store._newest(spark, root)).collect())
    first = stems()
    assert "running" in first and len(first) == len(set(first))
    write_documents(spark, root, documents(spark, range(2, 5), "running cats"))
    assert sorted(set(stems()) - set(first)) == ["3", "4", "body3", "body4", "cats", "word3", "word4"]
    assert len(stems()) == len(set(stems()))
    assert rows(open_index(spark, root).term_stats.where("term = 'run'").select("df")) != []
    compact(spark, root)
    assert len(stems()) == len(set(stems())) and "cats" in stems()


def test_buckets_follow_the_texts(spark, folder, monkeypatch):
    monkeypatch.setattr(store.bucket_count, "__defaults__", (100,))
    options = IndexOptions(num_shards=1)
    assert options.buckets(documents(spark, range(3))) == 8
    assert options.buckets(documents(spark, range(300))) > 30
    assert IndexOptions(num_buckets=5).buckets(documents(spark, range(300))) == 5


def test_large_query_vocabulary_keeps_postings_in_their_buckets(spark, folder, monkeypatch):
    index = create_index(spark, folder("index"), documents(spark, range(30)), OPTIONS)
    vectors = "query_id long, q string, query_vector array<float>"
    asked = [(1, "common word1", [1.0]), (2, "body7 body8 title", None), (3, " ".join(f"body{n}" for n in range(9, 25)), None)]
    queries = spark.createDataFrame(asked, vectors)
    usual = rows(hybrid_search(index, queries).hits)
    monkeypatch.setattr("quillrank.operators.joins.MAX_BROADCAST_BYTES", 60 * 160)
    requests = prepare(queries)
    clauses = bag_of_words(index, requests)
    assert len(retrieval._parts(index, clauses)) > 1
    hashed, plan = exchanges(score_words(index, clauses))
    # No posting is dealt out by its term; what moves are sums per query and document.
    assert "_salt" not in plan
    assert all("query_id#" in e for e in hashed if "id#" in e.replace("query_id#", ""))
    assert rows(hybrid_search(index, queries).hits) == usual
    # Nothing may be broadcast: other joins, the same hits, and the scoring runs once.
    monkeypatch.setattr("quillrank.operators.joins.MAX_BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert rows(hybrid_search(index, queries).hits) == usual
        _, plan = exchanges(scored_search(index, prepare(queries)))
        assert "postings" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760b")


def test_stream_with_a_new_checkpoint_indexes_everything(spark, tmp_path, folder):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda i: json.dumps({"id": i, "title": i, "body": "b"})
    (source / "a.json").write_text(line("a"))
    stream_index(spark, f"file:{source}", folder("index"), folder("progress"), OPTIONS).awaitTermination()
    shutil.rmtree(tmp_path / "progress")
    (source / "b.json").write_text(line("b"))
    stream_index(spark, f"file:{source}", folder("index"), folder("progress"), OPTIONS).awaitTermination()
    assert rows(open_index(spark, folder("index")).docs.select("id")) == [("a",), ("b",)]


def test_rare_stems_come_to_the_buckets(spark, folder, monkeypatch):
    """Where the dictionary is too large to broadcast, the rows of an index are still neither grouped nor stemmed across buckets."""
    from quillrank.operators import analysis, stems

    monkeypatch.setattr(stems, "max_broadcast_rows", lambda *_: 6)
    monkeypatch.setattr(analysis, "COUNTED_WORDS", 50, raising=False)
    plans, write = [], store._Segment.write_postings

    def seen(self, session, postings):
        plans.append(exchanges(postings)[0])
        return write(self, session, postings)

    monkeypatch.setattr(store._Segment, "write_postings", seen)
    data = [(f"d{n}", f"running {n} runs", f"the cats cat walked{'s' * (n % 3)} rare{n}ing rare{n} {'' if n else None}") for n in range(60)]
    data += [("empty", None, "")]
    docs = spark.createDataFrame(data, "id string, title string, body string")
    options = replace(STEMMED, positions=False)
    found = create_index(spark, folder("index"), docs, options)
    assert_same(found, build_index(docs, options))
    assert found.postings.where("id = 'd7' AND term = 'rare7' AND field = 'body'").select("tf").collect() == [(2,)]
    assert not [line for line in plans[0] if "shard" in line]
    assert not store._folders(spark, folder("index") + "/words")


def test_words_of_written_documents_are_not_grouped(spark, folder, monkeypatch):
    plans, write = [], store._Segment.write_postings

    def seen(self, session, postings):
        plans.append(exchanges(postings)[1])
        return write(self, session, postings)

    monkeypatch.setattr(store._Segment, "write_postings", seen)
    options = replace(OPTIONS, positions=False)
    docs = documents(spark, range(40), "title Title common")
    assert_same(create_index(spark, folder("index"), docs, options), build_index(docs, options))
    assert "Aggregate" not in plans[0] and "Exchange" not in plans[0]
