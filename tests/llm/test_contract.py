"""The registered queries against their SQL, or against brute force where SQL cannot express them."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from quillrank.llm.common import table
from quillrank.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"

pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def texts(spark):
    rows = table(spark, DATA, "documents").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    return {r.doc_id: r.text or "" for r in rows}


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op6_url_filter", "op10_mixing", "op11_conversation_repair", "op12_filter_audit", "op13_decontamination"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = contract.queries()[name](spark, DATA)
    expected = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    assert canonical(found.columns, found.collect()) == canonical(columns, expected.fetchall())


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.partition("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


def test_packing_keeps_every_token(spark, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = QUERIES["op2_packing"](spark, DATA).collect()
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    pieces = {(r.doc_id, r.start): r for r in rows}
    assert len(pieces) == len(rows)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    by_doc = Counter()
    for r in rows:
        by_doc[r.doc_id] += r.length
        assert r.length == 1024 or r.piece == 0
    assert by_doc == {d: len(x) for d, x in ids.items()}
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 1024
    assert len(sequences) <= -(-sum(sequences.values()) // 1024) + 1


def shingles(text):
    words = text.translate(str.maketrans(SPACE, " " * len(SPACE))).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_follow_the_edit_and_the_similarity(spark, texts):
    rows = sorted(QUERIES["op3_fingerprints"](spark, DATA).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == list(texts)
    ids = list(texts)
    errors = []
    prints = {}
    for i, r in enumerate(rows):
        text, after = texts[ids[i]], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        errors.append(r.near_edited - jaccard(shingles(text), shingles(edited)))
        errors.append(r.near_next - jaccard(shingles(text), shingles(after)))
    assert np.abs(errors).mean() < 0.04 and np.abs(errors).max() < 0.2


def test_quality_on_held_out_documents(spark):
    rows = QUERIES["op4_quality"](spark, DATA).join(table(spark, DATA, "labels"), "doc_id", "left").collect()
    assert all(r.held_out == is_held_out(r.doc_id) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    judged = [r.predicted == r.quality for r in rows if r.held_out and r.quality is not None]
    assert len(rows) == 200 and np.mean(judged) > 0.9


def test_language_on_held_out_documents(spark):
    rows = QUERIES["op8_language_id"](spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    judged = [r.lang_pred == r.lang for r in rows if r.held_out and r.lang is not None]
    assert len(rows) == 200 and np.mean(judged) > 0.9


def test_jaccard_classes_equal_brute_force(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op5_jaccard_join"](spark, DATA).collect()}
    sets = {d: shingles(t) for d, t in texts.items()}
    links = {d: [e for e in sets if e != d and jaccard(sets[d], sets[e]) >= 0.8] for d in sets}
    labels = {d: d for d in sets}
    for _ in range(len(sets)):
        labels = {d: min([labels[d], *(labels[e] for e in links[d])]) for d in sets}
    assert {d: (r.n_links, r.class_id, r.kept) for d, r in rows.items()} == {d: (len(links[d]), labels[d], labels[d] == d) for d in sets}


def test_suffix_dedup_equals_brute_force(spark, texts):
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_suffix_dedup"](spark, DATA).collect()}
    data = {d: t.encode() for d, t in texts.items()}
    starts = Counter(b[s : s + 200] for b in data.values() for s in range(len(b) - 199))
    for d, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 199):
            if starts[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(b)]).sum())
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        assert rows[d] == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_vector_join_equals_brute_force(spark):
    data = sorted(table(spark, DATA, "embeddings").select("vec_id", "embedding").collect())
    x = np.array([r.embedding for r in data], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    labels = np.arange(len(x))
    for _ in range(20):
        labels = np.minimum(labels, np.where(close, labels[None], len(x)).min(axis=1))
    ids = [r.vec_id for r in data]
    rows = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op9_vector_join"](spark, DATA).collect()}
    assert rows == {ids[i]: (int(close[i].sum()), ids[labels[i]], labels[i] == i) for i in range(len(x))}


def test_pipeline_stages(spark, texts):
    docs = table(spark, DATA, "documents")
    seen = [docs]
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, DATA)
        assert docs.columns == seen[0].columns
        docs = corpus_pipeline.stage(docs, "test")
        seen.append(docs)
    raw, good, cleaned, unique, mixed = seen
    labels = table(spark, DATA, "labels").collect()
    bad, fine = ({r.doc_id for r in labels if r.quality == q} for q in (0, 1))
    kept = {r.doc_id for r in good.collect()}
    assert len(bad & kept) <= 0.05 * len(bad) and len(fine - kept) <= 0.03 * len(fine)
    assert cleaned.count() == good.count()
    left = {r.doc_id: shingles(r.text) for r in unique.collect()}
    names = sorted(left)
    assert not any(jaccard(left[a], left[b]) >= 0.8 for i, a in enumerate(names) for b in names[:i])
    assert {r.doc_id for r in mixed.collect()} <= set(names)
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").filter("n > 1024").count() == 0
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
