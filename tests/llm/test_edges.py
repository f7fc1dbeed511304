"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for each operator."""

import hashlib
import random

import numpy as np
import pytest

from quillrank.llm.embedding_dedup import vector_components
from quillrank.llm.fingerprints import compare_with_edits, fingerprint_documents
from quillrank.llm.language_id import identify_languages, label_languages
from quillrank.llm.line_dedup import dedup_lines
from quillrank.llm.mixing import mix, mix_rates
from quillrank.llm.near_duplicates import jaccard_classes, one_of_each
from quillrank.llm.packing import bin_completion, least_bins, pack_documents
from quillrank.llm.quality import classify_quality
from quillrank.llm.suffix_dedup import remove_repeats
from quillrank.llm.url_filter import judge_urls

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, size int, _d int, _t string, "
    "label string, digest int, n int, runs int, spans int, piece int, target string, n_copies int"
)
LONG = " ".join(f"w{i % 9973}x{i}" for i in range(40_000))
PROSE = "\n".join(f"{a} the quick brown fox jumps over the lazy dog and runs home {a} again" for a in ("one", "two", "three", "four", "five"))


def rows():
    texts = [
        (None, None, None, None),
        (None, PROSE, "en", "a"),
        (1, "", "en", "a"),
        (2, " \n\t \n", None, "a"),
        (3, LONG, "de", "b"),
        (4, PROSE, "en", "a"),
        (4, PROSE, "en", "a"),
        (5, PROSE + "\nmore", "en", None),
        (6, None, "en", "b"),
        (7, "12 34 !!", None, "c"),
        (8, "a b", "fr", "c"),
        (8, "a b c", "fr", "c"),
        (9, "é" * 5000, "fr", "c"),
    ]
    return [(d, t, lang, source, None, 0.5, 1, 2, "x", "y", 3, 4, 5, 6, 7, "z", 8) for d, t, lang, source in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df):
    return sorted(str(r.doc_id) for r in df.collect())


ALL = sorted(str(r[0]) for r in rows())


def test_line_dedup(docs, nothing):
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    found = {}
    for r in out.collect():
        found.setdefault(r.doc_id, []).append(r.text)
    assert found[None] == [None, PROSE] or found[None] == [PROSE, None]
    assert found[4] == ["", ""]  # a missing id comes first; the rows of 4 are copies of one document
    assert found[5] == ["more"] and found[3] == [LONG] and found[1] == [""] and found[6] == [None]
    assert dedup_lines(nothing).collect() == []


def test_line_dedup_inside_a_document(spark):
    long_line = " ".join(f"w{i}" for i in range(60))
    text = "\n".join([long_line, "", long_line, "short", long_line])
    out = dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), counts=True).first()
    assert out.text == long_line + "\n\nshort" and (out.n_lines, out.n_removed) == (5, 2)


def test_packing(docs, nothing):
    out = pack_documents(docs).collect()
    assert sorted({str(r.doc_id) for r in out}) == sorted(set(ALL))
    assert sum(r.length == 1 for r in out if r.doc_id in (None, 1, 6)) == 3
    assert sum(r.length for r in out if r.doc_id == 4) % 2 == 0
    assert pack_documents(nothing).collect() == []


def test_bin_completion():
    rng = random.Random(3)
    better = 0
    for _ in range(60):
        sizes = [rng.randrange(20, 70) for _ in range(rng.randrange(1, 40))]
        bins = bin_completion(sizes, 100)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and max(map(sum, bins)) <= 100
        assert len(bins) >= least_bins(sizes, 100)
        better += len(bins) == least_bins(sizes, 100)
    assert better > 40
    # Best fit needs four bins here.
    assert len(bin_completion([44, 24, 24, 22, 21, 17, 8, 8, 6, 6, 20], 100)) == 2
    assert bin_completion([100], 100) == [[100]]


def test_fingerprints(docs, nothing):
    out = compare_with_edits(docs).collect()
    assert sorted(str(r.doc_id) for r in out) == ALL
    prints = [r.fingerprint for r in out if r.doc_id == 4]
    assert prints[0] == prints[1] and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert {r.fingerprint for r in out if r.doc_id in (1, 2, 6)} == {"0" * 256}
    assert compare_with_edits(nothing).collect() == []
    assert fingerprint_documents(docs).count() == len(ALL)


def test_fingerprint_of_next_wraps_around(spark):
    data = spark.createDataFrame([(i, f"{i} " + "abc " * i) for i in (30, 10, 20)], "doc_id long, text string")
    out = {r.doc_id: r for r in compare_with_edits(data).collect()}
    text, first = "30 " + "abc " * 30, "10 " + "abc " * 10
    half = len(text) // 2
    assert out[30].edited_sha256 == hashlib.sha256((text[: len(text) - half] + first[:half]).encode()).hexdigest()


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (3, None), (77, 1)], "doc_id long, quality int")
    out = classify_quality(docs, labels)
    assert set(docs.columns) <= set(out.columns) and ids(out) == ALL
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert classify_quality(nothing, labels).collect() == []
    assert ids(classify_quality(docs, labels.filter("false"))) == ALL


def test_near_duplicates(docs, nothing):
    out = jaccard_classes(docs)
    assert ids(out) == ALL
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.n_links == 3 and r.class_id is None for d in (4, 5) for r in by[d])
    assert {r.class_id for d in (1, 2, 6) for r in by[d]} == {None} and by[3][0].n_links == 0
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "8", "9", "None", "None"]
    assert jaccard_classes(nothing).collect() == [] and one_of_each(nothing).collect() == []


def test_near_duplicates_across_blocks(spark, monkeypatch):
    import quillrank.llm.near_duplicates as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 4)
    base = [f"w{i}" for i in range(200)]
    data = [(i, " ".join([*base[:i], f"new{i}", *base[i:]])) for i in range(20)] + [(99, "one two three")]
    out = {r.doc_id: r for r in jaccard_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(out[i].n_links == 19 and out[i].class_id == 0 for i in range(20)) and out[99].n_links == 0


def test_url_filter(spark):
    rules = spark.createDataFrame([("a.org", "/x", "block"), ("org", "/", "allow"), ("a.org", "/x", "allow")], "host string, path string, action string")
    urls = ["http://A.org/xy?q", "http://b.a.org/x", "http://a.org", None, "nothing", "http://ba.org/x#", "http://" + "a." * 3000 + "org/" + "y" * 9000]
    pages = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(urls)] + [(0, urls[0], "rule")], "page_id long, url string, rule string")
    out = {}
    for r in judge_urls(pages, rules).collect():
        out.setdefault(r.page_id, []).append((r.rule, r.verdict))
    assert out[0] == [("a.org/x", "block")] * 2 and out[1] == [("a.org/x", "block")]  # of equal rules, block
    assert out[2] == out[3] == out[4] == [(None, "allow")]
    assert out[5] == [("org/", "allow")] and out[6] == [("org/", "allow")]
    assert judge_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_url_rules_of_more_shapes_than_are_expanded(spark, monkeypatch, broadcast):
    import quillrank.llm.url_filter as module

    paths = ["/" + "ab/cd"[: n % 6] * (n // 6) for n in range(24)]
    rules = [(h, p, "block" if n % 3 else "allow") for n, p in enumerate(paths) for h in ("org", "x.org", "a.x.org", "\u00c4.org", "COM")[: 1 + n % 5]]
    rules = spark.createDataFrame(rules, "host string, path string, action string")
    urls = [f"http://{h}{p}{q}" for h in ("a.x.org", "b.a.x.org", "y.org", "\u00c4.org", "\u00e4.org", "z.com", "net") for p in paths for q in ("", "?/ab")]
    pages = spark.createDataFrame([(i % 300, u) for i, u in enumerate([*urls, None, "none"])], "page_id long, url string")
    expected = sorted(map(str, judge_urls(pages, rules).collect()))
    assert any("\u00c4.org" in e for e in expected)
    monkeypatch.setattr(module, "MAX_BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(module, "MAX_SHAPES", 3)
    assert sorted(map(str, judge_urls(pages, rules).collect())) == expected


def test_url_filter_without_broadcast(spark, monkeypatch):
    import quillrank.llm.url_filter as module

    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(i, f"http://h{i}.org/{i}") for i in range(50)], "page_id long, url string")
    expected = sorted(judge_urls(pages, rules).collect())
    monkeypatch.setattr(module, "MAX_BROADCAST_BYTES", 0)
    assert sorted(judge_urls(pages, rules).collect()) == expected


def test_suffix_dedup(docs, nothing):
    out = remove_repeats(docs).collect()
    assert sorted(str(r.doc_id) for r in out) == ALL
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [bytes(r.kept) for r in by[4]] == [b"", b""] and bytes(by[5][0].kept) == b"\nmore" and by[5][0].n_spans == 1
    assert by[3][0].n_removed == 0 and by[9][0].n_removed == 10_000 and by[6][0].n_bytes == 0
    assert remove_repeats(nothing).collect() == []


@pytest.mark.parametrize("max_sorted", [16_384, 1])
def test_suffix_dedup_equals_brute_force(spark, max_sorted):
    rng = np.random.default_rng(8)
    parts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (60, 90, 120, 75, 300)]
    texts = [b"".join(parts[i] for i in rng.integers(0, 5, rng.integers(0, 7))) for _ in range(40)] + [b"ab" * 400, b"x" * 333]
    data = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: (bytes(r.kept), r.n_spans) for r in remove_repeats(data, length=100, max_sorted=max_sorted).collect()}
    seen = {}
    for t in texts:
        for s in range(len(t) - 99):
            seen[t[s : s + 100]] = seen.get(t[s : s + 100], 0) + 1
    for i, t in enumerate(texts):
        gone = np.zeros(len(t) + 2, bool)
        for s in range(len(t) - 99):
            if seen[t[s : s + 100]] > 1:
                gone[s + 1 : s + 101] = True
        kept = bytes(c for c, g in zip(t, gone[1:-1], strict=True) if not g)
        assert found[i] == (kept, int((gone[1:] & ~gone[:-1]).sum()))


def test_language(docs, nothing):
    out = {}
    for r in identify_languages(docs).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, out.values())) == len(ALL)
    assert {r.lang_pred for d in (1, 2, 6, 7) for r in out[d]} == {"und"} and out[3][0].lang_pred != "und"
    assert identify_languages(nothing).collect() == []
    assert {r.lang_pred for r in label_languages(docs, [], None).collect()} == {"und"}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [1e300, 1e299]), (12, [0.0, 5.0]),
    ]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, node string")
    out = {}
    for r in vector_components(vectors).collect():
        out.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert out[1] == [(4, 1, True)] and out[2] == [(4, 1, False)] * 2 and out[None] == [(4, 1, True)] and out[11] == [(4, 1, False)]
    assert out[3] == [(1, 3, True)] and out[12] == [(1, 3, False)]
    assert all(out[i] == [(0, i, True)] for i in (4, 5, 6, 7, 8, 9, 10))
    assert vector_components(vectors.limit(0)).collect() == []


@pytest.mark.parametrize("cell_rows", [25, 10_000])
def test_vectors_in_cells_and_blocks(spark, monkeypatch, cell_rows):
    import quillrank.llm.embedding_dedup as module

    monkeypatch.setattr(module, "BLOCK_NUMBERS", 8 * 40)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((30, 8)), 10, axis=0) + 0.25 * rng.standard_normal((300, 8))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    labels = np.arange(300)
    for _ in range(300):
        labels = np.minimum(labels, np.where(close, labels[None], 300).min(axis=1))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r.vec_id: (r.n_links, r.component_id) for r in vector_components(data, cell_rows=cell_rows).collect()}
    assert out == {i: (int(close[i].sum()), int(labels[i])) for i in range(300)}


def test_mixing(docs, nothing):
    out = mix_rates(docs).collect()
    assert sorted(str(r.doc_id) for r in out) == ALL
    assert all(r.n_copies <= 3 and r.target <= 3 * r.source_size for r in out)
    copies = [r.n_copies for r in out if r.doc_id == 4]
    assert copies[0] == copies[1]
    taken = mix(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.n_copies for r in out)
    assert sorted(mix_rates(docs).select("doc_id", "n_copies").collect(), key=str) == sorted(((r.doc_id, r.n_copies) for r in out), key=str)
    assert mix(nothing).collect() == []


def test_mixing_meets_targets(spark):
    data = [(i, "w " * (i % 50), f"s{i % 7}") for i in range(7000)]
    out = mix_rates(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    taken, target, variance = {}, {}, {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.size * r.n_copies
        target[r.source] = r.target
        share = r.target / r.source_size % 1
        variance[r.source] = variance.get(r.source, 0) + r.size**2 * share * (1 - share)
    assert all(abs(taken[s] - target[s]) <= 4 * variance[s] ** 0.5 for s in target)
    assert abs(sum(target.values()) - sum(r.size for r in out)) < 1e-6 * len(out)


def test_chains_of_vectors_hold_together(spark):
    """Each chain has four vectors, linked to the next alone; whichever comes first in a block, all four are one component."""
    chains, turn = 40, np.radians(20)
    data = []
    for c in range(chains):
        for i in range(4):
            v = np.zeros(2 * chains)
            v[2 * c], v[2 * c + 1] = np.cos(i * turn), np.sin(i * turn)
            data.append((4 * c + i, v.tolist()))
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in vector_components(vectors).collect()}
    assert found == {i: ((1, 2, 2, 1)[i % 4], i - i % 4) for i in range(4 * chains)}


def test_vectors_are_written_once_however_many_blocks_meet_them(spark, monkeypatch):
    """Vectors without structure are near every cell; in many cells, blocks and rounds they are still one row each, and all pairs are seen."""
    import quillrank.llm.embedding_dedup as module

    monkeypatch.setattr(module, "BLOCK_NUMBERS", 16 * 30)
    monkeypatch.setattr(module, "ROUND_BYTES", 16 * 30 * 4 * 6, raising=False)
    written = []

    def counted(rows, name, stage=module.stage):
        rows = stage(rows, name)
        written.append((name, rows.count()))
        return rows

    monkeypatch.setattr(module, "stage", counted)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[200:240] = x[:40] + 0.1 * rng.standard_normal((40, 16)).astype(np.float32)
    x[240:260] = x[0]
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    labels = np.arange(400)
    for _ in range(400):
        labels = np.minimum(labels, np.where(close, labels[None], 400).min(axis=1))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = {r.vec_id: (r.n_links, r.component_id) for r in vector_components(data, cell_rows=40).collect()}
    assert out == {i: (int(close[i].sum()), int(labels[i])) for i in range(400)}
    assert [n for name, n in written if name != "vector-links"] == [380]
    assert sum(n for name, n in written if name == "vector-links") < 380


def test_vectors_at_the_threshold(spark):
    """What single precision leaves open is decided in double precision: cosines a little below, at and above 0.6."""
    at = [0.6 + d for d in (-1e-9, 1e-9, -1e-12, 1e-12)]
    data = [(0, [1.0, 0.0])] + [(i + 1, [c, -((1 - c * c) ** 0.5) if i % 2 else (1 - c * c) ** 0.5]) for i, c in enumerate(at)]
    vectors = spark.createDataFrame(data + [(9, [3.0, 4.0, 0.0]), (8, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    out = {r.vec_id: r.n_links for r in vector_components(vectors, threshold=0.6).collect()}
    assert out == {0: 2, 1: 1, 2: 2, 3: 1, 4: 2, 8: 1, 9: 1}
