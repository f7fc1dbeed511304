import hashlib
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrank.functions.routing import shard_of
from quillrank.functions.stemming import with_stem
from quillrank.functions.text import cache_key, clean_markup, is_long_enough
from quillrank.operators.analysis import analyzed, build_postings, terms
from quillrank.operators.stems import dictionary, stemmed


def column(spark, values, expression):
    rows = list(enumerate(values))
    found = spark.createDataFrame(rows, "i int, x string").select("i", expression(F.col("x")).alias("y"))
    return [r.y for r in sorted(found.collect())]


# Raw text and what is left of it.
CLEANING = {
    "''a''": "a",
    "'''b'''": "b",
    "'''''c'''''": "c",
    "''''d''''": "'d'",
    "{x} {{y}} [[z|w]] [u]": "{x} y z|w u",
    "a\u00a0\u3000b  c": "a b c",
    "a\rb \r\n c": "a\rb c",
    "x\x1c\x1d\x1e\x1fy": "x y",
    "\x85edge\x85": "edge",
    "   both ends    ": "both ends",
    "one\ntwo\tthree": "one two three",
    "it's 'quoted' text": "it's 'quoted' text",
    "": "",
    " \t\n ": "",
    "[[[a]]] {{{b}}} }}{{": "a {b}",
    "\U0001f600" * 2001: "\U0001f600" * 2001,
}


def test_cleaning(spark):
    assert column(spark, list(CLEANING), clean_markup) == list(CLEANING.values())
    limited = column(spark, ["\U0001f600" * 2001, "a" * 1999 + " bcd", "short"], lambda c: clean_markup(c, 2000))
    assert limited == ["\U0001f600" * 2000, "a" * 1999 + " ", "short"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab'[]{}| \n\t\r\x0b\x1c\x85\u3000\u200b\U0001f600", max_size=60), min_size=1, max_size=60))
def test_cleaning_of_any_text(spark, texts):
    for raw, clean in zip(texts, column(spark, texts, clean_markup), strict=True):
        assert not set(clean) & set("[]\n\t") and "  " not in clean and clean == clean.strip() and len(clean) <= len(raw)
        # Letters keep their number and order.
        assert [c for c in clean if c in "ab\U0001f600"] == [c for c in raw if c in "ab\U0001f600"]


def test_length_filter(spark):
    assert column(spark, ["x" * 49, "x" * 50, "x" * 51], is_long_enough) == [False, True, True]


@pytest.mark.parametrize("shards", [1, 3, 7, 8])
def test_routing(spark, shards):
    ids = [f"wiki_{n}" for n in range(500)] + ["", "é", "\U0001f600"]
    expected = [int.from_bytes(hashlib.md5(i.encode()).digest()[:8], "big") % shards for i in ids]
    assert column(spark, ids, lambda c: shard_of(c, shards)) == expected


def test_words(spark):
    texts = ["The cat's 2nd hat--", "", None, "x" * 39 + " " + "y" * 40, "é" * 19 + " " + "é" * 20, "東京tower", "हि", "İstanbul"]
    assert column(spark, texts, terms) == [
        ["the", "cat", "s", "2nd", "hat"],
        [],
        [],
        ["x" * 39],
        ["é" * 19],
        ["東京tower"],
        # A combining vowel sign belongs to its word.
        ["हि"],
        # The length limit and the word borders apply before lower-casing.
        ["i̇stanbul"],
    ]


def test_slots_keep_gaps(spark):
    found = column(spark, ["a " + "x" * 40 + " b"], lambda c: terms(c, slots=True))
    assert found == [["a", None, "b"]]


def test_stemmed_postings(spark):
    docs = spark.createDataFrame([("a", 0, "Running RUNNING ran", "databases " + "x" * 40 + " cats"), ("b", 0, None, "")], "id string, shard int, title string, body string")
    found = {(r.field, r.term): (r.tf, r.dl, r.positions) for r in build_postings(docs, "en_stem", positions=True).collect()}
    assert found == {
        ("title", "run"): (2, 3, [0, 1]),
        ("title", "ran"): (1, 3, [2]),
        ("body", "databas"): (1, 2, [0]),
        ("body", "cat"): (1, 2, [2]),
    }
    plain = build_postings(docs, "en_stem")
    assert {(r.field, r.term): r.tf for r in plain.collect()} == {k: v[0] for k, v in found.items()}
    assert "Python" not in plain._sc._jvm.PythonSQLUtils.explainString(plain._jdf.queryExecution(), "simple")


@pytest.mark.parametrize("max_rows", [None, 40, 3, 0])
def test_dictionary_of_any_size(spark, max_rows):
    """Broadcast whole, its frequent words only, or none of it; null words stay."""
    words = [w for i, w in enumerate(STEMS) for _ in range(1 + i % 9)] + [None]
    rows = spark.createDataFrame([(n, w) for n, w in enumerate(words)], "n int, term string")
    found = dictionary(rows, "term")
    assert {r.n: r.term for r in stemmed(rows, "term", found, max_rows).collect()} == {n: STEMS.get(w) for n, w in enumerate(words)}


def test_known_words_are_not_stemmed_again(spark):
    rows = spark.createDataFrame([("cats",), ("knives",), ("cats",)], "term string")
    known = spark.createDataFrame([("cats", "KNOWN"), ("dogs", "dog")], "word string, stem string")
    found = dictionary(rows, "term", known)
    assert [tuple(r) for r in found.added.collect()] == [("knives", "knive")]
    assert sorted(r.term for r in stemmed(rows, "term", found).collect()) == ["KNOWN", "KNOWN", "knive"]


def test_filters_on_stems_are_planned_at_once(spark):
    docs = spark.createDataFrame([("a", 0, "Running", "databases and cats")], "id string, shard int, title string, body string")
    begin = time.monotonic()
    found = build_postings(docs, "en_stem").where("term > 'd' AND term LIKE 'r%' AND length(term) > 1").collect()
    assert [r.term for r in found] == ["run"] and time.monotonic() - begin < 20
    plan = build_postings(docs, "en_stem").where("term IS NOT NULL AND term <> 'x'")
    begin = time.monotonic()
    plan._jdf.queryExecution().executedPlan()
    assert time.monotonic() - begin < 5


def test_longest_word_is_a_parameter(spark):
    assert column(spark, ["abc abcd é"], lambda c: terms(c, max_bytes=3)) == [["abc", "é"]]


def test_unknown_analyzer(spark):
    with pytest.raises(ValueError):
        analyzed(spark.range(1), "french")


# Pairs given in the published description of the algorithm.
STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign",
    "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist",
    "consistently": "consist", "consisting": "consist", "consists": "consist", "consolation": "consol",
    "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol",
    "consoles": "consol", "consolidate": "consolid", "consolidated": "consolid", "consolidating": "consolid",
    "consoling": "consol", "consolingly": "consol", "consols": "consol", "consonant": "conson",
    "consort": "consort", "consorted": "consort", "consorting": "consort", "conspicuous": "conspicu",
    "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirator": "conspir",
    "conspire": "conspir", "constable": "constabl", "constancy": "constanc", "constant": "constant",
    "knack": "knack", "knackeries": "knackeri", "knacks": "knack", "knag": "knag", "knave": "knave",
    "knavish": "knavish", "kneaded": "knead", "kneading": "knead", "knee": "knee", "kneel": "kneel",
    "kneeling": "kneel", "knees": "knee", "knell": "knell", "knelt": "knelt", "knew": "knew",
    "knick": "knick", "knif": "knif", "knife": "knife", "knight": "knight", "knightly": "knight",
    "knights": "knight", "knit": "knit", "knitted": "knit", "knitting": "knit", "knives": "knive",
    "knob": "knob", "knocked": "knock", "knocker": "knocker", "knocking": "knock", "knot": "knot", "knots": "knot",
}


def test_stemmer(spark):
    rows = spark.createDataFrame([(w,) for w in [*STEMS, None]], "word string")
    assert {r.word: r.stem for r in with_stem(rows, "word", "stem").collect()} == {**STEMS, None: None}


def test_cache_key(spark):
    assert column(spark, ["  Mixed Case ", "mixed case"], cache_key) == ["mixed case", "mixed case"]
