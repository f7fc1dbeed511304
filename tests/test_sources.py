import bz2
import json

import pytest

from quillrank.operators.ingest import ingest_counts, kept_documents, latest_versions, pages_to_documents
from quillrank.plans.ingest import index_counts, index_json, ingest_dump
from quillrank.plans.index_store import IndexOptions
from quillrank.sources.dumps import first_prefix, malformed_pages, quarantined_pages, read_pages
from quillrank.sources.jsonl import read_documents, read_numbered_documents, soft_cap

DUMP = """<mediawiki xmlns="http://example.org/export/" xml:lang="en">
  <siteinfo><sitename>pages</sitename></siteinfo>
  <page><title>One &amp; only</title><id>1</id>
    <revision><id>7</id><text xml:space="preserve">first &lt;b&gt; text</text></revision>
    <revision><text>second revision</text></revision></page>
  <page><revision><text>no title</text></revision></page>
  <page><title></title><revision><text>empty title</text></revision></page>
  <page><title>No revision</title></page>
  <page><title>No text</title><revision><id>3</id></revision></page>
  <page><title>First revision empty</title><revision><text/></revision><revision><text>late</text></revision></page>
  <page><title>Blank text</title><revision><text xml:space="preserve">   </text></revision></page>
  <page ><title> </title><revision><text>blank title \U0001f600</text></revision></page>
</mediawiki>
"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("suffix", [".xml", ".xml.bz2"])
def test_pages(spark, tmp_path, suffix):
    path = tmp_path / f"dump{suffix}"
    path.write_bytes(bz2.compress(DUMP.encode()) if suffix.endswith("bz2") else DUMP.encode())
    pages = read_pages(spark, f"file:{path}")
    assert rows(pages) == [
        (1, "One & only", "first <b> text"),
        (2, "Blank text", "   "),
        (3, " ", "blank title \U0001f600"),
    ]
    assert [r[0] for r in rows(read_pages(spark, f"file:{path}", max_docs=2))] == [1, 2]


def test_prefixed_pages(spark, tmp_path):
    path = tmp_path / "dump.xml"
    path.write_text(
        '<mw:mediawiki xmlns:mw="u"><mw:page><mw:title>T</mw:title><mw:revision><mw:text>X</mw:text></mw:revision>'
        "</mw:page></mw:mediawiki>"
    )
    assert rows(read_pages(spark, f"file:{path}", page_tag="mw:page")) == [(1, "T", "X")]
    assert first_prefix(spark, f"file:{path}") == "mw" and rows(read_pages(spark, f"file:{path}")) == [(1, "T", "X")]


def test_first_prefix_is_that_of_a_tag(spark, tmp_path):
    path = tmp_path / "dump.xml"
    for text, prefix in [('<?xml version="1.0"?>\n<!-- a:b -->\n<mediawiki xmlns:x="u"><x:page/>', ""), ("<é.x:a>", "é.x"), ("", ""), ("no tag", "")]:
        path.write_text(text, encoding="utf-8")
        assert first_prefix(spark, f"file:{path}") == prefix
    path.write_text("")
    assert read_pages(spark, f"file:{path}").collect() == []


def test_quarantine(spark, tmp_path):
    path = tmp_path / "dump.xml"
    path.write_text(DUMP + "<page><title>broken</page>")
    found = sorted((r.reason, r.title or "", bool(r.xml)) for r in quarantined_pages(spark, f"file:{path}").collect())
    assert [f for f in found if f[0] == "malformed"] == [("malformed", "", True)]
    assert ("text missing", "No revision", False) in found and ("text missing", "First revision empty", False) in found
    assert sum(f[0] == "title missing" for f in found) == 2
    plan = quarantined_pages(spark, f"file:{path}")
    assert plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple").count("from_xml") == 1


def test_malformed_page(spark, tmp_path):
    path = tmp_path / "dump.xml"
    good = "<page><title>{0}</title><revision><text>text {0}</text></revision></page>\n"
    path.write_text(good.format("a") + "<page><title>broken</page>\n" + good.format("b"))
    with pytest.raises(Exception):
        read_pages(spark, f"file:{path}").collect()
    assert rows(read_pages(spark, f"file:{path}", on_error="skip")) == [(1, "a", "text a"), (2, "b", "text b")]
    assert malformed_pages(spark, f"file:{path}").count() == 1
    with pytest.raises(ValueError):
        read_pages(spark, f"file:{path}", on_error="ignore")


@pytest.mark.parametrize("suffix", [".xml", ".xml.bz2"])
def test_split_file_keeps_every_page_in_order(spark, tmp_path, suffix):
    page = "  <page>\n<title>t{0}</title>\n<revision><text>{1}</text></revision></page>\n"
    text = "<mediawiki>\n" + "".join(page.format(n, f"body {n} " * (n % 90 + 1)) for n in range(4000)) + "</mediawiki>"
    path = tmp_path / f"dump{suffix}"
    path.write_bytes(bz2.compress(text.encode(), 1) if suffix.endswith("bz2") else text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = rows(read_pages(spark, f"file:{path}").select("seq", "title"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == [(n + 1, f"t{n}") for n in range(4000)]


def test_ingest(spark, tmp_path, folder):
    page = "<page><title>t{0}</title><revision><text>{1}</text></revision></page>\n"
    lengths = [49, 50, 51, 2100, 10]
    path = tmp_path / "dump.xml"
    path.write_text("".join(page.format(n, "x" * size) for n, size in enumerate(lengths)))
    counts = ingest_dump(spark, f"file:{path}", folder("out"), num_shards=3, max_chars=2000)
    assert rows(counts) == [(3, 2)]
    back = spark.read.json(folder("out"))
    assert {(r.id, len(r.body)) for r in back.collect()} == {("wiki_2", 50), ("wiki_3", 51), ("wiki_4", 2000)}
    assert {"id", "title", "body", "indexed_at", "title_vector", "shard"} == set(back.columns)
    ingest_dump(spark, f"file:{path}", folder("whole"))
    assert {len(r.body) for r in spark.read.json(folder("whole")).collect()} == {50, 51, 2100}


def test_jsonl(spark, tmp_path):
    good = {"id": "a", "title": "t", "body": "b"}
    lines = [
        json.dumps(good),
        "",
        "   ",
        "{bad",
        "[1]",
        json.dumps({"id": "b", "title": "t"}),
        "  " + json.dumps({**good, "id": "c", "title_vector": [1.5, 2], "indexed_at": "then"}),
        json.dumps({**good, "body": "later"}),
    ]
    path = tmp_path / "docs.jsonl"
    path.write_text("\n".join(lines))
    result = read_numbered_documents(spark, f"file:{path}")
    docs = {(r.id, r.body, r.version): r for r in result.docs.collect()}
    assert set(docs) == {("a", "b", 1), ("c", "b", 2), ("a", "later", 3)}
    assert docs[("c", "b", 2)].title_vector == [1.5, 2.0] and docs[("c", "b", 2)].indexed_at == "then"
    assert docs[("a", "b", 1)].title_vector == [] and docs[("a", "b", 1)].indexed_at
    assert sorted(r.reason for r in result.rejected.collect()) == ["malformed", "malformed", "missing:body"]
    assert rows(index_counts(result)) == [(3, 3)]
    assert rows(latest_versions(result.docs, ["version"]).select("id", "body")) == [("a", "later"), ("c", "b")]
    with pytest.raises(Exception, match="missing:body"):
        read_documents(spark, f"file:{path}", strict=True).docs.collect()


def test_index_json_last_line_wins(spark, tmp_path, folder):
    path = tmp_path / "docs.jsonl"
    path.write_text("\n".join(json.dumps({"id": str(n % 5), "title": f"t{n}", "body": f"word{n}"}) for n in range(13)))
    index, _ = index_json(spark, f"file:{path}", folder("index"), IndexOptions(num_shards=2, num_buckets=2))
    assert rows(index.docs.select("id", "title")) == [("0", "t10"), ("1", "t11"), ("2", "t12"), ("3", "t8"), ("4", "t9")]


def test_index_json_writes_nothing_but_the_index(spark, tmp_path, folder, monkeypatch):
    staged = []
    monkeypatch.setattr("quillrank.sources.ordering.stage", lambda df, name: staged.append(name) or df)
    path = tmp_path / "docs.jsonl"
    path.write_text(json.dumps({"id": "a", "title": "t", "body": "b"}))
    index_json(spark, f"file:{path}", folder("index"), IndexOptions(num_shards=2))
    assert staged == []


def test_numbers_run_over_many_files(spark, tmp_path):
    for n in range(40):
        lines = [json.dumps({"id": f"{n}-{i}", "title": "t", "body": "b"}) for i in range(n % 5)]
        (tmp_path / f"f{n:02d}.jsonl").write_text("\n".join(lines))
    docs = read_numbered_documents(spark, f"file:{tmp_path}").docs.orderBy("version").collect()
    expected = [f"{n}-{i}" for n in range(40) for i in range(n % 5)]
    assert [d.id for d in docs] == expected and [d.version for d in docs] == list(range(1, len(expected) + 1))


def test_soft_cap():
    assert [soft_cap(n, 100) for n in (1, 100, 101)] == [100, 100, 200]
    assert soft_cap(7) == 7


def test_pages_to_documents_keeps_title_and_counts(spark):
    pages = spark.createDataFrame([(4, "''T''", "y" * 60), (5, "u", "short")], "seq long, title string, raw string")
    docs = pages_to_documents(pages)
    assert rows(kept_documents(docs).select("id", "title", "shard")) == [("wiki_4", "''T''", 0)]
    assert rows(ingest_counts(docs)) == [(1, 1)]
