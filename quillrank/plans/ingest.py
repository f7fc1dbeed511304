"""Dump to JSON lines, JSON lines to index."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.text import MIN_BODY_CHARS
from quillrank.operators.embedding import ModelFactory, embed_missing_titles
from quillrank.operators.ingest import ingest_count_columns, kept_documents, pages_to_documents
from quillrank.operators.retrieval import Index
from quillrank.plans.index_store import IndexOptions, write_documents
from quillrank.session import index_buckets, input_bytes, stage
from quillrank.sources.dumps import read_pages
from quillrank.sources.jsonl import JsonLines, read_numbered_documents, read_ordered_documents
from quillrank.sources.jsonl import write_documents as write_json

def ingest_dump(
    spark: SparkSession,
    dump: str,
    output: str,
    *,
    num_shards: int = 1,
    max_docs: int = 0,
    max_chars: int | None = None,
    min_chars: int = MIN_BODY_CHARS,
    mode: str = "error",
    **reader,
) -> DataFrame:
    """Read a dump, clean and filter its pages, write documents; returns written/skipped counts.

    All pages are taken unless ``max_docs`` is given, and whole texts unless ``max_chars`` is. The counts are taken
    while the documents are written, so pages are cleaned once.
    """
    pages = read_pages(spark, dump, max_docs=max_docs, **reader)
    docs = pages_to_documents(pages, num_shards=num_shards, max_chars=max_chars, min_chars=min_chars)
    seen = Observation()
    counted = docs.observe(seen, *ingest_count_columns())
    write_json(kept_documents(counted), output, by_shard=num_shards > 1, mode=mode)
    counts = seen.get
    return spark.createDataFrame([(counts.get("written", 0), counts.get("skipped", 0))], "written long, skipped long")


def index_json(
    spark: SparkSession,
    path: str,
    root: str,
    options: IndexOptions = IndexOptions(),
    *,
    make_model: ModelFactory | None = None,
    max_docs: int = 0,
    batch_size: int = 0,
    strict: bool = False,
) -> tuple[Index, JsonLines]:
    """Index JSON-lines documents into ``root``; the last line of an id wins.

    Without ``make_model`` documents keep the vectors they bring, if any.
    """
    if max_docs > 0:
        lines = read_numbered_documents(spark, path, max_docs=max_docs, batch_size=batch_size, strict=strict)
    else:
        lines = read_ordered_documents(spark, path, strict=strict)
    docs = lines.docs
    if make_model is not None:
        docs = stage(embed_missing_titles(docs, make_model), "embedded")
    if not options.num_buckets:
        options = replace(options, num_buckets=index_buckets(spark, input_bytes(spark, path), options.positions))
    return write_documents(spark, root, docs, options), lines


def index_counts(lines: JsonLines) -> DataFrame:
    """One row: documents indexed (repeated ids included) and lines skipped."""
    one, none = F.lit(1), F.lit(0)
    rows = lines.docs.select(one.alias("indexed"), none.alias("skipped")).unionAll(
        lines.rejected.select(none.alias("indexed"), one.alias("skipped"))
    )
    return rows.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("indexed", "skipped")])
