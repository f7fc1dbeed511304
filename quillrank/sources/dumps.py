"""Wiki XML dumps (plain or bz2) as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.sources.ordering import number_rows, with_position

PAGE = "page"
#: What is read of a page; ``bad`` holds a record that is not well-formed.
_SCHEMA = "title string, revision array<struct<text: string>>, bad string"
_OPTIONS = {
    "rowTag": PAGE,
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "bad",
    "ignoreNamespace": "true",
    "ignoreSurroundingSpaces": "false",
}
_FIRST_TAG = r"<(?:([\p{L}_][\w.-]*):)?[\p{L}_][\w.-]*"


def read_pages(
    spark: SparkSession, path: str, *, page_tag: str | None = None, max_docs: int = 0, on_error: str = "fail"
) -> DataFrame:
    """Valid pages as ``(seq, title, raw)``; ``seq`` is the page's 1-based place in file order.

    The page end tag separates records, so one huge file, compressed or not, is read by many
    tasks. Pages without title or first-revision text are dropped before numbering.
    ``max_docs`` keeps the first pages by number (0: all). Tags are read with the prefix that the dump's first tag has, or with that
    of ``page_tag``. ``on_error="skip"`` leaves malformed pages out; ``quarantined_pages`` has them.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError(f"on_error must be 'fail' or 'skip', not {on_error}")
    pages = _parsed(spark, path, page_tag)
    if on_error == "fail":
        message = F.concat(F.lit("a page is not well-formed XML: "), F.substring("bad", 1, 200))
        pages = pages.withColumn("title", F.when(F.col("bad").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("title")))
    else:
        pages = pages.where("bad IS NULL")
    numbered = number_rows(pages.where("title <> '' AND raw <> ''").drop("bad")).select("seq", "title", "raw")
    return numbered.where(F.col("seq") <= max_docs) if max_docs > 0 else numbered


def quarantined_pages(spark: SparkSession, path: str, *, page_tag: str | None = None) -> DataFrame:
    """Pages that ``read_pages`` leaves out: ``(reason, title, xml)``, ``xml`` being the record of a malformed page."""
    reason = (
        F.when(F.col("bad").isNotNull(), "malformed")
        .when(F.coalesce("title", F.lit("")) == "", "title missing")
        .when(F.coalesce("raw", F.lit("")) == "", "text missing")
    )
    return _parsed(spark, path, page_tag).select(reason.alias("reason"), "title", F.col("bad").alias("xml")).where("reason IS NOT NULL")


def malformed_pages(spark: SparkSession, path: str, *, page_tag: str | None = None) -> DataFrame:
    """Page chunks that are not well-formed XML."""
    return quarantined_pages(spark, path, page_tag=page_tag).where("reason = 'malformed'").select("xml")


def first_prefix(spark: SparkSession, path: str) -> str:
    """The prefix of the dump's first tag, empty if it has none; reads no more than the beginning of a file."""
    tags = spark.read.option("lineSep", ">").text(path)
    found = tags.select(F.regexp_extract("value", _FIRST_TAG, 0).alias("tag"), F.regexp_extract("value", _FIRST_TAG, 1).alias("prefix"))
    first = found.where("tag <> ''").first()
    return first.prefix if first is not None else ""


def _parsed(spark: SparkSession, path: str, page_tag: str | None) -> DataFrame:
    """``title, raw, bad`` of each page, from one parse, with its file and split."""
    if page_tag is None:
        prefix = first_prefix(spark, path)
        page_tag = f"{prefix}:{PAGE}" if prefix else PAGE
    # The generator keeps the conditions that follow from parsing a second time.
    page = F.from_xml(F.col("xml"), _SCHEMA, _OPTIONS)
    rows = _page_chunks(spark, path, page_tag).select("src_file", "src_block", F.inline(F.array(page)))
    return rows.select("title", F.try_element_at("revision", F.lit(1))["text"].alias("raw"), "bad", "src_file", "src_block")


def _page_chunks(spark: SparkSession, path: str, page_tag: str) -> DataFrame:
    end_tag = f"</{page_tag}>"
    start = rf"<{re.escape(page_tag)}[\s>]"
    lines = with_position(spark.read.option("lineSep", end_tag).text(path))
    at = F.regexp_instr("value", F.lit(start))
    return lines.where(at > 0).select(
        F.concat(F.expr(f"substring(value, regexp_instr(value, '{_sql_text(start)}'))"), F.lit(end_tag)).alias("xml"),
        "src_file",
        "src_block",
    )


def _sql_text(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")
