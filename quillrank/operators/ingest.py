"""Pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.routing import shard_of
from quillrank.functions.text import MIN_BODY_CHARS, clean_markup, is_long_enough


def pages_to_documents(
    pages: DataFrame, *, num_shards: int = 1, max_chars: int | None = None, min_chars: int = MIN_BODY_CHARS
) -> DataFrame:
    """All pages as documents with cleaned body, shard and a ``keep`` flag for the length filter.

    Bodies are whole unless ``max_chars`` is given; ``keep`` is false below ``min_chars``.
    """
    docs = pages.select(
        F.concat(F.lit("wiki_"), F.col("seq")).alias("id"),
        "title",
        clean_markup(F.col("raw"), max_chars).alias("body"),
    )
    return docs.select(
        "id",
        "title",
        "body",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("indexed_at"),
        F.array().cast("array<float>").alias("title_vector"),
        shard_of(F.col("id"), num_shards).alias("shard"),
        is_long_enough(F.col("body"), min_chars).alias("keep"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    return docs.where("keep").drop("keep")


def ingest_count_columns() -> list[Column]:
    return [F.count_if("keep").alias("written"), F.count_if(~F.col("keep")).alias("skipped")]


def ingest_counts(docs: DataFrame) -> DataFrame:
    """One row: documents written and skipped."""
    return docs.agg(*ingest_count_columns())


def latest_versions(docs: DataFrame, order: list[str]) -> DataFrame:
    """The last write per id, ordered by ``order``; combines map-side, so a hot id is harmless."""
    newest = F.max_by(F.struct(*docs.columns), F.struct(*order))
    return docs.groupBy("id").agg(newest.alias("doc")).select("doc.*")
