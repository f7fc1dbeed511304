"""JSON-lines documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.schemas import JSON_DOC
from quillrank.sources.ordering import file_order, number_rows, with_position

RAW_SCHEMA = JSON_DOC + ", _corrupt_record string"
_DOC_NAMES = ["id", "title", "body", "indexed_at", "title_vector"]


@dataclass(frozen=True)
class JsonLines:
    """``docs`` ready to index, ``rejected`` lines with a ``reason``."""

    docs: DataFrame
    rejected: DataFrame


def read_documents(spark: SparkSession, path: str, *, strict: bool = False) -> JsonLines:
    """Read documents; blank lines are skipped, unusable lines go to ``rejected``.

    ``strict=True`` raises on a well-formed line that lacks a required field, instead of
    rejecting it.
    """
    return split_documents(spark.read.schema(RAW_SCHEMA).json(path), strict)


def read_numbered_documents(
    spark: SparkSession,
    path: str,
    *,
    max_docs: int = 0,
    batch_size: int = 0,
    strict: bool = False,
) -> JsonLines:
    """Like ``read_documents``, with a ``version`` that numbers documents in file order, which writes them once.

    ``max_docs`` keeps the first documents (0: all). With ``batch_size`` the cap applies at
    batch ends only, so it rounds up to whole batches.
    """
    rows = split_documents(with_position(spark.read.schema(RAW_SCHEMA).json(path)), strict, ["src_file", "src_block"])
    docs = number_rows(rows.docs, "version").drop("src_file", "src_block", "src_row")
    if max_docs > 0:
        docs = docs.where(F.col("version") <= soft_cap(max_docs, batch_size))
    return JsonLines(docs, rows.rejected)


def read_ordered_documents(spark: SparkSession, path: str, *, strict: bool = False) -> JsonLines:
    """Like ``read_documents``, with a ``version`` that orders documents as their files do; nothing is written."""
    rows = split_documents(with_position(spark.read.schema(RAW_SCHEMA).json(path)), strict, ["src_file", "src_block"])
    return JsonLines(file_order(rows.docs), rows.rejected)


def soft_cap(max_docs: int, batch_size: int = 0) -> int:
    """The cap rounded up to whole batches; exact without a batch size."""
    return -(-max_docs // batch_size) * batch_size if batch_size > 0 else max_docs


def split_documents(raw: DataFrame, strict: bool = False, extra: list[str] | None = None) -> JsonLines:
    """Separate usable documents, with defaults filled in, from unusable lines."""
    missing = F.concat_ws(
        ",", *[F.when(F.col(name).isNull(), F.lit(name)) for name in ("id", "title", "body")]
    )
    tagged = raw.withColumn(
        "reason",
        F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed")).when(
            missing != "", F.concat(F.lit("missing:"), missing)
        ),
    )
    if strict:
        # The check sits in the id, and a filter needs the id, so no plan leaves it out.
        is_incomplete = F.col("reason").startswith("missing")
        tagged = tagged.withColumn(
            "id", F.when(is_incomplete, F.raise_error(F.col("reason")).cast("string")).otherwise(F.col("id"))
        )
        good = tagged.where((F.col("reason").isNull() | is_incomplete) & F.col("id").isNotNull())
    else:
        good = tagged.where(F.col("reason").isNull())
    docs = good.select(
        "id",
        "title",
        "body",
        F.coalesce("indexed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias(
            "indexed_at"
        ),
        F.coalesce("title_vector", F.array().cast("array<float>")).alias("title_vector"),
        *(extra or []),
    )
    rejected = tagged.where(F.col("reason").isNotNull()).select("reason", "id", "_corrupt_record")
    return JsonLines(docs, rejected)


def write_documents(docs: DataFrame, path: str, *, by_shard: bool = False, mode: str = "error") -> None:
    """Write documents as JSON lines, one ``shard=i`` folder per shard when ``by_shard``.

    The rebalance hint gathers a shard's rows to avoid tiny files and still splits a large
    shard over several tasks.
    """
    names = _DOC_NAMES + (["shard"] if by_shard else [])
    rows = docs.select(*names)
    if by_shard:
        rows.hint("rebalance", "shard").write.mode(mode).partitionBy("shard").json(path)
    else:
        rows.write.mode(mode).json(path)
