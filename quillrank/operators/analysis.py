"""Documents and queries to terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from quillrank.functions.text import MAX_TOKEN_BYTES, word_slots, words
from quillrank.operators.stems import Dictionary, dictionary, stemmed
from quillrank.schemas import FIELDS
from quillrank.session import stage

ANALYZERS = ("simple", "en_stem")
#: Words that are counted at once, more only if one field has more.
COUNTED_WORDS = 1 << 20


def terms(text: Column, *, slots: bool = False, max_bytes: int = MAX_TOKEN_BYTES) -> Column:
    """Words of ``text``; with ``slots`` the array index is the word position and gaps are null."""
    return word_slots(text, max_bytes) if slots else words(text, max_bytes)


def check_analyzer(analyzer: str) -> None:
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer: {analyzer}")


def analyzed(rows: DataFrame, analyzer: str, column: str = "term") -> DataFrame:
    """Rows with one word each, the word made the term that the analyzer makes of it. ``rows`` are computed twice."""
    check_analyzer(analyzer)
    return rows if analyzer == "simple" else stemmed(rows, column, dictionary(rows, column))


def document_words(docs: DataFrame, *, slots: bool = False, max_bytes: int = MAX_TOKEN_BYTES) -> DataFrame:
    """One row per document and field: ``(id, shard, field, words)``."""
    split = docs.select("id", "shard", *[terms(F.col(name), slots=slots, max_bytes=max_bytes).alias(name) for name in FIELDS])
    per_field = [F.struct(F.lit(name).alias("field"), F.col(name).alias("words")) for name in FIELDS]
    return split.select("id", "shard", F.inline(F.array(*per_field)))


def word_rows(docs: DataFrame, *, positions: bool = False, max_bytes: int = MAX_TOKEN_BYTES) -> DataFrame:
    """A row for each word of a document and field, as it is written, with the field's length.

    The outer explode is deliberate: Catalyst would analyze the text a second time for the non-empty
    filter it derives from the inner one.
    """
    fields = document_words(docs, slots=positions, max_bytes=max_bytes)
    if positions:
        fields = fields.withColumn("dl", F.size(F.array_compact("words")))
        rows = fields.select("shard", "field", "id", "dl", F.posexplode_outer("words").alias("position", "term"))
    else:
        fields = fields.withColumn("dl", F.size("words"))
        rows = fields.select("shard", "field", "id", "dl", F.explode_outer("words").alias("term"))
    return rows.where("term IS NOT NULL")


def counted_words(docs: DataFrame, *, max_bytes: int = MAX_TOKEN_BYTES) -> DataFrame:
    """A row for each distinct word of a document's field: ``shard, field, id, dl, term, tf``, of documents with unique ids.

    Words are counted in their lists, a bounded number at once; so no row is made for each word, nor are rows grouped.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("words")).to_numpy())
            first = 0
            while first < batch.num_rows:
                before = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + COUNTED_WORDS, "right")))
                yield from counted(batch.slice(first, last - first))
                first = last

    def counted(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = part.column("words")
        lengths = pc.list_value_length(words).to_numpy()
        coded = words.flatten().dictionary_encode()
        n = max(1, len(coded.dictionary))
        pairs, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * n + coded.indices.to_numpy(), return_counts=True)
        row, word = pairs // n, pairs % n
        for start in range(0, len(pairs), 1 << 16):
            at = slice(start, start + (1 << 16))
            columns = [part.column(name).take(pa.array(row[at])) for name in ("shard", "field", "id")]
            columns += [pa.array(lengths[row[at]].astype(np.int32)), coded.dictionary.take(pa.array(word[at])), pa.array(tf[at].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "field", "id", "dl", "term", "tf"])

    fields = document_words(docs, max_bytes=max_bytes)
    schema = StructType([fields.schema[name] for name in ("shard", "field", "id")])
    schema = schema.add("dl", IntegerType()).add("term", StringType()).add("tf", IntegerType())
    return fields.mapInArrow(count, schema)


def build_postings(docs: DataFrame, analyzer: str = "simple", *, positions: bool = False, max_bytes: int = MAX_TOKEN_BYTES) -> DataFrame:
    """Term frequency and field length per (document, field, term)."""
    return postings_and_stems(docs, analyzer, positions=positions, max_bytes=max_bytes)[0]


def postings_and_stems(
    docs: DataFrame,
    analyzer: str = "simple",
    *,
    positions: bool = False,
    max_bytes: int = MAX_TOKEN_BYTES,
    known: DataFrame | None = None,
    unique: bool = False,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    num_buckets: int = 0,
) -> tuple[DataFrame, Dictionary | None]:
    """Postings, and the dictionary of stems of an analyzer that has one.

    Partitioned by id (as a bucketed documents table is), postings need no shuffle. Of documents with ``unique`` ids the words are
    counted in their lists. For a dictionary these counts are written first, by ``keep``, which may bucket them by id into
    ``num_buckets``: of their distinct words those that ``known (word, stem)`` does not have are stemmed; then each row looks its stem
    up, and rows of a document that have one stem are added up. With positions, or ids that may repeat, texts are split twice instead.
    """
    check_analyzer(analyzer)
    if unique and not positions:
        rows = counted_words(docs, max_bytes=max_bytes)
        if analyzer == "simple":
            return rows.select("shard", "field", "term", "id", "tf", "dl"), None
        rows = keep(rows) if keep is not None else stage(rows, "words")
        found = dictionary(rows, "term", known)
        counted = stemmed(rows, "term", found, num_buckets=num_buckets).groupBy("shard", "field", "term", "id", "dl")
        return counted.agg(F.sum("tf").cast("int").alias("tf")).select("shard", "field", "term", "id", "tf", "dl"), found
    rows, found = word_rows(docs, positions=positions, max_bytes=max_bytes), None
    if analyzer != "simple":
        found = dictionary(word_rows(docs, max_bytes=max_bytes), "term", known)
        rows = stemmed(rows, "term", found)
    counts = [F.count("*").cast("int").alias("tf")]
    if positions:
        counts.append(F.array_sort(F.collect_list("position")).alias("positions"))
    counted = rows.groupBy("shard", "field", "term", "id", "dl").agg(*counts)
    return counted.select("shard", "field", "term", "id", "tf", "dl", *(["positions"] if positions else [])), found


def query_terms(
    queries: DataFrame, analyzer: str = "simple", *, dedupe: bool = True, max_bytes: int = MAX_TOKEN_BYTES
) -> DataFrame:
    """``(query_id, term)`` of a bag-of-words query; a repeated word counts once by default."""
    found = queries.select("query_id", F.explode(terms(F.col("q"), max_bytes=max_bytes)).alias("term"))
    found = analyzed(found, analyzer)
    return found.distinct() if dedupe else found
