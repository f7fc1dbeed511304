"""Embedding columns with user-supplied models."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillrank.functions.text import cache_key
from quillrank.functions.vectors import has_vector
from quillrank.operators.joins import fits, max_broadcast_rows, vector_row_bytes
from quillrank.session import stage

# Texts per model call.
BATCH_SIZE = 256
_HOT_TEXT_SALTS = 64
# A text is hot if over one row in so many has it.
_MAX_HOT_TEXTS = 1024

# Called once per Python worker; returns a function from a list of texts to a float32 matrix.
ModelFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def embedder(make_model: ModelFactory, *, batch_size: int = BATCH_SIZE):
    """A column function for ``make_model``; a batch whose call fails gets empty vectors."""

    def make_predict():
        model = make_model()

        def predict(texts: np.ndarray) -> np.ndarray:
            try:
                return np.asarray(model([t or "" for t in texts]), dtype=np.float32)
            except Exception as error:  # any model failure leaves the batch without vectors
                logging.getLogger(__name__).warning("embedding failed for %d texts: %s", len(texts), error)
                return np.zeros((len(texts), 0), dtype=np.float32)

        return predict

    return predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)


def embed_texts(
    rows: DataFrame,
    text: str,
    make_model: ModelFactory,
    *,
    into: str,
    salt_by: str,
    ignore_case: bool = True,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add a vector for column ``text``, calling the model once per distinct text.

    ``ignore_case`` lets texts that differ only in case or outer blanks share a vector.
    """
    key = cache_key(F.col(text)) if ignore_case else F.col(text)
    keyed = rows.withColumn("_key", F.coalesce(key, F.lit("")))
    distinct = keyed.groupBy("_key").agg(F.min(text).alias("_text"), F.count("*").alias("_n"))
    vectors = distinct.select("_key", "_n", embedder(make_model, batch_size=batch_size)("_text").alias(into))
    vectors = stage(vectors, "vectors")
    if fits(vectors, max_broadcast_rows(vector_row_bytes(vectors, into))):
        return keyed.join(F.broadcast(vectors.drop("_n")), "_key").drop("_key")
    hot, dealt = _salted(vectors)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_by), F.lit(_HOT_TEXT_SALTS))).otherwise(0).cast("int")
    left = keyed.join(F.broadcast(hot), "_key", "left").withColumn("_salt", salt).drop("_hot")
    return left.join(dealt, ["_key", "_salt"]).drop("_key", "_salt")


def _salted(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys that many of the rows have, which are few, and ``vectors`` with theirs once per salt and the others once."""
    least = vectors.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] / _MAX_HOT_TEXTS
    hot = vectors.where(F.col("_n") > least).select("_key", F.lit(True).alias("_hot"))
    salts = F.sequence(F.lit(0), F.when(F.col("_n") > least, F.lit(_HOT_TEXT_SALTS - 1)).otherwise(0))
    return hot, vectors.withColumn("_salt", F.explode(salts)).drop("_n")


def embed_missing_titles(docs: DataFrame, make_model: ModelFactory, **options) -> DataFrame:
    """Fill ``title_vector`` of the documents that have none; the others pass through untouched."""
    present = F.coalesce(has_vector(F.col("title_vector")), F.lit(False))
    lacking = docs.where(~present).drop("title_vector")
    filled = embed_texts(lacking, "title", make_model, into="title_vector", salt_by="id", **options)
    return docs.where(present).unionByName(filled.select(*docs.columns))


def embed_queries(queries: DataFrame, make_model: ModelFactory, **options) -> DataFrame:
    """Add ``query_vector`` from the query text."""
    rows = queries.drop("query_vector")
    return embed_texts(rows, "q", make_model, into="query_vector", salt_by="query_id", **options)


def embedding_failures(rows: DataFrame, key: str, text: str, into: str) -> DataFrame:
    """``(key)`` of rows with a text whose vector is missing or empty: the model failed on their batch."""
    lacking = ~F.coalesce(has_vector(F.col(into)), F.lit(False))
    return rows.where(lacking & (F.coalesce(F.btrim(text), F.lit("")) != "")).select(key)
