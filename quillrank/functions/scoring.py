"""Ranking formulas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking model.
K1 = 1.2
B = 0.75
RRF_K = 60
SCORE_DIGITS = 6
DEFAULT_LIMIT = 20
MAX_LIMIT = 1000
DEFAULT_ALPHA = 0.5
WIDENED_LIMIT = 200


@dataclass(frozen=True)
class Bm25:
    """BM25 parameters.

    ``length_norm="quantized"`` stores a field length in one byte, as inverted-index libraries
    do: exact below 40, then eight steps per power of two.
    """

    k1: float = K1
    b: float = B
    length_norm: str = "exact"

    def __post_init__(self):
        if self.length_norm not in ("exact", "quantized"):
            raise ValueError(f"unknown length_norm: {self.length_norm}")

    def term_weight(self, tf: Column, dl: Column, idf: Column, avg_dl: Column) -> Column:
        length = quantized_length(dl) if self.length_norm == "quantized" else dl
        saturation = tf + F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * length / avg_dl)
        return idf * F.lit(self.k1 + 1) * tf / saturation


def inverse_document_frequency(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def quantized_length(dl: Column) -> Column:
    """Field length after the one-byte encoding (rounded down to a step)."""
    above = dl - F.lit(24)
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(above, F.lit(1)))) - 3)).cast("int")
    return F.when(dl < 40, dl).otherwise(F.lit(24) + above - above % step)


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)


def retrieval_limit(limit: Column) -> Column:
    """Hits each shard hands to fusion: twice the limit, at most 200, never under the limit."""
    return F.greatest(limit, F.least(limit * 2, F.lit(WIDENED_LIMIT)))


def weighted_score(keyword: Column, semantic: Column, alpha: Column) -> Column:
    return alpha * keyword + (F.lit(1.0) - alpha) * semantic


def rrf_score(keyword_rank: Column, semantic_rank: Column, k: int = RRF_K) -> Column:
    # Double divisors: a bare literal would make these decimals and lose digits.
    return F.lit(1.0).cast("double") / (F.lit(k) + keyword_rank).cast("double") + F.lit(1.0).cast("double") / (
        F.lit(k) + semantic_rank
    ).cast("double")
