"""Equi-joins of a large table with a usually small one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes that a broadcast may hold by the bound of its rows.
MAX_BROADCAST_BYTES = 64 << 20
#: Bytes of a row of ids, words and numbers as a broadcast keeps it.
ROW_BYTES = 160


def max_broadcast_rows(row_bytes: int = ROW_BYTES) -> int:
    return MAX_BROADCAST_BYTES // row_bytes


def fits(small: DataFrame, max_rows: int) -> bool:
    """Whether ``small`` has at most ``max_rows`` rows; looks at no more than one row beyond."""
    return small.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    bound: int | None = None,
    row_bytes: int = ROW_BYTES,
    salts: int = 0,
    salt_by: str = "id",
) -> DataFrame:
    """Join ``big`` with ``small``: broadcast if its size is proven to fit, else shuffled.

    The proof is ``bound``, a row count ``small`` cannot exceed, or else counting its rows, times ``row_bytes``.
    When shuffled with ``salts``, the rows of one key on the big side are spread over that
    many tasks by hashing ``salt_by`` and the small side is repeated once per salt, so a hot
    key does not end up in one task.
    """
    max_rows = max_broadcast_rows(row_bytes)
    if bound <= max_rows if bound is not None else fits(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    if salts <= 1:
        return big.join(small, on, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def vector_row_bytes(rows: DataFrame, column: str) -> int:
    """Bytes of a row with a vector, by the longest vector there is."""
    longest = rows.agg(F.coalesce(F.max(F.size(column)), F.lit(0))).first()[0]
    return ROW_BYTES + 4 * max(0, longest)
