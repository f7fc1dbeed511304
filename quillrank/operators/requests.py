"""Query batches: defaults, validation, size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.scoring import DEFAULT_ALPHA, DEFAULT_LIMIT, MAX_LIMIT, retrieval_limit
from quillrank.functions.vectors import has_vector
from quillrank.session import stage

FUSIONS = ("rrf", "weighted")


@dataclass(frozen=True)
class Requests:
    """A batch ready to run, with the numbers that bound the sizes of its results."""

    rows: DataFrame
    n_queries: int
    max_limit: int
    total_limit: int

    def by_limit(self) -> list[Requests]:
        """The batch in parts of similar limits: in each, the largest limit for all queries is at most twice their own limits."""
        if self.n_queries * self.max_limit <= 2 * self.total_limit:
            return [self]
        level = F.ceil(F.log2("k"))
        sizes = self.rows.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("k"))
        parts: list[list[int]] = []  # highest level, lowest, queries, sum of limits, largest limit
        for size in sizes.orderBy(F.desc("level")).collect():  # a row per power of two
            if parts and (parts[-1][2] + size.n) * parts[-1][4] <= 2 * (parts[-1][3] + size.total):
                parts[-1][1:4] = size.level, parts[-1][2] + size.n, parts[-1][3] + size.total
            else:
                parts.append([size.level, size.level, size.n, size.total, size.k])
        return [Requests(self.rows.where(level.between(low, high)), n, k, total) for high, low, n, total, k in parts] or [self]


def check_queries(queries: DataFrame, *, default_limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Fill in defaults and add ``reason``: null for a valid query, else what is wrong with it.

    An id that several rows bear would mix their hits, so none of these is valid.
    """
    filled = queries.select(
        "query_id",
        "q",
        _optional(queries, "query_vector", "array<float>"),
        F.coalesce(_optional(queries, "limit", "int"), F.lit(default_limit)).alias("limit"),
        F.coalesce(_optional(queries, "alpha", "double"), F.lit(DEFAULT_ALPHA)).alias("alpha"),
        F.coalesce(_optional(queries, "fusion", "string"), F.lit("rrf")).alias("fusion"),
    )
    reason = (
        F.when(F.col("query_id").isNull(), F.lit("query_id missing"))
        .when(F.col("is_repeated"), F.lit("query_id repeated"))
        .when(F.coalesce(F.col("q"), F.lit("")) == "", F.lit("q missing"))
        .when(~F.col("limit").between(1, MAX_LIMIT), F.lit("limit out of range"))
        .when(~F.col("alpha").between(0.0, 1.0), F.lit("alpha out of range"))
        .when(~F.col("fusion").isin(*FUSIONS), F.lit("unknown fusion"))
    )
    repeated = queries.groupBy("query_id").count().where("count > 1").select("query_id", F.lit(True).alias("is_repeated"))
    marked = filled.join(repeated, "query_id", "left")
    return marked.withColumn("is_repeated", F.coalesce("is_repeated", F.lit(False))).withColumn("reason", reason).drop("is_repeated")


def _optional(queries: DataFrame, name: str, kind: str):
    column = F.col(name).cast(kind) if name in queries.columns else F.lit(None).cast(kind)
    return column.alias(name)


def rejected_queries(queries: DataFrame) -> DataFrame:
    return check_queries(queries).where("reason IS NOT NULL").select("query_id", "reason")


def prepare(queries: DataFrame, *, widen: bool = False) -> Requests:
    """Keep the valid queries, write them once, and measure the batch.

    ``k`` is the number of hits wanted from each shard; ``widen`` raises it for fusion.
    """
    valid = check_queries(queries).where("reason IS NULL").drop("reason")
    k = retrieval_limit(F.col("limit")) if widen else F.col("limit")
    rows = stage(valid.withColumn("k", k.cast("int")), "requests")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("k"), F.lit(1)).alias("k"), F.coalesce(F.sum("k"), F.lit(0)).alias("total")).first()
    return Requests(rows, size["n"], size["k"], size["total"])


def fusion_method(fusion, query_vector):
    """RRF only if asked for and a query vector exists, else the weighted sum."""
    return F.when((fusion == "rrf") & F.coalesce(has_vector(query_vector), F.lit(False)), F.lit("rrf")).otherwise(
        F.lit("weighted")
    )
