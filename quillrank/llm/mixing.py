"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word of the size count: a run of anything but space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 3.0
) -> DataFrame:
    """Targets of ``sources (source, source_size)``: ``source, source_size, target``.

    Sources take the ``weights`` in turn, by code point, null last. Together they get the total size, shared by
    weight; no target exceeds ``max_repeat`` times its source's size, and what a bounded source leaves goes to the others
    by weight. Filling all sources to one level ``target / weight`` and stopping each at its bound does that. In the order
    of their bounds per weight, the level is the greatest of what the rest would get if all earlier ones were
    stopped, so one ordered pass finds it. The input has a row per source, whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    sized = sources.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(max_repeat)))
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    stopped = F.coalesce(F.sum("bound").over(earlier), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    level = sized.withColumn("level", (total - stopped) / open_weight)
    level = level.withColumn("level", F.max("level").over(everything))
    return level.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("bound")).alias("target"))


def draw(seed: int, *names: str) -> Column:
    """A number from 0 to 1 that depends on the seed and the named columns only."""
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix_rates(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 3.0, seed: int = 17
) -> DataFrame:
    """``docs`` with ``size, source_size, target, n_copies``: how often the mix takes each document.

    A source's rate is its target over its size. A document is taken floor(rate) times, and once more if its
    own draw is below the rate's fraction. The draw hashes the seed, the id and the source, so reruns agree and it
    does not matter where a row is processed; repeated rows have the same draw. Sizes are summed per task before they are
    shuffled, so a source with a third of all rows costs no more than others. The join with the targets is
    a broadcast only where Spark sees a small table, and else a join whose heavy keys adaptive execution splits. Null and
    empty texts have size 0 and follow their source's rate; a source of size 0 gets target 0 and is not taken. An empty
    table gives an empty one. Columns of ``docs`` with one of the new names are replaced.
    """
    added = ("size", "source_size", "target", "n_copies")
    docs = docs.drop(*added).withColumn("size", word_count())
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeat).select(F.col("source").alias("_s"), "source_size", "target")
    mixed = docs.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = F.when(draw(seed, "doc_id", "source") < rate - whole, 1).otherwise(0)
    return mixed.withColumn("n_copies", (whole + extra).cast("int"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as :func:`mix_rates` says, in the columns of ``docs``."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    taken = mix_rates(rows, **options).filter("n_copies > 0")
    repeated = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    return repeated.select("_row.*")
