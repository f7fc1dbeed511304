"""A dictionary of stems: each distinct word is stemmed once, and rows look their stems up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.functions.stemming import with_stem
from quillrank.operators.joins import max_broadcast_rows
from quillrank.session import stage


@dataclass(frozen=True)
class Dictionary:
    """``words (word, stem, n)``, ``n`` being the rows that hold the word, and those of them that were not known before.

    Both are written tables: no filter on a stem is pushed into the steps that make it.
    """

    words: DataFrame
    added: DataFrame


def dictionary(rows: DataFrame, column: str, known: DataFrame | None = None) -> Dictionary:
    """The stems of the words in ``column`` of ``rows``; those that ``known (word, stem)`` has are not stemmed again."""
    words = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("word")).agg(F.count("*").alias("n"))
    # Few bytes, but much work for each: small partitions must not be joined into one task.
    words = words.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if known is None:
        found = stage(with_stem(words, "word", "stem").select("word", "stem", "n"), "stems")
        return Dictionary(found, found.select("word", "stem"))
    words = stage(words, "words")
    new = stage(with_stem(words.join(known, "word", "left_anti"), "word", "stem").select("word", "stem", "n"), "stems")
    old = words.join(known, "word").select("word", "stem", "n")
    return Dictionary(stage(old.unionByName(new), "stems"), new.select("word", "stem"))


def stemmed(rows: DataFrame, column: str, found: Dictionary, max_rows: int | None = None, num_buckets: int = 0) -> DataFrame:
    """``rows`` with the words of ``column`` made their stems; null stays null.

    A dictionary that fits is broadcast. Of a larger one the frequent words are, down to the power of two from which on they fit; what they
    leave are words of few rows each, so the shuffle by word that finds their stems has no hot key. Rows that are bucketed by id into ``num_buckets`` stay so.
    """
    max_rows = max_broadcast_rows() if max_rows is None else max_rows
    order = rows.columns
    level = F.floor(F.log2("n")).cast("int")
    sizes = found.words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    least, held = None, 0
    for size in sizes:  # at most 63
        held += size["count"]
        if held > max_rows:
            break
        least = size.level
    else:
        least = 0
    stems = found.words.select(F.col("word").alias(column), F.col("stem").alias("_stem"), level.alias("_level"))
    if least is None:
        # Not even the most frequent words fit.
        return rows.join(stems.drop("_level"), column, "left").drop(column).withColumnRenamed("_stem", column).select(*order)
    frequent = stems if least == 0 else stems.where(F.col("_level") >= least)
    looked = rows.join(F.broadcast(frequent.drop("_level")), column, "left")
    if least > 0 and num_buckets:
        # A union would lose the buckets, so the stems of a document's rare words come to its rows, where they differ from the words.
        rare = stems.where((F.col("_level") < least) & (F.col("_stem") != F.col(column))).drop("_level").withColumnRenamed("_stem", "_rare")
        of = looked.where(F.col("_stem").isNull()).select("id", column).join(rare, column)
        of = of.repartition(num_buckets, "id").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct(column, "_rare"))).alias("_of"))
        looked = looked.join(of.hint("shuffle_hash"), "id", "left")
        own = F.coalesce(F.try_element_at("_of", F.col(column)), F.col(column))
        looked = looked.withColumn("_stem", F.when(F.col("_stem").isNotNull(), F.col("_stem")).otherwise(own)).drop("_of")
    elif least > 0:
        rare = stems.where(F.col("_level") < least).select(column, F.col("_stem").alias("_rare"))
        rest = looked.where(F.col("_stem").isNull()).join(rare, column, "left").withColumn("_stem", F.col("_rare")).drop("_rare")
        looked = looked.where(F.col("_stem").isNotNull()).unionByName(rest)
    return looked.drop(column).withColumnRenamed("_stem", column).select(*order)
