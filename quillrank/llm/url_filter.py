"""URL filters: rule lists matched through hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest prefix that the join is on (32 bits).
PREFIX_DIGITS = 8
#: A rule list is broadcast below this size; a row holds two digests and the rule.
MAX_BROADCAST_BYTES = 32 << 20
#: Distinct shapes up to which every URL is expanded into all of them; with more, into those that rules of its own hosts have.
MAX_SHAPES = 256


def _lower(host: Column) -> Column:
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_host(url: str = "url") -> Column:
    return _lower(F.regexp_extract(F.col(url), r"://([^/?#]*)", 1))


def url_path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, id_column: str = "page_id", url_column: str = "url", default: str = "allow"
) -> DataFrame:
    """The rule that decides each URL: ``<id>, host, path, rule, verdict``, one row per row of ``pages``.

    ``rules (host, path, action)``: a rule fits its host and all subdomains of it when the URL's path starts with
    the rule's path. The longest rule (host and path together) wins; of equally long ones the one with the
    longer host, then ``block``. Without a rule the verdict is ``default``.

    A URL is expanded into expressions, one for each shape (labels of the host, length of the path) that some rule has, so
    their number follows from the rules and not from the URL. If rules have over ``MAX_SHAPES`` shapes, each suffix of the URL's host
    is first looked up, for the path lengths that its rules have. In hosts A-Z count as lower case, on both sides. Expressions meet rules by the first 32 bits of
    their digests; then the whole digests must agree. The rule list is broadcast if its summed size is below
    ``MAX_BROADCAST_BYTES``; else it is shuffled and repeated over salts, as one host may own a third of the
    URLs. Repeated rows are judged once and given back as often as they came. Null URLs, and those without
    ``://``, have an empty host and path and fit no rule. No rules, or no pages, are allowed. Other columns of ``pages``
    are not read.
    """
    rules = rules.select(
        _lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "action"
    ).distinct()
    labels = F.size(F.split("r_host", r"\."))
    shapes = sorted(rules.select(labels, F.length("r_path")).distinct().limit(MAX_SHAPES + 1).collect())
    listed = rules.withColumn("rule", F.concat("r_host", "r_path")).withColumn(
        "digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)
    )
    rank = F.struct(
        F.length("rule").alias("n"), F.length("r_host").alias("h"), (F.col("action") == "block").alias("b"), "rule", "action"
    )
    listed = listed.select("digest", F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"), rank.alias("rank"))
    n_bytes = listed.agg(F.coalesce(F.sum(F.length("rank.rule") + 128), F.lit(0))).first()[0]

    # Equal rows are judged once; their number brings them back at the end.
    distinct = pages.groupBy(F.col(id_column).alias("_id"), F.col(url_column).alias("_url")).agg(F.count("*").alias("_n"))
    parts = distinct.withColumn("host", url_host("_url")).withColumn("path", url_path("_url"))
    small = n_bytes <= MAX_BROADCAST_BYTES

    def looked_up(rows: DataFrame, known: DataFrame, on: str, how: str) -> DataFrame:
        if small:
            return rows.join(F.broadcast(known), on, how)
        salts = 64
        spread = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(salts)))
        copies = known.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        return spread.join(copies, [on, "_salt"], how).drop("_salt")

    if len(shapes) <= MAX_SHAPES:
        n_labels = F.size(F.split("host", r"\."))
        expressions = [
            F.when(
                (n_labels >= k) & (F.length("path") >= length),
                F.concat_ws("\n", F.substring_index("host", ".", -k), F.substring("path", 1, length)),
            )
            for k, length in shapes
        ]
        wanted = F.array_compact(F.array(*expressions)) if expressions else F.array().cast("array<string>")
        expanded = parts.withColumn("expression", F.explode_outer(wanted))
    else:
        most_labels = rules.agg(F.max(labels)).first()[0]
        lengths = rules.groupBy(F.col("r_host").alias("_suffix")).agg(F.collect_set(F.length("r_path")).alias("_lengths"))
        suffixes = F.expr(f"transform(sequence(1, least({most_labels}, size(split(host, '[.]')))), k -> substring_index(host, '.', -k))")
        found = looked_up(parts.withColumn("_suffix", F.explode(suffixes)), lengths, "_suffix", "inner")
        found = found.withColumn("_length", F.explode("_lengths")).where(F.col("_length") <= F.length("path"))
        found = found.withColumn("expression", F.concat_ws("\n", "_suffix", F.col("path").substr(F.lit(1), F.col("_length"))))
        expanded = found.select(*parts.columns, "expression").unionByName(parts.withColumn("expression", F.lit(None).cast("string")))
    expanded = expanded.withColumn("url_digest", F.sha2("expression", 256))
    expanded = expanded.withColumn("prefix", F.substring("url_digest", 1, PREFIX_DIGITS))
    met = looked_up(expanded, listed, "prefix", "left")
    confirmed = F.when(F.col("digest") == F.col("url_digest"), F.col("rank"))
    best = met.groupBy("_id", "_url", "_n", "host", "path").agg(F.max(confirmed).alias("best"))
    judged = best.select(
        F.col("_id").alias(id_column),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
        "_n",
    )
    return judged.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n", "_copy")
