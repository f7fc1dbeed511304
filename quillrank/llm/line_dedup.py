"""Line dedup: winnowed line hashes find passages that were there before, whole lines of them are deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import keyed, stage, text_or_empty
from quillrank.llm.mixing import WORD


def _reach(counts: Column, at: Column, words: int, *, back: bool) -> Column:
    """How many lines from ``at`` on (or back) have ``words`` words together; null if there are not so many.

    Counted lines have a word at least, so ``words`` lines always suffice and the look-ahead is bounded.
    """
    if back:
        first = F.greatest(at - F.lit(words - 1), F.lit(0))
        near = F.reverse(F.slice(counts, first + 1, at - first + 1))
    else:
        near = F.slice(counts, at + 1, words)
    # Words and lines so far, in one number.
    lines, enough = words + 1, words * (words + 1)
    summed = F.aggregate(
        near,
        F.lit(0).cast("long"),
        lambda a, x: F.when(a >= enough, a).otherwise(a + x * lines + 1),
        lambda a: F.when(a >= enough, (a % lines).cast("int")),
    )
    return F.when(counts[at] >= words, F.lit(1)).otherwise(summed)


def _windows(docs: DataFrame, words: int) -> DataFrame:
    """A row per window of each document: its lines ``lo`` to ``hi``, place ``s``, fingerprint and content hashes."""
    lines = F.transform(
        F.split(text_or_empty(), "\n"),
        lambda x, i: F.struct(
            i.alias("p"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("n"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g")
        ),
    )
    docs = docs.select("_d", "_t", lines.alias("_l"))
    docs = docs.select("_d", "_t", F.filter("_l", lambda x: x["n"] > 0).alias("_l"))
    docs = docs.select("_d", "_t", *[F.col(f"_l.{c}").alias(f"_{c}") for c in "pnhg"]).filter(F.size("_n") > 0)
    base = words + 1

    def codes(i: Column) -> Column:
        ahead, behind = _reach(F.col("_n"), i, words, back=False), _reach(F.col("_n"), i, words, back=True)
        return F.array(i * base + ahead, (i - behind + 1) * base + behind)

    every = F.transform(F.sequence(F.lit(0), F.size("_n") - 1), codes)
    docs = docs.withColumn("_w", F.array_distinct(F.array_compact(F.flatten(every))))

    def window(code: Column) -> Column:
        s, k = F.floor(code / base).cast("int"), (code % base).cast("int")
        own = F.slice(F.col("_h"), s + 1, k)
        least = F.array_min(own)
        return F.struct(
            s.alias("s"),
            F.col("_p")[s].alias("lo"),
            F.col("_p")[s + k - 1].alias("hi"),
            least.alias("fingerprint"),
            (s + F.array_position(own, least).cast("int") - 1).alias("at"),
            F.xxhash64(own).alias("w1"),
            F.xxhash64(F.slice(F.col("_g"), s + 1, k)).alias("w2"),
        )

    return docs.select("_d", "_t", F.explode(F.transform("_w", window)).alias("w")).select("_d", "_t", "w.*")


def repeated_lines(docs: DataFrame, words: int = 50) -> DataFrame:
    """Runs of lines that occurred before: ``_d, _t, runs``, runs being an array of line ranges ``lo, hi``.

    A window is a shortest run of lines, from a line onwards or back from a line, with ``words`` words or more. Any run that
    is repeated and has that many words is a union of windows which are repeated with it, and it shares
    with its other occurrence the least line hash of each of them, at the same place. So:

    1. The least line hash of every window is selected as a fingerprint; neighbouring windows select the same line, so there
       is one fingerprint for a few lines. Only these places are counted. What stands at one place only is dropped.
    2. The places of the others are joined with the windows that selected them: from the fingerprint, a match extends both ways
       to the bounds of each window whose lines agree, compared by two 64-bit hashes. The first occurrence by (id, text
       hash, place) stays, each later one is a run to delete.

    Texts are read once: windows are written as narrow rows. Fingerprints and windows are counted with partial aggregates, and no pairs
    are made: each occurrence meets only the first of its kind. The joins are plain equi-joins whose heavy keys adaptive execution splits.
    """
    windows = stage(_windows(keyed(docs.select("doc_id", "text")), words), "windows")
    place = F.struct("_d", "_t", "at")
    places = windows.select("fingerprint", "_d", "_t", "at").groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    met = places.filter("a <> b").select("fingerprint")
    matches = windows.join(met, "fingerprint", "left_semi")
    start = F.struct("_d", "_t", "s")
    first = matches.groupBy("w1", "w2").agg(F.min(start).alias("first"), F.max(start).alias("last")).filter("first <> last")
    later = matches.join(first.select("w1", "w2", "first"), ["w1", "w2"]).filter(start != F.col("first"))
    return later.groupBy("_d", "_t").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))


def dedup_lines(docs: DataFrame, words: int = 50, counts: bool = False) -> DataFrame:
    """``docs`` without the lines of passages of ``words`` words or more that occurred before.

    A passage is a run of consecutive lines; its first occurrence in order of ``doc_id`` (missing ids first, then text
    hash, then place) stays, later ones go, also within a document. Lines without a word belong to no
    passage by themselves, do not interrupt one, and go if they are inside. The rest keeps its order; a text may end up
    empty. Null texts stay null. Rows with equal id and text are copies of one document and treated alike: they do not
    delete each other. All columns of ``docs`` are kept; an ``n_chars`` column is set to the new length. With ``counts`` the
    columns ``n_lines`` and ``n_removed`` are added, or replaced. An empty table gives an empty one.
    """
    rows = keyed(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")))
    joined = rows.join(repeated_lines(docs, words), ["_d", "_t"], "left").select("_row", "runs")
    joined = joined.withColumn("_lines", F.split("_row.text", "\n"))
    dead = F.flatten(F.transform("runs", lambda r: F.sequence(r["lo"], r["hi"])))
    rest = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), dead)
    joined = joined.withColumn("_kept", F.when(F.col("runs").isNotNull(), rest))
    cut = F.array_join(F.transform("_kept", lambda i: F.col("_lines")[i]), "\n")
    out = joined.withColumn("_new", F.when(F.col("_kept").isNotNull(), cut))
    row = F.col("_row").withField("text", F.coalesce("_new", "_row.text"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("_new").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new").cast("long"))
        row = row.withField("n_chars", length)
    if counts:
        n_lines = F.coalesce(F.size("_lines"), F.lit(0))
        row = row.withField("n_lines", n_lines)
        row = row.withField("n_removed", F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)))
    return out.select(row.alias("_row")).select("_row.*")
