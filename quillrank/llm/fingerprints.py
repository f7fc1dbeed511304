"""Document fingerprints: one-permutation MinHash with optimal densification, packed to four bits a bin."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.common import keyed, text_or_empty

BINS = 256
BITS = 4
PER_LONG = 64 // BITS
#: A bin is the top byte of a shingle hash, the rest decides which shingle of the bin is least.
BIN_SHIFT = 56
REST = (1 << BIN_SHIFT) - 1
#: Tries of an empty bin that are written out; later ones, rare, are a loop.
EARLY_TRIES = 8
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, k: int = 5) -> Column:
    """Hashes of all runs of ``k`` words, repeats included; of the whole text if it has fewer; none without words."""
    words = F.array_remove(F.split(text, SPACES), "")

    def of(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[h[i + j] for j in range(k)]))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= k, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _densified(least: Column) -> Column:
    """The low bits of each bin's least hash. An empty bin takes those of the first filled bin in its own probe order.

    The order is fixed by the bin's number: a random start and a random odd step, which visits all bins. It does not depend
    on the document, so two documents with equal filled bins fill the empty ones alike.
    """
    rng = random.Random(20170904)
    starts = F.array(*[F.lit(rng.randrange(BINS)) for _ in range(BINS)])
    steps = F.array(*[F.lit(rng.randrange(1, BINS, 2)) for _ in range(BINS)])

    def low(x: Column) -> Column:
        return F.when(x.bitwiseAND(F.lit(REST)) != REST, x.bitwiseAND(F.lit((1 << BITS) - 1)))

    def fill(x: Column, j: Column) -> Column:
        def attempt(a: Column | int) -> Column:
            return low(least[(starts[j] + steps[j] * a) % BINS])

        tries = [attempt(a) for a in range(EARLY_TRIES)]
        rest = F.aggregate(
            F.sequence(F.lit(EARLY_TRIES), F.lit(BINS - 1)), F.lit(None).cast("bigint"), lambda found, a: F.coalesce(found, attempt(a))
        )
        return F.coalesce(low(x), *tries, rest, F.lit(0).cast("bigint"))

    return F.transform(least, fill)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text, an array of 16 longs.

    Each shingle is hashed once; its hash names its bin and its rank in it. A marker at the end of every bin makes the
    sorted hashes hold each bin's least one first, and marks bins that are empty. Equal texts have equal fingerprints. A
    text without words (null, empty) has one of zeros.
    """
    # Signed order puts the bins in the order of the signed top byte; the numbering of bins follows it.
    markers = F.array(*[F.lit((j << BIN_SHIFT) | REST) for j in range(-BINS // 2, BINS // 2)])

    def firsts(s: Column) -> Column:
        new = lambda x, i: (i == 0) | (F.shiftright(x, BIN_SHIFT) != F.shiftright(s[F.greatest(i - 1, F.lit(0))], BIN_SHIFT))
        return F.filter(s, new)

    def packed(bits: Column) -> Column:
        def word(g: Column) -> Column:
            return F.aggregate(
                F.slice(bits, g * PER_LONG + 1, PER_LONG), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x)
            )

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), word)

    ordered = F.sort_array(F.concat(shingle_hashes(text), markers))
    return let(let(let(ordered, firsts), _densified), packed)


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two documents' shingles, from their packed fingerprints.

    Unequal hashes agree in their four bits one time in sixteen; the share of agreeing bins is corrected for that.
    """
    ones = F.lit(int("1" * PER_LONG, 16))

    def differing(x: Column) -> Column:
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(folded.bitwiseAND(ones))

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    chance = 1.0 / (1 << BITS)
    share = (F.lit(float(BINS)) - apart) / F.lit(float(BINS))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - chance) / (1 - chance)))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``fingerprint`` column (16 longs); no shuffle. A column of that name is replaced."""
    return docs.withColumn("fingerprint", fingerprint(text_or_empty()))


def next_rows(docs: DataFrame, columns: list[str], rows_per_range: int = 20_000, max_ranges: int = 1 << 14) -> DataFrame:
    """``docs`` with ``next_<c>`` for each of ``columns``: the value in the row with the next ``doc_id``, the first
    row's after the last.

    Ids are cut into ranges; a range is one window of one shuffle. The first row of each range also goes, as a guest, to
    the range before, so no second shuffle has to bring neighbours together; only range bounds reach the
    driver. Missing ids come first; rows with equal ids are ordered by their text's hash, then by the text. A single row
    is next to itself.
    """
    docs = keyed(docs)
    n, least = docs.agg(F.count("*"), F.min("_d")).first()
    if not n:
        return docs.drop("_d", "_t").withColumns({f"next_{c}": F.col(c) for c in columns})
    spark = docs.sparkSession
    ranges = min(max_ranges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // rows_per_range))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx("_d", shares, max(10_000, 20 * ranges))).first()[0] if shares else []
    cuts = sorted({int(c) for c in cuts or [] if int(c) > least})

    def range_of(d: Column) -> Column:
        """Number of cuts at or below the id, by bisection."""
        if not cuts:
            return F.lit(0)
        bounds = F.array(*[F.lit(c) for c in cuts]) if len(cuts) < 64 else F.from_json(F.lit(str(cuts)), "array<bigint>")
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

        def step(a: Column, _: Column) -> Column:
            mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
            upper = F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))
            lower = F.struct(a["lo"].alias("lo"), mid.alias("hi"))
            return F.when(a["lo"] >= a["hi"], a).when(F.element_at(bounds, mid + 1) <= d, upper).otherwise(lower)

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, step)["lo"]

    ranged = docs.withColumn("_range", range_of(F.col("_d")))
    heads = sorted(ranged.groupBy("_range").agg(F.min("_d")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads) if i}
    last = heads[-1][0]
    pairs = [x for head, r in before.items() for x in (F.lit(head), F.lit(r))]
    guest_of = F.try_element_at(F.create_map(*pairs), F.col("_d")) if pairs else F.lit(None).cast("int")
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest"))
    guest = F.when(guest_of.isNotNull(), F.struct(guest_of.alias("r"), F.lit(1).alias("guest")))
    around = F.when(F.col("_d") == least, F.struct(F.lit(last).alias("r"), F.lit(2).alias("guest")))
    placed = ranged.withColumn("_to", F.explode(F.array_compact(F.array(own, guest, around))))
    placed = placed.withColumns({"_r": F.col("_to.r"), "_guest": F.col("_to.guest")}).drop("_to", "_range")
    window = Window.partitionBy("_r").orderBy("_guest", "_d", "_t", "text")
    placed = placed.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns})
    return placed.filter("_guest = 0").drop("_d", "_t", "_r", "_guest")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of edited ones: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document's, by
    ascending id. Null texts count as empty. Repeated rows are kept, each next to the other. Other columns are not read.
    """
    base = docs.select("doc_id", text_or_empty().alias("text"))
    paired = next_rows(base.withColumn("fp", fingerprint(F.col("text"))), ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    edited = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    marked = edited.withColumn("edited_fp", fingerprint(F.col("edited")))
    return marked.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
