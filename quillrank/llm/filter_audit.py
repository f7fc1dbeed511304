"""Filter interaction audit: what each filter removes in every order, from the survivors of every subset of filters."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import NO_ID, stage

FILTERS = "ABCDE"
_SUBSETS = 1 << len(FILTERS)
#: Words kept before they are counted.
_PENDING = 1 << 20
_CAPITALS = bytes(range(65, 91))
_MARKS = re.compile(rb"[#$%&*|]")

#: For each set of failed filters the truth table of survival: bit S says that the subset S of filters lets the document pass.
SURVIVAL = np.array([sum(1 << s for s in range(_SUBSETS) if not s & failed) for failed in range(_SUBSETS)], np.uint32)


def failures(docs: DataFrame) -> DataFrame:
    """``id, part, failed, digest`` for each row: which of A to D it fails as bits, and 128 bits that name its text.

    A: under 50 words. B: under 65 distinct words in 100. C: over 5 capitals in 100 code points. D: any of ``#$%&*|``.
    """
    rows = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text"
    )
    return rows.mapInArrow(_failures, "id long, part string, failed int, digest binary")


def _failures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        failed, digests = [], []
        for text, points in zip(texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist(), strict=True):
            words = text.split()  # of bytes, this splits at the six ASCII blanks
            n, capitals = len(words), len(text) - len(text.translate(None, _CAPITALS))
            failed.append((n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | bool(_MARKS.search(text)) << 3)
            digests.append(blake2b(text, digest_size=16).digest())
        columns = [batch.column("id"), batch.column("part"), pa.array(failed, pa.int32()), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "failed", "digest"])


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, good, toxic`` for each row of ``docs``, E included in ``failed``.

    E: the text is that of a smaller ``doc_id`` anywhere. Only the least id of a text is looked for, by text and id together, so
    that copies, however many, never meet in one task: they are aggregated before they move and spread by their ids after.
    """
    rows = stage(failures(docs), "failures")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    judged = judged.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.when(F.col("first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    return (
        rows.join(firsts, ["digest", "id"], "left")
        .select("id", "part", F.col("failed").bitwiseOR(copy).alias("failed"))
        .join(judged, "id", "left")
        .select("part", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    )


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set, by carry-save adders.

    Three words of one weight become a sum of that weight and a carry of twice it, for all 32 positions at a time,
    until at most two words of each weight are left.
    """
    counts = np.zeros(32, np.int64)
    weight = 1
    while len(words):
        carries = []
        while len(words) > 2:
            n = len(words) // 3
            a, b, c, rest = words[:n], words[n : 2 * n], words[2 * n : 3 * n], words[3 * n :]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            words = np.concatenate([odd ^ c, rest])
        for word in words:
            counts += weight * ((int(word) >> np.arange(32)) & 1)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = ("all", "good", "toxic")
    pending: dict[tuple[str, str], list[np.ndarray]] = {}
    held = 0

    def counted() -> pa.RecordBatch:
        keys = list(pending)
        table = np.array([positional_counts(np.concatenate(pending[k])) for k in keys], np.int64).reshape(len(keys), _SUBSETS)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *map(pa.array, table.T)]
        return pa.RecordBatch.from_arrays(columns, names=["part", "label", *_BITS])

    for batch in batches:
        words = SURVIVAL[np.asarray(batch.column("failed"))]
        parts = batch.column("part").dictionary_encode()
        codes = np.asarray(parts.indices)
        chosen = {"all": np.ones(len(words), bool), **{k: batch.column(k).to_numpy(zero_copy_only=False) for k in kinds[1:]}}
        for kind in kinds:
            at = np.flatnonzero(chosen[kind])
            at = at[np.argsort(codes[at], kind="stable")]
            ends = np.flatnonzero(np.diff(codes[at], append=-1)) + 1
            for group in np.split(at, ends[:-1]):
                if len(group):
                    pending.setdefault((parts.dictionary[int(codes[group[0]])].as_py(), kind), []).append(words[group])
                    held += len(group)
        if held >= _PENDING:
            yield counted()
            pending.clear()
            held = 0
    if pending:
        yield counted()


_BITS = [f"s{i}" for i in range(_SUBSETS)]


def subset_survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, all, good, toxic``: for each part, arrays of how many documents the 32 subsets of filters let pass.

    Every document becomes one word of 32 bits, its truth table over the subsets; each task counts the bits of its words
    by position, and only its sums are shuffled.
    """
    sums = marked(docs, labels).mapInArrow(_count, "part string, label string, " + ", ".join(f"{b} long" for b in _BITS))
    rows = sums.groupBy("part", "label").agg(F.array(*[F.sum(b) for b in _BITS]).alias("n"))
    none = F.array_repeat(F.lit(0).cast("long"), _SUBSETS)

    def of(kind: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("label") == kind, F.col("n"))), none).alias(kind)

    return rows.groupBy("part").agg(of("all"), of("good"), of("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: what the step's filter keeps, removes and misses.

    Columns: ``part`` (``source``; null: empty), ``filter_order``, ``step`` (from 1), and counts within the part: ``kept`` after the step,
    ``removed`` by it, ``redundant`` (fail it, gone before), ``unique_fails`` (fail it only), ``good_lost`` and ``toxic_lost`` (removed by it with
    quality or toxic 1) and ``shapley`` (what the filter removes, summed over all orders).

    Null texts count as empty. A missing ``doc_id`` sorts before all others, has no label, and rows that agree in id and text are no copies
    of each other. Repeated rows count each; an id with several labels has all of them. No documents give no rows.
    """
    parts = subset_survivors(docs, labels)
    n = F.col("all")
    shapley = []
    for bit in range(len(FILTERS)):
        own = 1 << bit
        terms = [
            F.lit(factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())) * (n[s] - n[s | own]) for s in range(_SUBSETS) if not s & own
        ]
        shapley.append(sum(terms[1:], terms[0]))
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    rows = parts.withColumn("shapley", F.array(*shapley)).withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = F.instr(F.lit(FILTERS), F.col("filter_order").substr(F.col("step"), F.lit(1))) - 1
    place = [F.instr("filter_order", f) for f in FILTERS]
    before = sum((F.when(p < F.col("step"), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(place)), F.lit(0))
    rows = rows.withColumns({"bit": bit, "before": before}).withColumn("own", F.expr("shiftleft(1, bit)"))
    after = F.col("before") + F.col("own")
    removed = n[F.col("before")] - n[after]
    return rows.select(
        "part",
        "filter_order",
        "step",
        n[after].alias("kept"),
        removed.alias("removed"),
        (n[0] - n[F.col("own")] - removed).alias("redundant"),
        (n[F.lit(_SUBSETS - 1) - F.col("own")] - n[_SUBSETS - 1]).alias("unique_fails"),
        *[(F.col(k)[F.col("before")] - F.col(k)[after]).alias(f"{k}_lost") for k in ("good", "toxic")],
        F.col("shapley")[F.col("bit")].alias("shapley"),
    )
