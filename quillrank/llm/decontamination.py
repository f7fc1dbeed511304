"""Benchmark decontamination: test passages found in training documents by their word windows, and taken out."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import stage
from quillrank.llm.hashing import BASES, U64, Rolling, mix

#: Words after A-Z are lower-cased: runs of ASCII digits and letters and of anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of windows and item ids that one pass over the documents holds; more windows make more passes.
PASS_BYTES = 24 << 20
#: Bytes of text that are hashed at a time.
SLICE = 1 << 20

_UPPER = "".join(map(chr, range(65, 91)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

_FOUND = "n_words long, hits array<struct<first: int, last: int>>, items array<string>"


def benchmark_windows(benchmark: DataFrame, words: int = 10) -> DataFrame:
    """Distinct ``(item, k, gram)``: the windows of every item's normalised words, joined by a blank, and their size."""
    lowered = F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower())
    split = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lowered, F.lit(WORD), 0).alias("ws")
    ).where(F.size("ws") > 0)

    def window(i: Column) -> Column:
        return F.array_join(F.slice("ws", i, words), " ")

    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - F.lit(words - 1), F.lit(1)))
    return split.select("item", F.least(F.size("ws"), F.lit(words)).alias("k"), F.explode(F.transform(starts, window)).alias("gram")).distinct()


def find_windows(docs: DataFrame, benchmark: DataFrame, words: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``_row`` (all columns of ``docs``) with ``n_words``, ``hits`` and ``items``.

    ``hits`` are ranges of word numbers, ``first`` to before ``last``, in order and apart, that windows of the benchmark cover;
    ``items`` are the ids, as strings, of all items with a window in the document.

    The windows are the broadcast side: a set of hashes, and the windows themselves to verify what the hashes find. It is
    dealt by hash into as many parts as keep each within ``pass_bytes``, and each part is one pass over the documents that adds
    to what the ones before have found. Documents are never shuffled, so neither copies nor shared passages gather anywhere.
    """
    windows = stage(benchmark_windows(benchmark, words), "windows")
    size = windows.agg(F.coalesce(F.sum(F.octet_length("gram") + F.octet_length("item") + 200), F.lit(0))).first()[0]
    parts = max(1, -(-size // pass_bytes))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.lit(0).cast("long").alias("n_words"))
    rows = rows.withColumns({"hits": F.lit(None).cast("array<struct<first: int, last: int>>"), "items": F.lit(None).cast("array<string>")})
    sc = docs.sparkSession.sparkContext
    for part in range(parts):
        own = windows.where(F.pmod(F.xxhash64("gram", "item"), F.lit(parts)) == part).toArrow()
        held = sc.broadcast((uuid.uuid4().hex, own.to_pydict()))
        schema = rows.schema
        rows = rows.mapInArrow(lambda batches, held=held: _scan(batches, held), schema)
        if part + 1 < parts:
            rows = stage(rows, "leaks")
    return rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 10) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted strings) and ``contaminated``, replacing columns of these names.

    A window is ``words`` consecutive words of a benchmark item, or all words of a shorter one. Words inside any occurrence of a
    window are hit. Null and empty texts have no words and are clean; items without words have no window, an item without
    an id has the id ``""``, and rows with one id are one item. Repeated documents are each judged; no row is dropped.
    An empty table on either side gives clean rows, or none.
    """
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return find_windows(docs, benchmark, words).select(
        "_row.*" if not {"n_words", "n_hit", "items", "contaminated"} & set(docs.columns) else _others(docs),
        "n_words",
        hit.alias("n_hit"),
        F.array_sort("items").alias("items"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = 10, remove: str = "spans") -> DataFrame:
    """``docs`` without what the benchmark holds: ``remove`` says ``"spans"`` or whole ``"documents"``.

    A span goes from its first hit word to its last, with everything between. What stands around it stays as it is and is
    joined. Clean rows are untouched, null texts included; ``n_chars``, if there, is set for the others.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be 'spans' or 'documents', not {remove!r}")
    found = find_windows(docs, benchmark, words)
    if remove == "documents":
        return found.where(F.size("hits") == 0).select("_row.*")
    cut = found.mapInArrow(_cut, f"_row {docs.select(F.struct(*docs.columns).alias('r')).schema['r'].dataType.simpleString()}, text string, changed boolean")
    row = F.col("_row").withField("text", F.when(F.col("changed"), F.col("text")).otherwise(F.col("_row.text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(F.col("_row.n_chars")))
    return cut.select(row.alias("_row")).select("_row.*")


def _others(docs: DataFrame) -> Column:
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "contaminated")]
    return F.inline(F.array(F.struct(*[F.col(f"_row.{c}").alias(c) for c in kept])))


class _Windows:
    """Windows of one pass: sorted hashes to look up, by number of words, and the items of each window."""

    def __init__(self, rows: dict[str, list]):
        self.items: dict[bytes, tuple[str, ...]] = {}
        owners, sizes = defaultdict(list), defaultdict(set)
        for item, k, gram in zip(rows["item"], rows["k"], rows["gram"], strict=True):
            owners[gram.encode()].append(item)
            sizes[k].add(gram.encode())
        self.items = {gram: tuple(found) for gram, found in owners.items()}
        self.hashes = {}
        for k, grams in sizes.items():
            text = np.frombuffer(b"\0".join(grams), np.uint8)
            starts, ends = _words(text)
            self.hashes[k] = np.unique(_runs(Rolling(text)(starts, ends), k)[::k])


_held: tuple[str, _Windows] | None = None


def _windows(held) -> _Windows:
    """The broadcast windows, prepared once in a worker."""
    global _held
    key, rows = held.value
    if _held is None or _held[0] != key:
        _held = key, _Windows(rows)
    return _held[1]


def _words(lowered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(lowered) + 2, np.int8)
    inside[1:-1] = _IS_WORD[lowered]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each ``k`` consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * BASES[1] + hashes[j : j + n]
    return mix(out + U64(k))


def _slices(texts: list[bytes], overlap: int) -> Iterator[tuple[bytes, list[int], list[int], int]]:
    """Texts in slices of about ``SLICE`` bytes: the bytes, the places where documents begin, their numbers, and how many words
    of the first one were passed before. Short texts share a slice; of a long one each slice begins ``overlap`` words before the last ends.
    """
    small: list[bytes] = []
    places: list[int] = []
    numbers: list[int] = []
    filled = 0
    for number, text in enumerate(texts):
        if len(text) <= SLICE:
            if filled + len(text) > SLICE and small:
                yield b"\0".join(small), places, numbers, 0
                small, places, numbers, filled = [], [], [], 0
            small.append(text)
            places.append(filled)
            numbers.append(number)
            filled += len(text) + 1
            continue
        at, passed, length = 0, 0, SLICE
        while at < len(text):
            gap = _GAP.search(text, min(at + length, len(text)))
            end = gap.start() if gap else len(text)
            starts, _ = _words(_LOWER[np.frombuffer(text, np.uint8, end - at, at)])
            if end < len(text) and len(starts) <= overlap:
                length *= 2
                continue
            yield text[at:end], [0], [number], passed
            if end == len(text):
                break
            passed += len(starts) - overlap
            at += int(starts[len(starts) - overlap]) if overlap else end - at
            length = SLICE
    if small:
        yield b"\0".join(small), places, numbers, 0


def _scan(batches: Iterable[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    windows = _windows(held)
    overlap = max(windows.hashes, default=1) - 1
    for batch in batches:
        texts = [t or b"" for t in batch.column("_row").field("text").cast(pa.binary()).to_pylist()]
        n_words = np.zeros(len(texts), np.int64)
        hits: list[list[tuple[int, int]]] = [[(r["first"], r["last"]) for r in old or ()] for old in batch.column("hits").to_pylist()]
        items: list[set[str]] = [set(old or ()) for old in batch.column("items").to_pylist()]
        for text, places, numbers, passed in _slices(texts, overlap):
            lowered = _LOWER[np.frombuffer(text, np.uint8)]
            starts, ends = _words(lowered)
            firsts = np.searchsorted(starts, places)
            lasts = np.append(firsts[1:], len(starts))
            of = np.repeat(np.arange(len(numbers)), lasts - firsts)
            np.maximum.at(n_words, numbers, lasts - firsts + passed)
            hashes = Rolling(lowered)(starts, ends) if len(starts) else np.zeros(0, U64)
            joined = lowered.tobytes()
            for k, known in windows.hashes.items():
                runs = _runs(hashes, k)
                at = np.searchsorted(known, runs)
                at[at == len(known)] = 0
                met = np.flatnonzero((known[at] == runs) & (of[: len(runs)] == of[k - 1 :])) if len(runs) else []
                for i in met:
                    gram = b" ".join([joined[starts[j] : ends[j]] for j in range(i, i + k)])
                    if gram not in windows.items:
                        continue
                    one = int(of[i])
                    first = int(i - firsts[one]) + passed
                    hits[numbers[one]].append((first, first + k))
                    items[numbers[one]].update(windows.items[gram])
        out = {
            "_row": batch.column("_row"),
            "n_words": pa.array(n_words),
            "hits": pa.array([_merged(h) for h in hits], batch.schema.field("hits").type),
            "items": pa.array([sorted(i) for i in items], pa.list_(pa.string())),
        }
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def _merged(ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Ranges in order, joined where they touch."""
    out: list[dict[str, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1]["last"]:
            out[-1]["last"] = max(out[-1]["last"], last)
        else:
            out.append({"first": first, "last": last})
    return out


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts: list[str | None] = []
        for text, hits in zip(batch.column("_row").field("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
            if not hits:
                texts.append(None)
                continue
            raw = text.encode()
            starts, ends = _words(_LOWER[np.frombuffer(raw, np.uint8)])
            kept, at = [], 0
            for r in hits:
                kept.append(raw[at : starts[r["first"]]])
                at = int(ends[r["last"] - 1])
            texts.append(b"".join([*kept, raw[at:]]).decode())
        out = [batch.column("_row"), pa.array(texts, pa.string()), pa.array([t is not None for t in texts])]
        yield pa.RecordBatch.from_arrays(out, names=["_row", "text", "changed"])
