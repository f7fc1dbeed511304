"""Suffix-array dedup: bytes covered by long strings that start elsewhere too are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import grouped, keyed, stage, text_or_empty
from quillrank.llm.hashing import BASES, U64, Rolling, mix
from quillrank.llm.suffix_sort import order_suffixes

#: Bytes of an anchor. Any string of the wanted length holds one, chosen by its content.
GRAM = 64
#: Windows whose anchors are chosen at once, and the bits of a position among them.
CHUNK, POSITION_BITS = 1 << 21, 24
#: Contexts of one anchor that are sorted in one task; beyond it windows are counted by digest instead.
MAX_SORTED = 16_384
#: Windows sorted together in a task.
SORT_WINDOWS = 1 << 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, x
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(least[:n], least[width - size : width - size + n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts of ``length``-byte windows that share an anchor: ``gram, context, lo, last, offset``.

    A window's anchor is its substring of ``GRAM`` bytes with the least hash, the leftmost of several. So equal windows have
    equal anchors at equal places. ``lo`` and ``last`` are a run's first and last start; the context is a hash of the
    bytes of all its windows and of the anchor's place in them, ``offset`` bytes after ``lo``.
    """
    low = U64((1 << POSITION_BITS) - 1)
    parts = []
    for base in range(0, len(data) - length + 1, CHUNK):
        own = data[base : base + CHUNK + length - 1]
        grams = Rolling(own).grams(GRAM)
        keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        least = _sliding_min(keys, length - GRAM + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        at = (least[first] & low).astype(np.int64)
        context = mix(Rolling(own, 1).raw(first, last + length) + (last - first).astype(U64) * BASES[0] + (at - first).astype(U64))
        parts.append((grams[at].view(np.int64), context.view(np.int64), first + base, last + base, at - first))
    return tuple(np.concatenate(columns) for columns in zip(*parts, strict=True))


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    names = ["_d", "_t", "gram", "context", "lo", "last", "offset"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            n = 0
            for d, t, text in zip(batch.column("_d").to_pylist(), batch.column("_t").to_pylist(), batch.column("text"), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if len(data) < length:
                    continue
                found = anchors(data, length)
                held.append((np.full(len(found[0]), d), np.full(len(found[0]), t), *found))
                n += len(found[0])
                if n > 1 << 18:
                    yield rows(held)
                    held, n = [], 0
            if held:
                yield rows(held)

    def rows(held: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int16()]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, types, strict=True)], names)

    return docs.mapInArrow(find, "_d long, _t long, gram long, context long, lo int, last int, offset short")


def _packed(docs: DataFrame) -> DataFrame:
    """Documents with their bytes compressed for the shuffle."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tight = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([tight.compress(x.as_buffer()) for x in batch.column("text")], pa.binary())
            columns = [batch.column(c) for c in ("doc_id", "_d", "_t")]
            yield pa.RecordBatch.from_arrays([*columns, packed], ["doc_id", "_d", "_t", "packed"])

    return docs.mapInArrow(squeeze, "doc_id long, _d long, _t long, packed binary")


def _contexts(placed: DataFrame, length: int) -> DataFrame:
    """The bytes of contexts, from documents joined with a list of places in them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[tuple] = []
            for packed, places in zip(batch.column("packed"), batch.column("places"), strict=True):
                text = loose.decompress(packed.as_buffer())
                for p in places.as_py():
                    rows.append((p["gram"], p["context"], p["n"], p["hot"], text[p["lo"] : p["last"] + length]))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "context", "n", "hot", "bytes"])

    return placed.mapInArrow(read, "gram long, context long, n long, hot boolean, bytes binary")


def _windows_of(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of the given lengths: the owner of each of their windows, and its start in the context."""
    counts = lengths - length + 1
    owner = np.repeat(np.arange(len(lengths)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _sorted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """``gram, context, starts``: the windows of a context that others of the same anchor have too, by suffix order."""

    def resolve(groups: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(groups)
        grams, names = rows["gram"].to_numpy(), rows["context"].to_numpy()
        fresh = np.ones(len(grams), bool)  # a context comes twice only from repeated rows
        fresh[1:] = (grams[1:] != grams[:-1]) | (names[1:] != names[:-1])
        grams, names, weight = grams[fresh], names[fresh], rows["n"].to_numpy()[fresh]
        texts = [np.frombuffer(x.as_buffer(), np.uint8) for x, f in zip(rows["bytes"], fresh, strict=True) if f]
        lengths = np.array([len(t) for t in texts])
        owner, start = _windows_of(lengths, length)
        base = np.cumsum(lengths) - lengths
        group = np.cumsum(np.concatenate([[0], grams[1:] != grams[:-1]]))
        order, rank = order_suffixes(np.concatenate(texts), base[owner] + start, group[owner], length)
        several = np.bincount(rank, weights=weight[owner[order]], minlength=len(order))[rank] > 1
        repeated = np.zeros(len(order), bool)
        repeated[order] = several
        repeated &= weight[owner] == 1
        found = np.flatnonzero(repeated)
        some, counts = np.unique(owner[found], return_counts=True)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        starts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(start[found].astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(grams[some]), pa.array(names[some]), starts], ["gram", "context", "starts"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        n = 0
        for rows in grouped(batches, ["gram"]):
            waiting.append(rows)
            n += rows.num_rows * (length - GRAM) // 2
            if n > SORT_WINDOWS:
                yield resolve(waiting)
                waiting, n = [], 0
        if waiting:
            yield resolve(waiting)

    dealt = contexts.select("gram", "context", "n", "bytes").repartition("gram").sortWithinPartitions("gram", "context")
    return dealt.mapInArrow(sort, "gram long, context long, starts array<int>")


def _counted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with more contexts than a task should sort: windows meet by two 64-bit digests."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                texts = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("bytes")]
                lengths = np.array([len(t) for t in texts])
                owner, start = _windows_of(lengths, length)
                at = (np.cumsum(lengths) - lengths)[owner] + start
                both = [Rolling(np.concatenate(texts), base)(at, at + length).view(np.int64) for base in (0, 1)]
                kept = batch.select(["gram", "context", "n"]).take(pa.array(owner))
                columns = [*kept.columns, *map(pa.array, both), pa.array(start.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "context", "n", "w1", "w2", "start"])

    rows = contexts.dropDuplicates(["gram", "context"]).mapInArrow(digest, "gram long, context long, n long, w1 long, w2 long, start int")
    rows = stage(rows, "windows")
    several = rows.groupBy("w1", "w2").agg(F.sum("n").alias("total")).filter("total > 1").select("w1", "w2")
    found = rows.filter("n = 1").join(several, ["w1", "w2"])
    return found.groupBy("gram", "context").agg(F.collect_set("start").alias("starts"))


def repeated_spans(docs: DataFrame, length: int, max_sorted: int = MAX_SORTED) -> DataFrame:
    """``_d, _t, spans``: for documents with repeated strings, byte ranges ``s`` to ``e`` that these cover.

    ``docs`` are the keyed documents with ``text``. See :func:`remove_repeats` for the steps.
    """
    rows = stage(_anchor_rows(docs, length), "anchors")
    met = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
    met = met.filter("n > 1").select("gram", (F.col("a") != F.col("b")).alias("mixed"))
    matches = stage(rows.join(met, "gram"), "matches")
    mixed = matches.filter("mixed").drop("mixed")

    place = F.min(F.struct("_d", "_t", "lo", "last")).alias("place")
    contexts = stage(mixed.groupBy("gram", "context").agg(F.count("*").alias("n"), place), "contexts")
    sizes = contexts.groupBy("gram").agg((F.count("*") > max_sorted).alias("hot"))
    listed = contexts.join(sizes, "gram").select("place._d", "place._t", "gram", "context", "n", "hot", "place.lo", "place.last")
    places = listed.groupBy("_d", "_t").agg(F.collect_list(F.struct("gram", "context", "n", "hot", "lo", "last")).alias("places"))
    texts = stage(_contexts(_packed(docs).join(places, ["_d", "_t"]).select("packed", "places"), length), "context-bytes")
    alike = _sorted_repeats(texts.filter("not hot"), length)
    if not sizes.filter("hot").isEmpty():
        alike = alike.unionByName(_counted_repeats(texts.filter("hot"), length))

    span = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    whole = span(F.col("lo"), F.col("last") + length)
    sure = matches.filter("not mixed").select("_d", "_t", whole.alias("span"))
    several = mixed.join(contexts.filter("n > 1").select("gram", "context"), ["gram", "context"]).select("_d", "_t", whole.alias("span"))
    single = mixed.join(alike, ["gram", "context"]).withColumn("start", F.explode("starts"))
    single = single.select("_d", "_t", span(F.col("lo") + F.col("start"), F.col("lo") + F.col("start") + length).alias("span"))
    return sure.unionByName(several).unionByName(single).groupBy("_d", "_t").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, max_sorted: int = MAX_SORTED) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans`` for each document: its UTF-8 bytes (null text: empty) without those covered
    by a string of ``length`` bytes that also starts anywhere else, in this document or another.

    Matches do not cross documents; overlaps count; repeats are judged on the input, so all occurrences go. ``kept`` is binary, as a
    cut may part a character. ``n_spans`` counts maximal removed runs. Repeated rows are documents with the same text,
    which repeat each other. An empty table gives an empty one; other columns are not read. Lengths from 72 on work.

    1. Every window of ``length`` bytes has an anchor, chosen by content (``anchors``); windows that share one form a
       run, about one in 70 bytes. Runs are counted by anchor; an anchor that occurs once has no repeated window.
    2. Where all runs of an anchor have one context, all their windows are repeated; also where a context occurs twice.
    3. The other contexts, those at the ends of repeats, are read from the texts and sorted: their windows are suffixes, ordered by
       deep-shallow sorting, and neighbours that agree in ``length`` bytes are repeated.
       An anchor's contexts are sorted in one task, up to ``max_sorted``; beyond it their windows are counted by
       digest, which finds the same without gathering them.

    What is shuffled is 30 bytes a run, the texts twice, compressed, and the contexts of step 3.
    """
    base = keyed(docs.select(F.col("doc_id").cast("long"), "text")).withColumn("text", text_or_empty())
    spans = repeated_spans(base.select("doc_id", "_d", "_t", "text"), length, max_sorted)
    joined = _packed(base.select("doc_id", "_d", "_t", "text")).join(spans, ["_d", "_t"], "left").select("doc_id", "packed", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for packed, spans in zip(batch.column("packed"), batch.column("spans"), strict=True):
                text = loose.decompress(packed.as_buffer())
                if not spans.is_valid:
                    out.append((text, len(text), 0, 0))
                    continue
                covered = np.zeros(len(text) + 2, np.int32)
                s, e = (spans.values.field(c).to_numpy() for c in ("s", "e"))
                np.add.at(covered, s + 1, 1)
                np.add.at(covered, e + 1, -1)
                gone = np.cumsum(covered) > 0
                rest = np.frombuffer(text, np.uint8)[~gone[1:-1]].tobytes()
                out.append((rest, len(text), len(text) - len(rest), int((gone[1:] & ~gone[:-1]).sum())))
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
