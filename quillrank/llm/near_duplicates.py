"""N-gram Jaccard join: MinHash bands find candidates, whole shingle sets decide."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import NO_ID, component_labels, grouped, keyed, stage, text_or_empty
from quillrank.llm.hashing import U64, mix, shingle_set

#: Members of a cluster that are compared in one task, and 64-bit hashes their sets may hold together, both as means.
BLOCK_ROWS = 1024
BLOCK_HASHES = 1 << 21


def choose_bands(threshold: float, recall: float = 0.99999, max_hashes: int = 160) -> tuple[int, int]:
    """``(bands, rows)``: the longest bands with which a pair at the threshold is found with probability ``recall``."""
    for rows in range(32, 1, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= max_hashes:
            return bands, rows
    return max_hashes, 1


def band_hashes(shingles: np.ndarray, bands: int, rows: int, chunk: int = 2048) -> np.ndarray:
    rng = np.random.default_rng(59)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, U64)
    for i in range(0, len(shingles), chunk):
        np.minimum(least, (shingles[None, i : i + chunk] * a[:, None] + b[:, None]).min(axis=1), out=least)
    bins = least.reshape(bands, rows)
    hashes = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        hashes = mix(hashes * U64(0x9E3779B97F4A7C15) + bins[:, j])
    return hashes.view(np.int64)


def _signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, _d, _t, digest, n, bands`` per document; the digest stands for the shingle set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, bands_of = [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py().encode(), k)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sizes.append(len(found))
                bands_of.append(band_hashes(found, bands, rows) if len(found) else np.zeros(0, np.int64))
            columns = [batch.column(c) for c in ("doc_id", "_d", "_t")]
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands_of])]).astype(np.int32)
            values = pa.array(np.concatenate(bands_of) if bands_of else np.zeros(0, np.int64))
            columns += [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_d", "_t", "digest", "n", "bands"])

    return docs.mapInArrow(sign, "doc_id long, _d long, _t long, digest binary, n long, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """The shingle sets as binary next to the columns ``digest, cluster, blocks, n_copies``."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = pa.array([shingle_set(t.as_py().encode(), k).tobytes() for t in part.column("text")], pa.binary())
                columns = [part.column(c) for c in ("digest", "cluster", "blocks", "n_copies")]
                yield pa.RecordBatch.from_arrays([*columns, sets], ["digest", "cluster", "blocks", "n_copies", "hashes"])

    return docs.mapInArrow(fill, "digest binary, cluster binary, blocks int, n_copies long, hashes binary")


def intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``; sets have distinct values."""
    if len(a) * len(b) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a])
    both = [*a, *b]
    rows = np.repeat(np.arange(len(both)), [len(x) for x in both])
    values, columns, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    keep = counts[columns] > 1
    rows, columns = rows[keep], shared[columns[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    total = np.zeros((len(a), len(b)), np.float64)
    n = int(shared[-1]) + 1 if len(shared) else 0
    for first in range(0, n, width):
        lo, hi = np.searchsorted(columns, [first, first + width])
        dense = np.zeros((len(both), min(width, n - first)), np.float32)
        dense[rows[lo:hi], columns[lo:hi] - first] = 1
        total += dense[: len(a)] @ dense[len(a) :].T
    return np.rint(total).astype(np.int64)


def local_labels(linked: np.ndarray) -> np.ndarray:
    """Least index reachable from each node of a symmetric link matrix."""
    labels = np.arange(len(linked))
    while True:
        least = np.where(linked, labels[None, :], len(labels)).min(axis=1, initial=len(labels))
        new = np.minimum(labels, least)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _distinct(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Sorted batches without rows that repeat the row before in ``keys``; such come from repeated rows of the table."""
    last = None
    for batch in batches:
        fresh = []
        for name in zip(*(batch.column(c).to_pylist() for c in keys), strict=True):
            fresh.append(name != last)
            last = name
        yield batch if all(fresh) else batch.filter(pa.array(fresh, pa.bool_()))


def _linked(clusters: DataFrame, threshold: float) -> DataFrame:
    """``digest, links, root`` for each member of each block pair: linked rows in it, and a member linked to it."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(_distinct(batches, ("cluster", "a", "b", "digest")), ["cluster", "a", "b"]):
            digests, copies = rows["digest"].to_pylist(), rows["n_copies"].to_numpy()
            sets = [np.frombuffer(x.as_buffer(), U64) for x in rows["hashes"]]
            block = rows["block"].to_numpy()
            left, right = np.flatnonzero(block == rows["a"][0].as_py()), np.flatnonzero(block == rows["b"][0].as_py())
            sizes = np.array([len(s) for s in sets])
            common = intersections([sets[i] for i in left], [sets[i] for i in right])
            union = sizes[left][:, None] + sizes[right][None, :] - common
            found = common >= threshold * union
            linked = np.zeros((len(sets), len(sets)), bool)
            linked[np.ix_(left, right)] = found
            linked |= linked.T
            np.fill_diagonal(linked, False)
            links = linked @ copies
            roots = local_labels(linked)
            some = np.flatnonzero(links)
            columns = [[digests[i] for i in some], links[some].tolist(), [digests[roots[i]] for i in some]]
            types = [pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["digest", "links", "root"])

    return clusters.mapInArrow(compare, "digest binary, links long, root binary")


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.99999) -> DataFrame:
    """``doc_id, _d, _t, n_links, class_id, kept`` for each document.

    Two documents are linked if the Jaccard similarity of their sets of ``k``-word runs is ``threshold`` or more.
    ``n_links`` counts the other documents linked to one, copies included; ``class_id`` is the least id that can be reached by
    links, ``kept`` marks the class's first document by (id, text hash). Texts with fewer words have one run of all
    their words; those without words (null, empty) are equal to each other. Repeated rows are linked like copies
    and marked alike. Missing ids come first; a class of such has a null id. An empty table gives an empty one.

    Documents of one set are one row from the start, however many there are. MinHash bands (their number and length
    from ``recall`` at the threshold) are shuffled by value; everything that meets in a band is tied to the band's
    first member, which makes clusters without writing pairs. Inside clusters all pairs are compared by their full sets,
    so a link that no band shows is found as well if others tie its ends. A cluster is cut by hash into blocks of bounded rows and
    hashes, and each pair of blocks is a task's group; it sums its links, so no row per pair leaves it.
    """
    bands, rows = choose_bands(threshold, recall)
    base = keyed(docs.select("doc_id", "text")).withColumn("text", text_or_empty())
    signed = stage(_signed(base, k, bands, rows), "signed")
    first = F.min(F.struct("_d", "_t")).alias("first")
    reps = signed.groupBy("digest").agg(first, F.count("*").alias("n_copies"), F.first("n").alias("n"))

    buckets = signed.filter("n > 0").select("digest", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("digest").alias("u"), F.max("digest").alias("v")).filter("u <> v")
    edges = buckets.join(shared.select("band", "u"), "band").select("u", F.col("digest").alias("v"))
    clusters = component_labels(edges, "clusters").select(F.col("node").alias("digest"), F.col("label").alias("cluster"))

    members = stage(clusters.join(reps, "digest"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("int")
    sizes = members.groupBy("cluster").agg(blocks.alias("blocks"))
    wanted = members.join(sizes, "cluster").select("first._d", "first._t", "digest", "cluster", "blocks", "n_copies")
    # Repeated rows have one key, and one of them is enough.
    texts = base.join(wanted, ["_d", "_t"]).select("digest", "cluster", "blocks", "n_copies", "text")
    sets = _sets(texts, k).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    other = sets.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = other.withColumns({"a": F.least("block", "_o"), "b": F.greatest("block", "_o")}).drop("_o", "blocks")
    dealt = dealt.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "digest")
    links = stage(_linked(dealt, threshold), "links")

    counts = links.groupBy("digest").agg(F.sum("links").alias("links"))
    labels = component_labels(links.select(F.col("digest").alias("u"), F.col("root").alias("v")), "classes")
    classes = reps.join(labels.withColumnRenamed("node", "digest"), "digest", "left").join(counts, "digest", "left")
    classes = classes.withColumn("label", F.coalesce("label", "digest"))
    heads = classes.groupBy("label").agg(F.min("first").alias("head"))
    classes = classes.join(heads, "label").select(
        "digest", "head", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links")
    )
    return signed.join(classes, "digest").select(
        "doc_id",
        "_d",
        "_t",
        "n_links",
        F.when(F.col("head._d") != NO_ID, F.col("head._d")).alias("class_id"),
        (F.struct("_d", "_t") == F.col("head")).alias("kept"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the first document of each class of near duplicates, once, in all its columns."""
    classes = jaccard_classes(docs, **options).filter("kept").select("_d", "_t").distinct()
    rows = keyed(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")))
    return rows.join(classes, ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"]).select("_row.*")
