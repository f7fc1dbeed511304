"""Best-fit packing: documents as token sequences of bounded length, by bin completion."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import NO_ID, grouped, text_or_empty

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def encoder(ranks_path: str, vocabulary_path: str) -> Callable[[str], bytes]:
    """Token ids of a text as little-endian unsigned 32-bit numbers, from a file of ranks and the JSON file of the same vocabulary.

    The names of added tokens that the JSON file lists become those tokens also inside a text, as the ``tokenizers`` library does it
    by default. The ids are that library's; this encoder needs a fifth of its time.
    """
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(vocabulary_path, encoding="utf-8") as vocabulary:
        added = {token["content"]: token["id"] for token in json.load(vocabulary)["added_tokens"]}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: np.array(encoding.encode(text, allowed_special="all"), dtype="<u4").tobytes()


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, bytes]]:
    """Pieces of at most ``capacity`` tokens with their starts; only the first may be shorter."""
    n = len(ids) // 4
    start, end = 0, (n - 1) % capacity + 1
    while start < n:
        yield start, ids[4 * start : 4 * end]
        start, end = end, end + capacity


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """The pieces of all documents: ``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit), no shuffle.

    A document's ids are those of its whole text (null: empty) and ``end_id``; longer ones than ``capacity`` are cut. Repeated
    rows give repeated pieces. ``tokenizer`` names a file of ranks and a JSON file of one vocabulary that every executor can open.
    """
    paths = tokenizer or (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    end = end_id.to_bytes(4, "little")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for k, (start, ids) in enumerate(cut(encode(text.as_py()) + end, capacity)):
                    rows.append((doc_id, k, start, len(ids) // 4, ids))
                    held += len(ids)
                if held > 8 << 20:
                    yield to_batch(rows)
                    rows, held = [], 0
            if rows:
                yield to_batch(rows)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids"]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(tokenize, PIECES)


def least_bins(sizes: list[int], capacity: int) -> int:
    """Lower bound of the number of bins (Martello and Toth's L2): items over half a bin need one each, and
    those of at least a given size only fit into what the smaller of these leave."""
    counts = [0] * (capacity + 1)
    for s in sizes:
        counts[s] += 1
    half = capacity // 2
    above = sum(counts[half + 1 :])
    best = -(-sum(sizes) // capacity)
    big_n, big_sum, small_sum = above, sum(s * counts[s] for s in range(half + 1, capacity + 1)), sum(s * counts[s] for s in range(1, half + 1))
    for least in range(1, half + 1):
        # Items over capacity - least leave no room for what is counted.
        s = capacity - least + 1
        big_n, big_sum = big_n - counts[s], big_sum - s * counts[s]
        best = max(best, above + max(0, -(-(small_sum - (big_n * capacity - big_sum)) // capacity)))
        small_sum -= least * counts[least]
    return best


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of sizes."""
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    bins: list[list[int]] = []
    for size in sorted(sizes, reverse=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, []
            bins.append(chosen)
        chosen.append(size)
        by_room[room - size].append(chosen)
        rooms |= 1 << (room - size)
    return bins


def _dominated(filling: tuple[int, ...], slack: int, left: int) -> bool:
    """Whether another filling is at least as good: one where an item still left takes the place of some that are no
    larger together. ``left`` has a bit for each size that is left."""
    sums = {0: 0}
    for size in filling:
        for total, n in list(sums.items()):
            sums[total + size] = max(sums.get(total + size, 0), n + 1)
    del sums[0]
    for total, n in sums.items():
        more = left >> total if n > 1 else left >> total & ~1
        if more & ((1 << (slack + 1)) - 1):
            return True
    return False


def _fillings(counts: list[int], mask: int, room: int, waste: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """All undominated sets of items that leave at most ``waste`` of ``room``, large items first.

    Ends early when ``steps``, a counter that all levels of a search share, has run out.
    """
    stack: list[tuple[int, int, tuple[int, ...], int]] = [(room, room, (), mask)]
    while stack and steps[0] > 0:
        steps[0] -= 1
        rest, limit, chosen, left = stack.pop()
        if rest <= waste and not _dominated(chosen, rest, left):
            yield chosen
        fitting = left & ((1 << (min(rest, limit) + 1)) - 1)
        further = []
        while fitting:
            size = fitting.bit_length() - 1
            fitting &= ~(1 << size)
            further.append(size)
        for size in reversed(further):
            used = chosen.count(size) + 1
            stack.append((rest - size, size, (*chosen, size), left & ~(1 << size) if used >= counts[size] else left))


def _search(sizes: list[int], capacity: int, n_bins: int, steps: list[int]) -> list[list[int]] | None:
    """A solution of at most ``n_bins`` bins, if the search finds one within ``steps``."""
    allowed = n_bins * capacity - sum(sizes)
    counts = [0] * (capacity + 1)
    for s in sizes:
        counts[s] += 1
    mask = sum(1 << s for s in range(1, capacity + 1) if counts[s])
    wasted = 0
    bins: list[tuple[int, ...]] = []
    levels: list[Iterator[tuple[int, ...]]] = []

    def move(size: int, n: int) -> None:
        nonlocal mask
        counts[size] += n
        mask = mask | 1 << size if counts[size] else mask & ~(1 << size)

    def open_bin() -> None:
        largest = mask.bit_length() - 1
        move(largest, -1)
        bins.append((largest,))
        levels.append(_fillings(counts, mask, capacity - largest, allowed - wasted, steps))

    open_bin()
    while levels:
        largest, *before = bins[-1]
        for s in before:
            move(s, 1)
        chosen = next(levels[-1], None)
        if chosen is None:
            move(largest, 1)
            bins.pop()
            levels.pop()
            if bins:
                wasted -= capacity - sum(bins[-1])
            continue
        bins[-1] = (largest, *chosen)
        for s in chosen:
            move(s, -1)
        wasted += capacity - sum(bins[-1])
        if not mask:
            return [list(b) for b in bins]
        open_bin()
    return None


def bin_completion(sizes: list[int], capacity: int, max_steps: int = 40_000) -> list[list[int]]:
    """Bins (lists of sizes, each from 1 to ``capacity``) as few as the search finds.

    The incumbent is the best-fit solution. While it is above the lower bound, a depth-first search looks for one of
    fewer bins: it fills the bin of the largest item left in each undominated way, and turns back when the room
    wasted so far exceeds what a better solution may waste. The incumbent is optimal if it meets the bound, or if a search ends
    with fillings to spare: no filling is left out but dominated ones. After ``max_steps`` partial fillings in all, the search is given
    up and the incumbent taken, which may then be above the optimum.
    """
    best = best_fit(sizes, capacity)
    bound = least_bins(sizes, capacity)
    steps = [max_steps]
    while len(best) > bound and steps[0] > 0:
        found = _search(sizes, capacity, len(best) - 1, steps)
        if found is None:
            break
        best = found
    return best


def pack(pieces: DataFrame, capacity: int = 1024, items_per_group: int = 4096, n_items: int | None = None) -> DataFrame:
    """``pieces`` (with ``doc_id, piece, length``) with ``sequence_id`` and ``offset``: its sequence and its place there.

    Pieces are dealt by hash into groups of about ``items_per_group``, each packed by itself, which costs less than a
    sequence a group. ``n_items`` is the number of pieces if it is known; else they are counted. The other columns
    travel along and should be few. Lengths must be from 1 to ``capacity``.
    """
    n_items = pieces.count() if n_items is None else n_items
    groups = max(1, -(-n_items // items_per_group))
    place = F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(groups))
    schema = pieces.schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", sequence_id long, offset long"

    def place_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["_g"]):
            sizes = rows["length"].to_pylist()
            base = rows["_g"][0].as_py() << 32
            waiting: dict[int, list[int]] = {}
            for i in range(len(sizes) - 1, -1, -1):
                waiting.setdefault(sizes[i], []).append(i)
            sequence, offset = [0] * len(sizes), [0] * len(sizes)
            full = waiting.get(capacity, [])
            for k, i in enumerate(reversed(full)):
                sequence[i] = base + k
            rest = [s for s in sizes if s < capacity]
            for k, chosen in enumerate(bin_completion(rest, capacity) if rest else [], len(full)):
                at = 0
                for size in chosen:
                    i = waiting[size].pop()
                    sequence[i], offset[i] = base + k, at
                    at += size
            rows = rows.drop_columns(["_g"])
            rows = rows.append_column("sequence_id", pa.array(sequence, pa.int64()))
            yield from rows.append_column("offset", pa.array(offset, pa.int64())).to_batches()

    dealt = pieces.withColumn("_g", place).repartition("_g").sortWithinPartitions("_g", F.coalesce("doc_id", F.lit(NO_ID)), "piece")
    return dealt.mapInArrow(place_groups, out)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """All documents packed: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row per piece.

    A sequence's tokens are its pieces' (:func:`token_pieces`) in order of ``offset``; the ids are summed up by their
    checksum before the shuffle, as only lengths matter there. An empty or null text is its end token; repeated rows are
    packed each; an empty table gives none; other columns are not read.
    """
    pieces = token_pieces(docs, capacity, end_id, tokenizer)
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(narrow, capacity, n_items=docs.count())
