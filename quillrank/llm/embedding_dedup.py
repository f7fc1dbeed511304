"""Embedding near-dedup: an exact metric range join of blocks of vectors, dealt by pivot cells."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillrank.llm.common import component_labels, stage
from quillrank.llm.near_duplicates import local_labels

#: Vectors per cell that the number of pivots aims at, and the most pivots there are.
CELL_ROWS = 8192
MAX_PIVOTS = 1024
#: Numbers that a block may hold: its rows are this over the dimension.
BLOCK_NUMBERS = 1 << 19
#: Bytes of the blocks that one round broadcasts.
ROUND_BYTES = 32 << 20
#: Scores that are looked at together.
SCORES = 1 << 21


def _usable(vectors: DataFrame) -> DataFrame:
    """``v``, the vectors that are not null or zero and hold no null or number that is not finite, as floats or else doubles."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = vectors.select(F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.filter(F.exists("v", lambda x: x != 0))


def _number_type(rows: DataFrame) -> str:
    return "<f4" if isinstance(rows.schema["v"].dataType.elementType, FloatType) else "<f8"


def _node(x: np.ndarray) -> bytes:
    return hashlib.blake2b((x.astype(np.float64) + 0.0).tobytes(), digest_size=16).digest()


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The row numbers and the matrix of the vectors of each dimension in a list column without nulls."""
    dims = pc.list_value_length(column).to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        mine = column if len(at) == len(dims) else column.take(pa.array(at))
        yield at, mine.flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def choose_pivots(rows: DataFrame, n: int, cell_rows: int) -> dict[int, np.ndarray]:
    """A bounded hash sample of the vectors of each dimension, at most ``MAX_PIVOTS`` in all."""
    wanted = min(MAX_PIVOTS, max(1, -(-n // cell_rows)))
    pivots: dict[int, list] = {}
    for (v,) in rows.orderBy(F.xxhash64("v")).limit(wanted).collect():
        pivots.setdefault(len(v), []).append(v)
    return {dim: np.unique(_units(np.array(units)), axis=0) for dim, units in pivots.items()}


def _margin(dim: int) -> float:
    """More than a cosine of unit vectors rounded to single precision is off by."""
    return (dim + 8) * 2.0**-23


def _beyond(units: np.ndarray, pivots: np.ndarray, home: np.ndarray, cell: np.ndarray, radius: float) -> np.ndarray:
    """Whether a vector within ``radius`` of each of ``units``, whose cells are ``home``, may be at home in ``cell`` (one or several each).

    Let p be the pivot of the other cell and h that of the vector's own. A vector y at home with p is no nearer to h, so it lies beyond
    the plane between them, which x is (d(x,p)^2 - d(x,h)^2) / (2 d(p,h)) away from. Also y is within the cell's
    own radius of p at most 2 (all are unit vectors), so the plane is the bound that counts.
    """
    slack = 1e-9
    cosines = units @ pivots[cell].T
    own = np.einsum("ij,ij->i", units, pivots[home])[:, None]
    # Never less than the true distance, which rounding would make 0 for pivots of almost one direction.
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (pivots[home] @ pivots[cell].T)) + 1e-12)
    # d(x,p)^2 - d(x,h)^2 = 2 (cos(x,h) - cos(x,p)) for unit vectors; both vectors' cells are found with rounded cosines.
    beyond = own - cosines <= (radius + slack) * apart + 4 * _margin(units.shape[1])
    return beyond | (home[:, None] == cell[None, :])


def _cell_rows(rows: DataFrame, pivots: dict[int, np.ndarray], radius: float) -> DataFrame:
    """``dim, cell, word, bits, n``: vectors in each cell (``word`` -1), and in 64 bits each the cells that hold guests' neighbours."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        guests = {dim: np.zeros((len(p), len(p)), bool) for dim, p in pivots.items()}
        for batch in batches:
            for _, x in _matrices(batch.column("v")):
                dim = x.shape[1]
                p = pivots.get(dim)
                for first in range(0, len(x), 1024):
                    if p is None:
                        home = np.zeros(len(x[first : first + 1024]), np.int64)
                    else:
                        units = _units(x[first : first + 1024])
                        home = (units @ p.T).argmax(axis=1)
                        beyond = _beyond(units, p, home, np.arange(len(p)), radius)
                        for h in np.unique(home):
                            guests[dim][h] |= beyond[home == h].any(axis=0)
                    for h, n in zip(*np.unique(home, return_counts=True), strict=True):
                        counts[dim, int(h)] = counts.get((dim, int(h)), 0) + int(n)
        out = [(dim, h, -1, 0, n) for (dim, h), n in counts.items()]
        for dim, near in guests.items():
            packed = np.packbits(near, axis=1, bitorder="little")
            packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<i8")
            out += [(dim, int(h), int(w), int(packed[h, w]), 0) for h, w in zip(*np.nonzero(packed), strict=True)]
        types = {"dim": pa.int32(), "cell": pa.int32(), "word": pa.int32(), "bits": pa.int64(), "n": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types.values(), strict=True)], list(types))

    found = rows.mapInArrow(look, "dim int, cell int, word int, bits long, n long")
    return found.groupBy("dim", "cell", "word").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class _Plan:
    """The blocks: the first number of each cell's, how many these are, and of each block the dimension and cell; and which cells are near."""

    first: dict[tuple[int, int], int]
    blocks: dict[tuple[int, int], int]
    dims: np.ndarray
    cells: np.ndarray
    near: dict[int, np.ndarray]

    @staticmethod
    def of(cells: DataFrame, pivots: dict[int, np.ndarray]) -> _Plan:
        first, blocks, dims, of = {}, {}, [], []
        near = {dim: np.zeros((len(p), -(-len(p) // 64)), "<i8") for dim, p in pivots.items()}
        for r in sorted(cells.collect()):
            if r.word >= 0:
                near[r.dim][r.cell, r.word] = r.bits
                continue
            rows = max(1, BLOCK_NUMBERS // r.dim)
            first[r.dim, r.cell], blocks[r.dim, r.cell] = len(dims), -(-r.n // rows)
            dims += [r.dim] * blocks[r.dim, r.cell]
            of += [r.cell] * blocks[r.dim, r.cell]
        for dim, words in near.items():
            bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, : len(words)].astype(bool)
            near[dim] = bits & bits.T
        return _Plan(first, blocks, np.array(dims, np.int32), np.array(of, np.int32), near)

    def others(self, no: int) -> np.ndarray:
        """The blocks that block ``no`` is compared with: itself and, of each pair of near ones, every second in a circle."""
        n, dim = len(self.dims), self.dims[no]
        ahead = (np.arange(n) - no) % n
        mine = (2 * ahead < n) | ((2 * ahead == n) & (np.arange(n) > no))
        mine &= self.dims == dim
        if int(dim) in self.near:
            mine[mine] = self.near[int(dim)][self.cells[no], self.cells[mine]]
        return np.flatnonzero(mine).astype(np.int32)


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray], plan: _Plan) -> DataFrame:
    """A row per distinct vector, in order of blocks: ``no, node, n_copies, numbers``; a block is in one file."""
    spark = rows.sparkSession
    parts = max(1, min(len(plan.dims), 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _matrices(batch.column("v")):
                nodes = [_node(v) for v in x]
                names = np.frombuffer(b"".join(nodes), "<u8").reshape(-1, 2)
                # Copies are put together here already, so that a common vector is few rows of its partition.
                _, one, n_copies = np.unique(names, axis=0, return_index=True, return_counts=True)
                dim = x.shape[1]
                home = np.zeros(len(one), np.int64)
                for first in range(0, len(one), 1024) if dim in pivots else ():
                    home[first : first + 1024] = (_units(x[one[first : first + 1024]]) @ pivots[dim].T).argmax(axis=1)
                no = np.array([plan.first[dim, int(h)] for h in home], np.int64)
                no += (names[one, 0] % np.array([plan.blocks[dim, int(h)] for h in home], np.uint64)).astype(np.int64)
                columns = [pa.array((no * parts // len(plan.dims)).astype(np.int32)), pa.array(no.astype(np.int32))]
                columns += [pa.array([nodes[i] for i in one], pa.binary()), pa.array(n_copies.astype(np.int64))]
                columns += [pa.array([x[i].tobytes() for i in one], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "no", "node", "n_copies", "numbers"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which may have more copies
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if held is None else pa.concat_batches([held, batch])
            names = np.frombuffer(b"".join(batch.column("node").to_pylist()), "<u8").reshape(-1, 2)
            starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)]))
            n_copies = pa.array(np.add.reduceat(batch.column("n_copies").to_numpy(), starts))
            batch = batch.take(pa.array(starts)).set_column(2, "n_copies", n_copies)
            yield batch.slice(0, batch.num_rows - 1)
            held = batch.slice(batch.num_rows - 1)
        if held is not None:
            yield held

    placed = rows.mapInArrow(place, "part int, no int, node binary, n_copies long, numbers binary")
    placed = placed.repartitionById(parts, "part").drop("part").sortWithinPartitions("no", "node")
    return stage(placed.mapInArrow(merge, "no int, node binary, n_copies long, numbers binary"), "vectors")


def _packed(rows: DataFrame, plan: _Plan, names: list[str], wants: bool = False) -> DataFrame:
    """Blocks as one row: ``no, nodes, copies, numbers`` as ``names``; with ``wants`` the blocks to compare with. A block may come in several rows."""

    def row(no: int, parts: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        columns = [pa.array([no], pa.int32()), *(pa.array([b"".join(p)], pa.binary()) for p in zip(*parts, strict=True))]
        if wants:
            columns.append(pa.array([plan.others(no)], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names + ["wants"] * wants)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_no = [], None
        for batch in batches:
            numbers = batch.column("no").to_numpy()
            starts = np.flatnonzero(np.diff(numbers, prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(numbers)], strict=True):
                if held and held_no != numbers[start]:
                    yield row(held_no, held)
                    held = []
                held_no = int(numbers[start])
                part = batch.slice(start, end - start)
                nodes, values = (b"".join(x.as_buffer() for x in part.column(name)) for name in ("node", "numbers"))
                held.append((nodes, part.column("n_copies").to_numpy().tobytes(), values))
        if held:
            yield row(held_no, held)

    kinds = ["int", "binary", "binary", "binary"]
    schema = ", ".join(f"{name} {kind}" for name, kind in zip(names, kinds, strict=True)) + ", wants array<int>" * wants
    return rows.select("no", "node", "n_copies", "numbers").mapInArrow(pack, schema)


class _Block:
    """One side of a comparison."""

    def __init__(self, no: int, nodes: bytes, copies: bytes, numbers: bytes, dim: int, kind: str):
        self.no, self.dim = no, dim
        self.nodes = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        self.copies = np.frombuffer(copies, np.int64)
        self.numbers = np.frombuffer(numbers, kind).reshape(-1, dim)
        self.units = _units(self.numbers).astype(np.float32)


def _links(pairs: DataFrame, pivots: dict[int, np.ndarray], plan: _Plan, threshold: float, radius: float, kind: str) -> DataFrame:
    """``node, links, root`` of the vectors that have links in a pair of blocks, counted on both sides."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, known = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                dim = int(plan.dims[r["no"]])
                if left is None or (left.no, left.nodes[0]) != (r["no"], r["nodes"][:16]):
                    left = _Block(r["no"], r["nodes"], r["copies"], r["numbers"], dim, kind)
                name = (r["o_no"], r["o_nodes"][:16])
                if name not in known:
                    known[name] = _Block(r["o_no"], r["o_nodes"], r["o_copies"], r["o_numbers"], dim, kind)
                for out in _compared(left, known[name]):
                    columns = [pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "links", "root"])

    def _compared(a: _Block, b: _Block) -> Iterator[tuple[list, list, list]]:
        same, at_a, at_b = a.no == b.no, np.arange(len(a.nodes)), np.arange(len(b.nodes))
        of_a, of_b = plan.cells[a.no], plan.cells[b.no]
        if of_a != of_b:
            p = pivots[a.dim]
            at_a = np.flatnonzero(_beyond(a.units, p, np.full(len(at_a), of_a), np.array([of_b]), radius)[:, 0])
            at_b = np.flatnonzero(_beyond(b.units, p, np.full(len(at_b), of_b), np.array([of_a]), radius)[:, 0])
        if not len(at_a) or not len(at_b):
            return
        own = {node: j for j, node in enumerate(b.nodes)} if same else {}
        other, margin, step = b.units[at_b].T, _margin(a.dim), max(1, min(256, SCORES // len(at_b)))
        for first in range(0, len(at_a), step):
            mine = at_a[first : first + step]
            cosines = a.units[mine] @ other
            if cosines.max() < threshold - margin:
                continue
            close = cosines >= threshold - margin
            unsure = close & (cosines <= threshold + margin)
            if same:
                for i, k in enumerate(mine):
                    if (j := own.get(a.nodes[k])) is not None:
                        close[i, j] = unsure[i, j] = False
            if unsure.any():
                i, j = np.flatnonzero(unsure.any(axis=1)), np.flatnonzero(unsure.any(axis=0))
                close[np.ix_(i, j)] &= _units(a.numbers[mine[i]]) @ _units(b.numbers[at_b[j]]).T >= threshold
            some, tied = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
            if not len(some):
                continue
            held = close[np.ix_(some, tied)]
            # Vectors with a neighbour in common hang together: each, and each neighbour, is tied to the first of its group.
            shared = held.astype(np.float32)
            first_of = some[local_labels(shared @ shared.T > 0)]
            nodes = [a.nodes[mine[i]] for i in some] + [b.nodes[at_b[j]] for j in tied]
            roots = [a.nodes[mine[i]] for i in first_of] + [a.nodes[mine[first_of[i]]] for i in held.argmax(axis=0)]
            # Two parts of one block meet twice, once on either side.
            backward = np.zeros(len(tied), np.int64) if same else a.copies[mine[some]] @ held
            yield nodes, [*(held @ b.copies[at_b[tied]]).tolist(), *backward.tolist()], roots

    return pairs.mapInArrow(compare, "node binary, links long, root binary")


def _all_links(placed: DataFrame, plan: _Plan, pivots: dict[int, np.ndarray], threshold: float, radius: float, kind: str) -> DataFrame:
    """The links of all pairs of near blocks. A round broadcasts a bounded share of the blocks and passes all blocks by it.

    So vectors are written once however many blocks they are compared with, and a task holds one block and a round's.
    """
    rows = np.maximum(1, BLOCK_NUMBERS // np.maximum(1, plan.dims)) if len(plan.dims) else np.zeros(0, np.int64)
    bound = int((rows * (plan.dims * np.dtype(kind).itemsize + 24)).sum())
    rounds = max(1, min(len(plan.dims), -(-bound // ROUND_BYTES)))
    left = _packed(placed, plan, ["no", "nodes", "copies", "numbers"], wants=True)
    found = None
    for i in range(rounds):
        right = _packed(placed.where(F.col("no") % rounds == i), plan, ["o_no", "o_nodes", "o_copies", "o_numbers"])
        pairs = left.join(F.broadcast(right), F.expr("array_contains(wants, o_no)")).drop("wants")
        part = stage(_links(pairs, pivots, plan, threshold, radius, kind), "vector-links")
        found = part if found is None else found.unionByName(part)
    return found


def vector_components(vectors: DataFrame, threshold: float = 0.9, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors (vec_id, embedding)``.

    Two vectors are linked if their cosine, in double precision, is ``threshold`` or more; ``n_links`` counts the
    others linked to one, ``component_id`` is the least id reachable by links, ``kept`` marks the vector that bears it. Unusable
    vectors (null, zero, with null or not finite components) are linked with nothing, nor are vectors of different
    dimension. Equal vectors are one node from the start. Repeated rows are linked with each other. An empty table
    gives an empty one; other columns are not read.

    On unit vectors the threshold is a radius. Pivots, a hash sample of bounded number, part the vectors into cells; by the triangle
    inequality only vectors near a boundary can have neighbours beyond it. A cell is cut by hash into blocks, which are written once.
    Each pair of blocks of near cells is compared once, in rounds that broadcast a bounded share of the blocks; of two cells only
    those vectors are multiplied that may have neighbours in the other, in single precision, and in double precision what that leaves
    undecided. No row per link leaves a pair. The join is exact for any pivots; they decide only how much is compared. High-dimensional
    vectors without structure lie near every boundary, and then the join comes down to comparing all blocks with each other.
    """
    radius = math.sqrt(2 - 2 * threshold)
    usable = _usable(vectors)
    kind = _number_type(usable)
    pivots = choose_pivots(usable, vectors.count(), cell_rows)
    plan = _Plan.of(_cell_rows(usable, pivots, radius), pivots)
    nodes = _placed(usable, pivots, plan)
    links = _all_links(nodes, plan, pivots, threshold, radius, kind)

    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    labels = component_labels(links.select(F.col("node").alias("u"), F.col("root").alias("v")), "vector-classes")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            names = np.full(len(column), None, object)
            filled = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
            for at, x in _matrices(column.take(pa.array(filled))):
                names[filled[at]] = [_node(v) for v in x]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(names, pa.binary())], ["vec_id", "node"])

    whole = F.col("embedding").cast(usable.schema["v"].dataType)
    # With a null in it a vector is no node.
    whole = F.when(F.forall(whole, lambda x: x.isNotNull()), whole)
    named = vectors.select(F.col("vec_id").cast("long"), whole.alias("v")).mapInArrow(name, "vec_id long, node binary")
    known = nodes.select("node", "n_copies").join(counts, "node", "left").join(labels, "node", "left")
    known = known.withColumn("label", F.coalesce("label", "node"))
    found = named.join(known, "node", "left")
    heads = found.filter("label is not null").groupBy("label").agg(F.min("vec_id").alias("head"))
    found = found.join(heads, "label", "left")
    component = F.coalesce("head", "vec_id")
    return found.select(
        "vec_id",
        F.when(F.col("n_copies").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
