"""Conversation structure repair: the cheapest edits that make turns alternate, the least of equally cheap ones by doubled pointers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import NO_ID, stage

_BLANKS = " \t\n\x0b\x0c\r"
#: Faults, the first that holds counts, and kinds of roles by their initials.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
OTHER, SYSTEM, USER, ASSISTANT = range(4)
#: States: nothing yet, after system, after user, after assistant. What an inserted or renamed turn leads to from each.
_NEXT = np.array([2, 2, 3, 2])
#: States that a turn of each kind is accepted from.
_TAKES = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [1, 1, 0, 1], [0, 0, 1, 0]], bool)
_END = [True, False, False, True]
_FAR = 1 << 40
_RENAME, _DELETE, _INSERT, _UNREPAIRED = 2, 3, 2, 1
#: Letters of a path: delete, insert, keep, rename, by the state they lead to. ``audit`` has their initials, in ASCII order.
_STOP, _D, _I, _K, _R = range(5)
_LETTERS = np.array([list("...."), list("dddd"), list("..UA"), list("kkkk"), list("..ua")])


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with faults by the checksum of ``conv_id:turn``: one in twenty each is dropped, emptied, stripped of sentence ends,
    repeated, or made the user's. Null ids and turns count as a blank there; null roles and texts become one.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(role)
    hit = rows.select("conv_id", "turn", "role", "text", kind.alias("_kind")).where("_kind <> 0")
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, F.lit(2)).otherwise(F.lit(1))))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with their place: ``_c`` (conversation), ``_block`` and ``_pos``, written once.

    Rows are dealt by ranges of (conversation, turn), so a conversation of any size is a run of places that may span partitions;
    what lies in one partition is a block of it. A block's places have no gaps.
    """
    rows = rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("_c"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    rows = rows.withColumn("_h", F.xxhash64("text"))
    order = [F.col("_c"), F.asc_nulls_first("turn"), F.col("role"), F.col("_h")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(rows.withColumns({"_block": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()}), "turns")


def faults(ordered: DataFrame) -> DataFrame:
    """``_c, _block, _pos, turn, kind, fault`` of each row, without texts.

    The first row of each role and text in a conversation is found by an aggregate and marked by its place, so equal rows,
    however many, do not meet in a task.
    """
    said = F.rtrim("text", F.lit(_BLANKS))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    rows = ordered.select(
        "_c", "_block", "_pos", "turn", "_h",
        F.xxhash64(F.lit(1), "role", "text").alias("_g"),
        kind.alias("kind"),
        (said == "").alias("blank"),
        F.right(said, F.lit(1)).isin(".", "!", "?").alias("ended"),
    )
    firsts = rows.groupBy("_c", "_h", "_g").agg(F.min("_pos").alias("_pos")).select("_pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(NONE)
    return rows.join(firsts, "_pos", "left").select("_c", "_block", "_pos", "turn", "kind", fault.alias("fault"))


def _closed(p: list[int]) -> list[int]:
    """Costs with insertions before the next row."""
    user, assistant = min(p[2], p[3] + _INSERT), min(p[3], p[2] + _INSERT)
    return [min(p[0], user + _INSERT), min(p[1], user + _INSERT), user, assistant]


def _before(c: list[int], kind: int, fault: int) -> list[int]:
    """Least costs from before a row, given those from after it."""
    out = [x + _DELETE for x in c]
    if fault not in (BLANK, DUPLICATE):
        extra = _UNREPAIRED if fault == TRUNCATED else 0
        for state in range(4):
            out[state] = min(out[state], c[_NEXT[state]] + _RENAME + extra)
            if _TAKES[kind, state]:
                out[state] = min(out[state], c[kind] + extra)
    return _closed(out)


_TERMINAL = _closed([0 if end else _FAR for end in _END])
_memo: dict[tuple, tuple[list[int], int]] = {}


def _costs(kinds: np.ndarray, found: np.ndarray, after: list[int]) -> np.ndarray:
    """Least costs to the end from every place and state; ``after`` are those behind the last row.

    Costs of the four states differ by a few edits at most, so steps repeat and are looked up.
    """
    out = np.empty((len(kinds) + 1, 4), np.int64)
    out[-1] = c = list(after)
    for i in range(len(kinds) - 1, -1, -1):
        least = min(c)
        key = (c[0] - least, c[1] - least, c[2] - least, c[3] - least, int(kinds[i]), int(found[i]))
        step = _memo.get(key)
        if step is None:
            if len(_memo) > 100_000:
                _memo.clear()
            step = _memo[key] = _before(list(key[:4]), key[4], key[5])
        c = [x + least for x in step]
        out[i] = c
    return out


def _transfer(kinds: np.ndarray, found: np.ndarray) -> list[int]:
    """Least cost from each state before the rows to each state behind them, 16 numbers."""
    ends = [_costs(kinds, found, [0 if q == end else _FAR for q in range(4)])[0] for end in range(4)]
    return [min(int(ends[end][q]), _FAR) for q in range(4) for end in range(4)]


def least_paths(costs: np.ndarray, kinds: np.ndarray, found: np.ndarray, ends: np.ndarray, open_end: np.ndarray, roots: np.ndarray):
    """The ASCII-least of the cheapest paths from each of ``roots``: ``(path, state at its end)``.

    ``costs`` holds the places of several blocks one after the other, ``kinds`` and ``found`` a row for each place (the last place of a
    block has none), ``ends`` marks these last places and ``open_end`` those behind which another block follows. A node is a
    place and a state, ``4 * place + state``. An arc is optimal if its cost is what its node costs more than its target.

    Nodes are ranked by the first 1, 2, 4, ... letters of their least audit: by the rank of the first half, then by the
    rank of the node that the pointer of that length leads to. The letters of a node's arcs differ and name one target each, so
    the least first letter is the first of the least audit, and pointers double without branching. Paths are read through
    the doubled pointers, all steps at once.
    """
    n = len(costs)
    place, state = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n)
    here = costs.ravel()
    row = ~ends[place]
    kind, extra = kinds[place], np.where(found[place] == TRUNCATED, _UNREPAIRED, 0)
    live = row & (found[place] != BLANK) & (found[place] != DUPLICATE)
    after = np.minimum(place + 1, n - 1)
    letter = np.zeros(4 * n, np.int64)
    target = np.arange(4 * n)
    # From the last letter to the first, so that the least that is optimal stays.
    for code, allowed, at, to, cost in (
        (_R, live, after, _NEXT[state], _RENAME + extra),
        (_K, live & _TAKES[kind, state], after, kind, extra),
        (_I, ~(ends & open_end)[place], place, _NEXT[state], _INSERT),
        (_D, row, after, state, _DELETE),
    ):
        best = allowed & (here < _FAR) & (costs[at, to] + cost == here)
        letter[best] = code
        target[best] = (4 * at + to)[best]

    rank, pointer, steps = letter, target, (letter > 0).astype(np.int64)
    pointers = [pointer]
    while (letter[pointer] > 0).any():
        _, rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)
        steps = steps + steps[pointer]
        pointer = pointer[pointer]
        pointers.append(pointer)

    lengths = steps[roots]
    first = np.cumsum(lengths) - lengths
    node = np.repeat(roots, lengths)
    step = np.arange(len(node)) - np.repeat(first, lengths)
    for power, jump in enumerate(pointers):
        node = np.where(step >> power & 1, jump[node], node)
    letters = "".join(_LETTERS[letter[node], target[node] % 4])
    last = pointers[-1][roots] % 4
    return [letters[a : a + size] for a, size in zip(first.tolist(), lengths.tolist(), strict=True)], last.tolist()


def _runs(batches: Iterable[pa.RecordBatch], work: Callable[[pd.DataFrame, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``work`` on whole blocks of sorted rows: the rows of some batches and where their blocks begin. Holds a batch and a block at most."""
    pending: list[pd.DataFrame] = []
    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        pending.append(rows)
        c, block = rows["_c"].to_numpy(), rows["_block"].to_numpy()
        if (c[0], block[0]) == (c[-1], block[-1]) and (len(pending) == 1 or (pending[0]["_c"].iloc[0], pending[0]["_block"].iloc[0]) == (c[0], block[0])):
            continue
        rows = pd.concat(pending, ignore_index=True) if len(pending) > 1 else rows
        c, block = rows["_c"].to_numpy(), rows["_block"].to_numpy()
        starts = np.flatnonzero(np.append(True, (np.diff(c) != 0) | (np.diff(block) != 0)))
        yield work(rows.iloc[: starts[-1]], starts[:-1])
        pending = [rows.iloc[starts[-1] :]]
    if pending:
        rows = pd.concat(pending, ignore_index=True)
        yield work(rows, np.array([0]))


_BLOCK = (
    "_c long, _block int, start long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
    "first_kind int, last_kind int, cost long, paths array<string>, ends array<int>"
)


def _solve(rows: pd.DataFrame, starts: np.ndarray) -> pa.RecordBatch:
    """A row for each block: its counts, and its least path from each state it may be entered in."""
    bounds = np.append(starts, len(rows))
    kinds, found = rows["kind"].to_numpy(), rows["fault"].to_numpy()
    turn = rows["turn"].to_numpy(np.float64, na_value=np.nan) if rows["turn"].isna().any() else rows["turn"].to_numpy()
    after = rows["after"].to_numpy()
    entered = rows["entered"].to_numpy()
    tables, marks, opens = [], [], []
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        tables.append(_costs(kinds[s:e], found[s:e], _TERMINAL if after[s] is None else [int(x) for x in after[s]]))
        marks.append(e - s)
        opens.append(after[s] is not None)
    # A place more than rows in each block.
    blocks = len(starts)
    last = np.cumsum(np.array(marks) + 1) - 1
    size = int(last[-1]) + 1
    ends = np.zeros(size, bool)
    ends[last] = True
    open_end = np.zeros(size, bool)
    open_end[last] = opens
    wide_kinds, wide_found = np.zeros(size, np.int64), np.zeros(size, np.int64)
    wide_kinds[~ends], wide_found[~ends] = kinds, found
    firsts = last - np.array(marks)
    costs = np.concatenate(tables)
    wanted = [(b, q) for b in range(blocks) for q in (range(4) if entered[starts[b]] else (0,)) if costs[firsts[b], q] < _FAR]
    paths, states = least_paths(costs, wide_kinds, wide_found, ends, open_end, np.array([4 * firsts[b] + q for b, q in wanted], np.int64))
    all_paths: list[list] = [[None] * 4 for _ in range(blocks)]
    all_ends: list[list] = [[None] * 4 for _ in range(blocks)]
    for (b, q), path, state in zip(wanted, paths, states, strict=True):
        all_paths[b][q], all_ends[b][q] = path, state

    inside = np.ones(len(rows), bool)
    inside[starts] = False
    pair = 4 * np.append(0, kinds[:-1]) + kinds
    illegal = inside & ~np.isin(pair, (4 * SYSTEM + USER, 4 * USER + ASSISTANT, 4 * ASSISTANT + USER))
    known = ~rows["turn"].isna().to_numpy()
    before = np.append(0, turn[:-1])
    new = known & (~inside | ~np.append(False, known[:-1]) | (turn != before))
    sums = lambda x: np.add.reduceat(x.astype(np.int64), starts)
    # Turns ascend behind the nulls, so the least is the first that is known.
    first_known = [int(np.argmax(known[s:e])) + s if known[s:e].any() else None for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    columns = {
        "_c": rows["_c"].to_numpy()[starts],
        "_block": rows["_block"].to_numpy()[starts],
        "start": rows["_pos"].to_numpy()[starts],
        "blank": sums(found == BLANK),
        "duplicate": sums(found == DUPLICATE),
        "truncated": sums(found == TRUNCATED),
        "illegal": sums(illegal),
        "turns": sums(new),
        "first_turn": [None if i is None else int(turn[i]) for i in first_known],
        "last_turn": [None if i is None else int(turn[e - 1]) for i, e in zip(first_known, bounds[1:], strict=True)],
        "first_kind": kinds[starts],
        "last_kind": kinds[bounds[1:] - 1],
        "cost": [None if entered[s] else int(costs[f, 0]) for s, f in zip(starts, firsts, strict=True)],
        "paths": all_paths,
        "ends": all_ends,
    }
    kinds_of = [pa.int64(), pa.int32(), *[pa.int64()] * 8, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), kinds_of, strict=True)], names=list(columns))


def _sorted_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("_c", "_block").sortWithinPartitions("_c", "_block", "_pos")


def _boundaries(narrow: DataFrame, spans: DataFrame) -> DataFrame:
    """``_c, _block, after, entered`` for the blocks of conversations that span partitions: the costs behind each."""

    def transfers(rows: pd.DataFrame, starts: np.ndarray) -> pa.RecordBatch:
        kinds, found = rows["kind"].to_numpy(), rows["fault"].to_numpy()
        tables = [_transfer(kinds[s:e], found[s:e]) for s, e in zip(starts, np.append(starts[1:], len(rows)), strict=True)]
        columns = [pa.array(rows["_c"].to_numpy()[starts]), pa.array(rows["_block"].to_numpy()[starts], pa.int32()), pa.array(tables, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["_c", "_block", "transfer"])

    def behind(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_block", ignore_index=True)
        found: list = [None] * len(blocks)
        c = _TERMINAL
        for i in range(len(blocks) - 1, 0, -1):
            table = blocks["transfer"][i]
            c = [min(min(int(table[4 * q + end]) + c[end] for end in range(4)), _FAR) for q in range(4)]
            found[i - 1] = c
        return pd.DataFrame({"_c": blocks["_c"], "_block": blocks["_block"], "after": found, "entered": [i > 0 for i in range(len(blocks))]})

    rows = narrow.join(F.broadcast(spans), "_c", "left_semi")
    tables = _sorted_blocks(rows).mapInArrow(lambda batches: _runs(batches, transfers), "_c long, _block int, transfer array<long>")
    return tables.groupBy("_c").applyInPandas(behind, "_c long, _block int, after array<long>, entered boolean")


def _chained(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one conversation, each entered in the state in which the one before ends, and what is counted between them."""
    blocks = blocks.sort_values("_block", ignore_index=True)
    state, paths, illegal, turns = 0, [], [], []
    for i, b in blocks.iterrows():
        paths.append(b["paths"][state])
        state = int(b["ends"][state])
        if i:
            before = blocks.iloc[i - 1]
            legal = (before["last_kind"], b["first_kind"]) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
            illegal.append(b["illegal"] + (not legal))
            same = pd.notna(before["last_turn"]) and before["last_turn"] == b["first_turn"]
            turns.append(b["turns"] - same)
        else:
            illegal.append(b["illegal"])
            turns.append(b["turns"])
    return blocks.assign(path=paths, illegal=illegal, turns=turns).drop(columns=["paths", "ends", "first_kind", "last_kind"])


def solve(ordered: DataFrame) -> DataFrame:
    """A row for each block of ``ordered`` with its counts and the path of edits that repairs it.

    Costs are a dynamic program over four states, from the end to the beginning. A conversation that spans partitions is solved by
    blocks: a 4 x 4 table of least costs through each, multiplied from the last block back, gives the costs behind every block; then
    each finds its least path from every state it may be entered in, and the paths are chained. At most two blocks of a partition
    belong to such conversations, so their tables are at most twice as many as partitions: that bounds what is broadcast.
    """
    narrow = stage(faults(ordered), "faults")
    spans = ordered.groupBy("_c").agg(F.min("_block").alias("a"), F.max("_block").alias("b")).where("a < b").select("_c")
    edges = stage(_boundaries(narrow, stage(spans, "spans")), "edges")
    rows = narrow.join(F.broadcast(edges), ["_c", "_block"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    blocks = stage(_sorted_blocks(rows).mapInArrow(lambda batches: _runs(batches, _solve), _BLOCK), "blocks")
    kept = [c for c in blocks.columns if c not in ("paths", "ends", "first_kind", "last_kind")]
    several = F.broadcast(edges.select("_c").distinct())
    alone = blocks.join(several, "_c", "left_anti").select(*kept, F.col("paths")[0].alias("path"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alone.schema)
    chained = blocks.join(several, "_c", "left_semi").groupBy("_c").applyInPandas(lambda b: _chained(b)[[*kept, "path"]], schema)
    return alone.unionByName(chained)


def repaired_turns(ordered: DataFrame, solved: DataFrame) -> DataFrame:
    """The rows of all repaired conversations: ``_c, _pos, k, edit, role, text``, in order of ``(_c, _pos, k)``."""
    units = F.regexp_extract_all("path", F.lit(r"[UA]*[dkua](?:[UA]+\z)?"), 0)
    edits = solved.select("start", F.posexplode(units).alias("j", "unit")).select((F.col("start") + F.col("j")).alias("_pos"), "unit")
    rows = ordered.select("_c", "_pos", "role", "text").join(edits, "_pos")

    def turn(x: Column, k: Column) -> Column:
        role = F.when(F.lower(x) == "u", F.lit("user")).when(F.lower(x) == "a", F.lit("assistant")).otherwise(F.col("role"))
        text = F.when(x.isin("U", "A"), F.lit("")).otherwise(F.col("text"))
        return F.struct(k.alias("k"), _audit(x).alias("edit"), role.alias("role"), text.alias("text"))

    made = F.transform(F.split("unit", ""), turn)
    return rows.select("_c", "_pos", F.inline(F.filter(made, lambda t: t["edit"] != "D")))


def _audit(path: Column | str) -> Column:
    return F.translate(path, "dkuaUA", "DKRRII")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Conversations whose turns alternate again: ``conv_id, place, edit, role, text``, ``place`` being an order within a conversation.

    ``rows`` has ``conv_id, turn, role, text``; other columns are not read. Turns are in order of ``turn`` (nulls first), those of one turn
    by role, then by their text's hash. Blank turns and repetitions of an earlier role and text go, each for 3; other turns may be kept, deleted
    for 3, or given the role that fits for 2; empty ones may be inserted for 2; a truncated turn that stays costs 1. Of the cheapest repairs
    the one with the ASCII-least letters (D, I, K, R) is taken. Roles are judged by their first letter. Null roles and texts count as
    one blank; rows without an id are one conversation. An empty table gives an empty one.
    """
    ordered = in_order(rows)
    turns = repaired_turns(ordered, solve(ordered))
    return turns.select(_conv_id(), F.struct("_pos", "k").alias("place"), "edit", "role", "text")


def _conv_id() -> Column:
    return F.when(F.col("_c") != NO_ID, F.col("_c")).alias("conv_id")


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's lines in sorted rows; holds no more than a batch."""
    schema = pa.schema([("_c", pa.int64()), ("repaired_sha256", pa.string())])
    current, digest = None, None
    for batch in batches:
        done = []
        for c, line in zip(batch.column("_c").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if c != current or digest is None:
                if digest is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = c, sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(schema.types)], schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((current, digest.hexdigest()), schema.types, strict=True)], schema=schema)


def audit_conversations(rows: DataFrame, given: DataFrame) -> DataFrame:
    """A row for each ``conv_id`` of ``given``: the faults of its ``rows`` and the cheapest repair.

    Columns as the rules of ``repair_conversations`` have them: ``gaps`` in the turns, rows ``blank``, ``duplicate`` and ``truncated`` (the first
    that holds), ``illegal`` neighbours, ``cost``, ``audit`` and the SHA-256 of the repaired ``role:text`` lines. A conversation without rows
    has zeros, an empty audit and the digest of nothing. One digest is sequential by nature, so a conversation's repaired lines pass
    through one task, as a stream; everything else is spread.
    """
    ordered = in_order(rows)
    solved = stage(solve(ordered), "solved")
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    pieces = F.sort_array(F.collect_list(F.struct("_block", _audit("path").alias("piece"))))
    summary = solved.groupBy("_c").agg(
        F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        *counts,
        F.max("cost").alias("cost"),
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("audit"),
    )
    lines = repaired_turns(ordered, solved).select("_c", "_pos", "k", F.concat_ws(":", "role", "text").alias("line"))
    lines = lines.repartition("_c").sortWithinPartitions("_c", "_pos", "k").select("_c", "line")
    digests = lines.mapInArrow(_hashes, "_c long, repaired_sha256 string")
    every = given.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("_c")).distinct()
    found = every.join(summary, "_c", "left").join(digests, "_c", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(sha256(b"").hexdigest())
    return found.select(_conv_id(), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
