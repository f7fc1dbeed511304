"""Scores of a batch of optional words, a block of documents against all queries at once.

The postings of the batch's words are gathered per document. What is sorted and kept grows with their number, not with that of the pairs
of query and document that share a word: a block's scores are one bounded matrix, of which only the best of each query and shard stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from quillrank.functions.scoring import SCORE_DIGITS, Bm25
from quillrank.operators.joins import lookup_join, max_broadcast_rows
from quillrank.operators.requests import Requests
from quillrank.operators.retrieval import Clauses, Index, weighed_ranges

#: Uses of words that a batch may have, and hits that a task may keep for it.
MAX_USES = 1 << 20
MAX_KEPT = 1 << 20
#: Scores and summands of a block.
BLOCK_NUMBERS = 1 << 20


def fits_blocks(index: Index, clauses: Clauses, requests: Requests) -> bool:
    """Whether the batch asks for optional words of positive boost only, and is small enough for each task to hold."""
    kept = requests.n_queries * index.num_shards * requests.max_limit
    return clauses.is_plain and 0 < clauses.n_rows <= MAX_USES and clauses.n_terms <= max_broadcast_rows() and kept <= MAX_KEPT


def best_scores(index: Index, clauses: Clauses, requests: Requests, bm25: Bm25 = Bm25()) -> DataFrame:
    """BM25 ``query_id, shard, id, bm25_score`` of the best ``max_limit`` documents of each query, shard and task, ties by id."""
    uses = clauses.rows.where("n_words = 1").select("query_id", "field", "term", "boost").toArrow()
    queries = uses["query_id"].combine_chunks().dictionary_encode()
    words = pa.StructArray.from_arrays([uses["field"].combine_chunks(), uses["term"].combine_chunks()], ["field", "term"])
    keys, number = np.unique(np.array([f"{w['field']}\0{w['term']}" for w in words.to_pylist()], dtype=object), return_inverse=True)
    by_word = np.argsort(number, kind="stable")
    scorer = _Scorer(
        queries.dictionary,
        queries.indices.to_numpy()[by_word].astype(np.int64),
        uses["boost"].to_numpy()[by_word],
        np.bincount(number, minlength=len(keys)),
        index.num_shards,
        requests.max_limit,
    )
    numbers = clauses.rows.sparkSession.createDataFrame(
        [(*key.split("\0", 1), n) for n, key in enumerate(keys)], "field string, term string, no int"
    )
    weighed = reduce(DataFrame.unionByName, weighed_ranges(index, clauses, bm25))
    weighed = lookup_join(weighed, numbers, ["field", "term"], bound=clauses.n_terms)
    docs = weighed.groupBy("shard", "id").agg(F.collect_list(F.struct("no", "weight")).alias("words"))
    schema = StructType([clauses.rows.schema["query_id"]]).add("shard", IntegerType()).add("id", StringType()).add("bm25_score", DoubleType())
    # In order of ids, so that of equal scores the first stay.
    return docs.sortWithinPartitions("shard", "id").mapInArrow(scorer, schema)


class _Scorer:
    """Scores of documents that come as ``shard, id, words (no, weight)``; holds the batch's words in order of their numbers."""

    def __init__(self, query_ids: pa.Array, query: np.ndarray, boost: np.ndarray, count: np.ndarray, num_shards: int, k: int):
        self.query_ids, self.query, self.boost, self.count = query_ids, query, boost, count
        self.start = np.cumsum(count) - count
        self.num_shards, self.k = num_shards, k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The least score that is still among the best ``k`` of a query and shard.
        floors = np.zeros((len(self.query_ids), self.num_shards))
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        n_held = n_kept = 0
        for batch in batches:
            for slots, scores, ids in self._blocks(batch, floors):
                held.append((slots, scores, ids))
                n_held += len(slots)
                if n_held > max(2 * n_kept, BLOCK_NUMBERS):
                    held = [self._best(held, floors)]
                    n_held = n_kept = len(held[0][0])
        if held:
            slots, scores, ids = self._best(held, floors)
            for first in range(0, len(slots), 1 << 16):
                at = slice(first, first + (1 << 16))
                columns = [self.query_ids.take(pa.array(slots[at] // self.num_shards)), pa.array((slots[at] % self.num_shards).astype(np.int32))]
                columns += [ids[at], pa.array(scores[at] / 10**SCORE_DIGITS)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "shard", "id", "bm25_score"])

    def _blocks(self, batch: pa.RecordBatch, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """Per block of documents the numbers of query and shard, the scores in units of the last digit, and the ids of what is above the floors."""
        words, shards, n = batch.column("words"), batch.column("shard").to_numpy(), len(self.query_ids)
        offsets, numbers, weights = words.offsets.to_numpy(), words.values.field("no").to_numpy(), words.values.field("weight").to_numpy()
        uses = np.concatenate([[0], np.cumsum(self.count[numbers])])[offsets]
        first = 0
        while first < batch.num_rows:
            last = min(first + max(1, BLOCK_NUMBERS // n), int(np.searchsorted(uses, uses[first] + BLOCK_NUMBERS, "right")) - 1)
            last = min(max(last, first + 1), batch.num_rows)
            at = slice(offsets[first], offsets[last])
            count = self.count[numbers[at]]
            use = np.repeat(self.start[numbers[at]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            row = np.repeat(np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1])), count)
            summand = np.repeat(weights[at], count) * self.boost[use]
            total = np.bincount(row * n + self.query[use], summand, minlength=(last - first) * n).reshape(-1, n)
            score = np.floor(total * 10**SCORE_DIGITS + 0.5)
            # Ids rise, so of a score equal to the floor what comes later is not among the best.
            floor = floors[:, shards[first:last]].T
            row, query = np.nonzero((total > 0) & ((score > floor) | (floor == 0)))
            yield query * self.num_shards + shards[first + row], score[row, query], batch.column("id").take(pa.array(first + row))
            first = last

    def _best(self, held: list, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        slots, scores = (np.concatenate([part[i] for part in held]) for i in (0, 1))
        ids = pa.concat_arrays([part[2] for part in held])
        order = np.lexsort((-scores, slots))
        _, begins = np.unique(slots[order], return_index=True)
        rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        full = order[rank == self.k - 1]
        floors.ravel()[slots[full]] = scores[full]
        order = order[rank < self.k]
        return slots[order], scores[order], ids.take(pa.array(order))
