"""Places of phrases: a block of documents against all phrases of a batch at once.

A phrase is looked for where its first two words stand at their distance, so work follows the length of the documents and the
places of such pairs, not how many phrases share a word. The other words are then looked up one by one at their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators.joins import lookup_join
from quillrank.session import stage

#: Words of the phrases that are looked for at once; more take another pass over the postings.
MAX_WORDS = 1 << 20
#: Places of a block of documents.
BLOCK_PLACES = 1 << 20
HOT_TERM_SALTS = 64


def distinct_phrases(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of analyzed clauses the phrases ``phrase, field, words (word_offset, term)``, and who asks for each: ``phrase, query_id, occur, must_no, boost``."""
    words = F.array_sort(F.collect_list(F.struct("word_offset", "term"))).alias("words")
    asked = stage(rows.groupBy("query_id", "clause_id", "occur", "must_no", "boost", "field").agg(words), "asked")
    phrases = asked.select("field", "words").distinct().withColumn("phrase", F.monotonically_increasing_id())
    phrases = stage(phrases, "phrases")
    return phrases, asked.join(phrases, ["field", "words"]).select("phrase", "query_id", "occur", "must_no", "boost")


def phrase_counts(postings: DataFrame, phrases: DataFrame, n_terms: int) -> DataFrame:
    """``phrase, shard, id, dl, tf`` of each phrase and the documents that hold it."""
    n = phrases.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    passes = max(1, -(-n // MAX_WORDS))
    found = [_counts(postings, phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == i), n_terms) for i in range(passes)]
    return reduce(DataFrame.unionByName, found)


def _counts(postings: DataFrame, phrases: DataFrame, n_terms: int) -> DataFrame:
    rows = phrases.select("phrase", "field", F.posexplode("words").alias("place", "word")).orderBy("phrase", "place")
    rows = rows.select("phrase", "field", "word.term", "word.word_offset").toArrow()
    numbers: dict[tuple[str, str], int] = {}
    number = [numbers.setdefault(word, len(numbers)) for word in zip(rows["field"].to_pylist(), rows["term"].to_pylist(), strict=True)]
    finder = _Finder(rows["phrase"].to_numpy(), np.array(number, np.int64), rows["word_offset"].to_numpy().astype(np.int64), len(numbers))
    known = phrases.sparkSession.createDataFrame([(*word, n) for word, n in numbers.items()], "field string, term string, no int")
    places = postings.select("shard", "field", "term", "id", "dl", "positions")
    places = lookup_join(places, known, ["field", "term"], bound=n_terms, salts=HOT_TERM_SALTS)
    docs = places.groupBy("shard", "id", "field", "dl").agg(F.collect_list(F.struct("no", "positions")).alias("words"))
    return docs.where(F.size("words") > 0).mapInArrow(finder, "phrase long, shard int, id string, dl int, tf int")


class _Finder:
    """Counts phrases in documents that come as ``shard, id, dl, words (no, positions)``."""

    def __init__(self, phrase: np.ndarray, number: np.ndarray, offset: np.ndarray, n_words: int):
        self.number, self.n_words = number, n_words
        self.phrase, self.first, self.size = np.unique(phrase, return_index=True, return_counts=True)
        self.offset = offset - np.repeat(offset[self.first], self.size)
        self.pairs = []  # distance, sorted pairs of numbers, phrases in their order
        gap = self.offset[self.first + 1]
        for distance in np.unique(gap):
            at = np.flatnonzero(gap == distance)
            pair = number[self.first[at]] * n_words + number[self.first[at] + 1]
            order = np.argsort(pair, kind="stable")
            self.pairs.append((distance, pair[order], at[order]))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            entry, numbers, lists = words.offsets.to_numpy(), words.values.field("no").to_numpy(), words.values.field("positions")
            place, positions = lists.offsets.to_numpy(), lists.values.to_numpy()
            ends = place[entry]
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(ends, ends[first] + BLOCK_PLACES, "right")) - 1
                last = min(max(last, first + 1), batch.num_rows)
                of_word = np.repeat(numbers[entry[first] : entry[last]], np.diff(place[entry[first] : entry[last] + 1])).astype(np.int64)
                doc = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
                docs, phrases, tf = self._found(doc, positions[ends[first] : ends[last]].astype(np.int64), of_word)
                if len(docs):
                    rows = pa.array(first + docs)
                    columns = [pa.array(self.phrase[phrases]), *(batch.column(c).take(rows) for c in ("shard", "id", "dl")), pa.array(tf.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["phrase", "shard", "id", "dl", "tf"])
                first = last

    def _found(self, doc: np.ndarray, position: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, phrases, and how often the one holds the other."""
        width = position.max(initial=0) + self.offset.max(initial=0) + 1
        code = doc * width + position
        order = np.argsort(code)
        code, number = code[order], number[order]

        def standing(codes: np.ndarray) -> np.ndarray:
            """The number of the word at each place, -1 where there is none."""
            at = np.minimum(np.searchsorted(code, codes), len(code) - 1)
            return np.where(code[at] == codes, number[at], -1)

        starts, phrases = [], []
        for distance, pairs, of_pair in self.pairs:
            second = standing(code + distance)
            here = np.flatnonzero(second >= 0)
            pair = number[here] * self.n_words + second[here]
            low, high = np.searchsorted(pairs, pair), np.searchsorted(pairs, pair, "right")
            count = high - low
            start = np.repeat(code[here], count)
            phrase = of_pair[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            word = 2
            while len(longer := np.flatnonzero(self.size[phrase] > word)):
                at = self.first[phrase[longer]] + word
                missing = longer[standing(start[longer] + self.offset[at]) != self.number[at]]
                start, phrase = np.delete(start, missing), np.delete(phrase, missing)
                word += 1
            starts.append(start), phrases.append(phrase)
        start, phrase = np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(phrases or [np.zeros(0, np.int64)])
        both, tf = np.unique(start // width * len(self.phrase) + phrase, return_counts=True)
        return both // max(1, len(self.phrase)), both % max(1, len(self.phrase)), tf
