"""Quality classifier: a linear-chain conditional random field over a document's lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm.common import held_out
from quillrank.llm.hashing import Rolling

#: Labelled documents that the model is fitted on, and lines of each that are used.
SAMPLE_DOCS, SAMPLE_LINES = 4000, 400
#: Bytes of text whose lines are scored together.
CHUNK_BYTES = 4 << 20

# Byte classes.
ALPHA, UPPER, DIGIT, SPACE, POINT, SYMBOL, SHOUT = range(7)
_CLASS = np.zeros((7, 256), bool)
_CLASS[ALPHA, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS[UPPER, 65:91] = True
_CLASS[DIGIT, 48:58] = True
_CLASS[SPACE, [9, 11, 12, 13, 32]] = True
_CLASS[POINT, list(b".,;:'\"?-()")] = True
_CLASS[SHOUT, list(b"!")] = True
_CLASS[SYMBOL] = ~_CLASS[[ALPHA, DIGIT, SPACE, POINT, SHOUT]].any(axis=0)

#: Features of a line that its neighbours see too.
SHARED = [2, 3, 6, 7, 8, 10, 11]
N_OWN = 13
N_FEATURES = N_OWN + 2 * len(SHARED) + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, a line's weight (its length and one), and each text's number of lines.

    A line is known by its length and the shares of letters, capitals, digits, punctuation, symbols, words that repeat the word before,
    words that end in a symbol or are one; and by the same of the lines before and after it, and whether it repeats the
    line before. A text has one line more than it has line feeds.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    counts = np.diff(np.concatenate([[0], np.searchsorted(ends, text_ends) + 1]))

    def per_line(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[ends] - sums[starts]).astype(np.float64)

    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~(_CLASS[SPACE][data] | (data == 10))
    edges = np.diff(inside)
    word_start, word_end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    line = np.searchsorted(ends, word_start)
    n_words = np.bincount(line, minlength=len(ends)).astype(np.float64)
    rolled = Rolling(data)
    hashes = rolled(word_start, word_end) if len(word_start) else np.zeros(0, np.uint64)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    odd_end = _CLASS[[SYMBOL, SHOUT]].any(axis=0)[data[word_end - 1]]
    of_words = lambda flags: np.bincount(line, weights=flags, minlength=len(ends)) / np.maximum(n_words, 1)
    classes = [per_line(_CLASS[c][data]) for c in range(7)]
    filled = np.maximum(size, 1)

    own = np.empty((len(ends), N_OWN))
    own[:, 0] = 1
    own[:, 1] = np.log1p(size) / 7
    own[:, 2] = classes[ALPHA] / filled
    own[:, 3] = classes[UPPER] / np.maximum(classes[ALPHA], 1)
    own[:, 4] = classes[DIGIT] / filled
    own[:, 5] = classes[POINT] / filled
    own[:, 6] = classes[SYMBOL] / filled
    own[:, 7] = classes[SHOUT] / filled
    own[:, 8] = of_words(again)
    own[:, 9] = (size - classes[SPACE]) / np.maximum(n_words, 1) / 10
    own[:, 10] = of_words(odd_end)
    own[:, 11] = of_words(odd_end & (word_end - word_start == 1))
    own[:, 12] = size == 0

    first = np.zeros(len(ends), bool)
    first[np.cumsum(counts) - counts] = True
    last = np.roll(first, -1)
    before, after = np.roll(own[:, SHARED], 1, axis=0), np.roll(own[:, SHARED], -1, axis=0)
    before[first], after[last] = 0, 0
    content = rolled(starts, ends)
    repeats = np.zeros(len(ends), bool)
    repeats[1:] = content[1:] == content[:-1]
    return np.hstack([own, before, after, (repeats & ~first)[:, None]]).astype(np.float32), size + 1, counts


@dataclass
class LineField:
    """Weights of the field: a line's score for being good, and the scores of label pairs of neighbouring lines."""

    mean: np.ndarray
    scale: np.ndarray
    unary: np.ndarray
    pair: np.ndarray

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(line is good) for each line, and the expected label pairs, by the scaled forward and backward passes.

        All documents advance together, a line at a time.
        """
        x = (features - self.mean) / self.scale
        score = np.clip(x @ self.unary, -30, 30)
        emit = np.stack([np.ones_like(score), np.exp(score)], axis=1)
        emit /= emit.sum(axis=1, keepdims=True)
        step = np.exp(self.pair - self.pair.max())
        order = np.argsort(-counts, kind="stable")
        begin = (np.cumsum(counts) - counts)[order]
        alive = np.searchsorted(-counts[order], -np.arange(1, counts.max() + 1), side="right")
        ahead, back = np.empty_like(emit), np.empty_like(emit)
        for t, n in enumerate(alive):
            at = begin[:n] + t
            now = emit[at] if t == 0 else (ahead[at - 1] @ step) * emit[at]
            ahead[at] = now / now.sum(axis=1, keepdims=True)
        for t in range(len(alive) - 1, -1, -1):
            n, more = alive[t], alive[t + 1] if t + 1 < len(alive) else 0
            at = begin[:n] + t
            back[at] = 0.5
            if more:
                at = at[:more]
                now = (emit[at + 1] * back[at + 1]) @ step.T
                back[at] = now / now.sum(axis=1, keepdims=True)
        both = ahead * back
        both /= both.sum(axis=1, keepdims=True)
        inner = np.ones(len(score), bool)
        inner[(np.cumsum(counts) - 1)] = False
        at = np.flatnonzero(inner)
        joint = ahead[at][:, :, None] * step[None] * (emit[at + 1] * back[at + 1])[:, None, :]
        pairs = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(at) else np.zeros((2, 2))
        return both[:, 1], pairs


def fit(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 150, decay: float = 0.02) -> LineField:
    """The field of largest likelihood for documents whose lines all bear the document's label, with a quadratic penalty."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    mean[0], scale[0] = 0, 1
    field = LineField(mean, scale, np.zeros(features.shape[1]), np.zeros((2, 2)))
    x = (features - mean) / scale
    y = np.repeat(labels, counts).astype(np.float64)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (counts[labels == label] - 1).sum()
    n = len(y)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (field.unary, field.pair)]
    for i in range(1, rounds + 1):
        good, pairs = field.marginals(features, counts)
        slopes = (x.T @ (y - good) / n - decay * field.unary / 10, (seen - pairs) / n - decay * field.pair)
        for weights, slope, (m, v) in zip((field.unary, field.pair), slopes, moments, strict=True):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            weights += 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return field


def train_quality(docs: DataFrame, labels: DataFrame, max_docs: int = SAMPLE_DOCS, max_lines: int = SAMPLE_LINES) -> LineField:
    """Fits the field on a hash sample of at most ``max_docs`` labelled documents that are not held out.

    ``labels (doc_id, quality)``; other values than 0 and 1 are left out, as are ids without a text. The features are made on the
    executors; the driver gets those of at most ``max_lines`` lines a document. Without two different labels in the sample every score
    follows the share of good ones.
    """
    picked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    picked = picked.select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "quality").limit(max_docs)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("quality").to_pylist(), strict=True):
                features, _, _ = line_features([text.as_py().encode()])
                columns = [pa.array([label], pa.int32()), pa.array([features[:max_lines].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["quality", "features"])

    texts = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = texts.orderBy("doc_id", "quality").select("text", F.col("quality").cast("int")).mapInArrow(extract, "quality int, features binary").limit(2 * max_docs).collect()
    parts = [np.frombuffer(bytes(r.features), np.float32).reshape(-1, N_FEATURES) for r in rows]
    y = np.array([r.quality for r in rows])
    if len(set(y.tolist())) < 2:
        prior = np.zeros(N_FEATURES)
        prior[0] = 0.0 if not len(y) else (30.0 if y[0] else -30.0)
        return LineField(np.zeros(N_FEATURES), np.ones(N_FEATURES), prior, np.zeros((2, 2)))
    return fit(np.vstack(parts), np.array([len(p) for p in parts]), y)


def score_quality(docs: DataFrame, field: LineField) -> DataFrame:
    """``docs`` with ``score``: the mean of its lines' probabilities of being good, weighted by their lengths.

    Whole texts are read; null texts count as empty, which is one empty line. No shuffle: rows are scored where they are. Only the
    text is looked at. Repeated rows get equal scores; a ``score`` column is replaced.
    """
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column("text")]
            scores: list[float] = []
            first = 0
            while first < len(texts):
                last, held = first, 0
                while last < len(texts) and (held == 0 or held + len(texts[last]) <= CHUNK_BYTES):
                    held += len(texts[last]) + 1
                    last += 1
                features, weights, counts = line_features(texts[first:last])
                good, _ = field.marginals(features, counts)
                begin = np.cumsum(counts) - counts
                scores.extend(np.add.reduceat(good * weights, begin) / np.add.reduceat(weights, begin))
                first = last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(scores, 0, 1), pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(score, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` (1 if the score is ``threshold`` or more) and ``held_out``."""
    docs = docs.drop("score", "predicted", "held_out")
    scored = score_quality(docs, train_quality(docs, labels))
    return scored.withColumns({"predicted": (F.col("score") >= threshold).cast("int"), "held_out": held_out()})
