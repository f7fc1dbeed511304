"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.common import held_out, text_or_empty

#: Training documents of each language, the windows taken of each of them, and the bytes of a window.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOW = 400, 4, 160
HIDDEN = 8
#: Texts that advance together, and bytes they may hold together; a longer text advances alone.
GROUP_TEXTS, GROUP_BYTES = 1024, 1 << 23
#: Bytes after which texts that have ended leave their group.
CHUNK = 32


@dataclass
class ByteNetwork:
    """Weights; the first axis of ``look, turn`` is the direction, forward and backward.

    look: what each byte adds to the gates (reset, update, candidate); turn: what the state adds; out, bias: languages' scores from
    both states.
    """

    look: np.ndarray
    turn: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, n_languages: int, hidden: int = HIDDEN, seed: int = 11) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            draw(0.3, 2, 256, 3 * hidden), draw(0.3, 2, hidden, 3 * hidden), draw(0.3, 2 * hidden, n_languages), np.zeros(n_languages, np.float32)
        )

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.look, self.turn, self.out, self.bias

    def by_gate(self) -> tuple[np.ndarray, np.ndarray]:
        """``look`` as ``(direction * gate * byte, hidden)``, ``turn`` as ``(direction, gate, hidden, hidden)``; signs as sigmoids need them."""
        hidden = self.turn.shape[1]
        sign = np.array([-1, -1, 1], self.look.dtype)[:, None, None]
        look = self.look.reshape(2, 256, 3, hidden).transpose(0, 2, 1, 3) * sign
        turn = self.turn.reshape(2, hidden, 3, hidden).transpose(0, 2, 1, 3) * sign
        return look.reshape(-1, hidden), np.ascontiguousarray(turn)

    def scores(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """For each of ``texts``, which come in order of falling length, its languages' probabilities at each byte.

        The state of either direction runs through the whole of a text. Both directions start at once, one at the text's
        first byte and one at its last, so texts of any length advance together until they end.
        """
        look, turn = self.by_gate()
        hidden, n = self.turn.shape[1], len(self.bias)
        chunks = np.array([max(1, -(-len(t) // CHUNK)) for t in texts])
        starts = np.cumsum(chunks) - chunks
        # Each text forwards and backwards, filled up to whole chunks; what is read beyond its end changes nothing before it.
        data = np.zeros((2, int(chunks.sum()) * CHUNK), np.uint8)
        for text, at in zip(texts, (starts * CHUNK).tolist(), strict=True):
            data[0, at : at + len(text)] = np.frombuffer(text, np.uint8)
            data[1, at : at + len(text)] = data[0, at : at + len(text)][::-1]
        data = data.reshape(2, -1, CHUNK)
        odds = np.empty((*data.shape, n), look.dtype)
        state = np.zeros((2, len(texts), hidden), look.dtype)
        for c in range(int(chunks[0]) if len(texts) else 0):
            active = int(np.searchsorted(-chunks, -c))
            own = starts[:active] + c
            rows = _table_rows(data[:, own].transpose(2, 0, 1))
            state = state[:, :active]
            states = np.empty((2, CHUNK, active, hidden), look.dtype)
            for t in range(CHUNK):
                state = advance(look, turn, rows[t], state)
                states[:, t] = state
            for direction in range(2):
                found = states[direction].reshape(-1, hidden) @ self.out[direction * hidden : (direction + 1) * hidden]
                odds[direction, own] = found.reshape(CHUNK, active, n).transpose(1, 0, 2)
        odds = odds.reshape(2, -1, n)
        ones = np.ones((n, 1), look.dtype)
        for text, at in zip(texts, (starts * CHUNK).tolist(), strict=True):
            both = odds[0, at : at + len(text)] + odds[1, at : at + len(text)][::-1]
            both += self.bias
            np.exp(both, out=both)  # states are within 1, so the scores are small
            both /= both @ ones
            yield both

    def slopes(self, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean cross entropy over the bytes of windows, by backpropagation through time.

        ``data`` is ``(windows, steps)``, of which the first ``lengths`` count.
        """
        look, turn = self.by_gate()
        hidden, (n, steps) = self.turn.shape[1], data.shape
        at = np.arange(steps)
        real = at < lengths[:, None]
        turned = np.where(real, lengths[:, None] - 1 - at, at)
        reading = np.stack([data, np.take_along_axis(data, turned, 1)])
        rows = _table_rows(reading.transpose(2, 0, 1))
        state, states, kept = np.zeros((2, n, hidden), look.dtype), np.empty((2, n, steps, hidden), look.dtype), []
        for t in range(steps):
            state = advance(look, turn, rows[t], state, kept)
            states[:, :, t] = state
        both = np.concatenate([states[0], np.take_along_axis(states[1], turned[..., None], 1)], axis=-1)
        logits = both @ self.out + self.bias
        wrong = np.exp(logits - logits.max(axis=-1, keepdims=True))
        wrong /= wrong.sum(axis=-1, keepdims=True)
        wrong[np.arange(n), :, labels] -= 1
        wrong *= real[..., None] / max(1, real.sum())
        g_out = np.einsum("nth,ntk->hk", both, wrong)
        from_out = wrong @ self.out.T
        own = np.stack([from_out[..., :hidden], np.take_along_axis(from_out[..., hidden:], turned[..., None], 1)])
        g_look, g_turn = np.zeros_like(self.look), np.zeros_like(self.turn)
        carried, from_look = np.zeros((2, n, hidden), own.dtype), np.empty((2, n, steps, 3 * hidden), own.dtype)
        for t in range(steps - 1, -1, -1):
            state, past, reset, update, new = kept[t]
            d_state = own[:, :, t] + carried
            d_new = d_state * (1 - update) * (1 - new * new)
            d_update = d_state * (state - new) * update * (1 - update)
            d_reset = d_new * past * reset * (1 - reset)
            from_look[:, :, t] = np.concatenate([d_reset, d_update, d_new], axis=2)
            d_past = np.concatenate([d_reset, d_update, d_new * reset], axis=2)
            g_turn += state.transpose(0, 2, 1) @ d_past
            carried = d_state * update + d_past @ self.turn.transpose(0, 2, 1)
        for direction in range(2):
            order = np.argsort(reading[direction], axis=None, kind="stable")
            values, first = np.unique(reading[direction].ravel()[order], return_index=True)
            g_look[direction, values] = np.add.reduceat(from_look[direction].reshape(n * steps, -1)[order], first)
        return [g_look, g_turn, g_out, wrong.sum(axis=(0, 1))]


def _table_rows(data: np.ndarray) -> np.ndarray:
    """Rows of ``by_gate``'s first table for bytes ``(steps, 2, texts)`` read in both directions: ``(steps, 2, 3, texts)``."""
    return data[:, :, None].astype(np.intp) + np.arange(6).reshape(2, 3, 1) * 256


def advance(look: np.ndarray, turn: np.ndarray, rows: np.ndarray, state: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States ``(2, texts, hidden)`` after one more byte in both directions."""
    seen = look.take(rows, axis=0)
    past = state[:, None] @ turn
    gates = seen[:, :2]
    gates += past[:, :2]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    new = seen[:, 2]
    new += past[:, 2] * gates[:, 0]
    np.tanh(new, out=new)
    if keep is not None:
        keep.append((state, past[:, 2], gates[:, 0], gates[:, 1], new))
    state = state - new
    state *= gates[:, 1]
    state += new
    return state


def pooled(network: ByteNetwork, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over the bytes of each text; texts must not be empty."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    means = np.empty((len(texts), len(network.bias)))
    first = 0
    while first < len(order):
        last, held = first, 0
        while last < len(order) and last - first < GROUP_TEXTS and (last == first or held + len(texts[order[last]]) <= GROUP_BYTES):
            held += len(texts[order[last]])
            last += 1
        some = order[first:last]
        for i, found in zip(some, network.scores([texts[i] for i in some]), strict=True):
            means[i] = found.mean(axis=0, dtype=np.float64)
        first = last
    return means / means.sum(axis=1, keepdims=True)


def fit(
    rows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, n_languages: int, steps: int = 240, batch: int = 96, rate: float = 0.015, seed: int = 5
) -> ByteNetwork:
    """A network fitted by Adam on windows drawn evenly from the languages."""
    network = ByteNetwork.fresh(n_languages)
    rng = np.random.default_rng(seed)
    by_label = [np.flatnonzero(labels == k) for k in range(n_languages)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in network.parts()]
    for i in range(1, steps + 1):
        picked = np.concatenate([rng.choice(own, -(-batch // n_languages)) for own in by_label])
        slopes = network.slopes(rows[picked], lengths[picked], labels[picked])
        step = rate * min(1.0, 2 * (1 - (i - 1) / steps))
        for weights, slope, (m, v) in zip(network.parts(), slopes, moments, strict=True):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            weights -= step * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return network


def train_language(docs: DataFrame, docs_per_language: int = SAMPLE_DOCS, per_doc: int = SAMPLE_WINDOWS) -> tuple[list[str], ByteNetwork | None]:
    """The languages in order of name, and a network fitted on a bounded hash sample.

    Of each language at most ``docs_per_language`` documents that are not held out and have a text, and of each of these at
    most ``per_doc`` windows of ``WINDOW`` bytes, evenly spread. Without a labelled text there are no languages and no network.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out())
    picked = usable.select("doc_id", "lang").withColumn("_r", rank).filter(F.col("_r") <= docs_per_language).drop("_r").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, lang, text in zip(*(batch.column(c) for c in ("doc_id", "lang", "text")), strict=True):
                read = text.as_py().encode()
                for i in sorted(set(np.linspace(0, max(0, len(read) - WINDOW), per_doc).astype(int).tolist())):
                    out.append((doc_id.as_py(), i, lang.as_py(), read[i : i + WINDOW]))
            if out:
                types = [pa.int64(), pa.int32(), pa.string(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "lang", "bytes"])

    texts = usable.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])
    rows = texts.mapInArrow(cut, "doc_id long, at int, lang string, bytes binary").orderBy("lang", "doc_id", "at", "bytes").collect()
    languages = sorted({r.lang for r in rows})
    if not languages:
        return [], None
    number = {lang: i for i, lang in enumerate(languages)}
    data = np.stack([np.frombuffer(bytes(r.bytes).ljust(WINDOW, b"\0"), np.uint8) for r in rows])
    lengths = np.array([len(r.bytes) for r in rows])
    return languages, fit(data, lengths, np.array([number[r.lang] for r in rows]), len(languages))


def label_languages(docs: DataFrame, languages: list[str], network: ByteNetwork | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for each document.

    The network reads all of a text in both directions, its states running from end to end, and labels every byte; a document's
    probabilities are the means over its bytes. ``lang_pred`` is the likeliest language and ``score`` its probability to four
    digits, as the last bits depend on which texts are read together. A text that is null or has no letter (also an empty one) is
    ``und`` with score 0, as is any text if nothing was learned. Memory is bounded by ``GROUP_BYTES`` or one text, times about
    four numbers a language. No shuffle; repeated rows get equal results; other columns are not read.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch.column("lettered").to_pylist()
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            wanted = [i for i, some in enumerate(lettered) if some and network is not None]
            if wanted:
                means = pooled(network, [batch.column("text")[i].as_py().encode() for i in wanted])
                for i, best, score in zip(wanted, means.argmax(axis=1), means.max(axis=1).round(4), strict=True):
                    names[i], scores[i] = languages[best], min(1.0, score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    read = docs.select(
        F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    )
    return read.mapInArrow(label, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: languages of all documents, learned from those that are not held out."""
    languages, network = train_language(docs)
    return label_languages(docs, languages, network).withColumn("held_out", held_out())
