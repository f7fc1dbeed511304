"""Parts that other code relies on, against plain versions."""

import random

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from quillrank.llm.common import component_labels
from quillrank.llm.hashing import Rolling, shingle_set
from quillrank.llm.language_id import ByteNetwork, pooled
from quillrank.llm.near_duplicates import choose_bands, intersections
from quillrank.llm.packing import cut, encoder
from quillrank.llm.quality import LineField, line_features
from quillrank.llm.suffix_sort import blind_trie, order_suffixes


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    labels = {}
    for u, v in edges:
        labels.setdefault(u, u), labels.setdefault(v, v)
    for _ in labels:
        for u, v in edges:
            labels[u] = labels[v] = min(labels[u], labels[v])
    found = {r.node: r.label for r in component_labels(spark.createDataFrame(edges, "u long, v long")).collect()}
    alone = {u for u, v in edges if u == v} - {x for u, v in edges if u != v for x in (u, v)}
    assert found == {k: v for k, v in labels.items() if k not in alone}


def test_encoder_equals_the_tokenizers_library():
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    encode = encoder(path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json"))
    rng = random.Random(2)
    alphabet = "aB z'sé ß\n\t\r\x0b\x1c\x85  　中𝒳٣½_-<|>0‍\x00"
    texts = ["", "<|endoftext|>", " a <|endoftext|>\n\n<|endoftext|>  <|endoftext| x<|endoftext|>y", "it's  we'll \n\n x", *("".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(400))]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_cut():
    for n in range(1, 12):
        pieces = list(cut(bytes(4 * n), 4))
        assert [len(p) // 4 for _, p in pieces][1:] == [4] * (len(pieces) - 1)
        assert [s for s, _ in pieces] == np.cumsum([0, *(len(p) // 4 for _, p in pieces)])[:-1].tolist()
        assert sum(len(p) // 4 for _, p in pieces) == n


def test_rolling_hashes_depend_on_content_alone():
    data = np.frombuffer(b"abcabcabcXabc", np.uint8)
    for base in (0, 1):
        h = Rolling(data, base)(np.array([0, 3, 10, 1, 0]), np.array([3, 6, 13, 4, 2]))
        assert h[0] == h[1] == h[2] and len(set(h.tolist())) == 3
        assert len(set(Rolling(data, base).grams(3).tolist())) == 6
    assert len(shingle_set(b"a b c d e f")) == 2 and len(shingle_set(b"a b")) == 1 and len(shingle_set(b" \n")) == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = rng.integers(97, 97 + rng.integers(1, 4), 60, dtype=np.uint8)
        buffer = np.concatenate([np.tile(base, 5), rng.integers(97, 99, 100, dtype=np.uint8), base, base])
        depth = int(rng.integers(33, 60))
        starts = rng.permutation(len(buffer) - depth)
        group = rng.integers(0, 3, len(starts))
        order, rank = order_suffixes(buffer, starts, group, depth)
        keys = [(group[i], buffer[starts[i] : starts[i] + depth].tobytes()) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(len(starts)))
        assert all((rank[i] == rank[i - 1]) == (keys[i] == keys[i - 1]) for i in range(1, len(keys)))


def test_blind_trie():
    rng = random.Random(5)
    strings = ["".join(rng.choices("ab", k=6)).encode() for _ in range(80)]
    found = blind_trie(strings)
    assert [strings[g[0]] for g in found] == sorted(set(strings))
    assert all(strings[i] == strings[g[0]] for g in found for i in g) and sum(map(len, found)) == 80


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = choose_bands(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 160


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    expected = [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:20]]
    assert intersections(sets[:20], sets[20:], width=64).tolist() == expected


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    features, _, counts = line_features([b"one two\nTHREE!! four\n\nfive five", b"x"])
    field = LineField(np.zeros(features.shape[1]), np.ones(features.shape[1]), rng.standard_normal(features.shape[1]), rng.standard_normal((2, 2)))
    good, pairs = field.marginals(features, counts)
    score = features @ field.unary
    expected, first, joint = np.zeros(len(score)), 0, np.zeros((2, 2))
    for n in counts:
        total = 0.0
        own, both = np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            weight = np.exp(sum(score[first + i] * y[i] for i in range(n)) + sum(field.pair[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += weight
            own += weight * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                both[a, b] += weight
        expected[first : first + n] = own / total
        joint += both / total
        first += n
    assert np.allclose(good, expected) and np.allclose(pairs, joint)


def plain_states(net, text, direction):
    """States of one direction, byte by byte, as the equations of a gated recurrent unit have them."""
    look, turn = net.look[direction], net.turn[direction]
    hidden = len(turn)
    state, states = np.zeros(hidden), []
    for byte in text if direction == 0 else text[::-1]:
        seen, past = look[byte], state @ turn
        reset, update = 1 / (1 + np.exp(-(seen[: 2 * hidden] + past[: 2 * hidden]))).reshape(2, hidden)
        new = np.tanh(seen[2 * hidden :] + reset * past[2 * hidden :])
        state = update * state + (1 - update) * new
        states.append(state)
    return np.array(states if direction == 0 else states[::-1])


def test_network_state_runs_through_whole_texts(monkeypatch):
    """Also across chunks and groups, over NUL bytes, and whatever the texts beside are."""
    rng = np.random.default_rng(6)
    net = ByteNetwork.fresh(3, 4)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (1, 700, 64, 65, 3, 128, 200)] + [b"\0" * 70, b"a\0b"]
    means = []
    for text in texts:
        odds = np.concatenate([plain_states(net, text, 0), plain_states(net, text, 1)], axis=1) @ net.out + net.bias
        means.append((np.exp(odds) / np.exp(odds).sum(axis=1, keepdims=True)).mean(axis=0))
    assert np.allclose(pooled(net, texts), means, atol=1e-5)
    monkeypatch.setattr("quillrank.llm.language_id.GROUP_TEXTS", 2)
    assert np.allclose(pooled(net, texts), means, atol=1e-5)
    monkeypatch.setattr("quillrank.llm.language_id.GROUP_BYTES", 100)
    assert np.allclose(pooled(net, texts), means, atol=1e-5)


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = ByteNetwork.fresh(3, 4)
    net = ByteNetwork(*(w.astype(np.float64) for w in net.parts()))
    data, labels, lengths = rng.integers(0, 5, (6, 7)).astype(np.uint8), rng.integers(0, 3, 6), np.array([7, 7, 5, 4, 2, 1])

    def loss():
        found = net.scores([row[:n].tobytes() for row, n in zip(data, lengths, strict=True)])
        return -sum(np.log(p[:, label]).sum() for p, label in zip(found, labels, strict=True)) / lengths.sum()

    for weights, slope in zip(net.parts(), net.slopes(data, lengths, labels), strict=True):
        for _ in range(10):
            at = tuple(int(rng.integers(0, min(n, 5))) for n in weights.shape)
            before = weights[at]
            weights[at] = before + 1e-3
            up = loss()
            weights[at] = before - 1e-3
            down = loss()
            weights[at] = before
            assert abs((up - down) / 2e-3 - slope[at]) < 1e-4
