"""Vectorized hashing of byte strings, words and word runs (numpy)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Odd multipliers of the rolling hashes, and their inverses modulo 2**64.
BASES = tuple(U64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_INVERSES = tuple(U64(pow(int(b), -1, 1 << 64)) for b in BASES)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The final mix of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: int = 0, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of a base, or of its inverse; kept for later calls."""
    key = (base, inverse)
    known = _powers.get(key)
    if known is None or len(known) < n:
        factor = (_INVERSES if inverse else BASES)[base]
        steps = np.full(max(n, 1 << 12), factor, U64)
        steps[0] = 1
        known = np.cumprod(steps)
        if n <= 1 << 20:
            _powers[key] = known
    return known[:n]


class Rolling:
    """Hashes of any substrings of ``data`` in constant time each, by prefix sums of powers."""

    def __init__(self, data: np.ndarray, base: int = 0):
        self._n, self._base = len(data), base
        self._sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(len(data), base), out=self._sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._sums[ends] - self._sums[starts]) * powers(self._n + 1, self._base, True)[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all substrings of ``k`` bytes."""
        n = self._n - k + 1
        return mix((self._sums[k:] - self._sums[:n]) * powers(n, self._base, True))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word, words being runs of anything but ASCII white space."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return Rolling(data)(starts, ends) if len(starts) else np.zeros(0, U64)


def shingle_set(text: bytes, k: int = 5) -> np.ndarray:
    """Distinct hashes of runs of ``k`` words in ascending order; of all words if there are fewer; empty without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    hashes = np.zeros(n, U64)
    for j in range(k):
        hashes = hashes * BASES[1] + words[j : j + n]
    return np.unique(mix(hashes + U64(k)))
