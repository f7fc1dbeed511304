"""Deep-shallow ordering of suffixes: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

import numpy as np

WORD = 8


def _words(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number that orders as they do."""
    value = np.zeros(len(at), np.uint64)
    for j in range(WORD):
        value = (value << np.uint64(8)) | buffer[at + j].astype(np.uint64)
    return value


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings of one length."""
    apart = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (apart.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Indexes of equally long strings, equal ones together, in ascending order of the strings.

    Inner nodes know only the depth at which strings part and the byte there. A string goes down by these bytes to some
    leaf, is compared with it once, and is hung in where the comparison shows that it parts.
    """
    root: list = [None, [0]]
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while node[0] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        if s == other:
            node[1].append(i)
            continue
        depth = _common(s, other)
        node = root
        while node[0] is not None and node[0] < depth:
            node = node[1][s[node[0]]]
        if node[0] == depth:
            node[1][s[depth]] = [None, [i]]
        else:
            below = [node[0], node[1]]
            node[0], node[1] = depth, {other[depth]: below, s[depth]: [None, [i]]}
    ordered, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            ordered.append(node[1])
        else:
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
    return ordered


def order_suffixes(
    buffer: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int, shallow: int = 32
) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by group, then by their first ``depth`` bytes, and for each in that
    order a number that equal ones, and only they, share.

    The first ``shallow`` bytes are sorted a machine word at a time, and only suffixes which are not yet alone go on (multikey
    quicksort with words for characters). What is still together then has a long common prefix: pairs are compared at once, larger
    groups go through a blind trie. ``buffer`` must reach ``depth`` bytes beyond every start.
    """
    n = len(starts)
    order = np.lexsort((group,))
    rank = np.zeros(n, np.int64)
    sorted_group = group[order]
    heads = np.ones(n, bool)
    heads[1:] = sorted_group[1:] != sorted_group[:-1]
    # Classes are named by the place of their first member, so a part of a class can be reordered where it is.
    place = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    active = np.arange(n)
    for d in range(0, shallow, WORD):
        size = np.bincount(place[active], minlength=n) if len(active) else np.zeros(n, np.int64)
        active = active[size[place[active]] > 1]
        if not len(active):
            break
        items = order[active]
        word = _words(buffer, starts[items] + d)
        by = np.lexsort((word, place[active]))
        order[active] = items[by]
        cls, word = place[active], word[by]
        new = np.ones(len(active), bool)
        new[1:] = (cls[1:] != cls[:-1]) | (word[1:] != word[:-1])
        place[active] = np.maximum.accumulate(np.where(new, active, 0))
    size = np.bincount(place, minlength=n)
    active = active[size[place[active]] > 1]
    rank[:] = place
    if len(active):
        firsts = np.flatnonzero(size > 1)
        pairs = firsts[size[firsts] == 2]
        for part in np.array_split(pairs, max(1, len(pairs) // 50_000)):
            a, b = order[part], order[part + 1]
            rest = np.arange(shallow, depth)
            left, right = buffer[starts[a][:, None] + rest], buffer[starts[b][:, None] + rest]
            apart = left != right
            at = apart.argmax(axis=1)
            row = np.arange(len(part))
            unequal = apart[row, at] if len(part) else np.zeros(0, bool)
            swap = unequal & (left[row, at] > right[row, at]) if len(part) else unequal
            order[part[swap]], order[part[swap] + 1] = b[swap], a[swap]
            rank[part[unequal] + 1] = part[unequal] + 1
        for first in firsts[size[firsts] > 2]:
            items = order[first : first + size[first]].copy()
            strings = [buffer[s + shallow : s + depth].tobytes() for s in starts[items]]
            at = first
            for same in blind_trie(strings):
                order[at : at + len(same)] = items[same]
                rank[at : at + len(same)] = at
                at += len(same)
    return order, rank
