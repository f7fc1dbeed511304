"""Conversation repair, filter audit and decontamination: odd inputs, and plain versions to agree with."""

import random
import re
import zlib
from hashlib import sha256
from itertools import permutations, product

import numpy as np
import pytest

from quillrank.llm import conversation_repair as repair
from quillrank.llm.conversation_repair import audit_conversations, damage, repair_conversations
from quillrank.llm.decontamination import decontaminate, find_leaks, find_windows
from quillrank.llm.filter_audit import SURVIVAL, audit_filters, positional_counts

TURNS = "conv_id long, turn long, role string, text string, fault int, _c string, _block int"
DOCS = "doc_id long, text string, source string, n_words int, items string, digest int, part string, n_chars long"
ITEMS = "item_id string, text string, k int"


# Conversations


def cheapest(kinds, faults):
    """Cost and ASCII-least audit of the cheapest repair, by trying all plans of growing cost."""
    best = []
    longest = 2 * len(kinds) + 2

    def go(i, state, cost, audit, budget):
        if cost > budget or len(audit) > longest:
            return
        if i == len(kinds) and state in ("", "a"):
            best.append((cost, audit))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        go(i, "a" if state == "u" else "u", cost + 2, audit + "I", budget)
        if i < len(kinds):
            late = int(faults[i] == 3)
            go(i + 1, state, cost + 3, audit + "D", budget)
            if faults[i] not in (1, 2):
                if kinds[i] in follows:
                    go(i + 1, kinds[i], cost + late, audit + "K", budget)
                go(i + 1, "a" if state == "u" else "u", cost + 2 + late, audit + "R", budget)

    for budget in range(0, 3 * len(kinds) + 1):
        go(0, "", 0, "", budget)
        if best:
            return min(best)
    return 0, ""


def plain_repair(rows):
    """``{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)}`` of rows ``(conv_id, turn, role, text)``."""
    found = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if role is None else role, " " if x is None else x) for c, t, role, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        faults, seen = [], set()
        for _, role, text in own:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(1 if not said else 2 if (role, text) in seen else 0 if said[-1] in ".!?" else 3)
            seen.add((role, text))
        kinds = [role[0] if role[:1] in ("s", "u", "a") and role else "?" for _, role, _ in own]
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        cost, audit = cheapest(kinds, faults)
        lines, i, state = [], 0, ""
        for edit in audit:
            to = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[to]
            if edit == "I":
                lines.append(f"{name}:")
                state = to
                continue
            _, role, text = own[i]
            if edit == "K":
                lines.append(f"{role}:{text}")
                state = kinds[i]
            elif edit == "R":
                lines.append(f"{name}:{text}")
                state = to
            i += 1
        digest = sha256("\n".join(lines).encode()).hexdigest()
        found[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest)
    return found


def conversations(seed, n=24):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        turn = 0
        for _ in range(rng.randrange(1, 6)):
            turn += rng.choice([1, 1, 1, 2, 5])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hello.", "Why?", "no end", "", " \n", None, f"said {rng.randrange(99)}!", "Hello.", "x. \t"])
            rows.append((conv, rng.choice([turn] * 9 + [None]), role, text))
    # Rows of one turn are only in a stated order if their roles differ.
    unique = {(c, t, r): (c, t, r, x) for c, t, r, x in rows}
    return list(unique.values())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)


def audits(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("spans", [False, True])
def test_repairs_equal_all_plans_tried(spark, spans):
    rows = conversations(1)
    given = frame(spark, rows)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    if spans:
        # So many partitions that most conversations have several blocks.
        spark.conf.set("spark.sql.shuffle.partitions", 30)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        if spans:
            placed = repair.in_order(given).groupBy("_c").agg({"_block": "min", "_block": "max"}).collect()
            assert len(placed) == len({r[0] for r in rows})
        assert audits(audit_conversations(given, given)) == plain_repair(rows)
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_repaired_turns_alternate(spark):
    turns = repair_conversations(frame(spark, conversations(2))).collect()
    by_conv = {}
    for r in sorted(turns, key=lambda r: tuple(r.place)):
        by_conv.setdefault(r.conv_id, []).append(r)
    for conv in by_conv.values():
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in conv))
        assert all(r.text == "" for r in conv if r.edit == "I") and all(r.edit in "IKR" for r in conv)


def test_least_paths_equal_a_walk():
    """Doubled pointers against one letter at a time, on random blocks entered in any state."""
    rng = np.random.default_rng(3)
    tables, kinds, found, ends, opens = [], [], [], [], []
    for _ in range(40):
        n = int(rng.integers(1, 40))
        k, f = rng.integers(0, 4, n), rng.integers(0, 4, n)
        is_open = bool(rng.integers(0, 2))
        tables.append(repair._costs(k, f, list(rng.integers(0, 6, 4)) if is_open else repair._TERMINAL))
        kinds.append(np.append(k, 0)), found.append(np.append(f, 0))
        ends.append(np.append(np.zeros(n, bool), True)), opens.append(np.append(np.zeros(n, bool), is_open))
    costs, kinds, found, ends, opens = map(np.concatenate, (tables, kinds, found, ends, opens))
    firsts = np.append(0, np.flatnonzero(ends)[:-1] + 1)
    roots = np.array([4 * p + q for p in firsts for q in range(4) if costs[p, q] < repair._FAR])
    paths, states = repair.least_paths(costs, kinds, found, ends, opens, roots)

    def steps(place, q):
        """Optimal arcs from a node in order of their letters."""
        here, to = costs[place, q], int(repair._NEXT[q])
        last, extra = ends[place], int(found[place] == 3)
        if not last and costs[place + 1, q] + 3 == here:
            yield "d", place + 1, q
        if not (last and opens[place]) and costs[place, to] + 2 == here:
            yield "UA"[to - 2], place, to
        if not last and found[place] not in (1, 2):
            kind = int(kinds[place])
            if (kind, q) in {(1, 0), (2, 0), (2, 1), (2, 3), (3, 2)} and costs[place + 1, kind] + extra == here:
                yield "k", place + 1, kind
            if costs[place + 1, to] + 2 + extra == here:
                yield "ua"[to - 2], place + 1, to

    for root, path, state in zip(roots, paths, states, strict=True):
        place, q, walked = root // 4, root % 4, ""
        while (step := next(steps(place, q), None)) is not None:
            letter, place, q = step
            walked += letter
        assert (walked, q) == (path, state)


def test_damage(spark):
    rows = [(c, t, "assistant", f"One. Two! {c}? {t}") for c in (None, *range(20)) for t in (None, *range(6))]
    found = sorted(tuple(map(str, r)) for r in damage(frame(spark, rows)).collect())
    expected = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = tuple(map(str, (c, t, "user" if kind == 4 else role, text)))
        expected += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert found == sorted(expected)


def test_conversations_without_rows(spark):
    given = frame(spark, [(5, 1, "user", "Hi."), (5, 2, "assistant", "Ho.")])
    nothing = given.limit(0)
    assert audits(audit_conversations(nothing, given)) == {5: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}
    assert audits(audit_conversations(given, nothing)) == {} and repair_conversations(nothing).collect() == []


def test_one_long_conversation_of_repeated_turns(spark):
    """Half a conversation is one text, and all of its turns are missing."""
    rows = [(1, None, "user", "same.")] * 150 + [(1, None, "assistant", f"{i}.") for i in range(150)]
    (r,) = audit_conversations(frame(spark, rows), frame(spark, rows)).collect()
    assert (r.gaps, r.duplicate, len(r.audit.replace("I", ""))) == (0, 149, 300)
    # The assistant's turns come first, and every other one becomes the user's; of the user's one stays and is answered.
    assert r.audit.count("D") == 149
    assert r.cost == 2 * 75 + 3 * 149 + 2


# Filters


def plain_audit(docs, labels):
    rows = []
    least = {}
    for d, text, _ in docs:
        least[text or ""] = min(least.get(text or "", d), d, key=lambda x: (x is not None, x or 0))
    for d, text, source in docs:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        fails = [
            len(words) < 50,
            100 * len(set(words)) < 65 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            bool(re.search("[#$%&*|]", text)),
            d is not None and least[text] != d,
        ]
        judged = [(q, t) for i, q, t in labels if i is not None and i == d]
        rows.append((source or "", {f for f, bad in zip("ABCDE", fails) if bad}, any(q == 1 for q, _ in judged), any(t == 1 for _, t in judged)))
    found = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        counts = {}
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = sum(f in r[1] for r in own) - len(gone)
                left = [r for r in left if f not in r[1]]
                only = sum(r[1] == {f} for r in own)
                counts[part, "".join(order), step] = [len(left), len(gone), before, only, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[f] += len(gone)
        for key, values in counts.items():
            found[key] = (*values, total[key[1][key[2] - 1]])
    return found


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def filter_docs():
    rng = random.Random(4)
    texts = [None, "", " \t\n", "A B C", "word " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)), "a# b", "é è " * 40, "x" * 3000]
    docs = [(d, rng.choice(texts), rng.choice(["a", "b", "", None])) for d in range(80)]
    docs += [(None, texts[5], "a"), (None, texts[5], "a"), (7, texts[5], "b"), (7, texts[5], "b")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(0, 90, 2)] + [(None, 1, 1), (4, 1, 0), (4, 1, 0)]
    return docs, labels


def test_filter_audit_equals_all_orders_applied(spark):
    docs, labels = filter_docs()
    given = spark.createDataFrame([(d, t, s, 1, "x", 2, "y", 3) for d, t, s in docs], DOCS)
    judged = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit_rows(audit_filters(given, judged)) == plain_audit(docs, labels)
    assert audit_filters(given.limit(0), judged).collect() == []
    unjudged = audit_rows(audit_filters(given, judged.limit(0)))
    assert {k: v[:4] for k, v in unjudged.items()} == {k: v[:4] for k, v in plain_audit(docs, []).items()}


def test_survival_words():
    for failed, subset in product(range(32), range(32)):
        assert bool(int(SURVIVAL[failed]) >> subset & 1) == (not failed & subset)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 100, 4097])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert positional_counts(words).tolist() == [int(((words >> b) & 1).sum()) for b in range(32)]


# Benchmark passages


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def plain_leaks(docs, items, n=10):
    found = []
    grams = {}
    for item, text in items:
        words = split(text)
        for i in range(max(1, len(words) - n + 1) if words else 0):
            grams.setdefault(tuple(words[i : i + n]), set()).add(item or "")
    for d, text in docs:
        words, hit, ids = split(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    ids |= grams[tuple(words[i : i + k])]
        found.append((str(d), len(words), len(hit), sorted(ids), bool(hit)))
    return sorted(found)


PASSAGE = "The first, the second; third fourth FIFTH sixth seventh eighth ninth tenth eleventh twelfth"
DOCUMENTS = [
    (1, None), (2, ""), (3, "nothing here"), (4, f"Before it. {PASSAGE}. After it."), (4, f"Before it. {PASSAGE}. After it."),
    (5, PASSAGE.upper().replace(" ", "--\n")), (6, "a word short item é"), (7, "short item"), (8, "SHORT\titem, short item"), (None, PASSAGE),
    (9, "x" * 50_000 + " " + PASSAGE), (10, " ".join(f"w{i}" for i in range(3000)) + " " + PASSAGE + " " + "y " * 3000), (11, PASSAGE[:60]),
    (12, "Äther ÄTHER äther"), (13, "\x00\x00the\x00first"),
]
BENCHMARK = [("b", PASSAGE), ("a", "The " + PASSAGE), ("short", "Short item"), (None, "Äther"), ("none", "--"), ("empty", None), ("b", "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15")]


def leak_frames(spark):
    docs = spark.createDataFrame([(d, t, "s", 1, "x", 2, "y", 3) for d, t in DOCUMENTS], DOCS)
    return docs, spark.createDataFrame([(i, t, 1) for i, t in BENCHMARK], ITEMS)


def leak_rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in df.collect())


def test_leaks_equal_brute_force(spark, monkeypatch):
    docs, items = leak_frames(spark)
    expected = plain_leaks(DOCUMENTS, BENCHMARK)
    found = find_leaks(docs, items)
    assert leak_rows(found) == expected
    assert found.columns == [*(c for c in docs.columns if c not in ("n_words", "items")), "n_words", "n_hit", "items", "contaminated"]
    assert leak_rows(find_leaks(docs, items.limit(0))) == [(d, n, 0, [], False) for d, n, *_ in expected]
    assert find_leaks(docs.limit(0), items).collect() == []


def test_windows_in_several_passes_and_slices(spark, monkeypatch):
    docs, items = leak_frames(spark)
    whole = sorted(map(str, find_windows(docs, items).collect()))
    assert sorted(map(str, find_windows(docs, items, pass_bytes=900).collect())) == whole


@pytest.mark.parametrize("size", [5, 60, 400])
def test_slices_lose_no_window(size, monkeypatch):
    import pyarrow as pa

    from quillrank.llm import decontamination as module

    monkeypatch.setattr(module, "SLICE", size)
    rows = {"item": [], "k": [], "gram": []}
    for item, text in BENCHMARK:
        words = split(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            rows["item"].append(item or ""), rows["k"].append(min(10, len(words))), rows["gram"].append(" ".join(words[i : i + 10]))
    held = type("Held", (), {"value": (f"t{size}", rows)})
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    row = pa.StructArray.from_arrays([pa.array([t for _, t in DOCUMENTS])], ["text"])
    n = len(DOCUMENTS)
    batch = pa.RecordBatch.from_arrays(
        [row, pa.array([0] * n), pa.array([None] * n, kind), pa.array([None] * n, pa.list_(pa.string()))], names=["_row", "n_words", "hits", "items"]
    )
    (out,) = module._scan([batch], held)
    found = [
        (str(d), w, sum(r["last"] - r["first"] for r in h), i, bool(h))
        for (d, _), w, h, i in zip(DOCUMENTS, *(out.column(c).to_pylist() for c in ("n_words", "hits", "items")), strict=True)
    ]
    assert sorted(found) == plain_leaks(DOCUMENTS, BENCHMARK)


def test_decontaminate(spark):
    docs, items = leak_frames(spark)
    bad = {d for d, _, n, *_ in plain_leaks(DOCUMENTS, BENCHMARK) if n}
    kept = decontaminate(docs, items, remove="documents")
    assert kept.columns == docs.columns and {str(r.doc_id) for r in kept.collect()} == {str(d) for d, _ in DOCUMENTS} - bad
    cut = decontaminate(docs, items)
    assert cut.schema.fieldNames() == docs.schema.fieldNames() and cut.count() == len(DOCUMENTS)
    texts = {str(r.doc_id): r for r in cut.collect()}
    assert texts["4"].text == "Before it. . After it." and texts["4"].n_chars == len(texts["4"].text)
    assert texts["1"].text is None and texts["3"].text == "nothing here" and texts["3"].n_chars == 3
    assert texts["8"].text == "" and texts["6"].text == "a word  é"
    assert not any(r.contaminated for r in find_leaks(cut.where("doc_id <> 12"), items.where("item_id IS NOT NULL")).collect())
    with pytest.raises(ValueError):
        decontaminate(docs, items, remove="words")
