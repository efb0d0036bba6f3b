import hashlib
import random
import re

import pytest

from boxlens.llm import decontaminate as D

SCHEMA = "doc_id bigint, text string, hits string, item_id string"
ITEMS = "item_id bigint, text string, n_words string"


def slow_words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def slow(docs, items, window=10, slop=10):
    wins = {}
    for name, text in items:
        ws = slow_words(text)
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            wins.setdefault(tuple(ws[i : i + window]), set()).add(name)
    out = []
    for name, text in docs:
        ws, hit, got = slow_words(text), set(), set()
        for w, owners in wins.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    got |= owners
        names = sorted(map(str, got))
        out.append((name, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    vocab = ["The", "of", "été", "n1"] + [f"w{i}" for i in range(30)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, say(rng.choice([1, 4, 10, 11, 25]))) for i in range(12)] + [(50, []), (51, ["of"] * 15)]
    docs = [(1, []), (2, ["the"]), (3, ["of"] * 40)]
    for i in range(60):
        ws = say(rng.choice([5, 60, 200]))
        if i % 2:
            w = rng.choice(items[:12])[1]
            lo = rng.randrange(len(w))
            ws[rng.randrange(len(ws)) :][:0] = w[lo:]
            at = rng.randrange(len(ws))
            ws[at:at] = w
        docs.append((100 + i, ws))
    join = lambda ws: "".join(w + rng.choice([" ", ", ", ".\n", "-"]) for w in ws)
    docs = [(i, join(ws)) for i, ws in docs] + [(7, None), (100, "repeated id"), (2, "the")]
    return docs, [(i, join(ws)) for i, ws in items] + [(52, None), (0, join(items[3][1]))]


@pytest.mark.parametrize("query_bytes, shard, piece", [(2_000_000, 1 << 20, 1 << 20), (150, 300, 7)])
def test_matches_brute_force(spark, monkeypatch, query_bytes, shard, piece):
    for name, value in (("QUERY_BYTES", query_bytes), ("SHARD_WORDS", shard), ("PIECE", piece)):
        monkeypatch.setattr(D, name, value)
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS)
    rows = D.summary(D.contamination(frame, bench)).collect()
    got = sorted(((r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str)
    assert got == slow(docs, items)
    assert all(r.n_near >= r.n_items for r in rows)


def test_proximity(spark):
    words = [f"k{i}" for i in range(10)]
    near = words[:4] + ["x"] * 5 + words[:3:-1]  # all ten words, out of order, over 15 places
    far = words[:4] + ["x"] * 40 + words[4:]
    docs = spark.createDataFrame([(1, " ".join(near), "", ""), (2, " ".join(far), "", ""), (3, " ".join(words), "", "")], SCHEMA)
    bench = spark.createDataFrame([(9, " ".join(words), "")], ITEMS)
    got = {r.id: (r.n_hit, r.n_near) for r in D.summary(D.contamination(docs, bench)).collect()}
    assert got == {1: (0, 1), 2: (0, 0), 3: (10, 1)}


def test_empty(spark):
    none, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b", "")], ITEMS)
    one = spark.createDataFrame([(1, "a b", "", "")], SCHEMA)
    assert D.summary(D.contamination(none, bench)).collect() == []
    row = D.summary(D.contamination(one, spark.createDataFrame([], ITEMS))).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
