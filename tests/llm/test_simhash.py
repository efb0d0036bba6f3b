import random

import pytest
import xxhash

from boxlens.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, component string"


def slow_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=3):
    names = [r[0] for r in rows]
    fps = [slow_fingerprint(r[1]) for r in rows]
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                part[find(i)] = find(j)
    return sorted((names[i], fps[i], min(names[j] for j in range(len(rows)) if find(j) == find(i))) for i in range(len(rows)))


def corpus():
    rng = random.Random(5)
    vocab = ["wort", "Ära", "The", "of", "señal", "x1", "été", "ab"] + [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "one two three"), (6, "ONE two three")]
    for i in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 400]))]
        for k in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((100 + len(rows), " ".join(copy)))
    rows.append((500, rows[10][1]))
    rows.append(rows[10])
    return rows


@pytest.mark.parametrize("tree_nodes", [1 << 15, 3])
def test_components_match_brute_force(spark, tree_nodes):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)
    got = sorted((r.id, r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(df, tree_nodes=tree_nodes).collect())
    assert got == slow_components(rows)


def test_long_chain_and_slices(spark, monkeypatch):
    # a chain of fingerprints, each 3 bits from the next: one component, however long
    chain, x = [], 0
    for i in range(21):
        chain.append(x)
        x |= 0b111 << (3 * i)
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in chain], "fp bigint")
    roots = simhash.components(simhash.fingerprint_links(df, tree_nodes=2)).collect()
    assert {r.root for r in roots} == {0} and len(roots) == 21
    text = " ".join(str(i % 37) for i in range(1000))
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_id(spark):
    df = spark.createDataFrame([(None, "a b c", "", ""), (4, "a b c", "", ""), (None, "zz", "", "")], SCHEMA)
    assert sorted(((r.id is None, r.component) for r in simhash.near_duplicates(df).collect()), key=str) == [
        (False, 4), (True, 4), (True, None)]
