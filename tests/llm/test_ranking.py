import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from boxlens.llm import oracles, ranking, registry
from tests import harness


def slow_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_rank(docs, items, k=20):
    """Scores of every pair, by the formula as it is stated."""
    own = [(i, Counter(slow_terms(t))) for i, t in docs]
    sizes = [c.total() for _, c in own]
    n_docs, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    out = []
    for name, text in items:
        scored = []
        for (i, counts), n in zip(own, sizes, strict=True):
            score = 0
            for t in slow_terms(text):
                if tf := counts.get(t):
                    m = 100 - 25 + 25 * n * n_docs // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score:
                scored.append((-score, i is None, i or 0))
        out += [(name, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rank(spark, docs, items, **more):
    found = ranking.rank(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), **more)
    return sorted(map(tuple, found.collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "日本", "X9", "a_b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    draw = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, draw(rng.choice([1, 2, 5, 30]))) for i in range(300)] + [(i % 40, "w1 w2 w3") for i in range(80)]  # ties, also of one id
    docs += [(None, "w1 w2 w3"), (None, "w39"), (900, None), (901, ""), (902, "?!")]
    items = [(i, draw(rng.choice([1, 4, 20]))) for i in range(30)] + [(3, "w1 W1 w1"), (None, "w2 zz"), (50, None), (51, ""), (52, "zz")]
    return docs, items


def test_matches_the_plain_version(spark, texts):
    assert rank(spark, *texts) == slow_rank(*texts)
    assert rank(spark, *texts, k=3) == slow_rank(*texts, k=3)


def test_any_tiling_and_blocks_give_the_same(spark, texts, monkeypatch):
    want = slow_rank(*texts)
    for name, value in (("BLOCK_BYTES", 200), ("BLOCK_ITEMS", 4)):
        monkeypatch.setattr(ranking, name, value)
        assert rank(spark, *texts) == want, name
    # tiles are cut in the tasks, so the step is called here
    vocabulary, rng = 50, np.random.default_rng(1)
    item, column = np.divmod(np.flatnonzero(rng.random(20 * vocabulary) < 0.5), vocabulary)
    weight = rng.integers(1, 1 << 36, len(item))  # scores stay below 2^63
    tall = np.zeros((20, vocabulary), np.int64)
    tall[item, column] = weight
    impacts = rng.integers(0, ranking.IMPACT, (vocabulary, 30)).astype(np.float64)
    got = ranking._exact_product(tall, impacts)
    assert (got.astype(object) == tall.astype(object) @ impacts.astype(np.int64).astype(object)).all() and got.max() > 2**53
    with pytest.raises(OverflowError):
        ranking._exact_product(np.array([[ranking.CAP**2]]), np.ones((1, 1)))


def test_bound_of_partial_sums():
    assert ranking.TERMS * ranking.IMPACT * (ranking.CAP - 1) < 2**53
    assert max(1_000_000_000 * tf // (1000 * tf + 12 * 75) for tf in (1, 10**6, 10**12)) < ranking.IMPACT


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert harness.compare(registry.op12_ranking(spark, sf), oracles.RANKING, sf) == []


def test_long_and_empty_inputs(spark):
    long = "begin " + "filler " * 500_000 + "end"
    docs = [(1, long), (2, "end of it"), (3, "other")]
    assert rank(spark, docs, [(7, "begin end")]) == slow_rank(docs, [(7, "begin end")])
    assert b"".join(t for part in ranking.terms(long.encode()) for t in part) == long.replace(" ", "").encode()
    assert rank(spark, [], [(7, "begin")]) == rank(spark, docs, []) == rank(spark, [], []) == []
