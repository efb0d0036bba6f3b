import zlib

import numpy as np
import pytest

from boxlens.llm import quality as Q
from boxlens.llm.common import read

SF = "/root/testdata/sf0.01"


def test_statistics_of_odd_texts():
    assert Q.statistics(b"") == Q.statistics(b" \n\t") == [0.0] * len(Q.STATISTICS)
    for text in ("a", "\x00", "é" * 3_000_000, "x\n" * 100_000, "!!! | $$"):
        x = Q.statistics(text.encode())
        assert len(x) == len(Q.STATISTICS) and np.isfinite(x).all()
    by = dict(zip(Q.STATISTICS, Q.statistics(b"The The cat !!\nThe The cat !!"), strict=True))
    assert by["repeated_neighbours"] == 2 / 8 and by["repeated_lines"] == 0.5 and by["top_word"] == 0.5
    assert by["bangs"] == 4 / 22 and by["capitals"] == 4 / 22


def test_cosines_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(1)
    d = len(Q.STATISTICS)
    x = rng.normal(size=(40, d))
    z = Q.Model(np.zeros(d), np.ones(d)).cosines(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(z @ z.T - kernel).max() < 0.3 and np.abs(z @ z.T - kernel).mean() < 0.06


def test_isotonic_is_the_best_ascending_fit():
    at, n, hits = np.arange(6.0), np.array([1, 2, 1, 1, 4, 1.0]), np.array([0, 2, 0, 1, 1, 1.0])
    knots, values = Q.isotonic(at, n, hits)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()
    assert values.tolist() == [0, 0.5, 1]  # 2+0+1+1 hits of 8 pool to one half


def test_held_out_accuracy_and_normal_equations(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    stats = Q.statistics_of(docs).cache()
    model = Q.fit(stats, labels)
    target = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.id, r.x) for r in stats.collect() if r.id in target]
    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows}
    x, y = np.array([x for i, x in rows if not out[i]]), np.array([target[i] for i, _ in rows if not out[i]])
    z = model.cosines(x)
    penalty = Q.RIDGE * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    got = {r.id: r for r in Q.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].score, target[i]) for i, _ in rows if out[i]]
    assert all(got[i].held_out == out[i] for i, _ in rows)
    good, bad = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.85
    assert np.mean([(s >= 0.5) == bool(t) for s, t in held]) > 0.93


@pytest.mark.parametrize("n", [0, 4])
def test_empty_and_null(spark, n):
    rows = [(1, None, "z"), (None, "a b c", "z"), (2, "", None), (2, "", None)][:n]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    none = spark.createDataFrame([(9, None), (None, 1)], "doc_id bigint, quality int")
    got = Q.classify(docs, none).collect()
    assert len(got) == n and all(r.score == 0.5 and r.predicted == 1 for r in got)
    kept = Q.keep_good(docs, Q.Model(np.zeros(len(Q.STATISTICS)), np.ones(len(Q.STATISTICS))))
    assert kept.schema == docs.schema and kept.count() == n
