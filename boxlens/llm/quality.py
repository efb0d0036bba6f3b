"""Quality classifier: random Fourier features, ridge regression, isotonic calibration (operator 5).

Statistics of a text (never its id, source or language column) are standardised and mapped
by random cosines whose inner product approximates a Gaussian kernel. Every task sums its
share of the normal equations; the driver solves one small system, and calibrates with the
pool-adjacent-violators rule on counts of labelled rows per score bin.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.llm.common import per_text, rows_of, texts
from boxlens.session import materialize

COSINES = 256
RIDGE = 1.0
SEED = 20
BINS = 2000  # of raw scores from -1 to 2, for calibration

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_neighbours", "capitals", "digits", "bangs", "bars", "symbols",
    "punctuation", "beyond_ascii", "log_line_words", "repeated_lines", "top_word",
)


def statistics(data: bytes) -> list[float]:
    """Statistics of UTF-8 text in the order of ``STATISTICS``; zeros for an empty one."""
    words, lines = data.split(), data.split(b"\n")
    if not words:
        return [0.0] * len(STATISTICS)
    hist = np.zeros(256, np.int64)
    for lo in range(0, len(data), 1 << 20):
        hist += np.bincount(np.frombuffer(data, np.uint8, min(1 << 20, len(data) - lo), lo), minlength=256)
    share = lambda chars: float(hist[list(chars)].sum()) / shown
    blank = int(hist[list(b" \t\n\r\x0b\x0c")].sum())
    shown, n = max(1, len(data) - blank), len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(len(data)), np.log1p(n), np.log(shown / n), np.log(len(counts)) / np.log(n + 1), sum(map(operator.eq, words, words[1:])) / n,
        float(hist[65:91].sum()) / shown, float(hist[48:58].sum()) / shown, share(b"!"), share(b"|"), share(b"#$%&*<>=_~^{}[]\\@+/"),
        share(b".,;:?'\"()-"), float(hist[128:].sum()) / shown, np.log(n / len(lines)), 1 - len(set(lines)) / len(lines), max(counts.values()) / n,
    ]


def statistics_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) per row, x the statistics of its whole text."""
    rows = texts(docs, id_col, text_col)
    step = per_text(lambda: lambda data: (statistics(data),), [("x", pa.list_(pa.float64()))])
    return rows.mapInArrow(step, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")


def held_out(name: str) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 3 == 1, F.lit(False))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features with a constant; the kernel width is the root of the number of statistics."""
        rng = np.random.default_rng(SEED)
        turn = rng.normal(size=(x.shape[1], COSINES)) / np.sqrt(x.shape[1])
        phase = rng.uniform(0, 2 * np.pi, COSINES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ turn + phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:  # nothing was learned
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def _chunks(x: np.ndarray) -> Iterator[slice]:
    return (slice(lo, lo + 4096) for lo in range(0, len(x), 4096))


def _normal_equations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((COSINES + 1, COSINES + 2))
        for batch in batches:
            x, y = _matrix(batch), batch.column("y").to_numpy()
            for part in _chunks(x):
                z = model.cosines(x[part])
                total += z.T @ np.hstack([z, y[part, None]])
        rows = pa.array(list(total), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), rows], names=["i", "row"])

    return run


def _sum_rows(table: pa.Table) -> pa.Table:
    rows = table["row"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return pa.table({"i": table["i"].slice(0, 1), "row": pa.array([rows.sum(0)], pa.list_(pa.float64()))})


def _bins(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hits = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            x, y = _matrix(batch), batch.column("y").to_numpy()
            for part in _chunks(x):
                at = np.clip(((model.raw(x[part]) + 1) / 3 * BINS).astype(int), 0, BINS - 1)
                n += np.bincount(at, minlength=BINS)
                hits += np.bincount(at, y[part], minlength=BINS)
        kept = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(n[kept]), pa.array(hits[kept])], names=["bin", "n", "hits"])

    return run


def isotonic(at: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and means of the pooled blocks, both ascending."""
    pools: list[list[float]] = []
    for a, w, s in zip(at, n, hits, strict=True):
        pools.append([a * w, w, s])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    a, w, s = np.array(pools).T
    return a / w, s / w


def fit(stats: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality") -> Model:
    """Model from the statistics (id, x) of labelled rows that are not held out.

    Several labels of one id count as their mean; null labels and ids are no labels.
    Without any label every score is 0.5. The driver gets one row of moments, the
    summed normal equations (``COSINES`` + 1 rows) and at most ``BINS`` counts.
    """
    target = labels.select(labels[label_id].alias("id"), labels[label_col].cast("double").alias("y")).filter("id is not null and y is not null")
    target = target.filter(~held_out("id")).groupBy("id").agg(F.avg("y").alias("y"))
    rows = stats.join(target, "id").select("x", "y")
    d = len(STATISTICS)
    m = rows.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{p}{i}") for i in range(d) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not m["n"]:
        return Model(np.zeros(d), np.ones(d))
    model = Model(np.array([m[f"m{i}"] for i in range(d)]), np.array([m[f"s{i}"] or 1.0 for i in range(d)]))
    sums = rows.mapInArrow(_normal_equations(model), "i int, row array<double>").groupBy("i").applyInArrow(_sum_rows, "i int, row array<double>")
    total = np.array([r.row for r in sorted(sums.collect())])
    penalty = RIDGE * np.eye(COSINES + 1)
    penalty[-1, -1] = 0
    weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])
    model = Model(model.mean, model.scale, weights)
    counts = rows.mapInArrow(_bins(model), "bin int, n double, hits double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    bins = np.array([(r["bin"], r["n"], r["hits"]) for r in sorted(counts.collect())])
    knots, values = isotonic((bins[:, 0] + 0.5) / BINS * 3 - 1, bins[:, 1], bins[:, 2])
    return Model(model.mean, model.scale, weights, knots, values)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score) of every row of (id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            parts = [model.score(x[part]) for part in _chunks(x)] or [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(parts))], names=["id", "score"])

    return stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, held_out, score, predicted (1 if score >= 0.5).

    Null and empty texts have statistics of zero and are scored like any other; repeated
    rows come back once per occurrence; an empty table gives an empty result. Columns
    other than id and text are not read.
    """
    stats = materialize(statistics_of(docs, id_col, text_col), "statistics")
    scored = score(stats, fit(stats, labels))
    return scored.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores 0.5 or more; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in rows_of(batch, text_col)]).reshape(-1, len(STATISTICS))
            kept = [model.score(x[part]) >= 0.5 for part in _chunks(x)] or [np.zeros(0, bool)]
            yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
