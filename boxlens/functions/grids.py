"""Pinned float grids. Both engines must see exactly these doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ten IoU levels from 0.50 to 0.95, spaced like an inclusive linspace.
IOU_LEVELS = [0.5 + i * ((0.95 - 0.5) / 9) for i in range(9)] + [0.95]
# 101 recall points: k hundredths, computed by multiplication.
RECALL_POINTS = [i * 0.01 for i in range(101)]


def linspace(start: float, stop: float, steps: int) -> list[float]:
    """Inclusive grid rounded to 12 decimals."""
    return [round(start + i * (stop - start) / (steps - 1), 12) for i in range(steps)]


def threshold_grid(spark: SparkSession, start: float = 0.01, stop: float = 0.99, steps: int = 99) -> DataFrame:
    """One row per threshold; the row count is the ``steps`` argument."""
    step = (F.lit(float(stop)) - F.lit(float(start))) / F.lit(float(steps - 1))
    return spark.range(steps).select(
        F.col("id").cast("int").alias("t_idx"),
        F.round(F.lit(float(start)) + F.col("id") * step, 12).alias("threshold"),
    )


def points_reached(recall: Column) -> Column:
    """How many of the 101 recall points are at most ``recall``.

    The guess floor(100 r) is off by at most one at the pinned doubles; the two
    neighbouring grid literals settle it.
    """
    grid = F.array(*[F.lit(r) for r in RECALL_POINTS])
    guess = F.least(F.lit(100), F.floor(recall * 100).cast("int"))
    upper = F.least(F.lit(100), guess + 1)
    return (
        F.when(recall >= F.element_at(grid, upper + 1), upper)
        .when(recall >= F.element_at(grid, guess + 1), guess)
        .otherwise(guess - 1)
        .cast("int")
    )


def threshold_bucket(score: Column, thresholds: list[float]) -> Column:
    """Index of the largest threshold <= score, or -1; a balanced comparison tree."""

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo - 1)
        mid = (lo + hi) // 2
        return F.when(score >= F.lit(thresholds[mid]), node(mid + 1, hi)).otherwise(node(lo, mid))

    return node(0, len(thresholds)).cast("int")
