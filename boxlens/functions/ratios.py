"""Rates with the undefined-is-NULL policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def operating_ratios(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1. Both sides empty: NULL. One side empty: 0."""
    preds, targets = tp + fp, tp + fn
    undefined = (preds == 0) & (targets == 0)
    empty = (preds == 0) | (targets == 0)
    tp_d = tp.cast("double")
    precision = F.try_divide(tp_d, preds)
    recall = F.try_divide(tp_d, targets)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))

    def guard(value: Column) -> Column:
        return F.when(undefined, F.lit(None).cast("double")).when(empty, F.lit(0.0)).otherwise(value)

    return {"precision": guard(precision), "recall": guard(recall), "f1": guard(f1)}


def mean_or_null(total: Column, count: Column) -> Column:
    return F.try_divide(total.cast("double"), count)


def decimal_mean(value: Column) -> Column:
    """Mean of an aggregate of finite doubles, read as the decimals they print as (18 places at most).

    The sum is exact, so the mean does not depend on the order of the rows, and a mean that lies
    on the half of a rounding step is found there.
    """
    return F.sum(value.cast("decimal(38,18)")).cast("double") / F.count(value)


def finite_or_null(value: Column) -> Column:
    """NaN and infinities become NULL."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def sample_sd(value: Column) -> Column:
    """Sample SD of an aggregate: exactly 0 when all values agree, NULL below two."""
    return F.when(F.count(value) < 2, F.lit(None).cast("double")).when(
        F.min(value) == F.max(value), F.lit(0.0)
    ).otherwise(F.stddev_samp(value))
