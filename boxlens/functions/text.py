"""Number and text formats used in result tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def general_6g(values: pd.Series) -> pd.Series:
    """C-style ``%.6g``.

    The JVM formatter rounds the shortest decimal form, C the exact binary value;
    they differ on ties, so the few cells of a result table go through Arrow.
    """
    return values.map(lambda v: None if pd.isna(v) else f"{v:.6g}")


def mean_std(mean: Column, std: Column) -> Column:
    return F.concat(general_6g(mean), F.lit(" ± "), general_6g(std))


def scaled_round(value: Column, digits: int) -> Column:
    """Half away from zero of the scaled double, as C and SQL engines on doubles round.

    ``F.round`` rounds the shortest decimal form, so a mean that summation left just below
    a half goes down there and up here.
    """
    scale = F.lit(10.0**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + F.lit(0.5)) / scale


def ten_decimals(label: Column, *values: Column) -> Column:
    """``class v v v v`` line with ten decimals each, exact halves to even."""
    return F.format_string("%d" + " %.10f" * len(values), label, *[F.bround(v, 10) for v in values])


def strip(text: Column) -> Column:
    """Text without blanks, tabs and line breaks at its ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def parse_finite(text: Column) -> Column:
    """String to finite double, else NULL."""
    value = strip(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
