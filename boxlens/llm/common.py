"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of every row, whatever other columns are called; a null text is empty."""
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of a text column, one row at a time."""
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""


def per_text(make: Callable[[], Callable[[bytes], tuple]], names: list[tuple[str, pa.DataType]], keep: tuple[str, ...] = ("id",)):
    """Row-wise Arrow step: ``make()`` runs once per task and returns text bytes -> values of ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            out = list(zip(*map(one, rows_of(batch)), strict=True)) or [()] * len(names)
            arrays = [batch.column(k) for k in keep] + [pa.array(v, t) for v, (_, t) in zip(out, names, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *[n for n, _ in names]])

    return run
