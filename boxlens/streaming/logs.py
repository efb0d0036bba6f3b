"""Structured Streaming over epoch logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boxlens.operators.runlog import EPOCH_SCHEMA, STOP_FIELDS, ruled_records

METRIC_SCHEMA = "run_id bigint, epoch int, metric double, seconds double, arrival bigint"


LOG_SCHEMA = "run_id string, epoch bigint, arrival bigint, record string, problems string, fate string"
#: State with maps needs this store; a session may name another before the query starts.
STORE, ROCKS_DB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def epoch_stream(spark: SparkSession, path: str) -> DataFrame:
    """Run, epoch and metric as the patience rule needs them."""
    return spark.readStream.schema(METRIC_SCHEMA).option("recursiveFileLookup", True).json(path)


def epoch_record_stream(spark: SparkSession, path: str) -> DataFrame:
    """Full epoch records with their arrival; a value of another type becomes NULL and breaks its field's rule."""
    return spark.readStream.schema(f"{EPOCH_SCHEMA}, arrival bigint").option("recursiveFileLookup", True).json(path)


class EpochLog(StatefulProcessor):
    """Fates of a run's records: the accepted record per epoch and the last accepted epoch are the state.

    Rows of a run in one micro-batch are taken by arrival; a record is read from the state
    only for epochs that the micro-batch holds, so work follows the batch, not the log.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getMapState("accepted", "epoch bigint", "record string")
        self.last = handle.getValueState("last", "epoch bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("arrival", ignore_index=True)
        last = self.last.get()[0] if self.last.exists() else 0
        before, known, fates = last, {}, []
        for epoch, record, problems in zip(batch["epoch"], batch["record"], batch["problems"], strict=True):
            if problems:
                fates.append("rejected_invalid")
                continue
            epoch = int(epoch)
            if epoch not in known and epoch <= before and self.accepted.containsKey((epoch,)):
                known[epoch] = self.accepted.getValue((epoch,))[0]
            if epoch in known:
                fates.append("ignored" if known[epoch] == record else "rejected_conflict")
            elif epoch <= last:
                fates.append("rejected_not_rising")
            else:
                self.accepted.updateValue((epoch,), (record,))
                known[epoch], last = record, epoch
                fates.append("accepted")
        if last > before:
            self.last.update((last,))
        yield batch.assign(fate=fates)[[field.split()[0] for field in LOG_SCHEMA.split(", ")]]

    def close(self) -> None:
        pass


def ingest_epochs(stream: DataFrame, unbounded: tuple[str, ...] = ()) -> DataFrame:
    """Every arriving record with what it breaks and its fate, as ``runlog.classify_epoch_records`` gives in a batch.

    Nothing is read back from the log; state is one record per accepted epoch of a run.
    Records without a run share the empty run; they break a rule and keep no state.
    """
    spark = stream.sparkSession
    if not spark.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STORE, ROCKS_DB)
    ruled = ruled_records(stream, unbounded).withColumn("run_key", F.coalesce("run_id", F.lit("")))
    return ruled.groupBy("run_key").transformWithStateInPandas(EpochLog(), LOG_SCHEMA, "Append", "None")


def patience_states(epoch: np.ndarray, metric: np.ndarray, carry: tuple | None, patience: int, min_delta: float, min_epochs: int):
    """Columns of ``STOP_FIELDS`` for epochs in order, and the carry (best, its epoch, reference, stale) after them.

    As in the batch operator: a running maximum finds the best epochs, only they can move
    the reference, and staleness is the distance to the last move.
    """
    best, best_epoch, reference, stale = carry or (-np.inf, -1, -np.inf, 0)
    top = np.maximum.accumulate(np.r_[best, metric])
    is_best = metric > top[:-1]
    moved = np.zeros(len(metric), bool)
    for i in np.flatnonzero(is_best):
        if metric[i] > reference + min_delta:
            moved[i], reference = True, float(metric[i])
    at = np.arange(len(metric))
    last_move = np.maximum.accumulate(np.where(moved, at, -1 - stale))
    waited = at - last_move
    last_best = np.maximum.accumulate(np.where(is_best, at, -1))
    best_at = np.where(last_best >= 0, epoch[np.maximum(last_best, 0)], best_epoch)
    columns = (is_best, moved, waited.astype(np.int32), (epoch >= min_epochs) & (waited >= patience), best_at.astype(np.int32))
    return columns, (float(top[-1]), int(best_at[-1]), reference, int(waited[-1]))


def early_stopping_stream(stream: DataFrame, patience: int, min_delta: float, min_epochs: int) -> DataFrame:
    """Patience state per run across micro-batches; four scalars per run, no timeout.

    A run's rows of one micro-batch are sorted together, so a micro-batch bounds memory.
    """
    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("epoch")
        carry = state.get if state.exists else None
        columns, carry = patience_states(rows["epoch"].to_numpy(), rows["metric"].to_numpy(float), carry, patience, min_delta, min_epochs)
        state.update(carry)
        names = [field.split()[0] for field in STOP_FIELDS.split(", ")]
        yield pd.DataFrame({"run_id": key[0], "epoch": rows["epoch"].to_numpy(), "metric": rows["metric"].to_numpy(float), **dict(zip(names, columns, strict=True))})

    return stream.groupBy("run_id").applyInPandasWithState(
        update, f"run_id bigint, epoch int, metric double, {STOP_FIELDS}", "best double, best_epoch int, reference double, stale int", "append",
        GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain what is available into a Parquet table and read it."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
