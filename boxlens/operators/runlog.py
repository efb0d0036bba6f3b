"""Run-log analytics: curves, latency, projections, early stopping, log ingestion."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.operators.audit import field_rules
from boxlens.operators.blocks import exact_percentiles, range_blocks, running_maximum, running_totals, suffix_maximum
from boxlens.functions.ratios import finite_or_null
from boxlens.session import materialize, release

LOSSES = ("box_loss", "cls_loss", "dfl_loss")
FINAL = (*LOSSES, "map_50", "map_50_95")
CURVE = (*FINAL, "val_box_loss", "val_cls_loss", "val_dfl_loss")

#: Fields of an epoch record by kind.
EPOCH_INTEGERS = ("seed", "epoch", "optimizer_steps", "val_true_positives", "val_false_positives", "val_false_negatives", "epochs_without_improvement")
EPOCH_PROBABILITIES = ("val_precision", "val_recall", "val_f1", "val_map_50", "val_map_50_95")
EPOCH_FLOATS = ("learning_rate", "train_loss_total", "train_loss_classifier", "train_loss_box_reg", "train_loss_objectness", "train_loss_rpn_box_reg",
                *EPOCH_PROBABILITIES, "train_seconds", "validation_seconds", "epoch_seconds", "peak_gpu_memory_mib")
EPOCH_OPTIONAL = (*EPOCH_PROBABILITIES, "peak_gpu_memory_mib")


EPOCH_SCHEMA = ", ".join([
    "run_id string", *[f"{c} bigint" for c in EPOCH_INTEGERS], *[f"{c} double" for c in EPOCH_FLOATS], "is_best boolean"])


def epoch_rules(rows: DataFrame, other: tuple[str, ...] = (), unbounded: tuple[str, ...] = ()) -> Column:
    """Array of (field, rule) that a full epoch record breaks; columns that are no epoch field and not in ``other``, or of other types, raise.

    Probabilities named by ``unbounded`` are on another scale and may exceed one.
    """
    broken = field_rules(rows, ["run_id", *other], list(EPOCH_INTEGERS), list(EPOCH_FLOATS), [c for c in EPOCH_PROBABILITIES if c not in unbounded], EPOCH_OPTIONAL,
                         booleans=("is_best",), positive=("epoch", "epoch_seconds"))
    unnamed = F.when(F.coalesce(F.col("run_id"), F.lit("")) == "", F.struct(F.lit("run_id").alias("field"), F.lit("missing").alias("rule")))
    return F.concat(broken, F.array_compact(F.array(unnamed)))


def epoch_record_problems(rows: DataFrame) -> DataFrame:
    """(run_id, epoch, field, rule) of every rule that a full epoch record breaks; other columns or types raise."""
    return rows.select("run_id", "epoch", F.explode(epoch_rules(rows)).alias("v")).select("run_id", "epoch", "v.field", "v.rule")


def ruled_records(rows: DataFrame, unbounded: tuple[str, ...] = ()) -> DataFrame:
    """(run_id, epoch, arrival, record, problems): the epoch fields as one JSON text, and what they break as ``field:rule``, sorted.

    Equal records have equal texts, so a text is what repeats are compared by.
    """
    record = F.to_json(F.struct("run_id", *EPOCH_INTEGERS, *EPOCH_FLOATS, "is_best"))
    named = F.array_sort(F.transform(epoch_rules(rows, ("arrival",), unbounded), lambda v: F.concat_ws(":", v["field"], v["rule"])))
    return rows.select("run_id", "epoch", "arrival", record.alias("record"), F.array_join(named, ",").alias("problems"))


def epoch_fields(log: DataFrame) -> DataFrame:
    """The epoch fields of a classified log as columns, beside arrival, problems and fate."""
    return log.select(F.from_json("record", EPOCH_SCHEMA).alias("r"), "arrival", "problems", "fate").select("r.*", "arrival", "problems", "fate")


def training_curve_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Convergence indicators per run over all curve fields; NaN stays out of the maxima. A field that is NULL, or an empty curve, fails."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in CURVE])
    checked = F.when(missing, F.raise_error(F.lit("training curve lacks a numeric field")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    if rows.isEmpty():
        raise ValueError("training curve is empty")
    nonfinite = sum((finite_or_null(F.col(c)).isNull().cast("int") for c in CURVE), F.lit(0))
    zero = F.lit(True)
    for c in LOSSES:
        zero = zero & (F.col(c) == 0)
    final = F.max_by(F.struct(*FINAL), "epoch")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("completed_epochs"), F.sum(nonfinite + checked).alias("nonfinite_values"), F.count_if(zero).alias("zero_loss_epochs"),
        F.count_if(F.col("map_50_95") > 0).alias("positive_map_epochs"), F.max(finite_or_null(F.col("map_50"))).alias("best_map_50"), F.max(finite_or_null(F.col("map_50_95"))).alias("best_map_50_95"), final.alias("f"),
    ).select("*", *[F.col(f"f.{c}").alias(f"final_{c}") for c in FINAL]).drop("f")


def classify_convergence(status: Column) -> Column:
    """Complete, finite, no all-zero-loss epoch and a positive mAP somewhere."""
    normal = (status == "complete") & (F.col("nonfinite_values") == 0) & (F.col("zero_loss_epochs") == 0) & (F.col("positive_map_epochs") > 0) & (F.col("best_map_50_95") > 0)
    return F.when(normal, "normal_converged").otherwise("collapse_or_invalid")


def classify_operational(convergence: Column, frozen_predictions: Column, frozen_tp: Column, floor_tp: Column) -> Column:
    # fixed values: the four labels
    return (
        F.when(convergence != "normal_converged", "training_collapse_or_invalid")
        .when((frozen_predictions == 0) & (floor_tp > 0), "confidence_score_degeneracy_at_frozen_threshold")
        .when((frozen_predictions > 0) & (frozen_tp == 0), "detections_without_iou_qualified_match")
        .otherwise("operational_detections_present")
    )


def latency_summary(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Throughput and latency of timed batches (seconds, images)."""
    rows = batches.withColumn("per_image", F.col("seconds") / F.col("images"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("timed_batches"), F.sum("images").alias("timed_images"), F.sum("seconds").alias("total_seconds"))
    pct = exact_percentiles(rows, keys, "per_image", {"p50": 0.5, "p95": 0.95})
    return sums.join(pct, keys).select(
        *keys, "timed_batches", "timed_images", "total_seconds", (F.col("timed_images") / F.col("total_seconds")).alias("throughput_fps"),
        (F.col("total_seconds") / F.col("timed_images") * 1000).alias("mean_latency_ms"), (F.col("p50") * 1000).alias("p50_latency_ms"), (F.col("p95") * 1000).alias("p95_latency_ms"))


def epoch_time_projection(epochs: DataFrame, keys: list[str], minimum: int, maximum: int, scenarios: tuple[int, ...] = ()) -> DataFrame:
    """First epoch plus (n-1) median later epochs, with the min/max range."""
    first = epochs.groupBy(*keys).agg(F.min_by("seconds", "epoch").alias("first_seconds"), F.min("epoch").alias("first_epoch"))
    rest = epochs.join(first.select(*keys, "first_epoch"), keys).filter("epoch > first_epoch")
    spread = rest.groupBy(*keys).agg(F.min("seconds").alias("fastest"), F.max("seconds").alias("slowest"))
    median = exact_percentiles(rest, keys, "seconds", {"steady_seconds": 0.5})
    project = lambda n, per: F.col("first_seconds") + max(n - 1, 0) * F.col(per)
    return first.drop("first_epoch").join(spread, keys).join(median, keys).select(
        *keys, "first_seconds", "steady_seconds", project(minimum, "steady_seconds").alias("estimated_minimum"), project(maximum, "steady_seconds").alias("estimated_maximum"),
        project(maximum, "fastest").alias("maximum_low"), project(maximum, "slowest").alias("maximum_high"),
        *[project(n, "steady_seconds").alias(f"scenario_{n}") for n in scenarios])


STOP_FIELDS = "is_new_best boolean, is_significant boolean, epochs_without_improvement int, should_stop boolean, best_epoch int"


def _next_moves(metric: np.ndarray, min_delta: float) -> np.ndarray:
    """For each of ascending metrics the place of the first later one that beats it by more than ``min_delta``, else the length."""
    return np.searchsorted(metric, metric + min_delta, "right")


def _moves(raised: DataFrame, min_delta: float, key: str) -> DataFrame:
    """(key, epoch) of the raised epochs that move the reference, the first of each run included.

    Every raised epoch has one successor: the next that beats it by ``min_delta``. A block
    finds the last successor inside it for all its rows, an order by metric finds the row of
    a later block that follows, and pointer doubling over these entries reaches all blocks
    of a run in a logarithmic number of rounds; none if no run spans two blocks. Then the
    blocks, each one partition's share of the rows, mark the successors of their entries. ``raised`` is a written table with ``block``.
    """
    kind = raised.schema[key].dataType.simpleString()
    min_delta = max(min_delta, 0.0)  # each raised epoch beats the one before it, so a smaller delta changes nothing

    def leave(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("epoch", ignore_index=True)
        metric, here = rows["metric"].to_numpy(), np.arange(len(rows))
        after = _next_moves(metric, min_delta)
        last = np.where(after < len(rows), after, here)
        while not np.array_equal(further := last[last], last):
            last = further
        return rows[[key, "epoch"]].assign(leaves=metric[last])

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "epoch"], ignore_index=True)
        metric, entered = rows["metric"].to_numpy(), rows["entered"].to_numpy()
        begins = np.flatnonzero((rows[key] != rows[key].shift()).to_numpy())
        found = []
        for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)], strict=True):
            after = _next_moves(metric[lo:hi], min_delta).tolist()
            at = int(np.argmax(entered[lo:hi])) if entered[lo:hi].any() else hi - lo
            while at < hi - lo:
                found.append(lo + at)
                at = after[at]
        return rows.loc[found, [key, "epoch"]]

    best = raised.filter("is_new_best").select(key, "block", "epoch", "metric")
    runs = best.groupBy(key).agg(F.min("epoch").alias("epoch"), F.count_distinct("block").alias("blocks"))
    reached = materialize(runs.select(key, "epoch"), "reached")
    longest = runs.agg(F.max("blocks")).first()[0] or 1
    if longest > 1:
        # a run over two blocks holds a block's end, so there are fewer such runs than blocks
        wide = materialize(runs.filter("blocks > 1").select(key, "epoch"), "wide")
        spread = best.join(F.broadcast(wide.select(key)), key)
        exits = materialize(spread.groupBy(key, "block").applyInPandas(leave, f"{key} {kind}, epoch int, leaves double"), "exits")
        # of equal values the row comes first, so only greater metrics follow a question
        rows = spread.select(key, F.col("metric").alias("value"), F.lit(0).alias("kind"), (-F.col("epoch")).alias("late"))
        asked = exits.select(key, (F.col("leaves") + F.lit(min_delta)).alias("value")).distinct()
        ranged = range_blocks(rows.unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True), [(key, True), ("value", True), ("kind", True)], "reach")
        answers = suffix_maximum(ranged, [key], [("value", True), ("kind", True)], "late", "late_next")
        hops = materialize(answers.filter("kind = 1 and late_next is not null").select(key, "value", (-F.col("late_next")).alias("target")), "hops")
        entries = wide.union(hops.select(key, "target")).distinct()
        leaving = entries.join(exits, [key, "epoch"]).select(key, "epoch", (F.col("leaves") + F.lit(min_delta)).alias("value"))
        jumps = materialize(leaving.join(hops, [key, "value"]).select(key, "epoch", "target"), "jumps")
        covered = 1
        while covered < longest:
            old = reached, jumps
            reached = materialize(reached.union(reached.join(jumps, [key, "epoch"]).select(key, "target")), "reached")
            onward = jumps.select(key, F.col("epoch").alias("target"), F.col("target").alias("beyond"))
            jumps = materialize(jumps.join(onward, [key, "target"]).select(key, "epoch", F.col("beyond").alias("target")), "jumps")
            release(*old)
            covered *= 2
        release(wide, exits, ranged, hops, jumps)
    entered = best.join(reached.withColumn("entered", F.lit(True)), [key, "epoch"], "left").fillna(False, ["entered"])
    return entered.groupBy("block").applyInPandas(mark, f"{key} {kind}, epoch int")


def early_stopping(epochs: DataFrame, patience: int, min_delta: float, min_epochs: int, key: str = "run_id") -> DataFrame:
    """Patience state after every epoch of every run; epochs of a run are distinct.

    The best metric is a running maximum over range blocks, so a long run is spread. The
    metric that patience refers to can only move at an epoch that raises the maximum: all
    others lie within ``min_delta`` of it. So only those epochs are followed, block by block,
    and the epochs without improvement are a distance to the last move.
    """
    order = [("epoch", True)]
    rows = epochs.select(key, F.col("epoch").cast("int").alias("epoch"), F.col("metric").cast("double").alias("metric"))
    blocks = range_blocks(rows, [(key, True), *order], "epochs")
    raised = running_maximum(blocks, [key], order, {"before": F.col("metric")}, inclusive=False)
    is_best = F.coalesce(F.col("metric") > F.col("before"), F.col("metric").isNotNull())
    raised = materialize(raised.withColumn("is_new_best", is_best).drop("before"), "raised")
    moves = _moves(raised, min_delta, key).withColumn("is_significant", F.lit(True))
    marked = materialize(raised.join(moves, [key, "epoch"], "left").fillna(False, ["is_significant"]), "marked")
    release(blocks, raised)
    placed = running_totals(marked, [key], order, {"place": F.lit(1).cast("bigint")})
    last = running_maximum(placed, [key], order, {
        "moved": F.when(F.col("is_significant"), F.col("place")), "best_epoch": F.when(F.col("is_new_best"), F.col("epoch"))})
    stale = (F.col("place") - F.coalesce("moved", F.lit(0))).cast("int")
    return last.select(
        key, "epoch", "metric", "is_new_best", "is_significant", stale.alias("epochs_without_improvement"),
        ((F.col("epoch") >= min_epochs) & (stale >= patience)).alias("should_stop"), "best_epoch")


def classify_epoch_records(ruled: DataFrame) -> DataFrame:
    """Fate of each arriving record of ``ruled_records``.

    A record that breaks a field rule is rejected. Of the others, the first record of a
    (run, epoch) counts; identical repeats are ignored and differing ones rejected; epochs
    of a run must rise by arrival. Records are written once, so that their rules are not
    evaluated again (and inlined) in every branch; they are compared by digests, and the
    rising epochs are a running maximum over range blocks.
    """
    ruled = materialize(ruled, "ruled")
    digest = F.sha2("record", 256)
    lean = ruled.filter("problems = ''").select("run_id", "epoch", "arrival", digest.alias("digest"))
    first = lean.groupBy("run_id", "epoch").agg(F.min("arrival").alias("first_arrival"), F.min_by("digest", "arrival").alias("first_digest"))
    order = [("first_arrival", True)]
    blocks = range_blocks(first, [("run_id", True), *order], "first-records")
    before = running_maximum(blocks, ["run_id"], order, {"before": F.col("epoch")}, inclusive=False)
    rising = before.select("run_id", "epoch", "first_arrival", "first_digest", F.coalesce(F.col("epoch") > F.col("before"), F.lit(True)).alias("rises"))
    fate = (
        F.when(F.col("problems") != "", "rejected_invalid").when(~F.col("rises"), "rejected_not_rising").when(F.col("arrival") == F.col("first_arrival"), "accepted")
        .when(F.col("first_digest") == digest, "ignored").otherwise("rejected_conflict")
    )
    # the first records grow with the log, so they are not gathered for a broadcast
    return ruled.join(rising.hint("merge"), ["run_id", "epoch"], "left").select(*ruled.columns, fate.alias("fate"))
