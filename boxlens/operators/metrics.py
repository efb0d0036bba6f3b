"""Operating-point metrics from matches: totals, classes, images, macro means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.functions.geometry import dice
from boxlens.functions.ratios import mean_or_null, operating_ratios
from boxlens.operators.ap import coco_ap
from boxlens.operators.assignment import image_sums
from boxlens.operators.matching import RUN, rank_detections, score_filter, with_matches
from boxlens.session import by_key, for_each_run, materialize

MACRO_METRICS = ("precision", "recall", "f1", "mean_iou", "mean_dice")


def evidence_rows(matched: DataFrame, targets: DataFrame, runs: DataFrame, run=RUN, images: DataFrame | None = None,
                  image_partitions: int | None = None) -> DataFrame:
    """Long additive rows (image, label, preds, targets, tp, iou, dice).

    ``matched``: predictions with the target they take. Every metric below is one grouped sum
    over these rows, combined map-side; ``images`` adds zero rows so that images without any
    box survive; ``image_partitions`` is the number of tasks that boxes are dealt to by image, if one was asked for.
    """
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    one = F.lit(1).cast("bigint")
    shape = lambda df, p, t, m, i, j: df.select(
        *run, "image_id", "label", p.alias("preds"), t.alias("targets"), m.alias("tp"), i.alias("iou_sum"), j.alias("dice_sum")
    )
    hit = F.col("tidx").isNotNull()
    parts = [
        shape(matched, one, zero, hit.cast("bigint"), F.when(hit, F.col("iou")).otherwise(none), F.when(hit, dice(F.col("iou"))).otherwise(none)),
        shape(for_each_run(targets.select("image_id", "label"), runs, run), zero, one, zero, none, none),
    ]
    if images is not None:
        # partitioned like boxes that are partitioned by image, and before they are repeated for the runs
        blank = for_each_run(by_key(images.select("image_id"), "image_id", image_partitions), runs, run).withColumn("label", F.lit(None).cast(matched.schema["label"].dataType))
        parts.append(shape(blank, zero, zero, zero, none, none))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summarize(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates per key; mean IoU and Dice over all matches (micro)."""
    sums = evidence.groupBy(*keys).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("preds", "targets", "tp")],
        F.sum("iou_sum").alias("iou_sum"), F.sum("dice_sum").alias("dice_sum"),
    )
    return rates(sums.withColumns({"fp": F.col("preds") - F.col("tp"), "fn": F.col("targets") - F.col("tp")}), keys)


def rates(sums: DataFrame, keys: list[str]) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        *keys, "tp", "fp", "fn", (tp + fp).alias("prediction_count"), (tp + fn).alias("target_count"),
        *[c.alias(n) for n, c in operating_ratios(tp, fp, fn).items()],
        mean_or_null(F.col("iou_sum"), tp).alias("mean_iou"), mean_or_null(F.col("dice_sum"), tp).alias("mean_dice"),
    )


def summed_evidence(predictions: DataFrame, targets: DataFrame, runs: DataFrame, run=RUN, score_threshold: float = 0.05,
                    iou_threshold: float = 0.5, max_detections: int = 100) -> DataFrame:
    """``operating_evidence`` for sums over images: the predictions of an image, run and label are one row already."""
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    sums = image_sums(score_filter(predictions, score_threshold), targets, run, max_detections, iou_threshold).withColumn("targets", zero)
    every = for_each_run(targets.groupBy("label").agg(F.count("*").alias("targets")), runs, run)
    counts = every.select(*run, "label", zero.alias("preds"), "targets", zero.alias("tp"), none.alias("iou_sum"), none.alias("dice_sum"))
    return sums.select(counts.columns).unionByName(counts)


def operating_evidence(predictions: DataFrame, targets: DataFrame, runs: DataFrame, run=RUN, score_threshold: float = 0.05,
                       iou_threshold: float = 0.5, max_detections: int = 100, images: DataFrame | None = None,
                       image_partitions: int | None = None) -> DataFrame:
    ranked = rank_detections(score_filter(predictions, score_threshold), run, max_detections)
    return evidence_rows(with_matches(ranked, targets, run, iou_threshold, max_detections), targets, runs, run, images, image_partitions)


def operating_point(evidence: DataFrame, run=RUN) -> DataFrame:
    return summarize(evidence, [*run])


def operating_point_per_class(evidence: DataFrame, classes: DataFrame, runs: DataFrame, run=RUN) -> DataFrame:
    """Same per class; classes without any box keep a row (NULL rates)."""
    grid = for_each_run(classes.select("label"), runs, run)
    sums = evidence.filter(F.col("label").isNotNull()).groupBy(*run, "label").agg(
        *[F.sum(c).alias(c) for c in ("preds", "targets", "tp", "iou_sum", "dice_sum")]
    )
    full = grid.join(sums, [*run, "label"], "left").fillna(0)
    return rates(full.withColumns({"fp": F.col("preds") - F.col("tp"), "fn": F.col("targets") - F.col("tp")}), [*run, "label"])


def operating_point_per_image(evidence: DataFrame, run=RUN) -> DataFrame:
    return summarize(evidence, [*run, "image_id"])


def macro_average(per_class: DataFrame, run=RUN) -> DataFrame:
    """Mean over classes of each defined metric."""
    return per_class.groupBy(*run).agg(*[F.avg(m).alias(f"macro_{m}") for m in MACRO_METRICS])


def image_evidence(evidence: DataFrame, run=RUN) -> DataFrame:
    """Sufficient statistics per image-run, the input of all resampling."""
    sums = evidence.groupBy(*run, "image_id").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("preds", "targets", "tp")],
        F.sum("iou_sum").alias("iou_sum"), F.sum("dice_sum").alias("dice_sum"),
    )
    return sums.select(
        *run, "image_id", F.col("targets").alias("target_count"), "tp", (F.col("preds") - F.col("tp")).alias("fp"),
        (F.col("targets") - F.col("tp")).alias("fn"), "iou_sum", "dice_sum",
    )


def evaluate_predictions(predictions: DataFrame, targets: DataFrame, runs: DataFrame, classes: DataFrame, run=RUN,
                         score_threshold: float = 0.05, iou_threshold: float = 0.5, max_detections: int = 100,
                         min_score: float = 0.001) -> DataFrame:
    """Operating point, macro means and official AP of every run in one table."""
    evidence = summed_evidence(predictions, targets, runs, run, score_threshold, iou_threshold, max_detections)
    # a row per run and label, counted once for both
    sums = ("preds", "targets", "tp", "iou_sum", "dice_sum")
    evidence = materialize(evidence.groupBy(*run, "label").agg(*[F.sum(c).alias(c) for c in sums]), "evidence")
    overall = operating_point(evidence, run)
    macro = macro_average(operating_point_per_class(evidence, classes, runs, run), run)
    official = coco_ap(predictions, targets, classes, runs, run, min_score, max_detections)
    overall_ap = official.filter(F.col("label").isNull()).drop("label")
    return overall.join(macro, [*run]).join(overall_ap, [*run])


def max_score(predictions: DataFrame, runs: DataFrame, run=RUN) -> DataFrame:
    """Largest score per run; NULL for a run without predictions."""
    top = predictions.groupBy(*run).agg(F.max("score").alias("max_score"))
    return runs.select(*run).join(top, [*run], "left")


def undefined_reason(tp: Column, prediction_count: Column) -> Column:
    return (
        F.when(tp > 0, F.lit(""))
        .when(prediction_count == 0, F.lit("no_detections_at_frozen_score_threshold"))
        .otherwise(F.lit("no_iou_qualified_true_positive"))
    )


def fp_per_image(rows: DataFrame, image_count: Column, tolerance: float = 1e-12) -> DataFrame:
    """FROC axes with the two consistency checks of a published sweep row."""
    return rows.withColumns({
        "sensitivity": F.col("recall"),
        "fp_per_image": F.col("fp").cast("double") / image_count,
        "counts_ok": F.col("tp") + F.col("fn") == F.col("target_count"),
        "recall_ok": F.abs(F.col("recall") - F.try_divide(F.col("tp").cast("double"), F.col("target_count"))) <= tolerance,
    })
