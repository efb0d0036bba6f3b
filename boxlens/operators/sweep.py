"""Threshold sweeps: match once, then count.

Greedy matching visits predictions by falling score, so the matches at a
threshold are a prefix of those at a lower one, image cap included. One match at
the lowest threshold serves the whole grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlens.functions.geometry import dice
from boxlens.functions.grids import linspace, threshold_bucket
from boxlens.functions.ratios import sample_sd
from boxlens.functions.text import mean_std
from boxlens.operators.matching import RUN, rank_detections, score_filter, with_matches
from boxlens.operators.metrics import rates
from boxlens.session import for_each_run

SWEEP_METRICS = ("precision", "recall", "f1")


def grid_frame(runs: DataFrame, thresholds: list[float], run=RUN) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(i).alias("t_idx"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)])
    return runs.select(*run, F.explode(entries).alias("g")).select(*run, "g.t_idx", "g.threshold")


def threshold_sweep(predictions: DataFrame, targets: DataFrame, runs: DataFrame, thresholds: list[float] | None = None, run=RUN,
                    iou_threshold: float = 0.5, max_detections: int = 100) -> DataFrame:
    """Operating point of each run at each threshold."""
    grid = thresholds or linspace(0.01, 0.99, 99)
    ranked = rank_detections(score_filter(predictions, grid[0]), run, max_detections)
    matched = with_matches(ranked, targets, run, iou_threshold, max_detections)
    one, hit = F.lit(1).cast("bigint"), F.col("tidx").isNotNull()
    rows = matched.select(
        *run, threshold_bucket(F.col("score"), grid).alias("t_idx"), one.alias("preds"), hit.cast("bigint").alias("tp"),
        F.when(hit, F.col("iou")).otherwise(0.0).alias("iou_sum"), F.when(hit, dice(F.col("iou"))).otherwise(0.0).alias("dice_sum"))
    names = ("preds", "tp", "iou_sum", "dice_sum")
    buckets = rows.groupBy(*run, "t_idx").agg(*[F.sum(n).alias(n) for n in names])
    total = for_each_run(targets.agg(F.count("*").alias("targets")), runs, run)
    full = grid_frame(runs, grid, run).join(buckets, [*run, "t_idx"], "left").fillna(0).join(total, [*run])
    # a window holds one row per threshold of a run
    above = Window.partitionBy(*run).orderBy(F.desc("t_idx")).rowsBetween(Window.unboundedPreceding, 0)
    swept = full.select(*run, "t_idx", "threshold", "targets", *[F.sum(n).over(above).alias(n) for n in names])
    counts = swept.withColumns({"fp": F.col("preds") - F.col("tp"), "fn": F.col("targets") - F.col("tp")})
    return rates(counts, [*run, "t_idx", "threshold"])


def sweep_seed_mean(sweep: DataFrame, detector: str = "d") -> DataFrame:
    """Mean and sample SD over seeds per (detector, threshold)."""
    aggs = []
    for m in SWEEP_METRICS:
        aggs += [F.avg(m).alias(m), sample_sd(F.col(m)).alias(f"{m}_std")]
    return sweep.groupBy(detector, "t_idx", "threshold").agg(F.count("*").alias("seed_count"), *aggs)


def select_operating_targets(mean_rows: DataFrame, seed_rows: DataFrame, goals: list[tuple[str, float]], detector: str = "d",
                             seed: str = "s") -> DataFrame:
    """Best response among thresholds whose mean target reaches the goal.

    ``goals`` are (target metric, value); precision answers with recall and the
    other way round. Ties: higher target, then higher threshold.
    """
    goal = F.explode(F.array(*[F.struct(F.lit(m).alias("target_metric"), F.lit(float(v)).alias("target_value")) for m, v in goals])).alias("g")
    is_precision = F.col("target_metric") == "precision"

    def reaching(rows: DataFrame) -> DataFrame:
        asked = rows.select("*", goal).select("*", "g.*").drop("g")
        return asked.withColumns({
            "target": F.when(is_precision, F.col("precision")).otherwise(F.col("recall")),
            "response": F.when(is_precision, F.col("recall")).otherwise(F.col("precision")),
        }).withColumn("reached", F.coalesce(F.col("target") >= F.col("target_value"), F.lit(False)))

    keys = [detector, "target_metric", "target_value"]
    sd = F.when(is_precision, F.col("recall_std")).otherwise(F.col("precision_std"))
    order = F.struct("response", "target", "threshold")
    chosen = reaching(mean_rows).groupBy(*keys).agg(
        F.max_by(F.when(F.col("reached"), F.struct("threshold", "response", sd.alias("response_std"))), F.when(F.col("reached"), order)).alias("c")
    )
    seeds = reaching(seed_rows).groupBy(*keys).agg(
        F.count_distinct(F.when(F.col("reached"), F.col(seed))).alias("seeds_reaching_target"), F.count_distinct(seed).alias("seed_count")
    )
    return chosen.join(seeds, keys).select(
        *keys,
        F.when(F.col("c").isNull(), "not_reachable_at_any_swept_threshold").otherwise("reachable").alias("status"),
        F.col("c.threshold").alias("threshold"), F.col("c.response").alias("response"), F.col("c.response_std").alias("response_std"),
        "seeds_reaching_target", "seed_count",
    )


def select_validation_threshold(mean_rows: DataFrame, detector: str = "d") -> DataFrame:
    """Highest mean F1; exact ties go to the higher threshold."""
    return mean_rows.groupBy(detector).agg(
        F.max_by(F.struct("t_idx", "threshold", "precision", "recall", "f1"), F.struct("f1", "threshold")).alias("c")
    ).select(detector, F.col("c.t_idx").alias("t_idx"), F.col("c.threshold").alias("selected_threshold"),
             *[F.col(f"c.{m}").alias(f"validation_{m}") for m in SWEEP_METRICS])


def apply_selected_threshold(validation: DataFrame, test: DataFrame, detector: str = "d", seed: str = "s") -> DataFrame:
    """Validation-chosen threshold applied once to the test sweep, paired per seed.

    ``seeds_match`` is false for a seed that exists on one side only.
    """
    chosen = select_validation_threshold(sweep_seed_mean(validation, detector), detector).select(detector, "t_idx", "selected_threshold")
    # a sweep table has one row per (run, threshold); the chosen table one per detector
    side = lambda df, name: df.join(chosen, [detector, "t_idx"]).select(
        detector, seed, "selected_threshold", *[F.col(m).alias(f"{name}_{m}") for m in (*SWEEP_METRICS, "tp", "fp", "fn")]
    )
    both = side(validation, "validation").join(side(test, "test"), [detector, seed, "selected_threshold"], "full_outer")
    return both.withColumn("seeds_match", F.col("validation_tp").isNotNull() & F.col("test_tp").isNotNull())


def sweep_findings(mean_rows: DataFrame, reference_idx: int, detector: str = "d") -> DataFrame:
    """Values at the reference threshold, best mean recall, and the first F1 peak."""
    at = lambda c: F.max(F.when(F.col("t_idx") == reference_idx, F.col(c)))
    return mean_rows.groupBy(detector).agg(
        at("threshold").alias("reference_threshold"), *[at(m).alias(f"reference_{m}") for m in SWEEP_METRICS],
        F.max("recall").alias("maximum_mean_recall"),
        F.max_by(F.struct("f1", "threshold"), F.struct(F.col("f1"), -F.col("t_idx"))).alias("p"),
    ).withColumns({"peak_mean_f1": F.col("p.f1"), "peak_mean_f1_threshold": F.col("p.threshold")}).drop("p")


def compare_pr_curves(curve: DataFrame, a, b, value: str, detector: str = "d", tolerance: float = 1e-12) -> DataFrame:
    """Where two detectors' mean curves differ on shared recall points."""
    side = lambda det, name: curve.filter(F.col(detector) == det).select("point", F.col(value).alias(name))
    joined = side(a, "a").join(side(b, "b"), "point")
    gap = F.col("a") - F.col("b")
    last = lambda c: F.max(F.when(F.col(c) > tolerance, F.col("point") / F.lit(100.0)))
    return joined.agg(
        F.count("*").alias("recall_grid_points"), F.count_if(gap > tolerance).alias("a_higher"),
        F.count_if(F.abs(gap) <= tolerance).alias("equal"), F.count_if(-gap > tolerance).alias("b_higher"),
        last("a").alias("a_max_recall"), last("b").alias("b_max_recall"),
    )


def froc_budget_candidates(froc: DataFrame, budgets: list[float], tolerance: float = 1e-12) -> DataFrame:
    """Rows within each false-positive budget."""
    budget = F.explode(F.array(*[F.lit(float(x)) for x in budgets])).alias("budget")
    return froc.select("*", budget).filter(F.col("fp_per_image") <= F.col("budget") + tolerance)


def froc_operating_points(froc: DataFrame, budgets: list[float], run=RUN, tolerance: float = 1e-12) -> DataFrame:
    """Per run and budget: most sensitivity, then fewest FP, then highest threshold.

    ``status`` marks a budget no swept point satisfies.
    """
    best = froc_budget_candidates(froc, budgets, tolerance).groupBy(*run, "budget").agg(
        F.max_by(F.struct("sensitivity", "fp_per_image", "threshold"), F.struct(F.col("sensitivity"), -F.col("fp_per_image"), F.col("threshold"))).alias("c")
    )
    grid = froc.select(*run).distinct().select(*run, F.explode(F.array(*[F.lit(float(x)) for x in budgets])).alias("budget"))
    return grid.join(best, [*run, "budget"], "left").select(
        *run, "budget", F.col("c.sensitivity").alias("sensitivity"), F.col("c.fp_per_image").alias("achieved_fp_per_image"),
        F.col("c.threshold").alias("selected_threshold"), F.when(F.col("c").isNull(), "no_point_within_budget").otherwise("selected").alias("status"),
    )


def froc_curve(froc: DataFrame, detector: str = "d") -> DataFrame:
    return froc.groupBy(detector, "threshold").agg(
        F.count("*").alias("seed_count"), F.avg("sensitivity").alias("sensitivity"), sample_sd(F.col("sensitivity")).alias("sensitivity_std"),
        F.avg("fp_per_image").alias("fp_per_image"), sample_sd(F.col("fp_per_image")).alias("fp_per_image_std"),
    )


def froc_operating_summary(points: DataFrame, detector: str = "d") -> DataFrame:
    out = points.groupBy(detector, "budget").agg(
        F.count("*").alias("seed_count"), F.avg("sensitivity").alias("sensitivity"), sample_sd(F.col("sensitivity")).alias("sensitivity_std"),
        F.avg("achieved_fp_per_image").alias("achieved_fp_per_image"), sample_sd(F.col("achieved_fp_per_image")).alias("achieved_fp_per_image_std"),
        F.avg("selected_threshold").alias("selected_threshold_mean"), F.min("selected_threshold").alias("selected_threshold_min"),
        F.max("selected_threshold").alias("selected_threshold_max"),
    )
    return out.withColumn("sensitivity_text", mean_std(F.col("sensitivity"), F.col("sensitivity_std")))
