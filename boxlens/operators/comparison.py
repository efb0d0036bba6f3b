"""Result tables: seed means, pivots, cross-checks, dominance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.functions.ratios import sample_sd
from boxlens.functions.text import mean_std
from boxlens.operators.metrics import undefined_reason
from boxlens.session import small

CONDITIONAL = ("iou", "dice")
METRIC_VECTOR = ("precision", "recall", "f1", "iou", "dice", "map_50", "map_50_95")


def unpivot(df: DataFrame, keys: list[str], values: list[str], name: str = "metric", out: str = "value") -> DataFrame:
    return df.unpivot(keys, [F.col(v).cast("double").alias(v) for v in values], name, out)


def metric_vector(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The seven metrics in fixed order, long form."""
    return unpivot(rows, keys, list(METRIC_VECTOR))


def seed_contract_violations(rows: DataFrame, detector: str = "d", seed: str = "s") -> DataFrame:
    """Rows breaking the conditional-metric contract, with the rule they break.

    IoU and Dice are NULL together, exactly when tp = 0, and then carry the reason
    that the counts imply.
    """
    undefined = sum((F.col(m).isNull().cast("int") for m in CONDITIONAL), F.lit(0))
    repeated = F.count("*").over(Window.partitionBy(detector, seed)) > 1
    expected = undefined_reason(F.col("tp"), F.col("prediction_count"))
    rules = {
        "duplicate_seed": repeated,
        "invalid_true_positive_count": F.col("tp").isNull() | (F.col("tp") < 0),
        "not_jointly_defined": (undefined > 0) & (undefined < len(CONDITIONAL)),
        "defined_without_true_positive": (F.col("tp") == 0) & (undefined < len(CONDITIONAL)),
        "undefined_with_true_positive": (F.col("tp") > 0) & (undefined > 0),
        "reason_differs_from_counts": F.coalesce(F.col("reason"), F.lit("")) != expected,
        "nonconditional_metric_undefined": reduce(lambda a, b: a | b, [F.col(m).isNull() for m in METRIC_VECTOR if m not in CONDITIONAL]),
    }
    return violations(rows, rules, [detector, seed])


def violations(rows: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """One row per broken rule."""
    hit = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return rows.withColumn("_hit", hit).select(*keys, F.explode("_hit").alias("rule"))


def seed_mean_std(rows: DataFrame, metrics: list[str], detector: str = "d", seed: str = "s") -> DataFrame:
    """Per detector and metric: defined count, undefined seeds and reasons, mean, SD."""
    long = unpivot(rows.withColumn("reason", F.coalesce("reason", F.lit(""))), [detector, seed, "reason"], metrics)
    undefined = F.col("value").isNull()
    out = long.groupBy(detector, "metric").agg(
        F.count("value").alias("n"), F.count("*").alias("attempted_n"), F.count_if(undefined).alias("undefined_n"),
        F.array_join(F.sort_array(F.collect_list(F.when(undefined, F.col(seed)))).cast("array<string>"), ";").alias("undefined_seeds"),
        F.array_join(F.sort_array(F.collect_set(F.when(undefined, F.col("reason")))), ";").alias("undefined_reason"),
        F.avg("value").alias("mean"), sample_sd(F.col("value")).alias("std"),
    )
    return out.withColumn("mean_plus_minus_std", mean_std(F.col("mean"), F.col("std")))


def publication_pivot(long: DataFrame, detectors: list, detector: str = "d") -> DataFrame:
    """Metric rows, one column group per detector."""
    return long.groupBy("metric").pivot(detector, detectors).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"), F.first("mean_plus_minus_std").alias("text"), F.first("n").alias("n")
    )


def run_comparison_rows(metrics: DataFrame, training: DataFrame, compute: DataFrame, image_count: int | Column) -> DataFrame:
    """Metrics, training summary and compute profile of each run in one row.

    ``problems`` lists provenance faults: incomplete training, seed or model mismatch.
    """
    joined = metrics.alias("m").join(training.alias("t"), "run_id").join(compute.alias("c"), "run_id")
    faults = F.array_compact(F.array(
        F.when(F.col("t.status") != "complete", F.lit("incomplete_training")),
        F.when((F.col("t.seed") != F.col("m.s")) | (F.col("c.seed") != F.col("m.s")), F.lit("seed_mismatch")),
        F.when(F.col("t.model_sha256") != F.col("c.model_sha256"), F.lit("model_mismatch")),
    ))
    images = image_count if isinstance(image_count, Column) else F.lit(image_count)
    return joined.select(
        "run_id", F.col("m.d").alias("d"), F.col("m.s").alias("s"), "m.tp", "m.prediction_count",
        (F.col("m.tp") > 0).alias("conditional_defined"), undefined_reason(F.col("m.tp"), F.col("m.prediction_count")).alias("undefined_reason"),
        (images.cast("double") / F.col("c.inference_seconds")).alias("evaluation_fps"),
        (F.col("c.model_bytes") / F.lit(1048576.0)).alias("checkpoint_size_mib"), "t.training_seconds", F.array_join(faults, ";").alias("problems"),
    )


def check_factorial_grid(rows: DataFrame, dimensions: list[DataFrame], keys: list[str]) -> DataFrame:
    """Cells of the expected grid that are missing or repeated, and rows outside it.

    The dimensions are detector, seed and condition lists; each is broadcast only if counted small.
    """
    grid = reduce(lambda a, b: a.crossJoin(small(b)), dimensions)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    both = grid.withColumn("expected", F.lit(True)).join(counts, keys, "full_outer")
    problem = (
        F.when(F.col("expected").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    )
    return both.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), problem.alias("problem")).filter("problem is not null")


def reconcile(actual: DataFrame, published: DataFrame, keys: list[str], value: str = "value", tolerance: float = 1e-12) -> DataFrame:
    """Recomputed against published values: all that differ, null-safe."""
    a, b = F.col("actual"), F.col("published")
    joined = actual.select(*keys, F.col(value).alias("actual")).join(
        published.select(*keys, F.col(value).alias("published")), keys, "full_outer"
    )
    same = (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    return joined.filter(~same)


def diff_significance(current: DataFrame, archived: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Decisions that changed between two result tables, one row per key."""
    significant = (F.col("status") == "complete") & F.coalesce(F.col("p_holm") < alpha, F.lit(False))
    side = lambda df, name: df.select(*keys, significant.alias(name))
    both = side(current, "now").join(side(archived, "then"), keys, "full_outer")
    change = (
        F.when(F.col("now").isNull() | F.col("then").isNull(), "key_mismatch")
        .when(F.col("then") & ~F.col("now"), "lost").when(~F.col("then") & F.col("now"), "gained")
        .when(F.col("now"), "kept").otherwise("never")
    )
    return both.select(*keys, change.alias("change"))


def join_accuracy_compute(accuracy: DataFrame, recalls: DataFrame, compute: DataFrame) -> DataFrame:
    """Per-run accuracy, validation-selected recall and compute, 1:1."""
    c = compute.select("run_id", F.col("seed").alias("compute_seed"), "throughput_fps", "mean_latency_ms", "total_parameters", "estimated_gflops")
    return accuracy.join(c, "run_id").join(recalls, ["d", "s"]).filter(F.col("s") == F.col("compute_seed")).drop("compute_seed")


def accuracy_compute_violations(accuracy: DataFrame, recalls: DataFrame, compute: DataFrame) -> DataFrame:
    """Why the 1:1 join would not cover everything."""
    tag = lambda df, name: df.select("run_id", F.lit(name).alias("problem"))
    repeated = lambda df, name: tag(df.groupBy("run_id").count().filter("count > 1"), name)
    parts = [
        repeated(accuracy, "duplicate_accuracy_run"), repeated(compute, "duplicate_compute_run"),
        tag(compute.join(accuracy, "run_id", "left_anti"), "no_accuracy_row"),
        tag(accuracy.join(compute, "run_id", "left_anti"), "no_compute_row"),
        tag(accuracy.join(recalls, ["d", "s"], "left_anti"), "no_selected_recall"),
        tag(accuracy.join(compute.select("run_id", "seed"), "run_id").filter("seed <> s"), "seed_mismatch"),
        tag(seed_grid_gaps(accuracy), "seed_grid_differs"),
    ]
    return reduce(DataFrame.unionByName, parts)


def seed_grid_gaps(runs: DataFrame) -> DataFrame:
    """Runs whose seed does not occur for every detector."""
    per_seed = runs.groupBy("s").agg(F.count_distinct("d").alias("nd"))
    total = runs.agg(F.count_distinct("d").alias("all_d"))
    return runs.join(per_seed, "s").crossJoin(F.broadcast(total)).filter("nd < all_d")


# Benefit and resource axes of the four panels.
# Panels and the direction of their axes.
PANELS = (
    ("a", "throughput_fps", "higher", "map_50_95"),
    ("b", "mean_latency_ms", "lower", "recall"),
    ("c", "total_parameters", "lower", "map_50_95"),
    ("d", "estimated_gflops", "lower", "recall"),
)


def directed_objective(points: DataFrame) -> DataFrame:
    """Every point on every panel with higher-is-better axes."""
    return panel_points(points).select("panel", "d", "s", directed_by(F.col("x"), F.col("x_direction")).alias("x"), "y")


def directed_by(value: Column, direction: Column) -> Column:
    return F.when(direction == "lower", -value).otherwise(value)


def panel_points(points: DataFrame) -> DataFrame:
    rows = F.explode(F.array(*[
        F.struct(F.lit(p).alias("panel"), F.lit(direction).alias("x_direction"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        for p, x, direction, y in PANELS
    ])).alias("p")
    return points.select("d", "s", rows).select("p.panel", "d", "s", "p.x_direction", "p.x", "p.y")


def strict_dominance(points: DataFrame) -> DataFrame:
    """Per panel the detector whose worst run beats the other's best on both axes, else NULL."""
    spread = directed_objective(points).groupBy("panel", "d").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))]
    )
    other = spread.select("panel", F.col("d").alias("o"), F.col("max_x").alias("ox"), F.col("max_y").alias("oy"))
    pairs = spread.join(other, "panel").filter("d <> o")
    return pairs.groupBy("panel").agg(F.max(F.when((F.col("min_x") > F.col("ox")) & (F.col("min_y") > F.col("oy")), F.col("d"))).alias("dominant"))
