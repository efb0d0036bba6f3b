"""Average precision and precision-recall curves without a single-task sort.

With running counts per detection (range blocks), a true positive at position p
serves every recall point up to its own recall. So the interpolated precision
at point i is the largest precision among true positives whose recall reaches
further, and each (run, level) needs at most 101 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from boxlens.functions.grids import IOU_LEVELS, RECALL_POINTS, points_reached
from boxlens.operators.assignment import match_images
from boxlens.operators.blocks import Order, block_count, columns, range_blocks, running_totals, suffix_maximum
from boxlens.operators.matching import FOLD_CAP, RUN, level_matches, rank_detections, score_filter
from boxlens.session import for_each_run, materialize, small

LEVELS = range(len(IOU_LEVELS))
# Slices (Arrow batches of detections in one row) of one task; Spark batches rows by number, whatever their bytes.
TASK_SLICES = 64


def hit(level: int) -> Column:
    return F.col("level_mask").bitwiseAND(F.lit(1 << level)).cast("boolean").cast("bigint")


# Global detection order: score falling, then image, then rank in the image.
SCORE_ORDER = [("score", False), ("image_id", True), ("rank", True)]


def detection_blocks(detections: DataFrame, keys: list[str], num_blocks: int | None = None) -> DataFrame:
    """Detections in range blocks. They are written first, since finding the ranges reads them once more."""
    written = materialize(detections, "unordered")
    return range_blocks(written, [*[(k, True) for k in keys], *SCORE_ORDER], "detections", num_blocks or block_count(written))


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])


def _key_starts(now: list[pa.Array], held: list[pa.Array] | None) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; ``held`` are the keys of the batch before."""
    starts = np.zeros(len(now[0]) if now else 0, bool)
    starts[:1] = held is None
    for i, own in enumerate(now):
        both = own if held is None else pa.concat_arrays([held[i], own])
        here, there = both.slice(1), both.slice(0, len(both) - 1)
        differ = pc.fill_null(pc.not_equal(here, there), False).to_numpy(zero_copy_only=False)
        starts[len(own) - len(differ):] |= differ | (here.is_valid().to_numpy(zero_copy_only=False) != there.is_valid().to_numpy(zero_copy_only=False))
    return starts


def _spread(slices: DataFrame) -> DataFrame:
    return slices.repartition(max(-(-slices.count() // TASK_SLICES), slices.sparkSession.sparkContext.defaultParallelism))


def _slices(keys: list[str], schema: pa.Schema):
    """Sorted detections of a block -> a row per batch and keys: counts before and after it, and its true positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, np.zeros(1 + len(LEVELS), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k) for k in keys]
            starts = _key_starts(now, held)
            held = [c.slice(len(c) - 1) for c in now]
            mask, weight = (batch.column(c).to_numpy() for c in ("level_mask", "_w"))
            sums = np.zeros((1 + len(LEVELS), len(mask) + 1), np.int64)
            np.cumsum(weight, out=sums[0, 1:])
            for i in LEVELS:
                np.cumsum((mask >> i & 1) * weight, out=sums[1 + i, 1:])
            edges = np.unique([0, *np.flatnonzero(starts), len(mask)])
            rows = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if starts[lo : lo + 1].any():
                    before = np.zeros_like(before)
                at = lo + np.flatnonzero((mask[lo:hi] > 0) & (weight[lo:hi] > 0))
                after = before + sums[:, hi] - sums[:, lo]
                hits = [before[0] + sums[0, at + 1] - sums[0, lo], weight[at], mask[at].astype(np.int64)]
                rows.append((before.tolist(), after.tolist(), np.array(hits).tobytes()))
                before = after
            first = pa.array(edges[:-1])
            ends = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[-3:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[c.take(first) for c in (*now, batch.column("block"))], *ends], schema=schema)

    return run


def counted_detections(detections: DataFrame, keys: list[str], weight: Column | None = None, order: Order | None = None,
                       num_blocks: int | None = None) -> DataFrame:
    """Detections for ``interpolated_precision``, counted inside their range block by the task that sorts it.

    They are exchanged once. A row holds the true positives of an Arrow batch (position in the block, weight, mask) and the
    counts of its block before and after. ``weight`` is a whole number of zero or more.
    """
    order = order or SCORE_ORDER
    w = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    written = materialize(detections.withColumn("_w", w.cast("bigint")).select(*keys, *[c for c, _ in order if c not in keys], "level_mask", "_w"), "unordered")
    whole = columns([*[(k, True) for k in keys], *[c for c in order if c[0] not in keys]])
    ranged = written.repartitionByRange(num_blocks or block_count(written), *whole).sortWithinPartitions(*whole)
    rows = ranged.select(*keys, F.spark_partition_id().alias("block"), F.coalesce(F.col("level_mask").cast("bigint"), F.lit(0)).alias("level_mask"), "_w")
    counts = T.ArrayType(T.LongType())
    schema = T.StructType([*[T.StructField(k, written.schema[k].dataType) for k in keys], T.StructField("block", T.IntegerType()),
                           T.StructField("before", counts), T.StructField("after", counts), T.StructField("hits", T.BinaryType())])
    return materialize(rows.mapInArrow(_slices(keys, _arrow(schema)), schema), "counted")


def _best_of_slices(keys: list[str], schema: pa.Schema):
    """Slices with the totals before their block and the targets -> best precision per level and last recall point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.array(RECALL_POINTS)
        for batch in batches:
            out = []
            given = zip(*[batch.column(c).to_pylist() for c in ("before", "offset", "target_count", "hits")], strict=True)
            for row, (before, offset, targets, hits) in enumerate(given):
                base = np.array(before) + np.array(offset)
                n, weight, mask = np.frombuffer(hits, np.int64).reshape(3, -1)
                n = n + offset[0]
                for i in LEVELS:
                    at = np.flatnonzero(mask >> i & 1)
                    if not len(at):
                        continue
                    k = base[1 + i] + np.cumsum(weight[at])
                    last = np.searchsorted(points, k / targets, side="right") - 1
                    first = np.flatnonzero(np.diff(last, prepend=-1))
                    best = np.maximum.reduceat(k / n[at], first)
                    out += [(row, i, p, v) for p, v in zip(last[first].tolist(), best.tolist(), strict=True)]
            if out:
                rows, *values = zip(*out, strict=True)
                index = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(index) for k in keys], *[pa.array(v, f.type) for v, f in zip(values, list(schema)[-3:], strict=True)]], schema=schema)

    return run


def _precision_of_slices(counted: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level, last_point and precision, several rows per group, from ``counted_detections``."""
    counts = range(1 + len(LEVELS))
    per_block = counted.groupBy(*keys, "block").agg(*[F.max(F.col("after")[i]).alias(f"_t{i}") for i in counts])
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*keys, "block", F.array(*[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)) for i in counts]).alias("offset"))
    targets = totals.select(*keys, "target_count").filter("target_count > 0")
    # blocks are ranges of the keys, so this has about as many rows as there are blocks and keys
    offsets = materialize(offsets.join(targets, keys) if keys else offsets.crossJoin(targets), "offsets")
    rows = _spread(counted).join(small(offsets), [*keys, "block"]).select(*keys, "before", "offset", F.col("target_count").cast("bigint"), "hits")
    schema = T.StructType([*[T.StructField(k, counted.schema[k].dataType) for k in keys], T.StructField("level", T.IntegerType()),
                           T.StructField("last_point", T.IntegerType()), T.StructField("precision", T.DoubleType())])
    return rows.mapInArrow(_best_of_slices(keys, _arrow(schema)), schema)


def _precision_of_blocks(blocks: DataFrame, totals: DataFrame, keys: list[str], weight: Column | None, order: Order | None) -> DataFrame:
    """The same from ``detection_blocks``."""
    w = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    sums = {"n": w, **{f"k{i}": hit(i) * w for i in LEVELS}}
    running = running_totals(blocks, keys, order or SCORE_ORDER, sums, totals)
    levels = F.array(*[
        F.struct(F.lit(i).alias("level"), F.col(f"k{i}").alias("k"), hit(i).alias("h")) for i in LEVELS
    ])
    # only true positives can carry the envelope
    return (
        running.filter("level_mask > 0")
        .select(*keys, "n", "target_count", F.explode(levels).alias("x"))
        .filter("x.h > 0 and target_count > 0")
        .select(
            *keys, F.col("x.level").alias("level"), (F.col("x.k").cast("double") / F.col("n")).alias("precision"),
            points_reached(F.col("x.k").cast("double") / F.col("target_count")).alias("last_point"),
        )
    )


def target_totals(targets: DataFrame, runs: DataFrame, run=RUN, by: list[str] | None = None) -> DataFrame:
    """Number of targets per run (and class): a grouped count, then one row per run."""
    counts = targets.groupBy(*(by or [])).agg(F.count("*").alias("target_count"))
    return for_each_run(counts, runs, run)


def interpolated_precision(blocks: DataFrame, totals: DataFrame, keys: list[str], weight: Column | None = None,
                           order: Order | None = None) -> DataFrame:
    """Precision at each recall point per (keys, level), only where it is above zero.

    ``blocks`` come from ``counted_detections``, which took weight and order itself, or from ``detection_blocks``.
    ``totals`` holds keys and target_count; ``weight`` is an integer detection weight.
    """
    if "hits" in blocks.columns:
        tp = _precision_of_slices(blocks, totals, keys)
    else:
        tp = _precision_of_blocks(blocks, totals, keys, weight, order)
    best = tp.groupBy(*keys, "level", "last_point").agg(F.max("precision").alias("precision"))
    # at most 101 rows per window from here on
    w_desc = Window.partitionBy(*keys, "level").orderBy(F.desc("last_point"))
    env = best.select(
        *keys, "level", "last_point",
        F.max("precision").over(w_desc.rowsBetween(Window.unboundedPreceding, 0)).alias("precision"),
        F.lead("last_point", 1, -1).over(w_desc).alias("below"),
    )
    return env


def average_precision(blocks: DataFrame, totals: DataFrame, keys: list[str], weight: Column | None = None,
                      order: Order | None = None) -> DataFrame:
    """AP per (keys, level): mean over 101 recall points. No targets: NULL."""
    env = interpolated_precision(blocks, totals, keys, weight, order)
    ap = env.groupBy(*keys, "level").agg(
        (F.sum(F.col("precision") * (F.col("last_point") - F.col("below"))) / len(RECALL_POINTS)).alias("ap")
    )
    grid = totals.withColumn("level", F.explode(F.array(*[F.lit(i) for i in LEVELS])))
    return grid.join(ap, [*keys, "level"], "left").select(
        *keys, "level",
        F.when(F.col("target_count") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"),
    )


def ap_summary(ap: DataFrame, keys: list[str]) -> DataFrame:
    """AP at IoU 0.50 and the mean of the ten levels, from one grouped pass."""
    return ap.groupBy(*keys).agg(
        F.max(F.when(F.col("level") == 0, F.col("ap"))).alias("map_50"), F.avg("ap").alias("map_50_95")
    )


def recall_precision(blocks: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Precision at all 101 recall points per (keys, level); missing points are 0."""
    env = interpolated_precision(blocks, totals, keys)
    points = env.select(*keys, "level", "precision", F.explode(F.sequence(F.col("below") + 1, F.col("last_point"))).alias("point"))
    grid = totals.filter("target_count > 0").withColumn("level", F.explode(F.array(*[F.lit(i) for i in LEVELS]))).withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(100)))
    )
    return grid.join(points, [*keys, "level", "point"], "left").select(
        *keys, "level", "point", F.coalesce("precision", F.lit(0.0)).alias("precision")
    )


def class_detections(predictions: DataFrame, targets: DataFrame, run=RUN, min_score: float = 0.001, max_detections: int = 100) -> DataFrame:
    """Detections with match bits under a cap per class and image."""
    columns = [*run, "label", "image_id", "pidx", "rank", "score", "level_mask"]
    if max_detections is not None and max_detections <= FOLD_CAP:
        return match_images(score_filter(predictions, min_score), targets, run, max_detections, ("label",)).select(*columns)
    ranked = rank_detections(score_filter(predictions, min_score), run, max_detections, by=("label",))
    # the class joins the run key, so that ranks stay unique inside a fold
    per_class = ranked.withColumn("class_id", F.col("label"))
    return level_matches(per_class, targets, (*run, "class_id"), max_detections).select(*columns)


def class_totals(targets: DataFrame, classes: DataFrame, runs: DataFrame, run=RUN) -> DataFrame:
    counts = targets.groupBy("label").agg(F.count("*").alias("target_count"))
    full = classes.select("label").join(counts, "label", "left").fillna(0, ["target_count"])
    return for_each_run(full, runs, run).select(*run, "label", "target_count")


def coco_ap(predictions: DataFrame, targets: DataFrame, classes: DataFrame, runs: DataFrame, run=RUN, min_score: float = 0.001,
            max_detections: int = 100) -> DataFrame:
    """Official AP per class, and the class mean as the row with a NULL label.

    Classes without targets are undefined and left out of the mean.
    """
    dets = class_detections(predictions, targets, run, min_score, max_detections)
    keys = [*run, "label"]
    ap = average_precision(counted_detections(dets, keys), class_totals(targets, classes, runs, run), keys)
    per_class = ap_summary(ap, keys)
    overall = per_class.groupBy(*run).agg(F.avg("map_50").alias("map_50"), F.avg("map_50_95").alias("map_50_95"))
    return per_class.unionByName(
        overall.withColumn("label", F.lit(None).cast(per_class.schema["label"].dataType)).select(*keys, "map_50", "map_50_95")
    )


def pr_curve_101(predictions: DataFrame, targets: DataFrame, classes: DataFrame, runs: DataFrame, run=RUN, min_score: float = 0.001,
                 max_detections: int = 100) -> DataFrame:
    """Precision at 101 recalls for IoU 0.50 and for the mean of ten levels.

    One curve per class and the mean over defined classes (NULL label).
    """
    dets = class_detections(predictions, targets, run, min_score, max_detections)
    keys = [*run, "label"]
    curve = recall_precision(counted_detections(dets, keys), class_totals(targets, classes, runs, run), keys)
    per_class = curve.groupBy(*keys, "point").agg(
        F.max(F.when(F.col("level") == 0, F.col("precision"))).alias("precision_50"), F.avg("precision").alias("precision_50_95")
    )
    overall = per_class.groupBy(*run, "point").agg(
        F.avg("precision_50").alias("precision_50"), F.avg("precision_50_95").alias("precision_50_95")
    )
    return per_class.unionByName(
        overall.withColumn("label", F.lit(None).cast(per_class.schema["label"].dataType)).select(*per_class.columns)
    )


def _curve_slices(keys: list[str], carry: list[str], schema: pa.Schema):
    """Sorted detections of a block -> a row per batch and keys: the detections as arrays, how many and how many hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k) for k in keys]
            edges = np.unique([0, *np.flatnonzero(_key_starts(now, held)), batch.num_rows])
            held = [c.slice(len(c) - 1) for c in now]
            first, size = pa.array(edges[:-1]), np.diff(edges)
            hits = np.concatenate([[0], np.cumsum(batch.column("hit").to_numpy())])
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), batch.column(c)) for c in (*carry, "hit")]
            columns = [*[c.take(first) for c in (*now, batch.column("block"))], pa.array(done + np.arange(len(size))), *lists, pa.array(size), pa.array(np.diff(hits[edges]))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            done += len(size)

    return run


def _curve_of(row_hits: np.ndarray, n: int, tp: int) -> tuple[np.ndarray, np.ndarray]:
    cum = tp + np.cumsum(row_hits)
    return cum, cum / (n + np.arange(1, len(row_hits) + 1))


def _slice_tops(keys: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(batch.column("hit"), *[batch.column(c).to_pylist() for c in ("n", "tp")], strict=True)
            top = [_curve_of(h.values.to_numpy(), n, tp)[1].max() for h, n, tp in given]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*keys, "block", "slice")], pa.array(top, pa.float64())], schema=schema)

    return run


def _curve_rows(keys: list[str], carry: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, tp, later) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("n", "tp", "later")], strict=True)):
                hits = batch.column("hit")[i].values.to_numpy()
                cum, precision = _curve_of(hits, n, tp)
                envelope = np.maximum.accumulate(precision[::-1])[::-1]
                if later is not None:
                    envelope = np.maximum(envelope, later)
                same = pa.array(np.full(len(hits), i))
                columns = [*[batch.column(k).take(same) for k in keys], *[batch.column(c)[i].values for c in carry],
                           *map(pa.array, (cum, n + np.arange(1, len(hits) + 1) - cum, precision, envelope))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def detection_curve(detections: DataFrame, keys: list[str], level: int = 0, num_blocks: int | None = None, envelope: bool = True) -> DataFrame:
    """Every detection with its running TP and FP counts in global score order, precision, and (if asked for) the largest
    precision from there on.

    Detections are exchanged by ranges of that order, written as slices in order, and spread once more as such; what is
    known per slice (one row for up to an Arrow batch of detections) is put in order by itself.
    """
    carry = ["image_id", "pidx"]
    slim = detections.select(*keys, *[c for c, _ in SCORE_ORDER], "pidx", hit(level).cast("int").alias("hit"))
    written = materialize(slim, "unordered")
    whole = columns([*[(k, True) for k in keys], *SCORE_ORDER])
    ranged = written.repartitionByRange(num_blocks or block_count(written), *whole).sortWithinPartitions(*whole)
    kept = [T.StructField(k, written.schema[k].dataType) for k in keys]
    whose = [*kept, T.StructField("block", T.IntegerType()), T.StructField("slice", T.LongType())]
    schema = T.StructType([*whose, *[T.StructField(c, T.ArrayType(written.schema[c].dataType)) for c in (*carry, "hit")],
                           T.StructField("size", T.LongType()), T.StructField("hits", T.LongType())])
    rows = ranged.select(*keys, F.spark_partition_id().alias("block"), *carry, "hit")
    slices = materialize(rows.mapInArrow(_curve_slices(keys, carry, _arrow(schema)), schema), "slices")
    at = [*keys, "block", "slice"]
    earlier = Window.partitionBy(*keys).orderBy("block", "slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = materialize(slices.select(*at, sums("size").alias("n"), sums("hits").alias("tp")), "offsets")
    if envelope:
        tops = T.StructType([*whose, T.StructField("top", T.DoubleType())])
        best = _spread(slices).join(small(offsets), at).select(*at, "hit", "n", "tp").mapInArrow(_slice_tops(keys, _arrow(tops)), tops)
        after = Window.partitionBy(*keys).orderBy(F.desc("block"), F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
        offsets = materialize(best.withColumn("later", F.max("top").over(after)).join(offsets, at).select(*at, "n", "tp", "later"), "offsets")
    else:
        offsets = offsets.withColumn("later", F.lit(None).cast("double"))
    out = T.StructType([*kept, *[T.StructField(c, written.schema[c].dataType) for c in carry], T.StructField("cum_tp", T.LongType()),
                        T.StructField("cum_fp", T.LongType()), T.StructField("precision", T.DoubleType()), T.StructField("envelope", T.DoubleType())])
    given = _spread(slices).join(small(offsets), at).select(*keys, *carry, "hit", "n", "tp", "later")
    curve = given.mapInArrow(_curve_rows(keys, carry, _arrow(out)), out)
    return curve if envelope else curve.drop("envelope")


def pr_curve_seed_mean(curve: DataFrame, detector: str = "d") -> DataFrame:
    """Mean and sample SD over seeds at each recall point."""
    from boxlens.functions.ratios import sample_sd

    return curve.groupBy(detector, "label", "point").agg(
        F.count("*").alias("n"),
        F.avg("precision_50").alias("precision_50_mean"), sample_sd(F.col("precision_50")).alias("precision_50_sd"),
        F.avg("precision_50_95").alias("precision_50_95_mean"), sample_sd(F.col("precision_50_95")).alias("precision_50_95_sd"),
    )


def cumulative_tp_fp(blocks: DataFrame, keys: list[str], level: int = 0, totals: DataFrame | None = None) -> DataFrame:
    """Running TP and FP counts in global score order."""
    sums = {"cum_tp": hit(level), "cum_fp": F.lit(1).cast("bigint") - hit(level)}
    return running_totals(blocks, keys, SCORE_ORDER, sums, totals)


def precision_recall(blocks: DataFrame, totals: DataFrame, keys: list[str], level: int = 0) -> DataFrame:
    cum = cumulative_tp_fp(blocks, keys, level, totals)
    return cum.withColumns({
        "precision": F.col("cum_tp").cast("double") / (F.col("cum_tp") + F.col("cum_fp")),
        "recall": F.col("cum_tp").cast("double") / F.col("target_count"),
    })


def precision_envelope(pr: DataFrame, keys: list[str]) -> DataFrame:
    """Largest precision at or after each position."""
    return suffix_maximum(pr, keys, SCORE_ORDER, "precision", "envelope")


def recall_sampling(pr: DataFrame, keys: list[str]) -> DataFrame:
    """First position reaching each recall point, and its envelope precision.

    Recall only steps at true positives: a row reaches the points above the
    recall just before it. The first row also takes point 0.
    """
    # a true positive serves every point up to its recall, so the best of each last point will do; nothing is sorted
    position = F.col("cum_tp") + F.col("cum_fp")
    rows = pr.filter((hit(0) > 0) | (position == 1)).withColumns({"last_point": points_reached(F.col("recall")), "position": position})
    best = rows.filter("last_point is not null").groupBy(*keys, "last_point").agg(F.min("position").alias("position"), F.max("precision").alias("envelope"))
    # at most 101 rows per window from here on
    w_desc = Window.partitionBy(*keys).orderBy(F.desc("last_point"))
    after = w_desc.rowsBetween(Window.unboundedPreceding, 0)
    steps = best.select(*keys, "last_point", F.min("position").over(after).alias("position"), F.max("envelope").over(after).alias("envelope"),
                        F.lead("last_point", 1, -1).over(w_desc).alias("below"))
    return steps.select(*keys, F.explode(F.sequence(F.col("below") + 1, F.col("last_point"))).alias("point"), "position", "envelope")
