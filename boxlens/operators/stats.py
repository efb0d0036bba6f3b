"""Patient-cluster bootstrap, paired label-swap permutation and Holm correction.

A replicate is just another key: all replicates of all conditions run as one job.
Draws are hashes of (seed, replicate, unit), so they do not depend on row order.
All images of a group share one weight, so image evidence is summed per group
before the replicates multiply it. Replicate -1 is the observed sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from boxlens.functions.hashing import Draws, draw
from boxlens.functions.ratios import finite_or_null, mean_or_null, operating_ratios
from boxlens.operators.assignment import image_sums
from boxlens.operators.blocks import dense_ids
from boxlens.operators.comparison import METRIC_VECTOR, unpivot
from boxlens.operators.matching import RUN, score_filter
from boxlens.session import for_each_run, materialize

COUNTS = ("target_count", "tp", "fp", "fn", "iou_sum", "dice_sum")
# Detections of both detectors in one order: equal scores list detector A first.
PAIR_ORDER = [("score", False), ("d", True), ("image_id", True), ("rank", True)]
OBSERVED = -1
UNDEFINED_REASON = "undefined_metric"


def join_patient_cluster(images: DataFrame, groups: DataFrame) -> DataFrame:
    """Images with their patient group."""
    return images.join(groups, "image_id")


def patient_cluster_violations(images: DataFrame, groups: DataFrame) -> DataFrame:
    """Images without exactly one non-blank group."""
    blank = F.trim(F.coalesce(F.col("patient_group").cast("string"), F.lit(""))) == ""
    tag = lambda df, name: df.select("image_id", F.lit(name).alias("problem"))
    return reduce(DataFrame.unionByName, [
        tag(images.join(groups, "image_id", "left_anti"), "missing_group"),
        tag(groups.filter(blank), "blank_group"),
        tag(groups.groupBy("image_id").count().filter("count > 1"), "duplicate_mapping"),
    ])


def cluster_bootstrap_weights(groups: DataFrame, resamples: int, seed: int, group: str = "patient_group") -> DataFrame:
    """Multiplicity of each drawn group per replicate: G draws with replacement."""
    indexed = dense_ids(groups.select(group).distinct(), [group], "g", start=0)
    n = indexed.count()
    ids = groups.sparkSession.range(resamples * n)
    drawn = ids.select(
        F.floor(F.col("id") / n).cast("int").alias("rep"),
        (draw(F.lit(seed), F.lit("group"), F.floor(F.col("id") / n), F.col("id") % n) % n).alias("g"),
    )
    return drawn.groupBy("rep", "g").agg(F.count("*").alias("w")).join(indexed, "g").select("rep", group, "w")


def seed_bootstrap_weights(spark: SparkSession, seeds: list[int], resamples: int, seed: int) -> DataFrame:
    """Multiplicity of each training seed per replicate; a single seed is kept as is."""
    n = len(seeds)
    names = F.array(*[F.lit(x) for x in seeds])
    if n == 1:
        return spark.range(resamples).select(F.col("id").cast("int").alias("rep"), F.lit(seeds[0]).alias("s"), F.lit(1).cast("bigint").alias("sw"))
    reps = spark.range(resamples).select(F.col("id").cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    pick = F.element_at(names, (draw(F.lit(seed), F.lit("seed"), F.col("rep"), F.col("j")) % n + 1).cast("int"))
    return reps.select("rep", pick.alias("s")).groupBy("rep", "s").agg(F.count("*").alias("sw"))


def permutation_swaps(groups: DataFrame, resamples: int, seed: int, group: str = "patient_group") -> DataFrame:
    """One fair bit per group and replicate."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("rep")
    return groups.select(group).distinct().select(group, reps).withColumn(
        "swap", draw(F.lit(seed), F.lit("swap"), F.col("rep"), F.col(group)) % 2 == 1
    )


GROUP_BLOCK = 8192  # groups whose multiplicities are held together, in all replicates
DRAWN = 1 << 24  # multiplicities that a drawing task holds; beyond as many groups, those of one replicate
TAILS = 1 << 14  # draws of a replicate that are hashed together


def _partitions(df: DataFrame) -> int:
    """Few bytes but much work per row, so a number of tasks is asked for, else small exchanges are coalesced."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def drawn_blocks(groups: DataFrame, resamples: int, seed: int, group: str = "patient_group") -> tuple[DataFrame, DataFrame]:
    """Every group with its block, its place there and the block's size; and per block and run of replicates one matrix of the multiplicities of ``cluster_bootstrap_weights``.

    A task draws some replicates whole and counts in an array, so neither single draws nor
    (replicate, group) rows are exchanged, only a byte per group and replicate (four where a
    multiplicity exceeds 255).
    """
    spark = groups.sparkSession
    ids = materialize(dense_ids(groups.select(group).distinct(), [group], "g", start=0), "group-numbers")
    n = max(1, ids.count())
    parts = _partitions(groups)
    size = min(GROUP_BLOCK, -(-n // (2 * parts)))
    reps = max(1, min(DRAWN // n, -(-resamples // (2 * spark.sparkContext.defaultParallelism))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in batch.column("lo").to_pylist():
                hi = min(lo + reps, resamples)
                drawn, counts = Draws(seed, "group", count=hi, start=lo), np.zeros((hi - lo, n), np.int32)
                for j in range(0, n, TAILS):
                    picked = drawn([str(k) for k in range(j, min(j + TAILS, n))]) % np.uint32(n)
                    for rep, g in enumerate(np.ascontiguousarray(picked.T)):
                        np.add.at(counts[rep], g.astype(np.intp), 1)
                data = [c if c.max(initial=0) > 255 else c.astype(np.uint8) for c in (counts[:, k : k + size] for k in range(0, n, size))]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int32()), pa.array([lo] * len(data), pa.int32()),
                                                  pa.array([hi - lo] * len(data), pa.int32()), pa.array([x.tobytes() for x in data], pa.binary())], names=["block", "lo", "reps", "data"])

    starts = range(0, resamples, reps)
    tasks = spark.range(0, resamples, reps, numPartitions=len(starts)).select(F.col("id").cast("int").alias("lo"))
    blocks = tasks.mapInArrow(count, "block int, lo int, reps int, data binary").repartition(parts, "block")
    places = {"block": F.floor(F.col("g") / size).cast("int"), "place": (F.col("g") % size).cast("int"),
              "size": F.least(F.lit(size), n - F.col("g") + F.col("g") % size).cast("int")}
    return ids.withColumns(places).drop("g"), blocks


def _multiplicities(matrices: pa.Table, resamples: int, groups: int) -> np.ndarray:
    """(replicates, groups) of a block that holds ``groups`` groups."""
    parts = {lo: (reps, np.frombuffer(data, np.uint8)) for lo, reps, data in zip(*(matrices[c].to_pylist() for c in ("lo", "reps", "data")), strict=True)}
    narrow = all(len(x) == reps * groups for reps, x in parts.values())
    out = np.empty((resamples, groups), np.uint8 if narrow else np.int32)
    for lo, (reps, x) in parts.items():
        out[lo : lo + reps] = (x if len(x) == reps * groups else x.view(np.int32)).reshape(reps, groups)
    return out


def _per_group(groups: DataFrame, resamples: int, seed: int, group: str, name: str, kind: str, shape) -> DataFrame:
    """One row per group with a column that ``shape`` makes of the multiplicities (groups, replicates) of a block."""
    ids, blocks = drawn_blocks(groups, resamples, seed, group)

    def fill(members: pa.Table, matrices: pa.Table) -> pa.Table:
        if not members.num_rows:
            return members.select([group]).append_column(name, shape(np.zeros((0, resamples), np.int32)))
        drawn = _multiplicities(matrices, resamples, members.num_rows).T[members["place"].to_numpy()]
        drawn[members[group].is_null().to_numpy(zero_copy_only=False)] = 0  # a missing group is numbered, but no row names it
        return pa.table({group: members[group], name: shape(drawn)})

    members = ids.select(group, "block", "place").repartition(_partitions(groups), "block").groupBy("block")
    return members.cogroup(blocks.groupBy("block")).applyInArrow(fill, f"{group} {ids.schema[group].dataType.simpleString()}, {name} {kind}")


def bootstrap_arrays(groups: DataFrame, resamples: int, seed: int, group: str = "patient_group") -> DataFrame:
    """One row per group: its multiplicity in every replicate, as an array; groups that are never drawn have zeros."""
    def shape(drawn: np.ndarray) -> pa.Array:
        ends = pa.array(np.arange(len(drawn) + 1, dtype=np.int32) * np.int32(resamples))
        return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(drawn, np.int32).ravel()))

    return _per_group(groups, resamples, seed, group, "w", "array<int>", shape)


def bootstrap_texts(groups: DataFrame, resamples: int, seed: int, group: str = "patient_group") -> DataFrame:
    """The same as a text, multiplicities joined by commas."""
    def shape(drawn: np.ndarray) -> pa.Array:
        texts = np.full((len(drawn), 2 * resamples - 1), ord(","), np.uint8)
        texts[:, ::2] = drawn + ord("0")
        wide = (drawn > 9).any(1)
        return pa.array([",".join(map(str, row)) if long else text.tobytes().decode() for row, text, long in zip(drawn, texts, wide, strict=True)], pa.string())

    return _per_group(groups, resamples, seed, group, "weights", "string", shape)


SLICE = 256  # groups whose bits are held together


def _bits(permutations: int, seed: int):
    """(groups, replicates): fair bits of groups, given as texts; those of ``permutation_swaps``."""
    drawn = Draws(seed, "swap", count=permutations)
    return lambda groups: (drawn(groups) & np.uint32(1)).astype(np.uint8)


def _spread(groups: DataFrame, group: str) -> DataFrame:
    """Distinct groups with their text."""
    return groups.select(group).repartition(_partitions(groups), group).distinct().select(group, F.col(group).cast("string").alias("_text"))


def swap_texts(groups: DataFrame, permutations: int, seed: int, group: str = "patient_group") -> DataFrame:
    """One row per group: its fair bit in every replicate, as a text of 0 and 1."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(permutations, seed)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                texts = [row.tobytes().decode() for row in bits(part.column("_text").to_pylist()) + np.uint8(ord("0"))]
                yield pa.RecordBatch.from_arrays([part.column(group), pa.array(texts, pa.string())], names=[group, "swaps"])

    return _spread(groups, group).mapInArrow(write, f"{group} {groups.schema[group].dataType.simpleString()}, swaps string")


def bootstrap_sums(group_ev: DataFrame, groups: DataFrame, resamples: int, seed: int, keys: list[str], group: str = "patient_group") -> DataFrame:
    """Sums of ``COUNTS`` of every run in every bootstrap replicate, where a group's evidence counts as often as it is drawn.

    The evidence of a block of groups meets the block's multiplicities; a block gives one matrix
    per run, and those of a task are added up before they are exchanged.
    """
    ids, blocks = drawn_blocks(groups, resamples, seed, group)
    kinds = [group_ev.schema[c].dataType for c in COUNTS]
    rows = group_ev.select(*keys, group, *COUNTS).join(ids, group).drop(group).repartition(_partitions(groups), "block").groupBy("block")
    schema = "".join(f"{k} {group_ev.schema[k].dataType.simpleString()}, " for k in keys) + "rep int, " + ", ".join(f"{c} double" for c in COUNTS)

    def add(evidence: pa.Table, matrices: pa.Table) -> pa.Table:
        code = np.zeros(evidence.num_rows, np.int64)
        for k in keys:
            named = evidence[k].combine_chunks().dictionary_encode(null_encoding="encode")
            code = code * max(1, len(named.dictionary)) + named.indices.to_numpy()
        _, first, run = np.unique(code, return_index=True, return_inverse=True)
        groups_in = evidence["size"][0].as_py() if evidence.num_rows else 0
        sums = np.zeros((len(first), len(COUNTS), resamples))
        if groups_in:
            drawn, place = _multiplicities(matrices, resamples, groups_in), evidence["place"].to_numpy()
            found = np.zeros((len(first), len(COUNTS), groups_in))
            for i, c in enumerate(COUNTS):
                np.add.at(found[:, i], (run, place), evidence[c].cast(pa.float64()).to_numpy())
            found = found.reshape(-1, groups_in)
            for lo in range(0, resamples, 128):
                sums[:, :, lo : lo + 128] = (found @ drawn[lo : lo + 128].T.astype(np.float64)).reshape(len(first), len(COUNTS), -1)
        run_of = np.repeat(first, resamples)
        reps = np.tile(np.arange(resamples, dtype=np.int32), len(first))
        return pa.table({**{k: evidence[k].take(run_of) for k in keys}, "rep": reps, **{c: sums[:, i].ravel() for i, c in enumerate(COUNTS)}})

    parts = rows.cogroup(blocks.groupBy("block")).applyInArrow(add, schema)
    # counts are whole numbers below 2^53, so they are exact in between
    return parts.groupBy("rep", *keys).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in zip(COUNTS, kinds, strict=True)])


def hybrid_sums(group_ev: DataFrame, permutations: int, seed: int, detector_b, keys: list[str], group: str = "patient_group") -> DataFrame:
    """Evidence of hybrid a and b in every permutation: a swapped group trades detectors; ``keys`` omit the detector.

    The rows of a group meet in one task, which draws the group's bits once for all its runs;
    no bit is exchanged. A task gives one matrix per run and side.
    """
    n = int(group_ev.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [group_ev.schema[c].dataType for c in COUNTS]
    key_types = [to_arrow_type(group_ev.schema[k].dataType) for k in keys]
    is_b = F.coalesce(F.col("d") == F.lit(detector_b), F.lit(False)).alias("_b")
    rows = group_ev.select(*keys, F.col(group).cast("string").alias("_text"), is_b, *COUNTS).repartition(n, "_text").sortWithinPartitions("_text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, fixed, traded = _bits(permutations, seed), {}, {}
        for batch in batches:
            evidence = np.array([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in COUNTS])
            second = batch.column("_b").to_numpy(zero_copy_only=False)
            runs = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) or [()] * batch.num_rows
            own = {run: np.array([r == run for r in runs]) for run in set(runs)}
            coded = batch.column("_text").dictionary_encode(null_encoding="encode")
            names, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for run, mask in own.items():
                for b in (False, True):
                    fixed[run, b] = fixed.get((run, b), 0) + evidence[:, mask & (second == b)].sum(1)
            for lo in range(0, len(names), SLICE):
                swap = bits(names[lo : lo + SLICE]).astype(np.float64)
                for run, mask in own.items():
                    rows_in = mask & (place >= lo) & (place < lo + SLICE)
                    gain = np.zeros((len(COUNTS), len(swap)))  # what hybrid a wins where the group is swapped
                    np.add.at(gain.T, place[rows_in] - lo, (evidence[:, rows_in] * np.where(second[rows_in], 1, -1)).T)
                    traded[run] = traded.get(run, 0) + gain @ swap
        for run, gain in traded.items():
            for role, b, total in (("a", False, gain), ("b", True, -gain)):
                columns = [pa.array(x + start) for x, start in zip(total, fixed[run, b], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([v] * permutations, type=t) for t, v in zip(key_types, run, strict=True)], pa.array([role] * permutations),
                     pa.array(range(permutations), pa.int32()), *columns], names=[*keys, "role", "rep", *COUNTS])

    schema = "".join(f"{k} {group_ev.schema[k].dataType.simpleString()}, " for k in keys)
    parts = rows.mapInArrow(add, f"{schema}role string, rep int, " + ", ".join(f"{c} double" for c in COUNTS))
    # counts are whole numbers below 2^53, so they are exact in between
    return parts.groupBy("rep", "role", *keys).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in zip(COUNTS, kinds, strict=True)])


def count_metrics(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics that follow from summed evidence alone: all but the two average precisions."""
    return sums.select(
        *keys, *[c.alias(n) for n, c in operating_ratios(F.col("tp"), F.col("fp"), F.col("fn")).items()],
        mean_or_null(F.col("iou_sum"), F.col("tp")).alias("iou"), mean_or_null(F.col("dice_sum"), F.col("tp")).alias("dice"))


def group_evidence(image_evidence: DataFrame, groups: DataFrame, keys: list[str], group: str = "patient_group") -> DataFrame:
    """Sum of image evidence over the images of each group."""
    return image_evidence.join(groups, "image_id").groupBy(*keys, group).agg(*[F.sum(c).alias(c) for c in COUNTS])


def matched_group_evidence(predictions: DataFrame, targets: DataFrame, runs: DataFrame, groups: DataFrame, run: tuple = RUN,
                           group: str = "patient_group", score_threshold: float = 0.05, iou_threshold: float = 0.5, max_detections: int = 100) -> DataFrame:
    """``group_evidence`` of the predictions' image evidence, without a row per prediction or target on the way.

    An image's groups travel beside its targets, so what is exchanged is summed per run and group.
    """
    zero, none, sums = F.lit(0).cast("bigint"), F.lit(0.0), ("preds", "targets", "tp", "iou_sum", "dice_sum")
    beside = groups.groupBy("image_id").agg(F.collect_list(F.struct(group)).alias("_groups"))
    found = image_sums(score_filter(predictions, score_threshold), targets, run, max_detections, iou_threshold, beside)
    found = found.select(*run, F.inline("_groups"), "preds", zero.alias("targets"), "tp", "iou_sum", "dice_sum")
    owned = targets.select("image_id").join(groups, "image_id").groupBy(group).agg(F.count("*").alias("targets"))
    every = for_each_run(owned, runs, run).select(*run, group, zero.alias("preds"), "targets", zero.alias("tp"), none.alias("iou_sum"), none.alias("dice_sum"))
    rows = found.unionByName(every).groupBy(*run, group).agg(*[F.sum(c).alias(c) for c in sums])
    return rows.select(*run, group, F.col("targets").alias("target_count"), "tp", (F.col("preds") - F.col("tp")).alias("fp"),
                       (F.col("targets") - F.col("tp")).alias("fn"), "iou_sum", "dice_sum")


def seed_average(metrics: DataFrame, seed_weights: DataFrame, keys: list[str]) -> DataFrame:
    """Seed-weighted mean per (rep, keys) of the metrics given, long form; one undefined seed makes it NULL."""
    given = [m for m in METRIC_VECTOR if m in metrics.columns]
    long = unpivot(metrics, ["rep", *keys, "s"], given).join(seed_weights, ["rep", "s"])
    return long.groupBy("rep", *keys, "metric").agg(
        F.when(F.count_if(F.col("value").isNull()) == 0, F.sum(F.col("sw") * F.col("value")) / F.sum("sw")).alias("value")
    )


def with_retention(long: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Raw values plus value / clean reference of the same replicate."""
    ref = reference.withColumnRenamed("value", "ref")
    kept = long.join(ref, ["rep", *[k for k in keys if k in ref.columns], "metric"])
    ratio = kept.withColumn("value", F.try_divide("value", "ref")).drop("ref").withColumn("estimand", F.lit("retention"))
    return long.withColumn("estimand", F.lit("raw")).unionByName(ratio)


def percentile_ci(values: DataFrame, keys: list[str], value: str = "value", confidence: float = 0.95) -> DataFrame:
    """Linear quantiles of the finite values and how many there are."""
    tail = (1 - confidence) / 2
    v = finite_or_null(F.col(value))
    return values.groupBy(*keys).agg(
        F.percentile(v, F.lit(tail)).alias("ci_low"), F.percentile(v, F.lit(1 - tail)).alias("ci_high"), F.count(v).alias("valid")
    )


def p_value(null_diff: Column, observed: Column) -> Column:
    """Two-sided add-one p-value as an aggregate over the null differences."""
    exceed = F.count_if(F.abs(null_diff) >= F.abs(observed) - 1e-15)
    valid = F.count(null_diff)
    return F.when(valid > 0, (exceed + 1).cast("double") / (valid + 1))


def holm_adjust(rows: DataFrame, family: list[str], p: str = "p_raw", tie: list[str] | None = None) -> DataFrame:
    """Step-down adjusted p-values inside each family.

    A family is one column of a result table (a few conditions or metrics), so
    its window stays small; NULL p-values keep NULL and do not count.
    """
    order = Window.partitionBy(*family, F.col(p).isNull()).orderBy(F.col(p), *(tie or []))
    size = F.count(p).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (size - F.row_number().over(order) + 1) * F.col(p))
    staged = rows.withColumns({"holm_family_size": size, "_step": F.when(F.col(p).isNotNull(), step)})
    running = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return staged.withColumn("p_holm", F.when(F.col(p).isNotNull(), running)).drop("_step")


def holm_by_family(rows: DataFrame, condition: str = "condition", clean: str = "clean") -> DataFrame:
    """Correct each (metric, estimand) family over the non-clean complete rows."""
    member = (F.col(condition) != clean) & (F.col("status") == "complete")
    marked = rows.withColumn("_p", F.when(member, F.col("p_raw")))
    return holm_adjust(marked, ["metric", "estimand"], "_p", [condition]).withColumn(
        "p_holm", F.when(F.col(condition) == clean, F.col("p_raw")).otherwise(F.col("p_holm"))
    ).withColumn("holm_family_size", F.when(F.col(condition) == clean, F.lit(1).cast("bigint")).otherwise(F.col("holm_family_size"))).drop("_p")


def holm_clean_family(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Correct the seven clean endpoints; a family that is not whole fails.

    Failing families keep NULL and say why in ``family_status``.
    """
    w = Window.partitionBy(*keys)
    usable = (F.col("status") == "complete") & finite_or_null(F.col("p_raw")).isNotNull() & F.col("metric").isin(*METRIC_VECTOR)
    n = len(METRIC_VECTOR)
    whole = (F.count("*").over(w) == n) & (F.size(F.collect_set("metric").over(w)) == n) & (F.count_if(usable).over(w) == n)
    marked = rows.withColumn("family_status", F.when(whole, "corrected").otherwise("not_seven_estimable_endpoints"))
    checked = marked.withColumn("_p", F.when(F.col("family_status") == "corrected", F.col("p_raw")))
    return holm_adjust(checked, keys, "_p", ["metric"]).drop("_p")


def seed_eligibility(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Per (d, s): declared and observed undefined runs, and whether the seed pair is complete."""
    tp0 = F.col("tp") == 0
    pair_complete = F.count_if(tp0).over(Window.partitionBy("s")) == 0
    both = counts.withColumns({"undefined": tp0, "pair_complete": pair_complete}).join(
        expected.select("d", "s", F.col("prediction_count").alias("declared_predictions"), F.lit(True).alias("declared")), ["d", "s"], "left"
    )
    agrees = F.when(
        F.col("declared").isNotNull(), F.col("undefined") & (F.col("prediction_count") == F.col("declared_predictions"))
    ).otherwise(~F.col("undefined"))
    return both.select("d", "s", "tp", "prediction_count", "undefined", "pair_complete", agrees.alias("matches_declaration"))


def merge_endpoint_rows(all_rows: DataFrame, complete_rows: DataFrame, eligibility: DataFrame) -> DataFrame:
    """IoU and Dice from the complete-pair analysis, the others from all attempts."""
    conditional = F.col("metric").isin("iou", "dice")
    ids = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("s")))).cast("array<string>"), ";")
    # one row of seed lists
    lists = eligibility.agg(ids(F.lit(True)).alias("all_ids"), ids(F.col("pair_complete")).alias("ok_ids"), ids(~F.col("pair_complete")).alias("bad_ids"))
    merged = all_rows.filter(~conditional).unionByName(complete_rows.filter(conditional)).crossJoin(F.broadcast(lists))
    return merged.withColumns({
        "paired_seed_ids": F.when(conditional, F.col("ok_ids")).otherwise(F.col("all_ids")),
        "excluded_pair_seed_ids": F.when(conditional, F.col("bad_ids")).otherwise(F.lit("")),
        "seed_eligibility_policy": F.when(conditional, "paired_complete_case_conditional_metric").otherwise("all_predeclared_attempts"),
    }).drop("all_ids", "ok_ids", "bad_ids")


def decorate_rows(rows: DataFrame, scope: str, counts: DataFrame, **constants) -> DataFrame:
    """Attach scope, sample counts (a one-row frame) and analysis constants."""
    return rows.crossJoin(F.broadcast(counts)).withColumns(
        {"scope": F.lit(scope), "p_holm": F.col("p_raw"), "holm_family_size": F.lit(1).cast("bigint"), **{k: F.lit(v) for k, v in constants.items()}}
    )
