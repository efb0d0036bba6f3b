"""Quotas, seeded samples and group-safe splits.

Ranks inside strata are computed over range blocks, so a stratum holding most
images is still spread over tasks. Only strata totals and the group-size
histogram, both small by nature, reach the driver.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlens.functions.hashing import order_key, sha_hex
from boxlens.operators.audit import union_all
from boxlens.operators.blocks import range_blocks, running_totals
from boxlens.session import materialize, small


def largest_remainder(counts: DataFrame, size: int, name: str = "stratum", count: str = "n") -> DataFrame:
    """Allocate ``size`` over a small table of counts; ties go to the first name."""
    everyone = Window.partitionBy()
    quota = F.lit(size).cast("double") * F.col(count) / F.sum(count).over(everyone)
    staged = counts.withColumn("quota", quota).withColumn("base", F.floor("quota"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("quota") - F.col("base")), F.asc(name)))
    left = F.lit(size) - F.sum("base").over(everyone)
    return staged.withColumn("rank", rank).withColumn("allocated", F.col("base") + F.when(F.col("rank") <= left, 1).otherwise(0)).select(name, count, "allocated")


def exact_counts(spark: SparkSession, total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Ratios to integer counts by largest remainder; ties go by list position."""
    listed = spark.createDataFrame(list(enumerate(ratios.values())), "position int, share double")
    rows = largest_remainder(listed, total, "position", "share").collect()  # one row per split
    return {name: next(r["allocated"] for r in rows if r["position"] == i) for i, name in enumerate(ratios)}


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str = "position") -> DataFrame:
    """Row number inside keys, over range blocks."""
    spec = [(c, True) for c in order]
    blocks = range_blocks(df, [*[(k, True) for k in keys], *spec], "ranks")
    return running_totals(blocks, keys, spec, {out: F.lit(1).cast("bigint")}).drop("block")


def stratified_sample(images: DataFrame, size: int, seed: int, stratum: str = "stratum", key: str = "image_id") -> DataFrame:
    """Seeded draw without replacement, quota per stratum by largest remainder."""
    quotas = largest_remainder(images.groupBy(stratum).agg(F.count("*").alias("n")), size, stratum)
    drawn = ranked(images.withColumn("draw", order_key(seed, F.lit("sample"), F.col(key))), [stratum], ["draw", key])
    return drawn.join(small(quotas.select(stratum, "allocated")), stratum).filter(F.col("position") <= F.col("allocated")).drop("draw", "allocated", "position")


def sample_audit(images: DataFrame, sample: DataFrame) -> DataFrame:
    """Full against sampled counts per stratum."""
    count = lambda df, p: df.groupBy("stratum").agg(F.count("*").alias(f"{p}_images"), F.count_if("is_positive").alias(f"{p}_positives"),
                                                     F.sum("box_count").alias(f"{p}_boxes"), F.count_distinct("patient_group").alias(f"{p}_patients"))
    return count(images, "full").join(count(sample, "sample"), "stratum", "left").fillna(0)


def round_robin_sample(images: DataFrame, size: int, seed: int, stratum: str = "stratum", key: str = "image_id") -> DataFrame:
    """Strata take turns in name order; inside a stratum by seeded digest.

    No stratum can give more than ``size`` rows, so a group limit prunes first.
    """
    draw = sha_hex(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy("draw", key))
    first = images.withColumn("draw", draw).withColumn("turn", turn).filter(F.col("turn") <= size)
    return first.orderBy("turn", stratum).limit(size).drop("draw")


def balanced_smoke_sample(images: DataFrame, size: int, key: str = "file_name") -> DataFrame:
    """Up to half positives, then negatives, by file name."""
    w = Window.partitionBy("is_positive").orderBy(key)
    rows = images.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= size)
    have = rows.agg(F.least(F.lit(size // 2), F.count_if("is_positive")).alias("take"))
    return rows.crossJoin(F.broadcast(have)).filter(
        F.when(F.col("is_positive"), F.col("turn") <= F.col("take")).otherwise(F.col("turn") <= F.lit(size) - F.col("take"))
    ).drop("turn", "take")


def stable_hash_order(groups: DataFrame, seed: int, stage: str, key: str = "patient_group") -> DataFrame:
    return groups.withColumn("order_key", order_key(seed, F.lit(stage), F.col(key)))


def patient_groups(images: DataFrame, strata: list[str], group: str = "patient_group", stratum: str = "stratum") -> DataFrame:
    """Size, stratum counts and dominant stratum (ties: configured order) per group."""
    counts = images.groupBy(group, stratum).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(s) for s in strata]), F.col(stratum))
    position = F.when(place == 0, len(strata) + 1).otherwise(place)  # a stratum that is not listed comes last
    entry = F.struct(F.col(stratum), F.col("n"))
    return counts.groupBy(group).agg(
        F.sum("n").alias("size"), F.max_by(stratum, F.struct(F.col("n"), -position)).alias("dominant"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("stratum_counts"),
    )


def _reachable(size: list[int], count: list[int], goal: int) -> tuple[int, list[int]]:
    """Largest sum up to ``goal`` of at most count[i] pieces of size[i], and the sums (as bits) reachable before each size."""
    below = (1 << (goal + 1)) - 1
    seen, before = 1, []
    for z, n in zip(size, count, strict=True):
        before.append(seen)
        step = 1
        while n > 0:  # binary splitting: any number of pieces up to n
            k = min(step, n)
            seen |= (seen << (k * z)) & below
            n, step = n - k, 2 * step
    return seen.bit_length() - 1, before


def choose_counts(histogram: dict[tuple[str, int], int], target: int) -> tuple[dict[tuple[str, int], int], int]:
    """Numbers of groups per (stratum, size) that hold ``target`` images, and how many images are missing to it.

    Starts from each cell's share, rounded down, and changes it as little as an exact sum
    asks for. Changes are bounded: a solution at least distance from the start needs no
    more than rest + 2 * largest size + 1 of them, or a part of them would cancel out. So
    the search is exact, and its width depends on the sizes and not on the number of groups.
    """
    total = sum(size * n for (_, size), n in histogram.items())
    take = {cell: n * min(target, total) // total for cell, n in histogram.items()}
    unit = math.gcd(*(size for _, size in histogram))
    sizes = sorted({size for _, size in histogram}, reverse=True)
    held = sum(size * n for (_, size), n in take.items())
    rest = (min(target, total) - held) // unit
    most = rest + 2 * sizes[0] // unit + 1
    back = [min(most, sum(take[c] for c in take if c[1] == z)) for z in sizes]
    free = [min(most, sum(histogram[c] - take[c] for c in take if c[1] == z)) for z in sizes]
    small = [z // unit for z in sizes]
    # all that may go back is put back first; then the sum is made from pieces alone
    goal = rest + sum(z * n for z, n in zip(small, back, strict=True))
    reached, before = _reachable(small, [a + b for a, b in zip(back, free, strict=True)], goal)
    left = reached
    for i in reversed(range(len(sizes))):
        options = (k for k in range(back[i] + free[i] + 1) if left >= k * small[i] and before[i] >> (left - k * small[i]) & 1)
        k = min(options, key=lambda k: abs(k - back[i]))
        left -= k * small[i]
        # the stratum furthest below (above) its share gives (gets back) a group first
        cells = [c for c in take if c[1] == sizes[i]]
        lack = lambda c: histogram[c] * target / total - take[c]
        for _ in range(abs(k - back[i])):
            if k > back[i]:
                take[max((c for c in cells if take[c] < histogram[c]), key=lambda c: (lack(c), c))] += 1
            else:
                take[min((c for c in cells if take[c] > 0), key=lambda c: (lack(c), c))] -= 1
    return take, target - sum(size * n for (_, size), n in take.items())


def select_groups(groups: DataFrame, target: int, seed: int, stage: str, exact: bool, group: str = "patient_group") -> DataFrame:
    """Whole groups adding up to ``target`` images, or the most below it, with the overall stratum mix.

    Only the histogram of (dominant stratum, group size) reaches the driver; inside a cell
    groups are taken in hash order.
    """
    cells = {(r["dominant"], r["size"]): r["n"] for r in groups.groupBy("dominant", "size").agg(F.count("*").alias("n")).collect()}
    take, short = choose_counts(cells, target) if cells else ({}, target)
    if short and exact:
        raise ValueError(f"groups cannot satisfy the exact image count {target}: {short} short")
    wanted = groups.sparkSession.createDataFrame([(s, z, n) for (s, z), n in take.items()], "dominant string, size bigint, wanted bigint")
    spread = ranked(stable_hash_order(groups, seed, stage, group), ["dominant", "size"], ["order_key", group])
    return spread.join(small(wanted), ["dominant", "size"]).filter(F.col("position") <= F.col("wanted")).select(*groups.columns)


def group_subsample(images: DataFrame, strata: list[str], max_images: int, seed: int, group: str = "patient_group") -> DataFrame:
    """At most ``max_images`` images in whole groups."""
    if images.count() <= max_images:
        return images
    chosen = select_groups(patient_groups(images, strata, group), max_images, seed, "subsample", False, group)
    return images.join(chosen.select(group), group, "left_semi")


def group_split(images: DataFrame, strata: list[str], ratios: dict[str, float], seed: int, group: str = "patient_group") -> DataFrame:
    """Images with a ``split``: exact counts, whole groups; one split takes the remainder.

    Splits are filled one after the other in list order; if a later one finds no exact
    sum, other orders are tried before it fails.
    """
    targets = exact_counts(images.sparkSession, images.count(), ratios)
    groups = materialize(patient_groups(images, strata, group), "groups")
    for order in itertools.permutations(targets):
        try:
            return images.join(_split_in_order(groups, targets, order, seed, group), group)
        except ValueError as failure:
            problem = failure
    raise problem


def _split_in_order(groups: DataFrame, targets: dict[str, int], order: tuple[str, ...], seed: int, group: str) -> DataFrame:
    left, parts = groups, []
    for name in order[:-1]:
        chosen = materialize(select_groups(left, targets[name], seed, f"split:{name}", True, group), f"split-{name}")
        parts.append(chosen.select(group, F.lit(name).alias("split")))
        left = left.join(chosen.select(group), group, "left_anti")
    return union_all([*parts, left.select(group, F.lit(order[-1]).alias("split"))])


def split_summary(images: DataFrame) -> DataFrame:
    """Images, groups, positives, boxes per split."""
    return images.groupBy("split").agg(
        F.count("*").alias("images"), F.count_distinct("patient_group").alias("groups"), F.count_if("is_positive").alias("positives"),
        F.count_if(~F.col("is_positive")).alias("negatives"), F.sum("box_count").alias("boxes"))


def split_group_overlap(images: DataFrame) -> DataFrame:
    """Groups shared by each pair of splits; 0 everywhere means no leak."""
    members = images.select("split", "patient_group").distinct()
    names = members.select("split").distinct()
    other = members.select(F.col("split").alias("other"), "patient_group")
    shared = members.join(other, "patient_group").filter("split < other").groupBy("split", "other").agg(F.count("*").alias("shared"))
    pairs = names.join(names.withColumnRenamed("split", "other"), F.col("split") < F.col("other"))
    return pairs.join(shared, ["split", "other"], "left").fillna(0, ["shared"])


def study_distribution(images: DataFrame, strata: list[str]) -> DataFrame:
    """Split by stratum counts, listed strata only."""
    return images.groupBy("split").pivot("stratum", strata).agg(F.count(F.lit(1))).fillna(0)
