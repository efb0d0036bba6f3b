"""Global order without a global task: range blocks plus offset tables.

A running total over a whole run would put the run into one task. Here rows are
range-partitioned on their full (nearly unique) order key, so that equal scores
and large runs still spread evenly; the block number is written with the rows;
totals per block, at most one row per (run, block), give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.session import materialize

# Rows of a block, where the number of blocks follows from a count.
BLOCK_ROWS = 500_000

Order = list[tuple[str, bool]]


def columns(order: Order, reverse: bool = False) -> list[Column]:
    """Sort columns of (name, ascending) pairs."""
    return [F.asc(c) if up != reverse else F.desc(c) for c, up in order]


def range_blocks(df: DataFrame, order: Order, name: str = "blocks", num_blocks: int | None = None) -> DataFrame:
    """Rows with a ``block`` column: blocks are contiguous and ascending in ``order``."""
    n = num_blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *columns(order)).withColumn("block", F.spark_partition_id())
    return materialize(ranged, name)


def block_count(df: DataFrame) -> int:
    """At least one block per shuffle partition, more where blocks would grow with the (written) table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BLOCK_ROWS))


def block_offsets(blocks: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Totals of all earlier blocks of the same run, per (keys, block)."""
    totals = blocks.groupBy(*keys, "block").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, "block",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )


def running_totals(blocks: DataFrame, keys: list[str], order: Order, sums: dict[str, Column],
                   per_key: DataFrame | None = None) -> DataFrame:
    """Inclusive running sums in global order, added as columns named by ``sums``.

    ``per_key`` (one row per keys) rides on the offset table, so the rows
    themselves are never shuffled on the few run keys.
    """
    offsets = block_offsets(blocks, keys, sums)
    if per_key is not None:
        offsets = offsets.join(per_key, keys) if keys else offsets.crossJoin(per_key)
    inside = Window.partitionBy(*keys, "block").orderBy(*columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.select("*", *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in sums.items()])
    joined = local.join(offsets, [*keys, "block"])
    helper = [f"_{p}_{n}" for p in "lo" for n in sums]
    return joined.withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in sums}).drop(*helper)


def running_maximum(blocks: DataFrame, keys: list[str], order: Order, values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Largest non-null value up to each row (or before it) in global order, as columns named by ``values``."""
    totals = blocks.groupBy(*keys, "block").agg(*[F.max(c).alias(f"_t_{n}") for n, c in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "block", *[F.max(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in values])
    inside = Window.partitionBy(*keys, "block").orderBy(*columns(order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = blocks.select("*", *[F.max(c).over(inside).alias(f"_l_{n}") for n, c in values.items()])
    joined = local.join(before, [*keys, "block"])
    return joined.withColumns({n: F.greatest(f"_l_{n}", f"_o_{n}") for n in values}).drop(*[f"_{p}_{n}" for p in "lo" for n in values])


def suffix_maximum(blocks: DataFrame, keys: list[str], order: Order, value: str, out: str) -> DataFrame:
    """Largest ``value`` at or after each row in global order."""
    totals = blocks.groupBy(*keys, "block").agg(F.max(value).alias("_m"))
    # reversed order with a growing frame: a shrinking frame would be quadratic
    after = Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = totals.select(*keys, "block", F.max("_m").over(after).alias("_later"))
    inside = Window.partitionBy(*keys, "block").orderBy(*columns(order, reverse=True)).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumn("_here", F.max(value).over(inside))
    return local.join(later, [*keys, "block"]).withColumn(out, F.greatest("_here", "_later")).drop("_here", "_later")


def dense_ids(df: DataFrame, order: list[str], out: str = "id", start: int = 1, num_blocks: int | None = None) -> DataFrame:
    """Consecutive ids in global order; ``order`` must be a unique key."""
    cols = [F.col(c) for c in order]
    blocks = range_blocks(df, [(c, True) for c in order], "dense-ids", num_blocks)
    counts = blocks.groupBy("block").count()
    # one row per block: bounded by the number of partitions
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy("block").orderBy(*cols))
    return (
        blocks.withColumn("_l", local)
        .join(F.broadcast(offsets), "block")
        .withColumn(out, (F.col("_l") + F.col("_o") + F.lit(start - 1)).cast("bigint"))
        .drop("_l", "_o", "block")
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles of groups of any size.

    Equal values merge first; running counts over range blocks then locate the
    two neighbouring positions, so no group is held in one buffer.
    """
    merged = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    spec = [(value, True)]
    blocks = range_blocks(merged, [*[(k, True) for k in keys], *spec], "percentiles")
    total = blocks.groupBy(*keys).agg(F.sum("n").alias("total"))
    run = running_totals(blocks, keys, spec, {"upto": F.col("n")}, total)
    aggs = []
    for name, q in quantiles.items():
        position = (F.col("total") - 1) * F.lit(q)
        at = lambda p: F.max(F.when((F.col("upto") - F.col("n") <= p) & (p < F.col("upto")), F.col(value)))
        low, high = at(F.floor(position)), at(F.ceil(position))
        aggs.append((low + (high - low) * (F.max(position) - F.floor(F.max(position)))).alias(name))
    return run.groupBy(*keys).agg(*aggs)
