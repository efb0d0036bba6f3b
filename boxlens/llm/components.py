"""Connected components of a link table by alternating large and small stars.

Every round is a grouped minimum and a join on written tables. Only nodes with
a link take part, and nothing but two totals per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.session import materialize, release


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u > v). Large: every greater neighbour moves to the least one; small: every lesser one does."""
    if large:
        near = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the least node reachable.

    Self links are ignored; an empty table gives an empty result. Rounds grow with
    the logarithm of the longest path; the result is exact.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, name)
    before = None
    while True:
        old, links = links, materialize(_star(_star(links, True), False), name)
        release(old)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
