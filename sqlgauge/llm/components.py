"""Connected components of a link table by alternating star operations.

Every round is written to the shared folder, so no lineage grows and nothing is collected; only counts reach
the driver. Links point from a node to a smaller one. A large step links the greater neighbours of each node to
the smallest node of its neighbourhood, a small step links the smaller ones to it. When nothing changes each
component is a star around its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm.common import materialize


def _downwards(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _step(links: DataFrame, large: bool) -> DataFrame:
    sides = links.select("a", "b")
    if large:
        sides = sides.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # the smallest neighbour of each node is written first: the join then has two plain sides, of which a hot
    # node's can be split
    least = materialize(sides.groupBy("a").agg(F.min("b").alias("m")), "star-least")
    least = least.select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    met = sides.join(least, F.col("a") == F.col("n"))
    if large:
        new = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return materialize(_downwards(new), "star-links")


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (the smallest node that links reach) for each node that has a link to another."""
    now = materialize(_downwards(links.select(F.col(a).alias("a"), F.col(b).alias("b"))), "star-links")
    mark = _mark(now)
    while mark[0]:
        now = _step(_step(now, True), False)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select("b", "b").distinct())
