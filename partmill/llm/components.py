"""Connected components of an edge table, with no vertex state outside tables.

Alternating stars: every vertex sends its larger neighbours, then its smaller ones, to its smallest
neighbour, until each component is a star around its smallest vertex. The number of rounds grows
with the logarithm of the component's width; every round is aggregations with map-side combining
and joins, and its result is written, so nothing depends on executors that are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import materialize


def _towards_smallest(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of every vertex, and itself, to its smallest one."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("n"))
    if larger:
        both = both.unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("n")))
    least = both.groupBy("v").agg(F.min("n").alias("m")).withColumn("m", F.least("v", "m"))
    if larger:
        out = both.where("n > v").join(least, "v").select(F.col("n").alias("a"), F.col("m").alias("b"))
    else:  # a > b, so every neighbour listed under v is smaller
        out = both.join(least, "v").select(F.col("n").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether every vertex has one smaller neighbour, or only larger ones: nothing is left to do."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the smallest node of its component."""
    stars = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _is_star(stars):
        stars = materialize(_towards_smallest(_towards_smallest(stars, True), False), "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
