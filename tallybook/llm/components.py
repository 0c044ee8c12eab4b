"""Connected components of a link table, by alternating stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.session import cut


def _least_neighbour(both: DataFrame) -> DataFrame:
    """u -> the least of u and its neighbours; combined before the shuffle, so hubs cost one row a task."""
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both)
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every link points from the larger node to the smaller one here."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u")
    return (moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(moved.select("u", F.col("m").alias("v"))).where("u != v").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; the root is the component's least node.

    `links` has columns u and v of any orderable type; nulls and loops are ignored, repeated links do no
    harm. Each round is written to the shared folder, and rounds stop when the links no longer change,
    after about log2 of the longest chain rounds.
    """
    links = cut(links.where("u is not null and v is not null and u != v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = seen
        links = cut(_small_star(_large_star(links)))
