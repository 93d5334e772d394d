"""Connected components of a distributed set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.sources.scratch import materialized


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(near: DataFrame, larger: bool) -> DataFrame:
    """Tie the larger (or the other) neighbours of each node to its smallest one."""
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    tied = near.join(least, "u")
    if larger:
        tied = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), "m")
    else:
        tied = tied.select(F.col("v").alias("a"), "m").union(
            least.select(F.col("u").alias("a"), "m"))
    return tied.where(F.col("a") != F.col("m")).distinct().select(
        F.col("a").alias("u"), F.col("m").alias("v"))


def _settled(links: DataFrame) -> bool:
    """Whether each larger end has one link, and its smaller end none to a still smaller one."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(
        links.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    ups = F.sum("up")
    return ends.groupBy("node").agg(ups.alias("ups"), F.min("up").alias("least")).where(
        (F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("least") == 0)).isEmpty()


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node and root (the smallest node of its component) of every linked node but the roots.

    ``links`` has columns u and v. Each round ties neighbours to the smallest
    node in reach, first the larger ones and then all smaller ones, until every
    node is tied to its root; links that already are so take no round. Nodes
    with many links are added up before they are shuffled, and no component is
    gathered in one place.
    """
    down = links.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = materialized(down.distinct(), "links")
    for _ in range(most_rounds):
        if _settled(links):
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = _star(_both_ways(links), larger=True)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        links = materialized(_star(down, larger=False), "links")
    raise RuntimeError("components did not settle")
