"""Connected components of links between members of many groups at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, cut: Callable[[DataFrame], DataFrame], group: str = "tenant") -> DataFrame:
    """group, node and component, the least node that it hangs together with, of ``links`` (group, a, b).

    Rounds of two steps: every node's larger neighbours are tied to its least
    neighbour, then its smaller ones and itself. A node's neighbours meet in
    minima alone. ``cut`` writes each round where every executor can read it.
    """
    nodes = links.select(group, F.explode(F.array("a", "b")).alias("node")).distinct()
    now = cut(links.filter("a <> b").select(group, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ways = now.unionByName(now.select(group, F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy(group, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        up = ways.filter("b > a").join(least, [group, "a"]).select(group, F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = up.groupBy(group, "a").agg(F.min("b").alias("m"))
        down = up.join(low, [group, "a"]).filter("b <> m").select(group, F.col("b").alias("a"), F.col("m").alias("b"))
        then = cut(down.unionByName(low.withColumnRenamed("m", "b")).distinct())
        if then.exceptAll(now).isEmpty() and now.exceptAll(then).isEmpty():
            break
        now = then
    stars = now.select(group, F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(stars, [group, "node"], "left").withColumn("component", F.coalesce("component", "node"))
