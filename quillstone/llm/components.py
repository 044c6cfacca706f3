"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node and component, its smallest reachable node, for each node of ``edges`` (a, b).

    Each round is written to the shared folder. No round gathers a node's
    neighbours: minima are partial aggregates that meet the edges in a join.
    """
    current = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        # large star: every larger neighbour of u is tied to u's smallest neighbour
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: u's smaller neighbours and u itself are tied to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = materialise(tied.unionByName(least.withColumnRenamed("m", "b")).filter("a <> b").distinct(), "edges")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
