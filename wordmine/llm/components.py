"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    ``edges`` has columns a and b. Alternating large-star and small-star rounds
    until the edges stay the same: nothing is collected but two numbers a round,
    and a node with very many neighbours is a minimum (pre-aggregated) and a
    join whose partitions can be split. Each round is written to the shared
    folder, which cuts the lineage.
    """
    edges = (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
             .filter("a > b").distinct())
    edges = materialise(edges, "edges")
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(large.filter("a > b").distinct(), "large-star")
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = (edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))))
        edges = materialise(small.filter("a > b").distinct(), "small-star")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
