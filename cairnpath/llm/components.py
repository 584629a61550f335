"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnpath.llm.common import durable, forget, sorted_in, spread


def components(links: DataFrame, label: str = "stars") -> DataFrame:
    """Columns a and b of links (longs) -> node, root: root is the smallest node of node's component.

    Only nodes with a link to another node are returned. Each round hangs the neighbours of a node on the smallest of
    them; minima are partial aggregates and the joins that hand them back are plain equi-joins, which Spark splits where
    a node has very many links. Rounds grow with the logarithm of the longest chain; each is a durable table.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), label)
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = spread(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = both.join(sorted_in(least), "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = spread(large.groupBy("hi").agg(F.min("lo").alias("m")))
        moved = large.join(sorted_in(least), "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        old, edges = edges, durable(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct(), label)
        forget(old)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
