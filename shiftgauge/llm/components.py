"""Connected components of large link tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgauge.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component of every node of links (a, b); the component is the smallest node reachable.

    Links of a node with itself and nulls are left out, so a node without other links has no row; direction and
    repeats do not matter. In a round, each node hands its smallest neighbour on to its larger ones (large star)
    and to its smaller ones (small star); it ends when each node hangs on one that hangs on none.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("least"))
        pairs = F.inline(F.array(
            F.struct(F.col("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")),
        ))
        edges = stored(large.join(lowest, "a").select(pairs).filter("a <> b").distinct(), "links")
        # Done when no node has two parents or a parent that has one.
        parents = edges.groupBy("a").agg(F.count("*").alias("parents"))
        seen = parents.unionByName(edges.select(F.col("b").alias("a"), F.lit(0).cast("long").alias("parents")).distinct())
        state = seen.groupBy("a").agg(F.sum("parents").alias("parents"), F.count("*").alias("roles"))
        if not state.filter("parents > 1 or roles > 1").limit(1).count():
            roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
