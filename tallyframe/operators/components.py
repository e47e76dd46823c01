"""Connected components of a table of links, by hooking to smallest neighbours; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.tables import written


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): root is the smallest node that can be reached; nodes without a link are not listed.

    Each round joins every node to the smallest of its neighbours (a large star, then a small star), which halves
    long chains, so rounds grow with the logarithm of the longest; they end when nothing changes. Aggregation keeps one
    row for each node, so a node of many links is combined before its shuffle; in the joins with that row its
    links are one key, whose partition Spark splits where it is large (skew joins of adaptive execution). The links of each round are written to
    the shared folder. Links of a node with itself and repeated links do no harm; no links give no rows.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before: tuple | None = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that its size is known: under Spark's bound for broadcasts it goes to the links, hot nodes or not.
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.filter("m < a").select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges = written(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = tuple(state)
