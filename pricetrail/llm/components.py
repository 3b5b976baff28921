"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, component): the least node reachable from each node that has an edge.

    Both steps hook nodes onto the least neighbour, so stars flatten and chains halve; a node with very many
    neighbours is a grouped minimum with partial sums and the larger side of a join, never one list. Each round is
    written to the shared folder. Loops, repeated and reversed pairs change nothing; no edges give no rows.
    """
    links = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large, "large-star")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        links = stored(small.filter("a <> b").distinct(), "small-star")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
