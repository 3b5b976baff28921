"""Groups of things joined by chains of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.session import fresh_path


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def groups(links: DataFrame) -> DataFrame:
    """(a, b) links -> (id, group_id): the least id that chains of links reach, for every id that has one.

    Each round gives an id the least one among its neighbours' and its own, and then that one's own least: chains
    shrink to half or less. Both are grouped minima and joins, so an id with very many links is no list anywhere.
    Every round is written to the shared folder.
    """
    both = links.where("a <> b").select("a", "b")
    both = _kept(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = _kept(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("group_id")), "groups")
    while True:
        near = both.join(now.select(F.col("id").alias("b"), "group_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group_id").alias("m"))
        lower = now.join(near, "id").select("id", F.col("group_id").alias("was"), F.least("group_id", "m").alias("g"))
        lower = _kept(lower, "groups")
        # The group's own least name: pointers are followed one step.
        top = lower.select(F.col("id").alias("g"), F.col("g").alias("up"))
        after = _kept(lower.join(top, "g").select("id", "was", F.least("g", "up").alias("group_id")), "groups")
        if after.where("group_id <> was").isEmpty():
            return after.select("id", "group_id")
        now = after.select("id", "group_id")
