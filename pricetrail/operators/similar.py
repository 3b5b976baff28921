"""One product across shops whose names differ: a similarity join on name words, as groups instead of pairs.

Two names with a Jaccard likeness of t or more share one of the rarest n - ceil(t n) + 1 words of either, so only
products that share such a word are compared, all words of theirs. Equal word sets are one from the start. Products
under one word are compared block against block inside tasks, and what leaves a task is a spanning forest of the links
found: its size follows the number of products, not of pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.operators.linked import _kept, groups

LIKENESS = 0.8
#: Products of one word that meet in a task, on either side.
BLOCK = 512
WORDS = "filter(split(lower({}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"


def name_words(name: str = "name") -> str:
    """Distinct words of a name, in any case, sorted."""
    return f"array_sort(array_distinct({WORDS.format(name)}))"


def _dense(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word sets as rows of one 0/1 matrix each."""
    words, place = np.unique(np.concatenate(left + right), return_inverse=True)
    out = []
    start = 0
    for side in (left, right):
        grid = np.zeros((len(side), len(words)), np.float32)
        sizes = [len(s) for s in side]
        grid[np.repeat(np.arange(len(side)), sizes), place[start : start + sum(sizes)]] = 1
        start += sum(sizes)
        out.append(grid)
    return out[0], out[1]


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep the same products together: each with the first of its part."""
    names = np.r_[left, right]
    part = np.arange(len(names))
    i, j = np.nonzero(linked)
    j = j + len(left)
    while True:
        low = np.minimum(part[i], part[j])
        after = part.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        if (after == part).all():
            break
        part = after
    moved = np.flatnonzero(part != np.arange(len(names)))
    return names[moved], names[part[moved]]


def _compare(likeness: float):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        sets = [[np.asarray(s) for s in side.column("words").to_pylist()] for side in (left, right)]
        a, b = _dense(*sets)
        both = a @ b.T
        sizes = a.sum(axis=1)[:, None] + b.sum(axis=1)
        linked = both >= likeness * (sizes - both) - 1e-6
        x, y = _forest(linked, left.column("kind").to_numpy(), right.column("kind").to_numpy())
        differ = x != y
        return pa.table([pa.array(x[differ], pa.int64()), pa.array(y[differ], pa.int64())], schema=schema)

    return run


def similar_products(products: DataFrame, likeness: float = LIKENESS, key: str = "id", name: str = "name") -> DataFrame:
    """(id, group_id, group_size): products whose names are alike, by chains, named by the least id.

    Names are alike if their word sets have a Jaccard likeness of ``likeness`` or more. Products without a word in
    their name are alike with none. Repeated rows count once; null ids take no part.
    """
    named = products.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.expr(name_words(name)).alias("words")).distinct()
    named = _kept(named.withColumn("words", F.coalesce("words", F.array().cast("array<string>"))), "names")
    kinds = named.where("size(words) > 0").groupBy("words").agg(F.min("id").alias("kind"))
    kinds = _kept(kinds, "name-kinds")
    # Rarest first; ties by the word, so that the order is one for all.
    single = kinds.select("kind", F.explode("words").alias("word"))
    counts = _kept(single.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.monotonically_increasing_id()), "name-words")
    ranked = single.join(counts, "word").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("r"))
    prefix = f"slice(words, 1, cast(size(words) - ceil({likeness} * size(words) - 1e-9) + 1 AS int))"
    placed = _kept(ranked.select("kind", F.expr("transform(r, x -> x.w)").alias("words")).withColumn("w", F.explode(F.expr(prefix))), "name-prefixes")
    sizes = placed.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    sized = placed.join(sizes, "w").withColumn("block", F.pmod(F.hash("kind"), "blocks"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = sized.withColumn("other", others).where("block <= other").select("w", F.col("block").alias("x"), F.col("other").alias("y"), "kind", "words")
    right = sized.withColumn("other", others).where("other <= block").select("w", F.col("other").alias("x"), F.col("block").alias("y"), "kind", "words")
    right = right.toDF("w", "x", "y", "kind", "words")
    at = ["w", "x", "y"]
    links = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_compare(likeness), "a long, b long")
    found = groups(links).withColumnRenamed("id", "kind")
    classes = kinds.join(found, "kind", "left").select("words", F.coalesce("group_id", "kind").alias("group_id"))
    members = named.join(classes, "words", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
    members = _kept(members, "name-groups")
    # An id with two names keeps the least group.
    members = members.groupBy("id").agg(F.min("group_id").alias("group_id"))
    return members.join(members.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")), "group_id").select("id", "group_id", "group_size")
