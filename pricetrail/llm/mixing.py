"""Mixing sources to target weights: hash-threshold histograms.

Documents of a source are taken in the order of a hash of their id, up to a threshold per source. The threshold
comes from histograms only: words are summed by source and hash bucket, the bucket where the running sum meets the
budget is cut into finer buckets, and so on down to single hashes. Documents are then filtered by comparing their
hash; nothing is sorted. Budgets nest: a larger budget of a source takes all that a smaller one takes.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.llm.common import free, stored

#: A hash has 48 bits: four histogram levels of 12 bits.
HASH_BITS, LEVEL_BITS = 48, 12
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(column: str = "doc_id") -> Column:
    """The first 48 bits of the id's MD5; null ids share one hash."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size) -> (source, source_size, target, double).

    Sources by code point, null last, get the weights in turn. They share ``share[0] / share[1]`` of all sizes; a
    target stops at ``most`` times its source's size and the excess goes to the rest by weight. One row per source
    takes part, never one per document. In the order of size per weight the sources that stop are a prefix, so
    running sums settle it without rounds.
    """
    up, down = share
    numbered = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = numbered.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")).cast("long"))
    fullest = Window.orderBy(F.col("source_size") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    sums = weighted.select(
        "*",
        F.coalesce(F.sum("source_size").over(fullest), F.lit(0)).alias("_capped"),
        (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(fullest), F.lit(0))).alias("_open"),
        F.sum("source_size").over(whole).alias("_all"),
    )
    # The level is what a weight of one gets, in parts of down * open: it is exact in whole numbers.
    level = (F.col("_all") * up - F.col("_capped") * most * down).alias("_level")
    stops = F.col("source_size") * most * F.col("_open") * down <= F.col("_level") * F.col("_w")
    state = sums.select("*", level).withColumn("_stops", stops)
    free = F.min(F.when(~F.col("_stops"), F.struct(F.col("source_size") / F.col("_w"), F.col("_n"), F.col("_level"), F.col("_open")))).over(whole)
    out = state.withColumn("_free", free)
    target = F.when(F.col("_stops"), (F.col("source_size") * most).cast("double")).otherwise(
        (F.col("_free._level") * F.col("_w")).cast("double") / (F.col("_free._open") * down).cast("double")
    )
    return out.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, _hash, size), (source, budget) -> (source, threshold): rows with a hash below the threshold are taken.

    Each level sums sizes by source and bucket inside the bucket that the level above left open. The last level's
    buckets are single hashes; of the one where the budget is met, it is taken if that comes nearer to the budget.
    """
    open_ = budgets.select("source", "budget", F.lit(0).cast("long").alias("_bucket"), F.lit(0).cast("long").alias("_before"))
    for bits in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        here = (
            sized.withColumn("_up", F.shiftright("_hash", bits + LEVEL_BITS))
            .alias("d")
            .join(open_.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d._up") == F.col("o._bucket")))
            .groupBy("o.source", "o.budget", "o._before", F.shiftright("d._hash", bits).alias("_bucket"))
            .agg(F.sum("d.size").alias("_here"))
        )
        earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        run = here.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_here").over(earlier), F.lit(0)))
        bucket = F.struct("_bucket", "_before", "_here")
        met = run.groupBy("source", "budget").agg(
            F.min(F.when(F.col("_before") + F.col("_here") > F.col("budget"), bucket)).alias("_met"), F.max(bucket).alias("_last")
        )
        # Where a source ends below its budget, its last bucket stays open and is taken whole further down.
        found = met.select("source", "budget", F.coalesce("_met", "_last").alias("_b"), "_met", "_last")
        if bits:
            open_ = stored(found.select("source", "budget", "_b._bucket", "_b._before"), "mix-open")
    nearer = (F.col("budget") - F.col("_met._before")) * 2 > F.col("_met._here")
    threshold = F.when(F.col("_met").isNull(), F.col("_last._bucket") + 1).otherwise(
        F.col("_met._bucket") + F.when(nearer, 1).otherwise(0)
    )
    return found.select("source", threshold.alias("threshold"))


def plan(sized: DataFrame, weights: tuple[int, ...], share: tuple[int, int]) -> DataFrame:
    """(source, _hash, size) -> (_source, _source_size, _target, _whole, _threshold), stored, one row per source.

    A source whose target is above its size gives every document once (``_whole``) and those below the threshold of
    the rest a second time.
    """
    totals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share), "mix-targets")
    over = F.col("target") > F.col("source_size")
    budgets = totals.select("source", F.when(over, F.col("target") - F.col("source_size")).otherwise(F.col("target")).alias("budget"))
    limits = thresholds(sized, budgets).alias("l")
    both = totals.withColumn("whole", F.when(over, 1).otherwise(0)).alias("t").join(limits, F.col("t.source").eqNullSafe(F.col("l.source")))
    return stored(both.select("t.*", "l.threshold").toDF("_source", "_source_size", "_target", "_whole", "_threshold"), "mix-plan")


TIMES = "_whole + if(_hash < _threshold, 1, 0)"


def times_taken(docs: DataFrame, name: str, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2)) -> DataFrame:
    """``docs`` with how often the mix takes each row. Rows without words count like others."""
    sized = stored(docs.select("source", id_hash().alias("_hash"), words(F.col("text")).alias("size")), "mix-sized")
    by_source = plan(sized, weights, share).select("_source", "_whole", "_threshold")
    key, source, whole, threshold = free(docs.withColumn(name, F.lit(0)), "mix_hash", "mix_source", "mix_whole", "mix_threshold")
    rows = docs.withColumn(key, id_hash()).join(by_source.toDF(source, whole, threshold), F.col("source").eqNullSafe(F.col(source)))
    return rows.withColumn(name, F.col(whole) + F.when(F.col(key) < F.col(threshold), 1).otherwise(0)).select(*docs.columns, name)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2)) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per document.

    ``taken`` is 0, one or two times the size. Null text has size 0; null sources are one source, the last; rows with
    one id share a hash and are taken together; an empty table gives no rows; other columns are ignored.
    """
    sized = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size"), id_hash().alias("_hash")), "mix-sized")
    rows = sized.join(plan(sized.drop("doc_id"), weights, share), F.col("source").eqNullSafe(F.col("_source")))
    return rows.select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.expr(TIMES)).alias("taken")
    )
