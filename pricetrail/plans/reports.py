"""Monthly report kept by loads: first and last price, changes and sum of prices of each product and month.

``months`` is a bucketed table of the store. A load adds what it wrote; where it retracted rows, it counts the months of
those rows again, from the slices and buckets that they lie in. So a report reads one row per product and month, and
no price rows of older loads.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetrail.operators.history import order_key
from pricetrail.plans import store

MONTHS, MONTH = "months", "month"
_MONTH_FORMAT = "yyyy-MM"


def is_kept(done: store.Commit) -> bool:
    return MONTHS in done.buckets


def _by_month(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Partial report of written rows; rows without a time have a month of their own."""
    point = F.struct(order_key(order).alias("at"), "price")
    return rows.groupBy(*keys, store.slice_of(order[0], _MONTH_FORMAT).alias(MONTH)).agg(
        F.count(F.lit(1)).alias("n_changes"),
        F.sum(F.expr("cast(price * 100 AS bigint)")).alias("cents"),
        F.min(point).alias("first"),
        F.max(point).alias("last"),
    )


def _merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys, MONTH).agg(
        F.sum("n_changes").alias("n_changes"), F.sum("cents").alias("cents"), F.min("first").alias("first"), F.max("last").alias("last")
    )


def keep_months(load: store.Load, written: DataFrame, keys: list[str], order: list[str]) -> None:
    """Bring ``months`` up to the rows that this load wrote and retracted, in the buckets that they lie in.

    A store that has a history but no report yet counts its whole history, once.
    """
    added = _by_month(written, keys, order)
    if not is_kept(load.before):
        older = store.read_written(load.spark, load.root, load.before)
        if older is not None:
            gone = load.retracted()
            older = older if gone is None else older.join(gone.select(store.ROW), store.ROW, "left_anti")
            added = _merged(_by_month(older, keys, order).unionByName(added), keys)
        load.replace(MONTHS, added, keys, list(range(load.n)))
        return
    touched = sorted({*load.touched("written"), *load.touched("retracted")})
    if not touched:
        return
    before = load.current(MONTHS, touched)
    gone = load.retracted()
    if gone is not None and load.slices("retracted"):
        places = load.slices("retracted")
        # A slice is a month, or a part of one, and begins with its name.
        names = sorted({name[: len("yyyy-MM")] for name, _ in places})
        inside = F.substring(store.SLICE, 1, len("yyyy-MM")).isin(names) & F.col(store.BUCKET).isin(sorted({b for _, b in places}))
        rows = store.read_written(load.spark, load.root, load.before).where(inside)
        lost = gone.select(store.ROW, F.lit(True).alias("_lost"))
        rows = rows.join(lost, store.ROW, "left").withColumn(MONTH, store.slice_of(order[0], _MONTH_FORMAT))
        again = rows.where("_lost").select(*keys, MONTH).distinct()
        standing = rows.where("_lost IS NULL").join(again, [*keys, MONTH], "left_semi").drop(MONTH)
        before = before.join(again, [*keys, MONTH], "left_anti").unionByName(_by_month(standing, keys, order))
    load.replace(MONTHS, _merged(before.unionByName(added), keys), keys, touched)


def _kept_months(spark: SparkSession, root: str) -> DataFrame:
    found = store.read(spark, root, MONTHS)
    if found is None:
        raise ValueError(f"the store at {root} keeps no months: load with keep_months=True")
    return found


def monthly_change(spark: SparkSession, root: str, keys: list[str] | None = None) -> DataFrame:
    """First and last price per product and month, and the change against the month before, from what loads kept.

    Equal to ``analytics.monthly_change`` over the whole history. One row per product and month is read and sorted.
    """
    keys = keys or ["product_id"]
    months = _kept_months(spark, root)
    before = F.lag("last.price").over(Window.partitionBy(*keys).orderBy(MONTH))
    return months.select(
        *keys,
        F.try_to_timestamp(MONTH, F.lit(_MONTH_FORMAT)).alias(MONTH),
        F.col("first.price").alias("first_price"),
        F.col("last.price").alias("last_price"),
        before.alias("previous_price"),
        (F.col("last.price") - before).alias("change"),
        "n_changes",
    )


def shop_months(spark: SparkSession, root: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """(shop_id, n_products, n_changes, avg_price) of written prices, in all months or in those from ``first`` to ``last`` (yyyy-MM).

    Counts and sums of months add up to any range; products are counted once each. Sums are in whole cents.
    """
    months = _kept_months(spark, root)
    if first is not None:
        months = months.where(F.col(MONTH) >= first)
    if last is not None:
        months = months.where(F.col(MONTH) <= last)
    # One row per product before the shops meet, so that a shop with most products is summed in parts.
    by_product = months.groupBy("product_id").agg(F.sum("n_changes").alias("n_changes"), F.sum("cents").alias("cents"))
    shops = store.read(spark, root, "products").select(F.col("id").alias("product_id"), "shop_id")
    return by_product.join(shops, "product_id").groupBy("shop_id").agg(
        F.count(F.lit(1)).alias("n_products"),
        F.sum("n_changes").alias("n_changes"),
        (F.sum("cents").cast("double") / F.sum("n_changes") / F.lit(100)).alias("avg_price"),
    )
