"""Reads over the stored tables and the constraints between them.

Joins carry no hints: Spark broadcasts a side only when its measured size is small, and adaptive
execution splits the hot keys of the large side.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def products_with_shop(products: DataFrame, shops: DataFrame) -> DataFrame:
    shop = shops.selectExpr("id AS shop_id", "name AS shop_name", "base_url")
    return products.join(shop, "shop_id")


def products_of_shop(products: DataFrame, shops: DataFrame, base_url: str) -> DataFrame:
    """Products of one shop; the filter reaches the shop scan."""
    wanted = shops.where(F.col("base_url") == base_url).selectExpr("id AS shop_id")
    return products.join(wanted, "shop_id", "left_semi")


def products_with_prices(products: DataFrame, prices: DataFrame) -> DataFrame:
    """All price rows with their product; products without history stay.

    An inner join plus the products that match nothing, instead of a left join: adaptive execution
    splits a hot product's prices in an inner join, but not on the right of a left join.
    """
    keyed = products.withColumnRenamed("id", "product_id")
    rows = prices.select("product_id", "price", "is_in_stock", "parsed_at")
    matched = rows.join(keyed, "product_id").select(*keyed.columns, "price", "is_in_stock", "parsed_at")
    priced = rows.groupBy("product_id").agg(F.count("*").alias("n_rows"))
    bare = keyed.join(priced, "product_id", "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)


def latest_price(prices: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Row with the greatest time per product, the later id on a tie; reduced before the shuffle."""
    keys = keys or ["product_id"]
    order = order or ["parsed_at", "id"]
    rest = [name for name in prices.columns if name not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return prices.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def duplicate_ids(products: DataFrame) -> DataFrame:
    """Violations of unique (shop_id, internal_product_id); nulls repeat freely."""
    return (
        products.where("internal_product_id IS NOT NULL")
        .groupBy("shop_id", "internal_product_id")
        .agg(F.count("*").alias("n_rows"))
        .where("n_rows > 1")
    )


def colliding_hashes(products: DataFrame) -> DataFrame:
    """Product ids shared by different keys. Ids are 64-bit hashes, so this is checked, not assumed."""
    return (
        products.groupBy("id")
        .agg(F.min(F.struct("shop_id", "product_key")).alias("a"), F.max(F.struct("shop_id", "product_key")).alias("b"))
        .where("a <> b")
    )


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Child rows whose parent is missing."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.join(keys, child_key, "left_anti").select(child.columns)


def cascade_delete(prices: DataFrame, deleted: DataFrame) -> DataFrame:
    """Prices that stay when products are deleted."""
    keys = deleted.select(F.col("id").alias("product_id"))
    return prices.join(keys, "product_id", "left_anti").select(prices.columns)


def price_fits(price: str) -> str:
    """Does the price fit decimal(10,2)?"""
    return f"try_cast({price} AS decimal(10,2)) IS NOT NULL"
