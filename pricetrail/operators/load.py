"""Keyed load of shops and products.

Newest and first rows per key come from ``max_by``/``min_by``: Spark reduces before the shuffle, so
a key with a third of all rows sends one row per input partition.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.operators.history import order_key
from pricetrail.operators.routing import RULES, Rule, of_rule

OFFER_ORDER = ["observed_at", "page_url", "position"]
PRODUCT_KEY = ["shop_id", "product_key"]
_ALL_RULES = [rule for rules in RULES.values() for rule in rules]


def shop_id(base_url: str) -> str:
    return f"xxhash64({base_url})"


def product_key(internal_id: str, url: str) -> str:
    """Identity inside a shop: the id where there is one, else the URL."""
    return f"coalesce(concat('id:', {internal_id}), concat('url:', {url}))"


def new_shops(
    routed: DataFrame, shops: DataFrame | None = None, more_rules: list[Rule] | None = None
) -> DataFrame:
    """Shops of routed pages that are not stored yet, whether or not the page loaded.

    The first page of a shop gives the rule kept in ``parser_config``. Pages are reduced to one row
    per shop before anything is shuffled or joined.
    """
    first = (
        routed.where("rule IS NOT NULL")
        .groupBy("shop_base_url")
        .agg(
            F.min(F.struct("fetched_at", "page_url", "rule")).alias("_first"),
        )
    )
    found = first.selectExpr(
        f"{shop_id('shop_base_url')} AS id",
        f"{of_rule('_first.rule', [*_ALL_RULES, *(more_rules or [])], 'shop_name')} AS name",
        "shop_base_url AS base_url",
        "map('product_parser', _first.rule) AS parser_config",
        "_first.fetched_at AS created_at",
        "_first.fetched_at AS updated_at",
    )
    return found if shops is None else found.join(shops.select("base_url"), "base_url", "left_anti").select(found.columns)


def get_or_create_shops(
    routed: DataFrame, shops: DataFrame | None = None, more_rules: list[Rule] | None = None
) -> DataFrame:
    """All shops after the load; stored rows are never changed."""
    created = new_shops(routed, shops, more_rules)
    return created if shops is None else shops.unionByName(created)


def with_url(offers: DataFrame, page_url: str = "page_url") -> DataFrame:
    """Offers with ``shop_id``, and with the page's URL where they have none of their own."""
    return offers.selectExpr(
        *[c for c in offers.columns if c not in ("url", "shop_id")],
        f"coalesce(url, {page_url}) AS url",
        "shop_id" if "shop_id" in offers.columns else f"{shop_id('shop_base_url')} AS shop_id",
    )


def _identified(named: DataFrame) -> DataFrame:
    return named.selectExpr("*", f"{product_key('internal_product_id', 'url')} AS product_key")


def _with_product_id(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("product_id", F.xxhash64("shop_id", "product_key"))


def with_own_id(named: DataFrame) -> DataFrame:
    """``with_identity`` for offers that all have an id, and ``with_url``: nothing is looked up."""
    return _with_product_id(_identified(named))


def with_identity(offers: DataFrame, products: DataFrame | None = None, page_url: str = "page_url") -> DataFrame:
    """Offers with ``shop_id``, ``product_key``, ``product_id`` and the URL fallback.

    An offer without an id takes the product that already has its URL: a stored one without id
    first, then a stored one with id, then an offer with id of the same load. Only offers without
    id take part in that look-up.
    """
    named = with_url(offers, page_url)
    with_id = _identified(named.where("internal_product_id IS NOT NULL"))
    without_id = named.where("internal_product_id IS NULL")
    known = with_id.selectExpr("shop_id", "url", "2 AS rank", "product_key")
    if products is not None:
        stored = products.selectExpr(
            "shop_id",
            "url",
            "CASE WHEN internal_product_id IS NULL THEN 0 ELSE 1 END AS rank",
            "product_key",
        )
        known = known.unionByName(stored)
    # One row per URL and product, not per offer, is shuffled and sorted; only URLs of offers without id are looked up.
    known = known.distinct().join(without_id.select("shop_id", "url").distinct(), ["shop_id", "url"], "left_semi")
    by_url = known.groupBy("shop_id", "url").agg(F.min(F.struct("rank", "product_key")).alias("_known"))
    resolved = without_id.join(by_url, ["shop_id", "url"], "left").selectExpr(
        *named.columns, f"coalesce(_known.product_key, {product_key('NULL', 'url')}) AS product_key"
    )
    return _with_product_id(with_id.unionByName(resolved))


def newest_offers(offers: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Newest offer per product with its order key, and when the product was first seen in this load."""
    order = order or OFFER_ORDER
    attributes = ["name", "manufacturer_code", "url", order[0]]
    position = order_key(order)
    return (
        offers.groupBy(*PRODUCT_KEY)
        .agg(
            # Offers of one order key are settled by their attributes, so that no cut into loads matters.
            F.max(F.struct(position.alias("position"), *attributes)).alias("_newest"),
            F.min(order[0]).alias("first_seen"),
        )
        .selectExpr(
            *PRODUCT_KEY,
            "first_seen",
            "_newest.position AS newest_order",
            *[f"_newest.{name} AS {name}" for name in attributes if name != order[0]],
            f"_newest.{order[0]} AS last_seen",
        )
    )


def upsert_products(
    offers: DataFrame, products: DataFrame | None = None, order: list[str] | None = None
) -> DataFrame:
    """Products after the load, with ``created`` for those that had no row before.

    The newest offer overwrites all attributes, nulls too; the id stays what the key says. Newest is
    by the whole order key, which stays with the product: an older offer of a later load changes
    nothing but ``created_at``, and of one order key the greater attributes stay.
    """
    newest = newest_offers(offers, order)
    key_id = "CASE WHEN startswith(product_key, 'id:') THEN substring(product_key, 4) END"
    columns = ["id", *PRODUCT_KEY, "name", "internal_product_id", "manufacturer_code", "url", "created_at", "updated_at", "newest_order"]
    fresh = newest.selectExpr(
        "xxhash64(shop_id, product_key) AS id",
        *PRODUCT_KEY,
        "name",
        f"{key_id} AS internal_product_id",
        "manufacturer_code",
        "url",
        "first_seen AS created_at",
        "last_seen AS updated_at",
        "newest_order",
    )
    if products is None:
        return fresh.withColumn("created", F.lit(True))
    if "newest_order" not in products.columns:
        kind = fresh.schema["newest_order"].dataType
        products = products.withColumn("newest_order", F.lit(None).cast(kind))
    before, after = products.select(columns).alias("b"), fresh.alias("a")
    joined = before.join(
        after,
        (F.col("b.shop_id") == F.col("a.shop_id")) & (F.col("b.product_key") == F.col("a.product_key")),
        "full_outer",
    )
    later = " > ".join(
        f"named_struct('o', {side}.newest_order, 'n', {side}.name, 'm', {side}.manufacturer_code, 'u', {side}.url)"
        for side in "ab"
    )
    touched = f"a.product_key IS NOT NULL AND (b.newest_order IS NULL OR {later})"
    merged = [
        f"CASE WHEN {touched} THEN a.{name} ELSE b.{name} END AS {name}"
        for name in columns
        if name != "created_at"
    ]
    return joined.selectExpr(
        *merged, "least(b.created_at, a.created_at) AS created_at", "b.product_key IS NULL AS created"
    ).select(*columns, "created")


def load_counters(
    offers: DataFrame, written: DataFrame, products: DataFrame | None = None, order: list[str] | None = None
) -> DataFrame:
    """Offers found, products created and history rows written, per page.

    A product counts as created on the page of its first offer. The three counts are one union of
    flags, reduced before its only shuffle.
    """
    order = order or OFFER_ORDER
    page = ["page_url", "observed_at"]
    first = offers.groupBy(*PRODUCT_KEY).agg(F.min(F.struct(*order)).alias("_first"))
    if products is not None:
        first = first.join(products.select(*PRODUCT_KEY), PRODUCT_KEY, "left_anti")

    def flags(df: DataFrame, prefix: str, found: int, created: int, history: int) -> DataFrame:
        return df.selectExpr(
            *[f"{prefix}{name} AS {name}" for name in page],
            f"{found} AS found",
            f"{created} AS created",
            f"{history} AS history",
        )

    union = (
        flags(offers, "", 1, 0, 0)
        .unionByName(flags(first, "_first.", 0, 1, 0))
        .unionByName(flags(written, "", 0, 0, 1))
    )
    return union.groupBy(*page).agg(
        F.sum("found").alias("offers_found"),
        F.sum("created").alias("products_created"),
        F.sum("history").alias("history_rows"),
    )


def price_rows(written: DataFrame, time: str = "observed_at") -> DataFrame:
    """Written observations in the columns of the stored price table."""
    return written.selectExpr(
        "row_id AS id" if "row_id" in written.columns else "xxhash64(product_id, observed_at, page_url, position, price, is_in_stock) AS id",
        "product_id",
        "price",
        "is_in_stock",
        f"{time} AS parsed_at",
        f"{time} AS created_at",
        f"{time} AS updated_at",
    )
