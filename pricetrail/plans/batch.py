"""One load from page snapshots to the stored tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.operators import extract, load
from pricetrail.operators.history import ORDER
from pricetrail.operators.responses import captured_pages, catalog_payloads, diagnostics
from pricetrail.operators.routing import CATALOG_RULES, Rule
from pricetrail.operators.similar import name_words
from pricetrail.plans import reports, store
from pricetrail.session import fresh_path, scratch, side_by_side

CAPTURE_RULES = [rule for rule in CATALOG_RULES if rule.name == "pyaterochka_catalog"]


def load_snapshots(
    spark: SparkSession,
    pages: DataFrame,
    root: str,
    kind: str = "catalog",
    responses: DataFrame | None = None,
    drop_copies: bool = False,
    more_rules: list[Rule] | None = None,
    more_offers: dict[str, str] | None = None,
    source: str = "batch",
    batch: int | None = None,
    n_buckets: int = store.BUCKETS,
    index_words: bool = False,
    keep_months: bool = False,
) -> int:
    """Load pages behind the newest committed version of the store at ``root``; returns the version.

    Extraction is written once and read by every later step: pages are parsed a single time, and a
    lost executor costs a re-read, not a re-parse. The commit comes last: a load that fails leaves
    nothing readers see, and the next one writes the same version number. A load whose ``source`` and
    ``batch`` number are committed already is not repeated; pages loaded again as something new add
    no products and no prices. Product pages and catalogues share one store. ``drop_copies`` keeps
    one of several snapshots with equal URL and time; ``more_rules`` and ``more_offers`` add shops. A new store gets
    ``n_buckets`` key buckets; a load reads and writes those of its own products only. With ``index_words`` the store
    keeps the words of product names from then on, for ``store.search``; with ``keep_months`` the report by month, for
    ``reports``. Of snapshots of one page and time that differ,
    ``drop_copies`` leaves a reject.
    """
    before = store.state(spark, root)
    if store.committed(before, source, batch):
        return before.version
    version = store.Load(spark, root, source, batch, n_buckets)
    with scratch(spark):
        _load(version, pages, kind, responses, drop_copies, more_rules, more_offers, index_words, keep_months)
        return version.commit()


def _load(version: store.Load, pages, kind, responses, drop_copies, more_rules, more_offers, index_words, keep_months) -> None:
    spark = version.spark
    if responses is not None and kind == "catalog":
        captured = captured_pages(pages, responses, CAPTURE_RULES)
        version.append("diagnostics", diagnostics(captured, responses))
        pages = catalog_payloads(pages, responses, CAPTURE_RULES)
    if kind == "catalog":
        extracted = extract.extract_catalog(pages, more_rules, more_offers)
    else:
        extracted = extract.extract_product(pages, more_rules, more_offers)
    extracted = _kept(spark, extracted, "extracted")
    set_aside = extract.rejects(extracted)
    if drop_copies:
        differing = differing_copies(extracted)
        extracted = _kept(spark, without_copies(extracted), "extracted")
        set_aside = extract.rejects(extracted).unionByName(differing)
    _, _, offers = side_by_side(
        lambda: version.append("rejects", set_aside),
        lambda: _store_shops(version, extracted, more_rules),
        lambda: _store_offers(version, extract.offers(extracted)),
    )
    touched = version.touched("offers")
    before = version.current("products", touched)

    def beside(written: DataFrame) -> None:
        version.append("counters", load.load_counters(offers, written, before))
        if keep_months or reports.is_kept(version.before):
            reports.keep_months(version, written, ["product_id"], ORDER)

    side_by_side(
        lambda: _store_products(version, offers, before, touched, index_words),
        lambda: store.fold(version, offers, ["product_id"], ORDER, beside=beside),
    )


def _kept(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """An intermediate table, removed with the load's scope."""
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _store_shops(version: store.Load, extracted: DataFrame, more_rules: list[Rule] | None) -> None:
    """Shops are few: one new one makes the table anew, none leaves it. The pages are reduced to shops once."""
    shops = store.in_buckets(version.spark, version.before, version.root, "shops")
    new = _kept(version.spark, load.new_shops(extracted, shops, more_rules), "shops")
    if shops is None or not new.isEmpty():
        all_shops = new if shops is None else shops.unionByName(new)
        touched = [r[0] for r in all_shops.select(store.bucket_of(["base_url"], version.n)).distinct().collect()]
        version.replace("shops", all_shops, ["base_url"], touched)


def _store_offers(version: store.Load, offers: DataFrame) -> DataFrame:
    """Offers with the product that each one belongs to, by bucket of the product.

    Products are looked up by URL for offers without id only, in the buckets of those URLs.
    """
    named = load.with_url(offers)
    bare = named.where("internal_product_id IS NULL")
    wanted = [r[0] for r in bare.select(store.bucket_of(URL_KEY, version.n)).distinct().collect()]
    urls = version.current("urls", wanted) if wanted else None
    # Where every offer has an id of its own, none is looked up.
    known = load.with_identity(named, urls) if wanted else load.with_own_id(named)
    found = known.withColumn(store.BUCKET, store.bucket_of(["product_id"], version.n))
    return version.append("offers", found, [store.BUCKET])


URL_KEY = ["shop_id", "url"]


def _store_products(version: store.Load, offers: DataFrame, before: DataFrame | None, touched: list[int], words: bool) -> None:
    """The touched buckets of products, and of the look-ups by URL and by word those that new or changed products are in."""
    after = load.upsert_products(offers, before).drop("created")
    after = version.replace("products", after, ["id"], touched)
    held = ["id", "name", "shop_id", "url", "product_key", "internal_product_id"]
    if before is not None:
        was = before.select("id", F.col("name").alias("_name"), F.col("url").alias("_url"), F.lit(True).alias("_was"))
        changed = after.select(*held).join(was, "id", "left").where("NOT url <=> _url OR NOT name <=> _name")
        path = fresh_path(version.spark, "changed")
        changed.write.parquet(path)
        changed = version.spark.read.schema(changed.schema).parquet(path)
    else:
        changed = after.select(*held).withColumns({"_name": F.lit(None).cast("string"), "_url": F.lit(None).cast("string"), "_was": F.lit(None).cast("boolean")})
    urls, moved = ["shop_id", "url", "product_key", "internal_product_id"], changed.where("NOT url <=> _url")
    gone = changed.where("_was AND NOT url <=> _url").select("shop_id", F.col("_url").alias("url"), "product_key")
    jobs = [lambda: _look_up(version, "urls", URL_KEY, moved.select(*urls), gone)]
    # A store that has the words of names keeps them.
    if words or "words" in version.before.buckets:
        named = changed.where("NOT name <=> _name")
        new, old = (named.select("id", F.explode(F.expr(name_words(c))).alias("word")) for c in ("name", "_name"))
        jobs.append(lambda: _look_up(version, "words", ["word"], new, old))
    side_by_side(*jobs)


def _look_up(version: store.Load, table: str, key: list[str], new: DataFrame, gone: DataFrame) -> None:
    """Rows of a look-up table: ``gone`` ones leave their buckets, ``new`` ones come to theirs."""
    places = new.select(*key).unionByName(gone.select(*key))
    wanted = [r[0] for r in places.select(store.bucket_of(key, version.n)).distinct().collect()]
    if not wanted:
        return
    stay = version.current(table, wanted)
    if stay is not None:
        new = new.unionByName(stay.join(gone, gone.columns, "left_anti").select(new.columns))
    version.replace(table, new, key, wanted)


#: What makes two snapshots of one page and time copies, beside their offers.
COPY = ["stage", "reason", "rule", "shop_base_url"]


def without_copies(extracted: DataFrame) -> DataFrame:
    """One row per page and time. Reduced before the shuffle, so a page with many copies is no hot spot.

    Of differing copies a good one wins over a reject, and one with more offers over one with fewer.
    """
    one = F.min(F.struct(*COPY, (-F.coalesce(F.size("offers"), F.lit(0))).alias("_n"), "offers"))
    found = extracted.groupBy("page_url", "fetched_at").agg(one.alias("_one"))
    return found.select("page_url", "fetched_at", "_one.*").select(extracted.columns)


def differing_copies(extracted: DataFrame) -> DataFrame:
    """A reject for each page and time whose snapshots are not all alike: what the others say is not loaded."""
    kind = F.xxhash64(*COPY, "offers")
    found = extracted.groupBy("page_url", "fetched_at").agg(F.min(kind).alias("a"), F.max(kind).alias("b")).where("a <> b")
    return found.selectExpr("page_url", "fetched_at", "'copy' AS stage", "'snapshots of one page and time differ' AS reason")
