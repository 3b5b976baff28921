"""Registered queries: every operator run over the benchmark tables.

Prices leave as doubles and times without zone, so results compare by value with other engines.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.functions import html, sql, text, urls
from pricetrail.operators import analytics, asof, extract, load, relations, responses, routing, rule_table, similar
from pricetrail.operators.history import ORDER, change_history, is_change, last_written
from pricetrail.plans import reports, shapes, store
from pricetrail.plans.batch import CAPTURE_RULES, load_snapshots
from pricetrail.plans.shapes import table
from pricetrail.session import fresh_path, ship_package
from pricetrail.sources import snapshots, tables
from pricetrail.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SPLIT_TIME = "2024-01-16 00:00:00"


def query(function: Query) -> Query:
    """Register under the function's name; the package is sent to the executors first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


def _double(*names: str) -> list[str]:
    return [f"cast({name} AS double) AS {name}" for name in names]


def _plain_time(*names: str) -> list[str]:
    return [f"cast({name} AS timestamp_ntz) AS {name}" for name in names]


def _kept(df: DataFrame, label: str) -> DataFrame:
    """Written and read back, as a load keeps its intermediate tables: later steps read it many times."""
    root = fresh_path(df.sparkSession, label)
    tables.write_version(df, root, label, 0)
    return tables.read_version(df.sparkSession, root, label, 0)


# --- change-only history ---------------------------------------------------------------------


def _history(spark: SparkSession, sf_dir: str, price: str | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events")
    seen = shapes.observations(events) if price is None else shapes.observations(events, price)
    return change_history(seen, ["user_id"], ["observed_at"])


def _history_out(written: DataFrame) -> DataFrame:
    return written.selectExpr("user_id", *_plain_time("observed_at"), *_double("price"), "is_in_stock")


@query
def change_history_rows(spark, sf_dir):
    return _history_out(_history(spark, sf_dir))


@query
def change_history_one_cent_steps(spark, sf_dir):
    return _history_out(_history(spark, sf_dir, shapes.THRESHOLD_PRICE))


@query
def change_history_single_product(spark, sf_dir):
    """All observations belong to one product: the fold must split a key that holds every row."""
    events = table(spark, sf_dir, "events").withColumn("user_id", F.lit(1).cast("bigint"))
    seen = shapes.observations(events, shapes.THRESHOLD_PRICE)
    return _history_out(change_history(seen, ["user_id"], ["observed_at"]))


@query
def change_test(spark, sf_dir):
    """The write test alone: one-cent steps from different prices, stock changes, nothing stored yet."""
    pairs = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 10 > 0 THEN cast(1 + (event_id % 400) * 0.01 AS decimal(10,2)) END AS last_price",
        "event_id % 7 <> 0 AS last_stock",
        "cast(1 + (event_id % 400 + user_id % 3) * 0.01 AS decimal(10,2)) AS price",
        "event_type <> 'error' AS is_in_stock",
    )
    changes = is_change(F.col("last_price"), F.col("last_stock"), F.col("price"), F.col("is_in_stock"))
    return pairs.select("event_id", changes.alias("changes"))


@query
def change_history_in_two_loads(spark, sf_dir):
    """The second load starts from the last written rows; about half of all rows are no change."""
    seen = shapes.observations(table(spark, sf_dir, "events"), shapes.THRESHOLD_PRICE)
    first = change_history(seen.where(f"observed_at < '{SPLIT_TIME}'"), ["user_id"], ["observed_at"])
    stored = first.withColumnRenamed("observed_at", "parsed_at")
    second = change_history(
        seen.where(f"observed_at >= '{SPLIT_TIME}'"),
        ["user_id"],
        ["observed_at"],
        last_written(stored, ["user_id"]),
    )
    return _history_out(first.unionByName(second))


@query
def latest_price_after_history(spark, sf_dir):
    written = _history(spark, sf_dir)
    newest = relations.latest_price(written, ["user_id"], ["observed_at"])
    return _history_out(newest)


@query
def pages_to_history(spark, sf_dir):
    """From page bodies of three shops to written history rows; pages are parsed once and kept."""
    pages = shapes.event_pages(table(spark, sf_dir, "events"))
    extracted = _kept(extract.extract_catalog(pages), "extracted")
    offers = load.with_identity(extract.offers(extracted))
    written = change_history(offers, ["shop_base_url", "product_key"])
    return written.selectExpr(
        "shop_base_url", "product_key", *_plain_time("observed_at"), "name", *_double("price"), "is_in_stock"
    )


# --- URLs and links --------------------------------------------------------------------------


@query
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", f"{urls.host('url')} AS host", f"{urls.path('url')} AS path"
    )


@query
def route_catalog_pages(spark, sf_dir):
    """URLs of all shops and of strangers, through the rule list."""
    made = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE event_id % 8 WHEN 0 THEN concat('https://magnit.ru/catalog/', user_id)"
        " WHEN 1 THEN concat('https://magnit.ru/product/', user_id)"
        " WHEN 2 THEN concat('https://5ka.ru/catalog/', user_id, '/?page=2')"
        " WHEN 3 THEN concat('https://www.perekrestok.ru/cat/c/', user_id)"
        " WHEN 4 THEN concat('https://www.perekrestok.ru/about?x=/cat/', user_id)"
        " WHEN 5 THEN concat('http://user@m.magnit.ru:8080/x/catalog/', user_id, '#a')"
        " WHEN 6 THEN concat('https://example.com/5ka.ru/catalog/', user_id)"
        " ELSE concat('/catalog/', user_id) END AS page_url",
    )
    catalog = routing.route(made, "catalog")
    return catalog.selectExpr(
        "event_id",
        "rule",
        "shop_base_url",
        f"{routing.matching_rule('page_url', routing.PRODUCT_RULES)} AS product_rule",
    )


@query
def page_links(spark, sf_dir):
    """Anchors of crawled pages in document order, with absolute URLs."""
    pages = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url AS page_url", f"{html.anchors('html')} AS links"
    )
    return (
        pages.selectExpr("page_id", "page_url", "inline(links)")
        .selectExpr(
            "page_id",
            "page_url",
            "position",
            f"{urls.trimmed_href(html.attribute_text('attributes', 'href'))} AS href",
            f"{text.normalize(html.text_content('markup'))} AS label",
        )
        .selectExpr(
            "page_id",
            "position",
            "href",
            f"{urls.absolute('href', 'page_url', urls.page_origin('page_url'))} AS url",
            "label",
        )
    )


@query
def product_links(spark, sf_dir):
    """Link tests and ids read from URLs, over product links of every form."""
    made = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "CASE p_partkey % 6 WHEN 0 THEN concat('https://magnit.ru/product/', p_partkey, '-x?shopCode=1')"
        " WHEN 1 THEN concat('https://magnit.ru/product/', p_partkey, '/?a=1')"
        " WHEN 2 THEN concat('https://magnit.ru/product/', p_partkey)"
        " WHEN 3 THEN concat('https://www.perekrestok.ru/cat/c/12/p/x-', p_partkey, '/')"
        " WHEN 4 THEN concat('https://www.perekrestok.ru/cat/12/p/x-', p_partkey)"
        " ELSE concat('https://www.perekrestok.ru/cat/x/p/x', p_partkey) END AS url",
    )
    return made.selectExpr(
        "p_partkey",
        f"{urls.is_magnit_product('url')} AS magnit_link",
        f"{urls.is_perekrestok_product('url')} AS perekrestok_link",
        f"{urls.magnit_catalog_id('url')} AS magnit_catalog_id",
        f"{urls.magnit_product_id('url')} AS magnit_product_id",
        f"{urls.perekrestok_id('url')} AS perekrestok_id",
    )


@query
def first_elements(spark, sf_dir):
    """First heading, title and body preview of crawled pages."""
    scanned = table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "html",
        f"get({html.elements('html', 'h1')}, 0) AS h1",
        f"get({html.elements('html', 'title')}, 0) AS title",
    )
    return scanned.selectExpr(
        "page_id",
        f"{text.normalize(html.text_content('h1'))} AS h1",
        f"{text.normalize(html.text_content('title'))} AS title",
        f"{responses.body_preview('html')} AS preview",
    )


@query
def loaded_and_failed_pages(spark, sf_dir):
    """Rejects of crawled pages: no shop takes them, whether they loaded or not."""
    pages = shapes.raw_pages(table(spark, sf_dir, "pages"))
    as_shop = pages.withColumn(
        "page_url", F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("https://magnit.ru/catalog/"), "page_id")).otherwise(F.col("page_url"))
    )
    return extract.rejects(extract.extract_catalog(as_shop)).selectExpr(
        "page_url", *_plain_time("fetched_at"), "stage", "reason"
    )


# --- prices and names in text ----------------------------------------------------------------


@query
def price_texts(spark, sf_dir):
    """The price readers side by side on texts made from each part."""
    made = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "concat('Цена 0,00 ₽ было ', p_size, ' ', translate(format_string('%.2f', p_retailprice), '.', ','), '  ₽') AS words",
        "CASE p_partkey % 4 WHEN 0 THEN format_string('%.2f', p_retailprice)"
        " WHEN 1 THEN concat('от ', translate(format_string('%.2f', p_retailprice), '.', ','), ' руб.')"
        " WHEN 2 THEN concat('1 ', p_size, '₽') ELSE 'нет' END AS scalar_text",
        "CASE WHEN p_partkey % 2 = 0 THEN translate(format_string('%.2f', p_retailprice), '.', ',') ELSE 'скоро' END AS numeric_text",
    )
    return made.selectExpr(
        "p_partkey",
        f"cast({text.first_price('words')} AS double) AS first_price",
        f"cast({text.first_positive_price('words')} AS double) AS first_positive_price",
        f"cast({text.scalar_price('scalar_text')} AS double) AS scalar_price",
        f"cast({text.numeric_price('numeric_text')} AS double) AS numeric_price",
    )


# --- extraction ------------------------------------------------------------------------------


def _offers_out(offers: DataFrame) -> DataFrame:
    return offers.selectExpr(
        "shop_base_url",
        "internal_product_id",
        "name",
        *_double("price"),
        "url",
        "manufacturer_code",
        "is_in_stock",
    )


@query
def magnit_catalog_offers(spark, sf_dir):
    pages = shapes.magnit_catalog_pages(table(spark, sf_dir, "part"))
    return _offers_out(extract.offers(extract.extract_catalog(pages)))


@query
def perekrestok_catalog_offers(spark, sf_dir):
    pages = shapes.perekrestok_catalog_pages(table(spark, sf_dir, "part"))
    return _offers_out(extract.offers(extract.extract_catalog(pages)))


@query
def pyaterochka_catalog_offers(spark, sf_dir):
    pages = shapes.pyaterochka_catalog_pages(table(spark, sf_dir, "part"))
    return _offers_out(extract.offers(extract.extract_catalog(pages)))


@query
def magnit_product_offers(spark, sf_dir):
    pages = shapes.magnit_product_pages(table(spark, sf_dir, "part"))
    return _offers_out(extract.offers(extract.extract_product(pages)))


@query
def extraction_rejects(spark, sf_dir):
    """Pages that fail at each stage, made from parts."""
    pages = table(spark, sf_dir, "part").selectExpr(
        "CASE p_partkey % 8 WHEN 0 THEN concat('https://example.com/', p_partkey)"
        " WHEN 1 THEN concat('https://magnit.ru/catalog/', p_partkey)"
        " WHEN 2 THEN concat('https://www.perekrestok.ru/cat/', p_partkey)"
        " ELSE concat('https://5ka.ru/catalog/', p_partkey) END AS page_url",
        "timestamp'2024-03-01 00:00:00' AS fetched_at",
        "CASE WHEN p_partkey % 8 = 1 THEN 404 ELSE 200 END AS http_status",
        "'text/html' AS content_type",
        "CASE p_partkey % 8 WHEN 2 THEN concat('<a href=\"/about\">', p_name, ' 5 ₽</a>')"
        " WHEN 3 THEN concat('<html>', p_name, '</html>')"
        " WHEN 4 THEN '{\"products\": []}'"
        " WHEN 5 THEN concat('{\"products\": [{\"plu\": ', p_partkey, '}]}')"
        " WHEN 6 THEN concat('{\"products\": [{\"plu\": ', p_partkey, ', \"name\": \"x\", \"prices\": {\"regular\": \"', p_partkey, '00000000.00\"}}]}')"
        " ELSE concat('{\"products\": [{\"plu\": ', p_partkey, ', \"name\": \"x\", \"prices\": {\"regular\": \"5\"}}]}') END AS body",
    )
    return extract.rejects(extract.extract_catalog(pages)).select("page_url", "stage", "reason")


# --- captured responses ----------------------------------------------------------------------


def _captured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    answers = shapes.captured_responses(events)
    return responses.capture(shapes.capture_pages(events), answers), answers


@query
def response_log(spark, sf_dir):
    answers = responses.logged(shapes.captured_responses(table(spark, sf_dir, "events")))
    return answers.selectExpr("seq", "url", "status", f"{responses.body_preview('body')} AS preview")


@query
def response_tests(spark, sf_dir):
    """Block tests and kind of every response body."""
    answers = shapes.captured_responses(table(spark, sf_dir, "events"))
    return answers.selectExpr(
        "seq",
        f"{responses.is_page_blocked('body')} AS page_blocked",
        f"{responses.is_refused('status', 'body')} AS refused",
        f"{responses.response_kind('body')} AS kind",
    )


@query
def first_matching_responses(spark, sf_dir):
    answers = shapes.captured_responses(table(spark, sf_dir, "events"))
    return responses.first_matching(answers).selectExpr(
        "page_url", *_plain_time("fetched_at"), "matched.seq AS seq", "matched.url AS url", "matched.status AS status"
    )


@query
def capture_outcomes(spark, sf_dir):
    captured, _ = _captured(spark, sf_dir)
    return captured.selectExpr(
        "page_url",
        *_plain_time("fetched_at"),
        "matched.seq AS seq",
        "response_kind",
        "block_stage",
        "capture_reject",
    )


@query
def capture_report(spark, sf_dir):
    captured, answers = _captured(spark, sf_dir)
    return responses.diagnostics(captured, answers).selectExpr(
        "page_url", *_plain_time("fetched_at"), "line_no", "label", "text"
    )


@query
def captured_offers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    pages = responses.catalog_payloads(
        shapes.capture_pages(events), shapes.captured_responses(events), CAPTURE_RULES
    )
    return _offers_out(extract.offers(extract.extract_catalog(pages)))


# --- load ------------------------------------------------------------------------------------


@query
def shops_created(spark, sf_dir):
    """Shops of routed pages; one shop is stored already and stays as it is."""
    routed = routing.route(shapes.event_pages(table(spark, sf_dir, "events")), "catalog")
    stored = load.new_shops(routed.where("rule = 'magnit_catalog'")).withColumns(
        {"name": F.lit("stored name"), "parser_config": F.create_map(F.lit("product_parser"), F.lit("stored rule"))}
    )
    return load.get_or_create_shops(routed, stored).selectExpr(
        "name", "base_url", "parser_config['product_parser'] AS product_parser", *_plain_time("created_at")
    )


def _line_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(
        shapes.line_offers(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")), "line_offers"
    )


def _line_loads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    offers = _line_offers(spark, sf_dir)
    return offers.where("observed_at < '1999-01-01'"), offers.where("observed_at >= '1999-01-01'")


@query
def products_upserted(spark, sf_dir):
    """Two loads: new products, overwritten products, untouched products, ids found by URL."""
    early, late = _line_loads(spark, sf_dir)
    first = _kept(load.upsert_products(load.with_identity(early)).drop("created"), "products")
    second = load.upsert_products(load.with_identity(late, first), first)
    return second.selectExpr(
        "shop_id",
        "product_key",
        "name",
        "internal_product_id",
        "manufacturer_code",
        "url",
        *_plain_time("created_at", "updated_at"),
        "created",
    )


@query
def load_counters(spark, sf_dir):
    # Both loads of ``_line_loads`` in one scan. Names and URLs are not counted, so they are not stored again.
    found = load.with_identity(_line_offers(spark, sf_dir).where("observed_at IS NOT NULL"))
    seen = ["product_id", *ORDER, "price", "is_in_stock"]
    offers = _kept(found.select(*load.PRODUCT_KEY, *seen), "offers")
    # As in a load, the key of the fold is the product's id: its columns are all shuffled, sorted and cross to Python.
    written = change_history(offers.select(*seen), ["product_id"])
    return load.load_counters(offers, written).selectExpr(
        "page_url", *_plain_time("observed_at"), "offers_found", "products_created", "history_rows"
    )


# --- relations and constraints ---------------------------------------------------------------


@query
def products_with_shop(spark, sf_dir):
    products = shapes.products(table(spark, sf_dir, "part"), 25)
    return relations.products_with_shop(products, shapes.shops(table(spark, sf_dir, "nation"))).select(
        "id", "name", "shop_name", "base_url"
    )


@query
def products_of_one_shop(spark, sf_dir):
    products = shapes.products(table(spark, sf_dir, "part"), 25)
    shops = shapes.shops(table(spark, sf_dir, "nation")).withColumn(
        "base_url", F.concat(F.lit("shop-"), F.col("id").cast("string"))
    )
    return relations.products_of_shop(products, shops, "shop-7").select("id", "name", "shop_id")


@query
def products_with_prices(spark, sf_dir):
    products = shapes.products(table(spark, sf_dir, "part"))
    prices = shapes.prices(table(spark, sf_dir, "lineitem").where("l_partkey % 13 <> 0"))
    return relations.products_with_prices(products, prices).selectExpr(
        "product_id", "name", *_double("price"), "is_in_stock", *_plain_time("parsed_at")
    )


@query
def latest_price(spark, sf_dir):
    prices = shapes.prices(table(spark, sf_dir, "lineitem"))
    return relations.latest_price(prices, order=shapes.PRICE_ORDER).selectExpr(
        "product_id", *_double("price"), "is_in_stock", *_plain_time("parsed_at")
    )


@query
def duplicate_product_ids(spark, sf_dir):
    return relations.duplicate_ids(shapes.products(table(spark, sf_dir, "part")))


@query
def hash_collisions(spark, sf_dir):
    products = shapes.products(table(spark, sf_dir, "part")).withColumn("id", F.col("id") % 1500)
    return relations.colliding_hashes(products).select("id")


@query
def orphan_products(spark, sf_dir):
    products = shapes.products(table(spark, sf_dir, "part"), 30)
    return relations.orphans(products, shapes.shops(table(spark, sf_dir, "nation")), "shop_id").select("id", "shop_id")


@query
def orphan_prices(spark, sf_dir):
    products = shapes.products(table(spark, sf_dir, "part").where("p_size > 10"))
    prices = shapes.prices(table(spark, sf_dir, "lineitem"))
    return relations.orphans(prices, products, "product_id").selectExpr(
        "product_id", *_double("price"), *_plain_time("parsed_at")
    )


@query
def prices_after_cascade(spark, sf_dir):
    deleted = shapes.products(table(spark, sf_dir, "part").where("p_size > 40"))
    prices = shapes.prices(table(spark, sf_dir, "lineitem"))
    return relations.cascade_delete(prices, deleted).selectExpr(
        "product_id", *_double("price"), *_plain_time("parsed_at")
    )


@query
def price_range_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "cast(cast(o_totalprice AS decimal(20,2)) * 1000 AS decimal(20,2)) AS price"
    )
    return orders.selectExpr("o_orderkey", f"{relations.price_fits('price')} AS fits")


# --- reports ---------------------------------------------------------------------------------


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.latest_price(shapes.prices(table(spark, sf_dir, "lineitem")), order=shapes.PRICE_ORDER)


@query
def average_price_across_shops(spark, sf_dir):
    products = shapes.products(table(spark, sf_dir, "part"))
    return analytics.average_price(products, _latest(spark, sf_dir)).selectExpr(
        "canonical_key", "avg_price", *_double("min_price", "max_price"), "n_shops"
    )


@query
def monthly_price_change(spark, sf_dir):
    prices = shapes.prices(table(spark, sf_dir, "lineitem"))
    return analytics.monthly_change(prices, order=shapes.PRICE_ORDER).selectExpr(
        "product_id",
        *_plain_time("month"),
        *_double("first_price", "last_price", "previous_price", "change"),
        "n_changes",
    )


@query
def product_across_shops(spark, sf_dir):
    products = shapes.products(table(spark, sf_dir, "part"))
    return analytics.product_across_shops(products, _latest(spark, sf_dir)).selectExpr(
        "canonical_key", "shop_id", *_double("min_price"), "listings", "any_in_stock"
    )


@query
def compare_shops(spark, sf_dir):
    products = shapes.products(table(spark, sf_dir, "part"))
    return analytics.compare_shops(products, _latest(spark, sf_dir), [0, 1, 2]).selectExpr(
        "canonical_key", *_double("price_shop_0", "price_shop_1", "price_shop_2")
    )


@query
def search_products(spark, sf_dir):
    products = shapes.products(table(spark, sf_dir, "part"))
    return analytics.search(products, ["Red", "widget"]).select("id", "name")


@query
def price_validity(spark, sf_dir):
    prices = shapes.prices(table(spark, sf_dir, "lineitem"))
    return analytics.price_validity(prices, order=shapes.PRICE_ORDER).selectExpr(
        "product_id", *_double("price"), *_plain_time("parsed_at", "valid_to")
    )


# --- whole loads and streams -----------------------------------------------------------------


#: So many rows a file of a made stream holds; a part of more rows is written by several tasks.
STREAM_FILE_ROWS = 250_000


def _stream(spark: SparkSession, sf_dir: str, name: str, parts: int = 3, file_rows: int | None = None) -> DataFrame:
    """A table as a stream of files, in micro-batches of one part each; the first part comes twice.

    Rows are dealt to the parts by hash, so that their times interleave. All parts have as many files, so a micro-batch
    takes that many.
    """
    rows = table(spark, sf_dir, name)
    path = fresh_path(spark, f"{name}-files")
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(rows.columns[0]), F.lit(parts)))
    files = max(1, -(-rows.count() // (parts * (file_rows or STREAM_FILE_ROWS))))
    for number in [*range(parts), 0]:
        part = dealt.where(F.col("_part") == number).drop("_part")
        # Dealt out row by row, no file of a part is empty, however often a key comes.
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _loaded_out(spark: SparkSession, root: str) -> DataFrame:
    named = relations.products_with_shop(store.read(spark, root, "products"), store.read(spark, root, "shops"))
    return relations.products_with_prices(named, store.read_prices(spark, root)).selectExpr(
        "shop_name", "product_key", "name", *_plain_time("parsed_at"), *_double("price"), "is_in_stock"
    )


@query
def snapshots_loaded_in_two_versions(spark, sf_dir):
    """Whole loads: the second one overlaps the first and adds only what is new."""
    pages = shapes.event_pages(table(spark, sf_dir, "events"))
    root = fresh_path(spark, "load")
    load_snapshots(spark, pages.where(f"fetched_at < '{SPLIT_TIME}'"), root)
    load_snapshots(spark, pages.where("fetched_at >= '2024-01-10 00:00:00'"), root)
    return _loaded_out(spark, root)


def _three_loads(spark: SparkSession, sf_dir: str) -> str:
    """Loads whose times interleave, the first one repeated at the end."""
    pages = shapes.event_pages(table(spark, sf_dir, "events"))
    root = fresh_path(spark, "load")
    for part in (0, 1, 2, 0):
        load_snapshots(spark, pages.where(F.pmod(F.hash("page_url", "fetched_at"), F.lit(3)) == part), root)
    return root


@query
def loads_in_any_order(spark, sf_dir):
    """The history is the same however the pages were cut into loads."""
    return _loaded_out(spark, _three_loads(spark, sf_dir))


@query
def loaded_products(spark, sf_dir):
    """First and last time of every product over loads whose times interleave."""
    root = _three_loads(spark, sf_dir)
    named = relations.products_with_shop(store.read(spark, root, "products"), store.read(spark, root, "shops"))
    return named.selectExpr("shop_name", "product_key", *_plain_time("created_at", "updated_at"))


@query
def snapshots_read_back(spark, sf_dir):
    """Pages written as JSON lines and as parquet, read by the snapshot reader, and extracted."""
    pages = shapes.magnit_catalog_pages(table(spark, sf_dir, "part"))
    path = fresh_path(spark, "snapshots")
    pages.where("length(page_url) % 2 = 0").write.json(f"{path}/json")
    pages.where("length(page_url) % 2 = 1").write.parquet(f"{path}/parquet")
    read = snapshots.read_snapshots(spark, f"{path}/json", "json").unionByName(snapshots.read_snapshots(spark, f"{path}/parquet"))
    return _offers_out(extract.offers(extract.extract_catalog(read)))


@query
def streamed_offers(spark, sf_dir):
    pages = shapes.magnit_product_pages(_stream(spark, sf_dir, "part"))
    root = fresh_path(spark, "streamed-offers")
    jobs.write_stream(jobs.offers_stream(pages, "product"), f"{root}/offers", f"{root}/checkpoint").awaitTermination()
    return _offers_out(spark.read.parquet(f"{root}/offers"))


@query
def streamed_history(spark, sf_dir):
    seen = shapes.observations(_stream(spark, sf_dir, "events"), shapes.THRESHOLD_PRICE)
    root = fresh_path(spark, "streamed-history")
    jobs.stream_history(seen, ["user_id"], ["observed_at"], root, f"{root}/checkpoint").awaitTermination()
    return _history_out(store.read_written(spark, root))


@query
def streamed_load(spark, sf_dir):
    pages = shapes.event_pages(_stream(spark, sf_dir, "events"))
    root = fresh_path(spark, "streamed-load")
    jobs.stream_load(pages, root, f"{root}/checkpoint").awaitTermination()
    return _loaded_out(spark, root)


@query
def product_and_catalog_streams_in_one_store(spark, sf_dir):
    """Two streams with checkpoints of their own fill one store."""
    root = fresh_path(spark, "one-store")
    catalogs = shapes.event_pages(_stream(spark, sf_dir, "events"))
    jobs.stream_load(catalogs, root, f"{root}/checkpoint-catalog").awaitTermination()
    pages = shapes.magnit_product_pages(_stream(spark, sf_dir, "part", 2))
    jobs.stream_load(pages, root, f"{root}/checkpoint-product", "product").awaitTermination()
    return _loaded_out(spark, root)


# --- what loads keep -------------------------------------------------------------------------


@query
def small_load_into_large_store(spark, sf_dir):
    """Pages of a few products, loaded behind all others: their buckets alone are written again; then files are merged."""
    pages = shapes.event_pages(table(spark, sf_dir, "events"))
    root = fresh_path(spark, "large-store")
    few = F.regexp_extract("page_url", r"(\d+)", 1).cast("int") % 100 == 7
    load_snapshots(spark, pages.where(~few), root)
    load_snapshots(spark, pages.where(few & F.expr("fetched_at < '2024-01-20'")), root)
    load_snapshots(spark, pages.where(few & F.expr("fetched_at >= '2024-01-20'")), root)
    store.compact(spark, root, 2)
    return _loaded_out(spark, root)


@query
def late_rows_in_a_long_history(spark, sf_dir):
    """Every fifth observation comes after all others; products fold again from the day before it, as far as needed."""
    seen = _kept(shapes.observations(table(spark, sf_dir, "events"), shapes.THRESHOLD_PRICE), "observations")
    root = fresh_path(spark, "late-rows")
    behind = F.pmod(F.xxhash64("user_id", "observed_at"), F.lit(5)) == 0
    for part in (seen.where(~behind), seen.where(behind)):
        version = store.Load(spark, root)
        store.fold(version, part, ["user_id"], ["observed_at"], "yyyy-MM-dd")
        version.commit()
    return _history_out(store.read_written(spark, root))


@query
def load_rejects(spark, sf_dir):
    """Pages that a load set aside, as its store tells."""
    pages = shapes.raw_pages(table(spark, sf_dir, "pages"))
    as_shop = pages.withColumn(
        "page_url", F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("https://magnit.ru/catalog/"), "page_id")).otherwise(F.col("page_url"))
    )
    root = fresh_path(spark, "rejected")
    load_snapshots(spark, as_shop.drop("page_id"), root)
    return store.read(spark, root, "rejects").selectExpr("page_url", *_plain_time("fetched_at"), "stage", "reason")


@query
def load_diagnostics(spark, sf_dir):
    """The report on captured responses, as a load's store tells."""
    events = table(spark, sf_dir, "events")
    root = fresh_path(spark, "captured")
    load_snapshots(spark, shapes.capture_pages(events), root, responses=shapes.captured_responses(events))
    return store.read(spark, root, "diagnostics").selectExpr("page_url", *_plain_time("fetched_at"), "line_no", "label", "text")


@query
def product_pages_loaded(spark, sf_dir):
    """Product pages through a whole load; their URL is the page's, for they name none."""
    root = fresh_path(spark, "product-pages")
    load_snapshots(spark, shapes.magnit_product_pages(table(spark, sf_dir, "part")), root, "product")
    prices = store.read_prices(spark, root).selectExpr("product_id AS id", "price", "is_in_stock")
    return store.read(spark, root, "products").join(prices, "id").selectExpr(
        "name", *_double("price"), "url", "internal_product_id", "manufacturer_code", "is_in_stock"
    )


@query
def indexed_search(spark, sf_dir):
    """Products with any of three words, rare ones first, from the words that two loads kept."""
    pages = shapes.magnit_product_pages(table(spark, sf_dir, "part"))
    root = fresh_path(spark, "words")
    even = F.length("page_url") % 2 == 0
    load_snapshots(spark, pages.where(even), root, "product", index_words=True)
    load_snapshots(spark, pages.where(~even), root, "product")
    found = store.search(spark, root, ["Red", "widget", "gizmo"], all_words=False)
    return store.read(spark, root, "products").join(found, "id").select("product_key", "name", "n_words", F.round("score", 9).alias("score"))


# --- across shops and times ------------------------------------------------------------------


@query
def price_as_of(spark, sf_dir):
    """What did a product cost on the day of an order? One product has half of the prices and of the questions."""
    hot = "CASE WHEN {0} % 2 = 0 THEN 1 ELSE {1} END AS product_id"
    prices = shapes.prices(table(spark, sf_dir, "lineitem")).selectExpr(
        hot.format("l_orderkey", "product_id"), "price", "is_in_stock", "parsed_at", "l_orderkey", "l_suppkey", "l_linenumber"
    )
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey", hot.format("o_orderkey", "o_custkey"), "o_orderdate AS at")
    return asof.price_as_of(prices, asked, order=shapes.PRICE_ORDER).selectExpr(
        "o_orderkey", "product_id", *_plain_time("at", "parsed_at"), *_double("price"), "is_in_stock"
    )


@query
def similar_products(spark, sf_dir):
    """Products of all shops whose names have most words in common."""
    return similar.similar_products(shapes.named_products(table(spark, sf_dir, "part")))


# --- reports that loads keep -----------------------------------------------------------------


def _months_store(spark: SparkSession, sf_dir: str) -> str:
    """Three loads whose times interleave, and the first one again; the report is kept from the second one on."""
    pages = shapes.event_pages(table(spark, sf_dir, "events"))
    pages = _kept(pages.withColumn("fetched_at", F.expr("fetched_at + make_interval(0, cast(day(fetched_at) % 4 AS int))")), "month-pages")
    root = fresh_path(spark, "months")
    dealt = F.pmod(F.xxhash64("page_url", "fetched_at"), F.lit(3))
    for number, part in enumerate((0, 1, 2, 0)):
        load_snapshots(spark, pages.where(dealt == part), root, keep_months=number == 1)
    return root


@query
def maintained_monthly_change(spark, sf_dir):
    """First and last written price per product and month, as loads kept it; late rows take written ones back."""
    root = _months_store(spark, sf_dir)
    keyed = store.read(spark, root, "products").selectExpr("id AS product_id", "product_key")
    return reports.monthly_change(spark, root).join(keyed, "product_id").selectExpr(
        "product_key",
        *_plain_time("month"),
        *_double("first_price", "last_price", "previous_price", "change"),
        "n_changes",
    )


@query
def maintained_shop_months(spark, sf_dir):
    """Average written price, changes and products of each shop over two of the months that loads kept."""
    root = _months_store(spark, sf_dir)
    shops = store.read(spark, root, "shops").selectExpr("id AS shop_id", "base_url")
    return reports.shop_months(spark, root, "2024-02", "2024-03").join(shops, "shop_id").select("base_url", "n_products", "n_changes", "avg_price")


# --- pages in any order ----------------------------------------------------------------------


@query
def streamed_late_pages(spark, sf_dir):
    """Pages up to three weeks behind the newest ones, copies and differing copies of them in later micro-batches."""
    parts = table(spark, sf_dir, "part")
    path = fresh_path(spark, "late-part-files")
    changed = parts.withColumn("p_retailprice", F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_retailprice + 1 ELSE p_retailprice END"))
    for rows in (parts.where("p_partkey % 20 < 5"), parts.where("p_partkey % 20 >= 5"), changed.where("p_partkey % 4 < 2")):
        rows.coalesce(1).write.mode("append").parquet(path)
    found = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(path)
    pages = shapes.magnit_product_pages(found).withColumn(
        "fetched_at", F.expr("fetched_at - make_dt_interval(cast(regexp_extract(page_url, '([0-9]+)', 1) AS int) % 20)")
    )
    root = fresh_path(spark, "late-pages")
    jobs.stream_offers(pages, root, f"{root}/checkpoint", "product").awaitTermination()
    done = store.state(spark, root)
    offers = store.appended(spark, done, root, "offers").selectExpr(
        "page_url", "observed_at AS fetched_at", "name", "cast(price AS double) AS price", "cast(NULL AS string) AS reason"
    )
    rejects = store.appended(spark, done, root, "rejects").selectExpr(
        "page_url", "fetched_at", "cast(NULL AS string) AS name", "cast(NULL AS double) AS price", "reason"
    )
    return offers.unionByName(rejects).selectExpr("page_url", *_plain_time("fetched_at"), "name", "price", "reason")


# --- rules as a table, functions in SQL ------------------------------------------------------


@query
def route_by_rule_table(spark, sf_dir):
    """Two rules for each supplier and some for each customer; URLs of orders that one, several or none of them take."""
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "concat('all-', s_suppkey) AS rule", "concat('https://s', s_suppkey, '.example') AS shop_base_url",
        "concat('S', s_suppkey, '.Example') AS host", "cast(NULL AS string) AS path", "9 AS priority",
    )
    catalogs = table(spark, sf_dir, "supplier").selectExpr(
        "concat('list-', s_suppkey)", "concat('https://s', s_suppkey, '.example')", "concat('s', s_suppkey, '.example')", "'/catalog/'", "5"
    )
    customers = table(spark, sf_dir, "customer").selectExpr(
        "concat('shelf-', c_custkey)", "'https://all.example'", "'all.example'", "concat('shelf/', c_custkey)", "cast(c_custkey % 3 AS int)"
    )
    rules = suppliers.union(catalogs).union(customers)
    suppliers_known = "1 + o_custkey % 150"
    pages = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        f"CASE o_orderkey % 6 WHEN 0 THEN concat('https://www.s', {suppliers_known}, '.example/catalog/', o_orderkey)"
        f" WHEN 1 THEN concat('http://u@S', {suppliers_known}, '.example:80/catalogue?x=/catalog/')"
        " WHEN 2 THEN concat('https://m.all.example//shelf/', o_custkey, '/x/y/z')"
        f" WHEN 3 THEN concat('https://xs', {suppliers_known}, '.example/catalog/')"
        f" WHEN 4 THEN concat('https://s', {suppliers_known}, '.example/catalog') END AS page_url",
    )
    return rule_table.route_by_table(pages, rules).select("o_orderkey", "rule", "shop_base_url")


@query
def links_in_sql(spark, sf_dir):
    """Anchors of crawled pages, asked for in SQL."""
    sql.register(spark)
    return spark.sql(
        "SELECT page_id, inline(links) FROM (SELECT page_id, pt_page_links(html, url) AS links FROM {pages})",
        pages=table(spark, sf_dir, "pages"),
    )


@query
def page_facts_in_sql(spark, sf_dir):
    """Hosts, JSON-LD scripts and prices in the text of product pages, asked for in SQL."""
    sql.register(spark)
    return spark.sql(
        "SELECT page_url, pt_host(page_url) AS host, size(pt_ld_json_scripts(body)) AS n_scripts,"
        " cast(pt_first_positive_price(pt_html_text(body)) AS double) AS text_price FROM {pages}",
        pages=shapes.magnit_product_pages(table(spark, sf_dir, "part")),
    )
