"""The engine's input shapes, derived by Spark from the benchmark tables.

Every shape grows with its table. Catalogue pages are bounded by key blocks, so no page collects
an unbounded group.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS_PER_BLOCK = 500
THRESHOLD_PRICE = "cast(2.24 + least(floor(value / 25), 2) * 0.01 AS decimal(10,2))"


def spread(df: DataFrame, key: str) -> DataFrame:
    """The benchmark tables are single files; made pages are spread out as a crawl's files would be."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def observations(events: DataFrame, price: str = "cast(value AS decimal(10,2))") -> DataFrame:
    """Price observations: the user is the product."""
    return events.selectExpr(
        "user_id", "ts AS observed_at", f"{price} AS price", "event_type <> 'error' AS is_in_stock"
    )


def line_offers(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Offers with and without ids over three shops."""
    return spread(lineitem, "l_orderkey").join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_suppkey % 3 AS shop_id",
        "concat('https://shop', l_suppkey % 3, '.example/catalog/', lpad(l_orderkey, 12, '0'), '/',"
        " lpad(l_suppkey, 9, '0')) AS page_url",
        "l_shipdate AS observed_at",
        "l_linenumber AS position",
        "concat(p_name, ' ', l_linenumber % 3) AS name",
        "cast(l_extendedprice AS decimal(10,2)) AS price",
        "concat('https://shop', l_suppkey % 3, '.example/product/', l_partkey) AS url",
        "CASE WHEN l_partkey % 5 <> 0 AND l_linenumber <> 3 THEN cast(l_partkey AS string) END AS internal_product_id",
        "CASE WHEN l_returnflag = 'A' THEN concat('M', l_partkey) END AS manufacturer_code",
        "l_returnflag <> 'R' AS is_in_stock",
    )


def raw_pages(pages: DataFrame) -> DataFrame:
    """Snapshots of the crawled pages; some did not load."""
    return pages.selectExpr(
        "page_id",
        "url AS page_url",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id) AS fetched_at",
        "CASE WHEN page_id % 7 = 3 THEN 404 WHEN page_id % 11 = 5 THEN 503 ELSE 200 END AS http_status",
        "'text/html' AS content_type",
        "html AS body",
    )


_PRICE = "format_string('%.2f', p_retailprice)"
_COMMA_PRICE = f"translate({_PRICE}, '.', ',')"
_BRAND = "substring(p_brand, 7)"
_BLOCK = f"cast(floor(p_partkey / {KEYS_PER_BLOCK}) AS bigint)"


def _catalog_pages(part: DataFrame, page_url: str, item: str, before: str, separator: str, after: str) -> DataFrame:
    """One page per brand and key block, items in key order."""
    return (
        part.selectExpr("p_partkey", f"{page_url} AS page_url", f"{_BLOCK} AS block", f"{item} AS item")
        .groupBy("page_url", "block")
        .agg(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))).alias("items"))
        .selectExpr(
            "page_url",
            "timestamp'2024-03-01 00:00:00' AS fetched_at",
            "200 AS http_status",
            "'text/html' AS content_type",
            f"concat({before}, array_join(items.item, {separator}), {after}) AS body",
        )
    )


def magnit_catalog_pages(part: DataFrame) -> DataFrame:
    """Anchors in four text forms, with an unpriced copy before and a repeated copy behind some."""
    href = "concat('/product/', p_partkey, '-tovar?shopCode=1')"
    words = (
        f"CASE p_partkey % 4 WHEN 0 THEN concat('По карте ', {_PRICE}, ' ₽ -18% 1999.00 ₽ ', p_name, ' 4.9 · 83 отзыва')"
        f" WHEN 1 THEN concat({_COMMA_PRICE}, ' ₽ ', p_name, ' ', p_partkey, ' г 4.8 · 5 отзывов')"
        f" WHEN 2 THEN concat('Новинка ', {_PRICE}, ' ₽ Акция ', p_name, ' №', p_partkey, ' Нет отзывов')"
        f" ELSE concat('<span>', {_PRICE}, '&nbsp;&#8381;</span>\\n<b>', p_name, '</b> арт ', p_partkey) END"
    )
    item = (
        f"concat(CASE WHEN p_partkey % 6 = 0 THEN concat('<a href=\"', {href}, '\">нет цены</a>') ELSE '' END,"
        f" '<a class=\"card\" href=\"', {href}, '\">', {words}, '</a>',"
        f" CASE WHEN p_partkey % 10 = 0 THEN concat('<a href=\"', {href}, '\">1.00 ₽ Повтор</a>') ELSE '' END)"
    )
    return _catalog_pages(
        part,
        f"concat('https://magnit.ru/catalog/', {_BRAND}, '-tovary?page=', {_BLOCK})",
        item,
        "'<html><body><a href=\"#top\">1 ₽ Вверх</a>'",
        "'\\n'",
        "'<a href=\"/catalog/2\">5 ₽ Далее</a></body></html>'",
    )


def perekrestok_catalog_pages(part: DataFrame) -> DataFrame:
    """Even blocks list products as anchors; odd ones as JSON-LD, with anchors that must not count."""
    path = (
        "CASE WHEN p_partkey % 7 = 0 THEN concat('https://promo.perekrestok.ru/cat/c/1/p/tovar-', p_partkey, '/')"
        " ELSE concat('/cat/', 1, '/p/tovar-', p_partkey) END"
    )
    anchor = (
        f"concat('<a href=\"', {path}, '\" ', CASE p_partkey % 4"
        f" WHEN 0 THEN concat('aria-label=\"', p_name, '\">Цена ', {_COMMA_PRICE}, ' ₽ Старая цена 1,00 ₽ прочее')"
        f" WHEN 1 THEN concat('title=\"', p_name, ' &amp; ко\">Цена ', {_COMMA_PRICE}, ' ₽')"
        f" WHEN 2 THEN concat('>Цена ', {_COMMA_PRICE}, ' ₽ ', p_name, ' №', p_partkey, ' В наличии много')"
        f" ELSE concat('>Цена 0,00 ₽ ', {_COMMA_PRICE}, ' ₽ ', p_name, ' нет в наличии') END, '</a>')"
    )
    node = (
        f"concat('{{\"name\": \"', p_name, '\", \"url\": \"', {path}, '\"',"
        " CASE WHEN p_partkey % 2 = 0 THEN concat(', \"mpn\": \"M', p_partkey, '\"') ELSE '' END,"
        f" CASE p_partkey % 3 WHEN 0 THEN concat(', \"price\": ', {_PRICE})"
        f" WHEN 1 THEN concat(', \"offers\": [{{\"price\": null}}, {{\"price\": \"', {_PRICE}, '\"}}]')"
        f" ELSE concat(', \"price\": \"\", \"offers\": {{\"lowPrice\": \"', {_COMMA_PRICE},"
        " '\", \"availability\": \"https://schema.org/OutOfStock\"}') END, '}')"
    )
    url = f"concat('https://www.perekrestok.ru/cat/c/', {_BRAND}, '?page=', {_BLOCK})"
    links = _catalog_pages(
        part.where(f"{_BLOCK} % 2 = 0"), url, anchor, "'<html><body>'", "'\\n'", "'</body></html>'"
    )
    listed = _catalog_pages(
        part.where(f"{_BLOCK} % 2 = 1"),
        url,
        node,
        "'<html><script type=\"application/ld+json\">{\"@graph\": ['",
        "','",
        "']}</script><a href=\"/cat/1/p/lishnij-1\" title=\"Лишний\">Цена 1,00 ₽</a></html>'",
    )
    return links.unionByName(listed)


def pyaterochka_catalog_pages(part: DataFrame) -> DataFrame:
    """Catalogue JSON with the price in one of the four fields."""
    prices = (
        f"CASE p_partkey % 4 WHEN 0 THEN concat('\"discount\": \"', {_PRICE}, '\", \"regular\": \"1999.0\"')"
        f" WHEN 1 THEN concat('\"discount\": null, \"cpd_promo_price\": ', {_PRICE}, ', \"regular\": \"1999.0\"')"
        f" WHEN 2 THEN concat('\"discount\": \"\", \"cpd_promo_price_from_sum_cart\": \"', {_COMMA_PRICE}, '\"')"
        f" ELSE concat('\"discount\": \"скоро\", \"regular\": \"', {_PRICE}, '\"') END"
    )
    item = (
        "concat('{\"plu\": ', p_partkey, ', \"name\": \"', p_name, '  ', p_type, '\"',"
        " CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN ', \"is_available\": false'"
        " ELSE ', \"is_available\": true' END,"
        f" ', \"prices\": {{', {prices}, '}}}}')"
    )
    return _catalog_pages(
        part,
        f"concat('https://5ka.ru/catalog/brand--', {_BRAND}, '/?page=', {_BLOCK})",
        item,
        "'{\"name\": \"Каталог\", \"products\": ['",
        "','",
        "']}'",
    )


def magnit_product_pages(part: DataFrame) -> DataFrame:
    """One page per part, in five forms that reach down the fallback chains."""
    script = "'<script type=\"application/ld+json\">'"
    body = (
        "CASE p_partkey % 5"
        f" WHEN 0 THEN concat('<title>Магазин</title><meta itemprop=\"price\" content=\"', {_PRICE},"
        " '\"><h1>Раздел</h1><h1 data-test-id=\"v-product-details-name\">', p_name, ' <i>', p_type, '</i></h1>')"
        f" WHEN 1 THEN concat('<h1>', p_name, ' &laquo;', p_brand, '&raquo;</h1><span itemprop=\"price\"><span>', {_COMMA_PRICE},"
        " '</span> <span>₽</span></span> 1 ₽')"
        f" WHEN 2 THEN concat('<meta property=\"og:title\" content=\"', p_name, '\"><title>Магазин</title>', {script},"
        f" '{{\"sku\": \"S', p_partkey, '\", \"mpn\": \"M', p_partkey, '\", \"offers\": {{\"price\": \"', {_PRICE}, '\"}}}}</script>')"
        f" WHEN 3 THEN concat('<title>', p_name, '</title>', {script}, '{{broken</script>', {script},"
        f" '{{\"@graph\": [{{\"sku\": null, \"offers\": {{\"lowPrice\": ', {_PRICE}, '}}}}, {{\"productID\": ', p_partkey + 1,"
        " ', \"gtin13\": \"G', p_partkey, '\", \"price\": 1}]}</script>')"
        f" ELSE concat({script}, '[{{\"headline\": \"', p_name, '\", \"price\": \"от ', {_COMMA_PRICE}, ' руб.\"}}]</script>') END"
    )
    return spread(part, "p_partkey").selectExpr(
        "concat('https://magnit.ru/product/', p_partkey, '/?shopCode=1') AS page_url",
        "timestamp'2024-03-01 00:00:00' AS fetched_at",
        "200 AS http_status",
        "'text/html' AS content_type",
        f"{body} AS body",
    )


def event_pages(events: DataFrame) -> DataFrame:
    """One catalogue page with one product per event, over the three shops, in one-cent price steps.

    The steps leave about half of the offers without a change, so that what a load doesn't write shows too.
    """
    price = f"format_string('%.2f', cast({THRESHOLD_PRICE} AS double))"
    sold_out = "event_type = 'error'"
    return spread(events, "event_id").selectExpr(
        "CASE user_id % 3 WHEN 0 THEN concat('https://magnit.ru/catalog/', user_id, '-x')"
        " WHEN 1 THEN concat('https://5ka.ru/catalog/', user_id, '/')"
        " ELSE concat('https://www.perekrestok.ru/cat/', user_id) END AS page_url",
        "ts AS fetched_at",
        "200 AS http_status",
        "'text/html' AS content_type",
        f"CASE user_id % 3 WHEN 0 THEN concat('<a href=\"/product/', user_id, '-x\">', {price}, ' ₽ Товар ', user_id, '</a>')"
        f" WHEN 1 THEN concat('{{\"products\": [{{\"plu\": ', user_id, ', \"name\": \"Товар ', user_id,"
        f" '\", \"is_available\": ', NOT ({sold_out}), ', \"prices\": {{\"regular\": \"', {price}, '\"}}}}]}}')"
        f" ELSE concat('<a href=\"/cat/1/p/x-', user_id, '\" title=\"Товар ', user_id, '\">Цена ', {price}, ' ₽',"
        f" CASE WHEN {sold_out} THEN ' Нет в наличии' ELSE '' END, '</a>') END AS body",
    )


def captured_responses(events: DataFrame) -> DataFrame:
    """Network responses of one page per user and day; events are the responses."""
    return events.selectExpr(
        "concat('https://5ka.ru/catalog/u', user_id, '/') AS page_url",
        "date_trunc('day', cast(ts AS timestamp)) AS fetched_at",
        "cast(event_id AS int) AS seq",
        "CASE WHEN event_id % 4 = 0 OR (event_id % 4 = 3 AND event_type = 'view')"
        " THEN concat('https://5d.5ka.ru/api/catalog/v2/', event_id)"
        " WHEN event_id % 4 = 1 THEN concat('https://5ka.ru/static/', event_id, '.css')"
        " WHEN event_id % 4 = 2 THEN concat('https://mc.example.com/pixel/', event_id)"
        " ELSE concat('https://example.com/catalog.js?', event_id) END AS url",
        "CASE event_type WHEN 'purchase' THEN 403 WHEN 'error' THEN 500 ELSE 200 END AS status",
        "CASE WHEN event_type = 'click' THEN 'text/html' ELSE 'application/json' END AS content_type",
        "CASE event_type WHEN 'view' THEN concat('{\"products\": [{\"plu\": ', event_id, ', \"name\": \"Товар ', user_id,"
        " '\", \"is_available\": true, \"prices\": {\"regular\": \"', format_string('%.2f', value), '\"}}]}')"
        " WHEN 'click' THEN '  <HTML>no</HTML>' WHEN 'signup' THEN '' WHEN 'purchase' THEN '{}'"
        " ELSE '[\"Проверьте настройки интернета и VPN\"]' END AS body",
    )


def capture_pages(events: DataFrame) -> DataFrame:
    """The pages those responses belong to; some are block pages."""
    return (
        events.selectExpr("user_id", "date_trunc('day', cast(ts AS timestamp)) AS fetched_at")
        .distinct()
        .selectExpr(
            "concat('https://5ka.ru/catalog/u', user_id, '/') AS page_url",
            "fetched_at",
            "200 AS http_status",
            "'text/html' AS content_type",
            "CASE WHEN user_id % 11 = 0 THEN '<html>Service_connect@x5.ru</html>' ELSE '<html>ok</html>' END AS body",
        )
    )


def shops(nation: DataFrame) -> DataFrame:
    return nation.selectExpr(
        "cast(n_nationkey AS bigint) AS id",
        "n_name AS name",
        "concat('https://', lower(replace(n_name, ' ', '-')), '.example') AS base_url",
    )


def products(part: DataFrame, n_shops: int = 3) -> DataFrame:
    return part.selectExpr(
        "p_partkey AS id",
        f"p_partkey % {n_shops} AS shop_id",
        "concat('id:', p_partkey) AS product_key",
        "p_name AS name",
        "CASE WHEN p_partkey % 9 <> 0 THEN cast(p_partkey % 300 AS string) END AS internal_product_id",
        "CASE WHEN p_partkey % 4 = 0 THEN concat('M', p_partkey % 50) END AS manufacturer_code",
        "concat('https://shop.example/product/', p_partkey) AS url",
    )


PRICE_ORDER = ["parsed_at", "l_orderkey", "l_suppkey", "l_linenumber"]


def prices(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "l_partkey AS product_id",
        "cast(l_extendedprice AS decimal(10,2)) AS price",
        "l_returnflag <> 'R' AS is_in_stock",
        "l_shipdate AS parsed_at",
        "l_orderkey",
        "l_suppkey",
        "l_linenumber",
    )


def named_products(part: DataFrame) -> DataFrame:
    """Products with the longer names that shops give them, a word or two more or less."""
    return part.selectExpr(
        "p_partkey AS id",
        "concat(p_name, ' ', p_brand, ' ', lower(p_type), ' ', p_size % 5,"
        " CASE p_partkey % 3 WHEN 0 THEN ' new' WHEN 1 THEN ' super offer' ELSE '' END) AS name",
    )
