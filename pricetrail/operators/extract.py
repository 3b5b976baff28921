"""Offers from routed pages.

All work on a page happens inside its row, on arrays: no shuffle, the body is read once for all
shops, and the same code runs in batch and in a stream.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail import schemas
from pricetrail.functions import fixed, html, jsonld, quoted, text, urls
from pricetrail.operators.routing import CATALOG_RULES, PRODUCT_RULES, Rule, route

_PAGE = ["page_url", "fetched_at", "rule", "shop_base_url"]
_NO_OFFERS = f"cast(array() AS array<{schemas.PAGE_OFFER}>)"


def _offer(position, name, price, url="NULL", product_id="NULL", maker_code="NULL", in_stock="true") -> str:
    fields = {
        "position": position,
        "name": name,
        "price": price,
        "url": url,
        "internal_product_id": product_id,
        "manufacturer_code": maker_code,
        "is_in_stock": in_stock,
    }
    inside = ", ".join(f"'{field}', {value}" for field, value in fields.items())
    return f"cast(named_struct({inside}) AS {schemas.PAGE_OFFER})"


def _complete(offers: str, *extra: str) -> str:
    """Offers with name, price and the extra fields."""
    present = " AND ".join(f"o.{field} IS NOT NULL" for field in ("name", "price", *extra))
    return f"filter({offers}, o -> {present})"


def _links(anchors: str, origin: str, is_product) -> str:
    """Product links of a page: position, absolute URL, attributes, normalised text.

    Each stage works a value out once and hands it on as a field.
    """
    href = urls.trimmed_href(html.attribute_text("a.attributes", "href"))
    with_href = (
        f"transform({anchors}, a -> named_struct('position', a.position, 'href', {href},"
        " 'attributes', a.attributes, 'markup', a.markup))"
    )
    usable = f"filter({with_href}, a -> {urls.is_usable_href('a.href')})"
    absolute = (
        f"transform({usable}, a -> named_struct('position', a.position,"
        f" 'url', {urls.absolute('a.href', 'page_url', origin)}, 'attributes', a.attributes, 'markup', a.markup))"
    )
    products = f"filter({absolute}, a -> {is_product('a.url')})"
    words = text.normalize(html.text_content("a.markup"))
    return (
        f"transform({products}, a -> named_struct('position', a.position, 'url', a.url,"
        f" 'attributes', a.attributes, 'text', coalesce({words}, '')))"
    )


def magnit_catalog_offers(anchors: str) -> str:
    links = _links(anchors, quoted(fixed.MAGNIT[1]), urls.is_magnit_product)
    priced = f"filter({links}, a -> {text.has_price('a.text')})"
    offer = _offer(
        "a.position",
        text.name_after_price("a.text"),
        text.first_price("a.text"),
        "a.url",
        urls.magnit_catalog_id("a.url"),
    )
    return _complete(f"transform({priced}, a -> {offer})")


def perekrestok_link_offers(anchors: str) -> str:
    links = _links(anchors, urls.page_origin("page_url"), urls.is_perekrestok_product)
    labels = [text.normalize(html.attribute_text("a.attributes", name)) for name in fixed.NAME_ATTRIBUTES]
    offer = _offer(
        "a.position",
        f"coalesce({', '.join(labels)}, {text.cleaned_name('a.text')})",
        text.first_positive_price("a.text"),
        "a.url",
        urls.perekrestok_id("a.url"),
        in_stock=f"NOT rlike(a.text, {quoted('(?iu)' + fixed.NOT_IN_STOCK_TEXT)})",
    )
    return _complete(f"transform({links}, a -> {offer})")


def perekrestok_ld_offers(facts: str) -> str:
    url = urls.absolute(text.normalize("f.url"), "page_url", urls.page_origin("page_url"))
    located = f"transform({facts}, (f, i) -> named_struct('position', i, 'url', {url}, 'fact', f))"
    products = f"filter({located}, f -> {urls.is_perekrestok_product('f.url')})"
    prices = f"transform(f.fact.prices, n -> {text.numeric_price('n')})"
    offer = _offer(
        "f.position",
        text.normalize("f.fact.name"),
        text.first_of(prices),
        "f.url",
        urls.perekrestok_id("f.url"),
        text.normalize("f.fact.manufacturer_code"),
        "NOT f.fact.sold_out",
    )
    return _complete(f"transform({products}, f -> {offer})")


def _variant(value: str, path: str, kind: str) -> str:
    return f"try_variant_get({value}, '$.{path}', '{kind}')"


def _variant_type(value: str, path: str) -> str:
    return f"schema_of_variant({_variant(value, path, 'variant')})"


def catalog_json_products(document: str) -> str:
    """Elements of ``products`` as variants, whether it is an array or an object; else null."""
    as_array = _variant(document, "products", "array<variant>")
    as_object = _variant(document, "products", "map<string,variant>")
    return f"coalesce({as_array}, map_values({as_object}))"


def _is_true(product: str, path: str) -> str:
    """Truth of a JSON value: empty text, "0", zero, empty arrays and objects and null are false."""
    kind = _variant_type(product, path)
    return (
        f"CASE WHEN {kind} = 'STRING' THEN {_variant(product, path, 'string')} NOT IN ('', '0')"
        f" WHEN startswith({kind}, 'ARRAY') OR startswith({kind}, 'OBJECT')"
        f" THEN to_json({_variant(product, path, 'variant')}) NOT IN ('[]', '{{}}')"
        f" ELSE coalesce({_variant(product, path, 'boolean')}, false) END"
    )


def pyaterochka_offers(products: str) -> str:
    """Offers from catalogue JSON. A product that is malformed is skipped alone."""
    prices = ", ".join(
        text.numeric_price(_variant("r", f"prices.{field}", "string")) for field in fixed.CATALOG_PRICE_FIELDS
    )
    name = f"CASE WHEN {_variant_type('r', 'name')} = 'STRING' THEN {_variant('r', 'name', 'string')} END"
    offer = _offer(
        "i",
        text.normalize(name),
        f"coalesce({prices})",
        product_id=f"nullif({_variant('r', 'plu', 'string')}, '')",
        in_stock=_is_true("r", "is_available"),
    )
    return _complete(f"transform({products}, (r, i) -> {offer})", "internal_product_id")


def _first_per_url(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Keep the first offer per URL in the page; offers without a URL all stay.

    Sorting makes equal URLs neighbours, so this is n log n per page and needs no shuffle. The
    sorted array is a column of its own: the comparison reads it twice.
    """
    by_url = f"array_sort(transform({column}, o -> named_struct('url', o.url, 'position', o.position, 'offer', o)))"
    is_first = "s.url IS NULL OR i = 0 OR NOT (s.url <=> get(_by_url, i - 1).url)"
    return df.selectExpr(*keep, f"{by_url} AS _by_url").selectExpr(
        *keep, f"transform(filter(_by_url, (s, i) -> {is_first}), s -> s.offer) AS {column}"
    )


_LOADED = "coalesce(http_status BETWEEN 200 AND 299, false)"
_HTTP_REASON = "concat('page did not load: HTTP ', coalesce(cast(http_status AS string), '-'))"


def _reject(*cases: tuple[str, str, str]) -> str:
    """Stage and reason of the first case that holds; null for a good page."""
    whens = " ".join(
        f"WHEN {condition} THEN named_struct('stage', '{stage}', 'reason', {reason})"
        for condition, stage, reason in cases
    )
    return f"CASE {whens} END AS _reject"


def _is_closed(body: str) -> str:
    """The whole body looks like one JSON array or object; a mere scalar is not a catalogue."""
    return (
        f"coalesce(rlike({body}, {quoted(r'(?s)^[ \t\n\r]*[{].*[}][ \t\n\r]*$')})"
        f" OR rlike({body}, {quoted(r'(?s)^[ \t\n\r]*[\[].*[\]][ \t\n\r]*$')}), false)"
    )


# What Spark's JSON documents hold at most.
_MOST_JSON_BYTES = 128 << 20


def extract_catalog(
    pages: DataFrame, more_rules: list[Rule] | None = None, more_offers: dict[str, str] | None = None
) -> DataFrame:
    """Catalogue pages to one row per page: ``offers`` array, or ``stage`` and ``reason`` of the reject.

    A page may bring ``capture_reject`` (see ``responses.catalog_payloads``); its body is then the
    captured payload. Further shops come as rules behind the built-in ones, each with a SQL
    expression over ``body`` and ``page_url`` that gives an array of offers.
    """
    # Of a key that an object holds twice the last value counts, as in most JSON readers.
    pages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    if "capture_reject" not in pages.columns:
        pages = pages.withColumn("capture_reject", F.lit(None).cast("string"))
    state = [*_PAGE, "http_status", "capture_reject"]
    usable = f"{_LOADED} AND capture_reject IS NULL"
    is_json = f"{usable} AND rule = 'pyaterochka_catalog'"
    added = " ".join(
        f"WHEN {quoted(name)} THEN cast({offers} AS array<{schemas.PAGE_OFFER}>)"
        for name, offers in (more_offers or {}).items()
    )
    read = route(pages, "catalog", [*CATALOG_RULES, *(more_rules or [])]).selectExpr(
        *state,
        f"CASE WHEN {usable} AND rule IN ('magnit_catalog', 'perekrestok_catalog')"
        f" THEN {html.anchors('body')} END AS _anchors",
        f"CASE WHEN {usable} AND rule = 'perekrestok_catalog' THEN {html.ld_json_scripts('body')} END AS _scripts",
        f"CASE WHEN {is_json} THEN try_parse_json(body) END AS _json",
        f"CASE WHEN {is_json} THEN body END AS _payload",
        f"CASE WHEN {usable} THEN CASE rule {added} END END AS _added" if added else "NULL AS _added",
    ).selectExpr(
        *state,
        "_anchors",
        "_scripts",
        f"{_is_closed('_payload')} AND _json IS NOT NULL AS _is_json",
        f"CASE WHEN NOT {_is_closed('_payload')} THEN 'HTML instead of JSON'"
        f" WHEN octet_length(_payload) > {_MOST_JSON_BYTES} THEN 'JSON is too large'"
        " WHEN _json IS NULL THEN 'JSON cannot be decoded' END AS _fault",
        f"{catalog_json_products('_json')} AS _products",
        "_added",
    )
    located = read.withColumn("_facts", jsonld.listed_facts(F.col("_scripts"))).selectExpr(
        "*", f"CASE WHEN size(_facts) > 0 THEN {perekrestok_ld_offers('_facts')} END AS _ld"
    )
    kept = [*state, "_is_json", "_fault", "_listed"]
    found = located.selectExpr(
        *state,
        "_is_json",
        "_fault",
        "coalesce(size(_products), 0) AS _listed",
        f"coalesce(CASE WHEN rule = 'magnit_catalog' THEN {magnit_catalog_offers('_anchors')}"
        " WHEN size(_ld) > 0 THEN _ld"
        f" WHEN rule = 'perekrestok_catalog' THEN {perekrestok_link_offers('_anchors')}"
        f" WHEN rule = 'pyaterochka_catalog' AND _is_json THEN {pyaterochka_offers('_products')}"
        f" ELSE _added END, {_NO_OFFERS}) AS offers",
    )
    deduped = _first_per_url(found, "offers", kept)
    return deduped.selectExpr(
        *_PAGE,
        "offers",
        _reject(
            ("rule IS NULL", "route", "'no rule for this catalogue URL'"),
            (f"NOT {_LOADED}", "http", _HTTP_REASON),
            ("capture_reject IS NOT NULL", "capture", "capture_reject"),
            ("rule = 'pyaterochka_catalog' AND NOT _is_json", "decode", "_fault"),
            ("rule = 'pyaterochka_catalog' AND _listed <= 0", "extract", "'catalogue holds no products'"),
            ("size(offers) = 0", "extract", "'no offers found'"),
        ),
    ).selectExpr(*_PAGE, "offers", "_reject.stage AS stage", "_reject.reason AS reason")


def _text_of(element: str) -> str:
    """Normalised text of an element; "0" counts as nothing."""
    return f"nullif({text.normalize(html.text_content(element))}, '0')"


def _content_of(element: str) -> str:
    return html.attribute_text(html.tag_attributes(element), "content")


def extract_product(
    pages: DataFrame, more_rules: list[Rule] | None = None, more_offers: dict[str, str] | None = None
) -> DataFrame:
    """Product pages to one row per page with at most one offer.

    Further shops come as rules behind the built-in ones, each with a SQL expression over ``body``
    and ``page_url`` that gives an array of offers; the first complete one counts.
    """
    state = [*_PAGE, "http_status", "_added"]
    added = " ".join(
        f"WHEN {quoted(name)} THEN cast({offers} AS array<{schemas.PAGE_OFFER}>)"
        for name, offers in (more_offers or {}).items()
    )
    body = f"CASE WHEN rule IS NOT NULL AND {_LOADED} THEN body END"
    read = route(pages, "product", [*PRODUCT_RULES, *(more_rules or [])]).selectExpr(
        *[name for name in state if name != "_added"],
        f"get({_complete(f'CASE WHEN {_LOADED} THEN CASE rule {added} END END')}, 0) AS _added"
        if added
        else f"cast(NULL AS {schemas.PAGE_OFFER}) AS _added",
        f"{html.without_comments_and_code(body)} AS _clean",
        f"{html.ld_json_scripts(body)} AS _scripts",
    )
    scanned = read.selectExpr(
        *state,
        "_clean",
        "_scripts",
        f"{html.elements('_clean', 'h1')} AS _h1",
        f"{html.void_elements('_clean', 'meta')} AS _meta",
        f"get({html.elements('_clean', 'title')}, 0) AS _title",
        f"{html.first_with_attribute(html.opening_tags_naming('_clean', 'itemprop'), 'itemprop', 'price')} AS _priced",
    )
    picked = scanned.selectExpr(
        *state,
        "_scripts",
        f"{html.first_with_attribute('_h1', 'data-test-id', fixed.NAME_HEADING_TEST_ID)} AS _name_h1",
        "get(_h1, 0) AS _first_h1",
        f"{html.first_with_attribute('_meta', 'property', 'og:title')} AS _og_title",
        "_title",
        f"{html.first_with_attribute('_meta', 'itemprop', 'price')} AS _meta_price",
        f"nullif(nullif({_content_of('_priced')}, ''), '0') AS _priced_content",
        f"{html.inner_markup('_clean', '_priced')} AS _priced_markup",
    )
    priced_text = f"coalesce(_priced_content, {html.text_content('_priced_markup')})"
    facts = picked.withColumn("_ld", jsonld.product_facts(F.col("_scripts"))).selectExpr(
        *state,
        f"coalesce(_added.name, {_text_of('_name_h1')}, {_text_of('_first_h1')},"
        f" nullif({text.normalize(_content_of('_og_title'))}, '0'), {_text_of('_title')}, _ld.name) AS _name",
        f"coalesce(_added.price, {text.scalar_price(_content_of('_meta_price'))}, {text.scalar_price(priced_text)},"
        f" {text.first_of(f'transform(_ld.prices, n -> {text.scalar_price("n")})')}) AS _price",
        f"coalesce(_ld.internal_product_id, {urls.magnit_product_id('page_url')}) AS _id",
        "_ld.manufacturer_code AS _maker",
    )
    return facts.selectExpr(
        *_PAGE,
        f"array(coalesce(_added, {_offer('0', '_name', '_price', product_id='_id', maker_code='_maker')})) AS offers",
        _reject(
            ("rule IS NULL", "route", "'no rule for this product URL'"),
            (f"NOT {_LOADED}", "http", _HTTP_REASON),
            ("_name IS NULL", "extract", "'no product name'"),
            ("_price IS NULL", "extract", "'no product price'"),
        ),
    ).selectExpr(
        *_PAGE,
        f"CASE WHEN _reject IS NULL THEN offers ELSE {_NO_OFFERS} END AS offers",
        "_reject.stage AS stage",
        "_reject.reason AS reason",
    )


_FITS = "try_cast(o.price AS decimal(10,2))"


def _exploded(extracted: DataFrame) -> DataFrame:
    """Offers as rows. The outer form: for the inner one Spark infers a filter on the array's size
    and pushes it below the projections, which works every page out twice."""
    return extracted.selectExpr("shop_base_url", "page_url", "fetched_at", "explode_outer(offers) AS o")


def offers(extracted: DataFrame) -> DataFrame:
    """One row per offer whose price fits decimal(10,2)."""
    return (
        _exploded(extracted)
        .where(f"{_FITS} IS NOT NULL")
        .selectExpr(
            "shop_base_url",
            "page_url",
            "fetched_at AS observed_at",
            "o.position",
            "o.name",
            f"{_FITS} AS price",
            "o.url",
            "o.internal_product_id",
            "o.manufacturer_code",
            "o.is_in_stock",
        )
    )


def rejects(extracted: DataFrame) -> DataFrame:
    """Pages that gave nothing, and single offers whose price does not fit."""
    pages = extracted.where("stage IS NOT NULL").select("page_url", "fetched_at", "stage", "reason")
    oversized = (
        _exploded(extracted)
        .where(f"o IS NOT NULL AND {_FITS} IS NULL")
        .selectExpr(
            "page_url",
            "fetched_at",
            "'price' AS stage",
            "concat('price out of range at position ', o.position) AS reason",
        )
    )
    return pages.unionByName(oversized)
