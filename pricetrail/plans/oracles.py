"""The registered queries' results as SQL over the benchmark tables, for comparison in DuckDB.

Extraction queries are checked against the tables the pages were made from: what went into the
markup has to come out again.
"""

ORACLES: dict[str, str] = {}

_EVENT_OBSERVATIONS = """
SELECT user_id, ts AS observed_at, {price} AS price, event_type <> 'error' AS is_in_stock FROM events
"""
_PLAIN_PRICE = "CAST(value AS DECIMAL(10,2))"
_STEP_PRICE = "CAST(2.24 + least(floor(value / 25), 2) * 0.01 AS DECIMAL(10,2))"


def _fold(source: str, keys: str, order: str) -> str:
    """Rows written by the change test, one recursion step per observation of a key."""
    match = " AND ".join(f"o.{key.strip()} = f.{key.strip()}" for key in keys.split(","))
    key_columns = ", ".join(f"o.{key.strip()}" for key in keys.split(","))
    changed = "(abs(CAST(f.last_price AS DOUBLE) - CAST(o.price AS DOUBLE)) > 0.01 OR f.last_stock <> o.is_in_stock)"
    return f"""
src AS ({source}),
o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM src),
f AS (
  SELECT {keys}, rn, price AS last_price, is_in_stock AS last_stock, true AS wrote FROM o WHERE rn = 1
  UNION ALL
  SELECT {key_columns}, o.rn,
    CASE WHEN {changed} THEN o.price ELSE f.last_price END,
    CASE WHEN {changed} THEN o.is_in_stock ELSE f.last_stock END,
    {changed}
  FROM f JOIN o ON {match} AND o.rn = f.rn + 1
),
written AS (SELECT o.* FROM o JOIN f ON {match} AND o.rn = f.rn WHERE f.wrote)
"""


def _event_history(price: str, user: str = "user_id") -> str:
    source = _EVENT_OBSERVATIONS.format(price=price).replace("SELECT user_id", f"SELECT {user} AS user_id")
    return f"""WITH RECURSIVE {_fold(source, "user_id", "observed_at")}
SELECT user_id, observed_at, CAST(price AS DOUBLE) AS price, is_in_stock FROM written"""


ORACLES["change_history_rows"] = _event_history(_PLAIN_PRICE)
ORACLES["change_history_one_cent_steps"] = _event_history(_STEP_PRICE)
ORACLES["change_history_single_product"] = _event_history(_STEP_PRICE, "CAST(1 AS BIGINT)")
ORACLES["change_test"] = """
SELECT event_id,
  event_id % 10 = 0 OR (event_id % 7 <> 0) <> (event_type <> 'error')
    OR abs(CAST(CAST(1 + (event_id % 400) * 0.01 AS DECIMAL(10,2)) AS DOUBLE)
         - CAST(CAST(1 + (event_id % 400 + user_id % 3) * 0.01 AS DECIMAL(10,2)) AS DOUBLE)) > 0.01 AS changes
FROM events"""
ORACLES["change_history_in_two_loads"] = _event_history(_STEP_PRICE)
ORACLES["latest_price_after_history"] = f"""
SELECT * FROM ({_event_history(_PLAIN_PRICE)})
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY observed_at DESC) = 1"""

_SHOP_OF_EVENT = """CASE user_id % 3 WHEN 0 THEN 'https://magnit.ru' WHEN 1 THEN 'https://5ka.ru'
  ELSE 'https://www.perekrestok.ru' END"""
_PAGE_EVENTS = f"""
SELECT {_SHOP_OF_EVENT} AS shop_base_url, 'id:' || user_id AS product_key, ts AS observed_at,
  'Товар ' || user_id AS name, {_STEP_PRICE} AS price,
  event_type <> 'error' OR user_id % 3 = 0 AS is_in_stock
FROM events"""
ORACLES["pages_to_history"] = f"""
WITH RECURSIVE {_fold(_PAGE_EVENTS, "shop_base_url, product_key", "observed_at")}
SELECT shop_base_url, product_key, observed_at, name, CAST(price AS DOUBLE) AS price, is_in_stock FROM written"""

ORACLES["url_parts"] = """
SELECT page_id, regexp_extract(url, '^[a-z]+://([^:/?#]*)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path
FROM pages"""

ORACLES["route_catalog_pages"] = """
SELECT event_id, rule,
  CASE rule WHEN 'magnit_catalog' THEN 'https://magnit.ru' WHEN 'pyaterochka_catalog' THEN 'https://5ka.ru'
    WHEN 'perekrestok_catalog' THEN 'https://www.perekrestok.ru' END AS shop_base_url,
  CASE WHEN event_id % 8 IN (0, 1, 5) THEN 'magnit_product' END AS product_rule
FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'magnit_catalog' WHEN 5 THEN 'magnit_catalog'
    WHEN 2 THEN 'pyaterochka_catalog' WHEN 3 THEN 'perekrestok_catalog' END AS rule FROM events)"""


def _decoded(text: str) -> str:
    for entity, character in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{character}')"
    return text


def _normal(text: str) -> str:
    return f"nullif(trim(regexp_replace({text}, '\\s+', ' ', 'g')), '')"


ORACLES["page_links"] = f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS position, href,
  'https://' || regexp_extract(page_url, '^[a-z]+://([^:/?#]*)', 1) || href AS url, label
FROM (
  SELECT page_id, page_url, i, {_decoded("hrefs[i]")} AS href, {_normal(_decoded("labels[i]"))} AS label
  FROM (
    SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM (
      SELECT page_id, url AS page_url,
        regexp_extract_all(html, '(?is)<a href="([^"]*)">(.*?)</a>', 1) AS hrefs,
        regexp_extract_all(html, '(?is)<a href="([^"]*)">(.*?)</a>', 2) AS labels
      FROM pages)))"""

ORACLES["product_links"] = """
SELECT p_partkey, p_partkey % 6 < 3 AS magnit_link, p_partkey % 6 IN (3, 4) AS perekrestok_link,
  CASE WHEN p_partkey % 6 < 3 THEN CAST(p_partkey AS VARCHAR)
    WHEN p_partkey % 6 IN (3, 4) THEN '12' END AS magnit_catalog_id,
  CASE WHEN p_partkey % 6 IN (1, 2) THEN CAST(p_partkey AS VARCHAR) END AS magnit_product_id,
  CASE WHEN p_partkey % 6 IN (3, 4) THEN CAST(p_partkey AS VARCHAR) END AS perekrestok_id
FROM part"""

ORACLES["first_elements"] = f"""
SELECT page_id,
  {_normal(_decoded("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))} AS h1,
  {_normal(_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title,
  substring(html, 1, 500) AS preview
FROM pages"""

ORACLES["loaded_and_failed_pages"] = """
SELECT CASE WHEN page_id % 3 <> 0 THEN 'https://magnit.ru/catalog/' || page_id ELSE url END AS page_url,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) AS fetched_at,
  CASE WHEN page_id % 3 = 0 THEN 'route' WHEN page_id % 7 = 3 OR page_id % 11 = 5 THEN 'http' ELSE 'extract' END AS stage,
  CASE WHEN page_id % 3 = 0 THEN 'no rule for this catalogue URL'
    WHEN page_id % 7 = 3 THEN 'page did not load: HTTP 404'
    WHEN page_id % 11 = 5 THEN 'page did not load: HTTP 503' ELSE 'no offers found' END AS reason
FROM pages"""

ORACLES["price_texts"] = """
SELECT p_partkey, CAST(0 AS DOUBLE) AS first_price, round(p_retailprice, 2) AS first_positive_price,
  CASE p_partkey % 4 WHEN 0 THEN round(p_retailprice, 2) WHEN 1 THEN round(p_retailprice, 2)
    WHEN 2 THEN CAST('1' || p_size AS DOUBLE) END AS scalar_price,
  CASE WHEN p_partkey % 2 = 0 THEN round(p_retailprice, 2) END AS numeric_price
FROM part"""

_OFFER_OUT = """CAST(p_partkey AS VARCHAR) AS internal_product_id, round(p_retailprice, 2) AS price"""

ORACLES["magnit_catalog_offers"] = f"""
SELECT 'https://magnit.ru' AS shop_base_url, {_OFFER_OUT},
  CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_partkey || ' г'
    WHEN 2 THEN p_name || ' №' || p_partkey ELSE p_name || ' арт ' || p_partkey END AS name,
  'https://magnit.ru/product/' || p_partkey || '-tovar?shopCode=1' AS url,
  CAST(NULL AS VARCHAR) AS manufacturer_code, true AS is_in_stock
FROM part"""

ORACLES["perekrestok_catalog_offers"] = f"""
SELECT 'https://www.perekrestok.ru' AS shop_base_url, {_OFFER_OUT},
  CASE WHEN (p_partkey // 500) % 2 = 1 THEN p_name
    WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN p_name || ' & ко'
    WHEN p_partkey % 4 = 2 THEN p_name || ' №' || p_partkey ELSE p_name || ' нет в наличии' END AS name,
  CASE WHEN p_partkey % 7 = 0 THEN 'https://promo.perekrestok.ru/cat/c/1/p/tovar-' || p_partkey || '/'
    ELSE 'https://www.perekrestok.ru/cat/1/p/tovar-' || p_partkey END AS url,
  CASE WHEN (p_partkey // 500) % 2 = 1 AND p_partkey % 2 = 0 THEN 'M' || p_partkey END AS manufacturer_code,
  CASE WHEN (p_partkey // 500) % 2 = 1 THEN p_partkey % 3 <> 2 ELSE p_partkey % 4 <> 3 END AS is_in_stock
FROM part"""

ORACLES["pyaterochka_catalog_offers"] = f"""
SELECT 'https://5ka.ru' AS shop_base_url, {_OFFER_OUT}, p_name || ' ' || p_type AS name,
  CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS manufacturer_code,
  p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AS is_in_stock
FROM part"""

ORACLES["magnit_product_offers"] = """
SELECT 'https://magnit.ru' AS shop_base_url, round(p_retailprice, 2) AS price,
  CASE p_partkey % 5 WHEN 2 THEN 'S' || p_partkey WHEN 3 THEN CAST(p_partkey + 1 AS VARCHAR)
    ELSE CAST(p_partkey AS VARCHAR) END AS internal_product_id,
  CASE p_partkey % 5 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN p_name || ' «' || p_brand || '»'
    ELSE p_name END AS name,
  CAST(NULL AS VARCHAR) AS url,
  CASE p_partkey % 5 WHEN 2 THEN 'M' || p_partkey WHEN 3 THEN 'G' || p_partkey END AS manufacturer_code,
  true AS is_in_stock
FROM part"""

ORACLES["extraction_rejects"] = """
SELECT CASE p_partkey % 8 WHEN 0 THEN 'https://example.com/' || p_partkey
    WHEN 1 THEN 'https://magnit.ru/catalog/' || p_partkey
    WHEN 2 THEN 'https://www.perekrestok.ru/cat/' || p_partkey
    ELSE 'https://5ka.ru/catalog/' || p_partkey END AS page_url,
  CASE p_partkey % 8 WHEN 0 THEN 'route' WHEN 1 THEN 'http' WHEN 3 THEN 'decode' WHEN 6 THEN 'price'
    ELSE 'extract' END AS stage,
  CASE p_partkey % 8 WHEN 0 THEN 'no rule for this catalogue URL' WHEN 1 THEN 'page did not load: HTTP 404'
    WHEN 3 THEN 'HTML instead of JSON' WHEN 4 THEN 'catalogue holds no products'
    WHEN 6 THEN 'price out of range at position 0' ELSE 'no offers found' END AS reason
FROM part WHERE p_partkey % 8 <> 7"""

_RESPONSES = """
SELECT user_id, 'https://5ka.ru/catalog/u' || user_id || '/' AS page_url, date_trunc('day', ts) AS fetched_at,
  CAST(event_id AS INTEGER) AS seq, event_type, value,
  CASE WHEN event_id % 4 = 0 OR (event_id % 4 = 3 AND event_type = 'view')
      THEN 'https://5d.5ka.ru/api/catalog/v2/' || event_id
    WHEN event_id % 4 = 1 THEN 'https://5ka.ru/static/' || event_id || '.css'
    WHEN event_id % 4 = 2 THEN 'https://mc.example.com/pixel/' || event_id
    ELSE 'https://example.com/catalog.js?' || event_id END AS url,
  CASE event_type WHEN 'purchase' THEN 403 WHEN 'error' THEN 500 ELSE 200 END AS status,
  CASE WHEN event_type = 'click' THEN 'text/html' ELSE 'application/json' END AS content_type,
  CASE event_type WHEN 'view' THEN '{"products": [{"plu": ' || event_id || ', "name": "Товар ' || user_id
      || '", "is_available": true, "prices": {"regular": "' || CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) || '"}}]}'
    WHEN 'click' THEN '  <HTML>no</HTML>' WHEN 'signup' THEN '' WHEN 'purchase' THEN '{}'
    ELSE '["Проверьте настройки интернета и VPN"]' END AS body,
  CASE event_type WHEN 'click' THEN 'block page' WHEN 'error' THEN 'block page' WHEN 'signup' THEN 'unknown'
    ELSE 'json' END AS kind,
  event_type IN ('click', 'error', 'purchase') AS refused
FROM events"""

ORACLES["response_log"] = f"""
SELECT seq, url, status, substring(body, 1, 500) AS preview FROM ({_RESPONSES}) WHERE seq % 4 <> 2"""

ORACLES["response_tests"] = f"""
SELECT seq, event_type = 'error' AS page_blocked, refused, kind FROM ({_RESPONSES})"""

_FIRST = f"""
SELECT * FROM ({_RESPONSES}) WHERE url LIKE '%/api/catalog/%'
QUALIFY row_number() OVER (PARTITION BY page_url, fetched_at ORDER BY seq) = 1"""

ORACLES["first_matching_responses"] = f"SELECT page_url, fetched_at, seq, url, status FROM ({_FIRST})"

_CAPTURED = f"""
SELECT p.page_url, p.fetched_at, p.user_id, p.user_id % 11 = 0 AS blocked,
  CASE WHEN p.user_id % 11 <> 0 THEN m.seq END AS seq, m.url, m.status, m.content_type, m.body, m.event_type, m.value,
  CASE WHEN p.user_id % 11 = 0 THEN 'block page' ELSE m.kind END AS response_kind,
  CASE WHEN p.user_id % 11 = 0 THEN 'page' WHEN m.refused THEN 'api' END AS block_stage,
  CASE WHEN p.user_id % 11 = 0 THEN 'page is blocked before the catalogue loads'
    WHEN m.seq IS NULL THEN 'timeout waiting for the catalogue response'
    WHEN m.refused THEN 'catalogue API is blocked after the page loads' END AS capture_reject
FROM (SELECT DISTINCT user_id, page_url, fetched_at FROM ({_RESPONSES})) p
LEFT JOIN ({_FIRST}) m ON m.page_url = p.page_url AND m.fetched_at = p.fetched_at"""

ORACLES["capture_outcomes"] = f"""
SELECT page_url, fetched_at, seq, response_kind, block_stage, capture_reject FROM ({_CAPTURED})"""

ORACLES["capture_report"] = f"""
WITH c AS ({_CAPTURED})
SELECT page_url, fetched_at, CAST(0 AS BIGINT) AS line_no, 'page' AS label, page_url AS text FROM c
UNION ALL SELECT page_url, fetched_at, 1, 'kind', coalesce(response_kind, '-') FROM c
UNION ALL SELECT page_url, fetched_at, 2, 'block stage', coalesce(block_stage, '-') FROM c
UNION ALL SELECT page_url, fetched_at, 3, 'matched', url || ' [status ' || status || ']' FROM c WHERE seq IS NOT NULL
UNION ALL SELECT page_url, fetched_at, 4, 'content type', content_type FROM c WHERE seq IS NOT NULL
UNION ALL SELECT page_url, fetched_at, 5, 'preview', substring(body, 1, 500) FROM c WHERE seq IS NOT NULL AND body <> ''
UNION ALL SELECT page_url, fetched_at, CAST(seq AS BIGINT) + 1000, 'network', url || ' [' || status || '] ' || content_type
  FROM ({_RESPONSES}) WHERE seq % 4 <> 2"""

ORACLES["captured_offers"] = f"""
SELECT 'https://5ka.ru' AS shop_base_url, CAST(seq AS VARCHAR) AS internal_product_id, 'Товар ' || user_id AS name,
  CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS url,
  CAST(NULL AS VARCHAR) AS manufacturer_code, true AS is_in_stock
FROM ({_CAPTURED}) WHERE seq IS NOT NULL AND event_type = 'view'"""

ORACLES["shops_created"] = """
SELECT CASE user_id % 3 WHEN 0 THEN 'stored name' WHEN 1 THEN 'Пятёрочка' ELSE 'Перекрёсток' END AS name,
  CASE user_id % 3 WHEN 0 THEN 'https://magnit.ru' WHEN 1 THEN 'https://5ka.ru' ELSE 'https://www.perekrestok.ru' END AS base_url,
  CASE user_id % 3 WHEN 0 THEN 'stored rule' WHEN 1 THEN 'pyaterochka_catalog' ELSE 'perekrestok_catalog' END AS product_parser,
  min(ts) AS created_at
FROM events GROUP BY ALL"""

_LINES = """
SELECT l_suppkey % 3 AS shop_id,
  'https://shop' || (l_suppkey % 3) || '.example/catalog/' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '/'
    || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS page_url,
  l_shipdate AS observed_at, l_linenumber AS position, p_name || ' ' || (l_linenumber % 3) AS name,
  CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
  'https://shop' || (l_suppkey % 3) || '.example/product/' || l_partkey AS url,
  CASE WHEN l_partkey % 5 <> 0 AND l_linenumber <> 3 THEN CAST(l_partkey AS VARCHAR) END AS iid,
  CASE WHEN l_returnflag = 'A' THEN 'M' || l_partkey END AS manufacturer_code,
  l_returnflag <> 'R' AS is_in_stock
FROM lineitem JOIN part ON l_partkey = p_partkey"""

_ID_CTES = f"""
lines AS ({_LINES}),
early AS (SELECT * FROM lines WHERE observed_at < TIMESTAMP '1999-01-01'),
early_ids AS (SELECT shop_id, url, min('id:' || iid) AS known FROM early WHERE iid IS NOT NULL GROUP BY ALL),
early_keyed AS (
  SELECT e.*, coalesce('id:' || e.iid, i.known, 'url:' || e.url) AS product_key
  FROM early e LEFT JOIN early_ids i ON e.shop_id = i.shop_id AND e.url = i.url)
"""

ORACLES["products_upserted"] = f"""
WITH {_ID_CTES},
first_load AS (
  SELECT *, CASE WHEN product_key LIKE 'id:%' THEN substring(product_key, 4) END AS internal_product_id,
    min(observed_at) OVER (PARTITION BY shop_id, product_key) AS created_at
  FROM early_keyed
  QUALIFY row_number() OVER (PARTITION BY shop_id, product_key ORDER BY observed_at DESC, page_url DESC, position DESC) = 1),
late AS (SELECT * FROM lines WHERE observed_at >= TIMESTAMP '1999-01-01'),
known AS (
  SELECT shop_id, url, min(k) AS known FROM (
    SELECT shop_id, url, CASE WHEN internal_product_id IS NULL THEN '0' ELSE '1' END || product_key AS k FROM first_load
    UNION ALL SELECT shop_id, url, '2id:' || iid FROM late WHERE iid IS NOT NULL) GROUP BY ALL),
late_keyed AS (
  SELECT e.*, coalesce('id:' || e.iid, substring(k.known, 2), 'url:' || e.url) AS product_key
  FROM late e LEFT JOIN known k ON e.shop_id = k.shop_id AND e.url = k.url),
second_load AS (
  SELECT *, CASE WHEN product_key LIKE 'id:%' THEN substring(product_key, 4) END AS internal_product_id,
    min(observed_at) OVER (PARTITION BY shop_id, product_key) AS created_at
  FROM late_keyed
  QUALIFY row_number() OVER (PARTITION BY shop_id, product_key ORDER BY observed_at DESC, page_url DESC, position DESC) = 1)
SELECT coalesce(n.shop_id, o.shop_id) AS shop_id, coalesce(n.product_key, o.product_key) AS product_key,
  coalesce(n.name, o.name) AS name, coalesce(n.internal_product_id, o.internal_product_id) AS internal_product_id,
  CASE WHEN n.product_key IS NULL THEN o.manufacturer_code ELSE n.manufacturer_code END AS manufacturer_code,
  coalesce(n.url, o.url) AS url, coalesce(o.created_at, n.created_at) AS created_at,
  coalesce(n.observed_at, o.observed_at) AS updated_at, o.product_key IS NULL AS created
FROM first_load o FULL JOIN second_load n ON o.shop_id = n.shop_id AND o.product_key = n.product_key"""

ORACLES["load_counters"] = f"""
WITH RECURSIVE {_ID_CTES.replace("1999-01-01", "2999-01-01")},
{_fold("SELECT * FROM early_keyed", "shop_id, product_key", "observed_at, page_url, position")},
flags AS (
  SELECT page_url, observed_at, 1 AS found, CASE WHEN rn = 1 THEN 1 ELSE 0 END AS created, 0 AS history FROM o
  UNION ALL SELECT page_url, observed_at, 0, 0, 1 FROM written)
SELECT page_url, observed_at, CAST(sum(found) AS BIGINT) AS offers_found,
  CAST(sum(created) AS BIGINT) AS products_created, CAST(sum(history) AS BIGINT) AS history_rows
FROM flags GROUP BY ALL"""

_SHOP_URL = "'https://' || lower(replace(n_name, ' ', '-')) || '.example'"
ORACLES["products_with_shop"] = f"""
SELECT p_partkey AS id, p_name AS name, n_name AS shop_name, {_SHOP_URL} AS base_url
FROM part JOIN nation ON p_partkey % 25 = n_nationkey"""
ORACLES["products_of_one_shop"] = """
SELECT p_partkey AS id, p_name AS name, p_partkey % 25 AS shop_id FROM part WHERE p_partkey % 25 = 7"""
ORACLES["products_with_prices"] = """
SELECT p_partkey AS product_id, p_name AS name, CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS price,
  l_returnflag <> 'R' AS is_in_stock, l_shipdate AS parsed_at
FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_partkey % 13 <> 0) ON p_partkey = l_partkey"""

_PRICES = """
SELECT l_partkey AS product_id, CAST(l_extendedprice AS DECIMAL(10,2)) AS price, l_returnflag <> 'R' AS is_in_stock,
  l_shipdate AS parsed_at, l_orderkey, l_suppkey, l_linenumber FROM lineitem"""
_PRICE_ORDER = "parsed_at {d}, l_orderkey {d}, l_suppkey {d}, l_linenumber {d}"
_LATEST = f"""
SELECT * FROM ({_PRICES})
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY {_PRICE_ORDER.format(d="DESC")}) = 1"""
ORACLES["latest_price"] = f"""
SELECT product_id, CAST(price AS DOUBLE) AS price, is_in_stock, parsed_at FROM ({_LATEST})"""

_PRODUCTS = """
SELECT p_partkey AS id, p_partkey % 3 AS shop_id, p_name AS name,
  CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 300 AS VARCHAR) END AS internal_product_id,
  CASE WHEN p_partkey % 4 = 0 THEN 'code:M' || (p_partkey % 50) ELSE 'name:' || lower(p_name) END AS canonical_key
FROM part"""
ORACLES["duplicate_product_ids"] = f"""
SELECT shop_id, internal_product_id, count(*) AS n_rows FROM ({_PRODUCTS})
WHERE internal_product_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1"""
ORACLES["hash_collisions"] = """
SELECT p_partkey % 1500 AS id FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1"""
ORACLES["orphan_products"] = """
SELECT p_partkey AS id, p_partkey % 30 AS shop_id FROM part
WHERE p_partkey % 30 NOT IN (SELECT n_nationkey FROM nation)"""
ORACLES["orphan_prices"] = f"""
SELECT product_id, CAST(price AS DOUBLE) AS price, parsed_at FROM ({_PRICES})
WHERE product_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)"""
ORACLES["prices_after_cascade"] = f"""
SELECT product_id, CAST(price AS DOUBLE) AS price, parsed_at FROM ({_PRICES})
WHERE product_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)"""
ORACLES["price_range_check"] = """
SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,2)) * 1000 < 100000000 AS fits FROM orders"""

_PRICED = f"""
SELECT canonical_key, shop_id, price, l.is_in_stock FROM ({_PRODUCTS}) p JOIN ({_LATEST}) l ON p.id = l.product_id"""
ORACLES["average_price_across_shops"] = f"""
SELECT canonical_key, CAST(sum(CAST(price * 100 AS BIGINT)) AS DOUBLE) / count(*) / 100 AS avg_price,
  CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price,
  count(DISTINCT shop_id) AS n_shops
FROM ({_PRICED}) GROUP BY ALL"""
ORACLES["product_across_shops"] = f"""
SELECT canonical_key, shop_id, CAST(min(price) AS DOUBLE) AS min_price, count(*) AS listings,
  bool_or(is_in_stock) AS any_in_stock
FROM ({_PRICED}) GROUP BY ALL"""
ORACLES["compare_shops"] = f"""
SELECT canonical_key, CAST(min(price) FILTER (shop_id = 0) AS DOUBLE) AS price_shop_0,
  CAST(min(price) FILTER (shop_id = 1) AS DOUBLE) AS price_shop_1,
  CAST(min(price) FILTER (shop_id = 2) AS DOUBLE) AS price_shop_2
FROM ({_PRICED}) GROUP BY ALL"""
ORACLES["monthly_price_change"] = f"""
WITH p AS (SELECT *, CAST(date_trunc('month', parsed_at) AS TIMESTAMP) AS month FROM ({_PRICES})),
m AS (
  SELECT product_id, month, first(price ORDER BY {_PRICE_ORDER.format(d="ASC")}) AS first_price,
    first(price ORDER BY {_PRICE_ORDER.format(d="DESC")}) AS last_price, count(*) AS n_changes
  FROM p GROUP BY ALL)
SELECT product_id, month, CAST(first_price AS DOUBLE) AS first_price, CAST(last_price AS DOUBLE) AS last_price,
  CAST(lag(last_price) OVER w AS DOUBLE) AS previous_price,
  CAST(last_price - lag(last_price) OVER w AS DOUBLE) AS change, n_changes
FROM m WINDOW w AS (PARTITION BY product_id ORDER BY month)"""
ORACLES["search_products"] = """
SELECT p_partkey AS id, p_name AS name FROM part
WHERE list_contains(string_split(lower(p_name), ' '), 'red') AND list_contains(string_split(lower(p_name), ' '), 'widget')"""
ORACLES["price_validity"] = f"""
SELECT product_id, CAST(price AS DOUBLE) AS price, parsed_at,
  lead(parsed_at) OVER (PARTITION BY product_id ORDER BY {_PRICE_ORDER.format(d="ASC")}) AS valid_to
FROM ({_PRICES})"""

_LOADED = f"""
WITH RECURSIVE {_fold(_PAGE_EVENTS, "shop_base_url, product_key", "observed_at")}
SELECT CASE shop_base_url WHEN 'https://magnit.ru' THEN 'Магнит' WHEN 'https://5ka.ru' THEN 'Пятёрочка'
    ELSE 'Перекрёсток' END AS shop_name,
  product_key, name, observed_at AS parsed_at, CAST(price AS DOUBLE) AS price, is_in_stock
FROM written"""
ORACLES["snapshots_loaded_in_two_versions"] = _LOADED
ORACLES["streamed_load"] = _LOADED
ORACLES["loads_in_any_order"] = _LOADED
ORACLES["loaded_products"] = f"""
SELECT CASE shop_base_url WHEN 'https://magnit.ru' THEN 'Магнит' WHEN 'https://5ka.ru' THEN 'Пятёрочка'
    ELSE 'Перекрёсток' END AS shop_name,
  product_key, min(observed_at) AS created_at, max(observed_at) AS updated_at
FROM ({_PAGE_EVENTS}) GROUP BY ALL"""
_BOTH_KINDS = f"""
SELECT *, '' AS page_url FROM ({_PAGE_EVENTS})
UNION ALL
SELECT 'https://magnit.ru', 'id:' || internal_product_id, TIMESTAMP '2024-03-01 00:00:00', name,
  CAST(price AS DECIMAL(10,2)), true, 'https://magnit.ru/product/' || p_partkey || '/?shopCode=1'
FROM ({ORACLES["magnit_product_offers"].replace("SELECT 'https", "SELECT p_partkey, 'https", 1)})"""
ORACLES["product_and_catalog_streams_in_one_store"] = f"""
WITH RECURSIVE {_fold(_BOTH_KINDS, "shop_base_url, product_key", "observed_at, page_url")},
names AS (
  SELECT shop_base_url, product_key, name FROM src
  QUALIFY row_number() OVER (PARTITION BY shop_base_url, product_key ORDER BY observed_at DESC, page_url DESC) = 1)
SELECT CASE w.shop_base_url WHEN 'https://magnit.ru' THEN 'Магнит' WHEN 'https://5ka.ru' THEN 'Пятёрочка'
    ELSE 'Перекрёсток' END AS shop_name,
  w.product_key, n.name, observed_at AS parsed_at, CAST(price AS DOUBLE) AS price, is_in_stock
FROM written w JOIN names n ON w.shop_base_url = n.shop_base_url AND w.product_key = n.product_key"""
ORACLES["snapshots_read_back"] = ORACLES["magnit_catalog_offers"]
ORACLES["streamed_offers"] = ORACLES["magnit_product_offers"]
ORACLES["streamed_history"] = ORACLES["change_history_one_cent_steps"]

ORACLES["small_load_into_large_store"] = _LOADED
ORACLES["late_rows_in_a_long_history"] = ORACLES["change_history_one_cent_steps"]
ORACLES["load_rejects"] = ORACLES["loaded_and_failed_pages"]
ORACLES["load_diagnostics"] = ORACLES["capture_report"]
ORACLES["product_pages_loaded"] = f"""
WITH offers AS (
  SELECT * EXCLUDE (url), 'https://magnit.ru/product/' || p_partkey || '/?shopCode=1' AS url
  FROM ({ORACLES["magnit_product_offers"].replace("SELECT 'https", "SELECT p_partkey, 'https", 1)})),
newest AS (
  SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY internal_product_id ORDER BY url DESC) = 1)
SELECT n.name, o.price, n.url, o.internal_product_id, n.manufacturer_code, o.is_in_stock
FROM offers o JOIN newest n ON o.internal_product_id = n.internal_product_id"""

ORACLES["price_as_of"] = f"""
WITH p AS (
  SELECT CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE product_id END AS product_id, price, is_in_stock, parsed_at, l_orderkey, l_suppkey, l_linenumber
  FROM ({_PRICES})),
newest AS (
  SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY product_id, parsed_at ORDER BY {_PRICE_ORDER.format(d="DESC")}) = 1),
asked AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE o_custkey END AS product_id, CAST(o_orderdate AS TIMESTAMP) AS at FROM orders)
SELECT q.o_orderkey, q.product_id, q.at, n.parsed_at, CAST(n.price AS DOUBLE) AS price, n.is_in_stock
FROM asked q ASOF LEFT JOIN newest n ON q.product_id = n.product_id AND q.at >= n.parsed_at"""

ORACLES["similar_products"] = """
WITH RECURSIVE named AS (
  SELECT p_partkey AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || lower(p_type) || ' ' || (p_size % 5) ||
    CASE p_partkey % 3 WHEN 0 THEN ' new' WHEN 1 THEN ' super offer' ELSE '' END), '[^a-z0-9]+'), lambda w: w <> ''))) AS words
  FROM part),
kinds AS (SELECT words, min(p.id) AS kind, len(words) AS n FROM named p GROUP BY words),
tokens AS (SELECT kind, n, unnest(words) AS w FROM kinds),
links AS (
  SELECT a.kind AS a, b.kind AS b FROM tokens a JOIN tokens b ON a.w = b.w AND a.kind <> b.kind
  GROUP BY a.kind, b.kind, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
reached(kind, seen) AS (SELECT kind, kind FROM kinds UNION SELECT r.kind, l.b FROM reached r JOIN links l ON r.seen = l.a),
least AS (SELECT kind, min(seen) AS group_id FROM reached GROUP BY kind),
members AS (SELECT p.id, l.group_id FROM named p JOIN kinds k ON p.words = k.words JOIN least l ON k.kind = l.kind)
SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM members"""

ORACLES["indexed_search"] = f"""
WITH offers AS (
  SELECT name, internal_product_id, 'https://magnit.ru/product/' || p_partkey || '/?shopCode=1' AS page
  FROM ({ORACLES["magnit_product_offers"].replace("SELECT 'https", "SELECT p_partkey, 'https", 1)})),
newest AS (
  SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY internal_product_id ORDER BY page DESC) = 1),
words AS (
  SELECT DISTINCT internal_product_id, name, unnest(regexp_split_to_array(lower(name), '[^a-zа-яё0-9]+')) AS word FROM newest),
hits AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n FROM words WHERE word IN ('red', 'widget', 'gizmo'))
SELECT 'id:' || internal_product_id AS product_key, name, count(*) AS n_words, round(sum(1.0::DOUBLE / n), 9) AS score
FROM hits GROUP BY ALL"""

_MONTH_EVENTS = _PAGE_EVENTS.replace("FROM events", "FROM (SELECT * REPLACE (ts + to_months(CAST(day(ts) % 4 AS INTEGER)) AS ts) FROM events)")
_MONTH_HISTORY = f"""
WITH RECURSIVE {_fold(_MONTH_EVENTS, "shop_base_url, product_key", "observed_at")},
p AS (SELECT *, CAST(date_trunc('month', observed_at) AS TIMESTAMP) AS month FROM written)"""
ORACLES["maintained_monthly_change"] = f"""{_MONTH_HISTORY},
m AS (
  SELECT product_key, month, first(price ORDER BY observed_at) AS first_price, last(price ORDER BY observed_at) AS last_price,
    count(*) AS n_changes
  FROM p GROUP BY ALL)
SELECT product_key, month, CAST(first_price AS DOUBLE) AS first_price, CAST(last_price AS DOUBLE) AS last_price,
  CAST(lag(last_price) OVER w AS DOUBLE) AS previous_price,
  CAST(last_price - lag(last_price) OVER w AS DOUBLE) AS change, n_changes
FROM m WINDOW w AS (PARTITION BY product_key ORDER BY month)"""
ORACLES["maintained_shop_months"] = f"""{_MONTH_HISTORY}
SELECT shop_base_url AS base_url, count(DISTINCT product_key) AS n_products, count(*) AS n_changes,
  CAST(sum(CAST(price * 100 AS BIGINT)) AS DOUBLE) / count(*) / 100 AS avg_price
FROM p WHERE month BETWEEN TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-03-01' GROUP BY ALL"""

ORACLES["streamed_late_pages"] = f"""
WITH pages AS (
  SELECT p_partkey, 'https://magnit.ru/product/' || p_partkey || '/?shopCode=1' AS page_url,
    TIMESTAMP '2024-03-01' - to_days(CAST(p_partkey % 20 AS INTEGER)) AS fetched_at, name, price
  FROM ({ORACLES["magnit_product_offers"].replace("SELECT 'https", "SELECT p_partkey, 'https", 1)}))
SELECT page_url, fetched_at, name, price, CAST(NULL AS VARCHAR) AS reason FROM pages
UNION ALL
SELECT page_url, fetched_at, NULL, NULL, 'snapshots of one page and time differ' FROM pages
WHERE p_partkey % 4 < 2 AND p_partkey % 3 = 0"""

ORACLES["route_by_rule_table"] = """
WITH rules AS (
  SELECT 'all-' || s_suppkey AS rule, 'https://s' || s_suppkey || '.example' AS shop_base_url, 's' || s_suppkey || '.example' AS host,
    '' AS path, 9 AS priority FROM supplier
  UNION ALL
  SELECT 'list-' || s_suppkey, 'https://s' || s_suppkey || '.example', 's' || s_suppkey || '.example', 'catalog', 5 FROM supplier
  UNION ALL
  SELECT 'shelf-' || c_custkey, 'https://all.example', 'all.example', 'shelf/' || c_custkey, c_custkey % 3 FROM customer),
pages AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 2 THEN 'all.example' WHEN o_orderkey % 6 IN (0, 1, 4)
      THEN 's' || (1 + o_custkey % 150) || '.example' END AS host,
    CASE o_orderkey % 6 WHEN 0 THEN 'catalog' WHEN 1 THEN '' WHEN 2 THEN 'shelf/' || o_custkey WHEN 4 THEN 'catalog' END AS folder
  FROM orders),
hits AS (
  SELECT o_orderkey, rule, shop_base_url FROM pages p JOIN rules r ON p.host = r.host AND r.path IN ('', p.folder)
  QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY priority, rule) = 1)
SELECT o.o_orderkey, rule, shop_base_url FROM orders o LEFT JOIN hits h ON o.o_orderkey = h.o_orderkey"""
ORACLES["links_in_sql"] = ORACLES["page_links"]
ORACLES["page_facts_in_sql"] = """
SELECT 'https://magnit.ru/product/' || p_partkey || '/?shopCode=1' AS page_url, 'magnit.ru' AS host,
  CAST(CASE p_partkey % 5 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS INTEGER) AS n_scripts,
  CASE WHEN p_partkey % 5 = 1 THEN CAST(round(p_retailprice, 2) AS DOUBLE) END AS text_price
FROM part"""
