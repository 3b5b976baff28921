"""Rules as a table, and the expression builders as functions of SQL."""

from pricetrail.functions import sql
from pricetrail.operators import rule_table

RULES = [
    ("shop", "https://shop.example", "Shop.example", None, 5),
    ("list", "https://shop.example", "shop.example", "/catalog/", 5),
    ("first", "https://shop.example", "shop.example", "catalog/new", 1),
    ("deep", "https://a.shop.example", "a.shop.example", "", 5),
    ("last", "https://shop.example", "shop.example", "catalog", None),
    ("twin-b", "https://twin.example", "twin.example", "", 2),
    ("twin-a", "https://twin.example", "twin.example", "", 2),
    (None, "https://none.example", "none.example", "", 1),
    ("hostless", "https://x", "", "catalog", 0),
    ("nullhost", "https://x", None, "catalog", 0),
]
URLS = {
    "https://shop.example/": "shop",
    "https://shop.example": "shop",
    "https://www.SHOP.example:8080/x?y=/catalog/": "shop",
    "https://shop.example/catalog": "list",
    "https://shop.example//catalog//a/b/c#d": "list",
    "https://shop.example/catalogue": "shop",
    "https://u@shop.example/catalog/new/1": "first",
    "https://a.shop.example/catalog/1": "deep",
    "https://b.a.shop.example/catalog/new": "first",
    "https://xshop.example/catalog": None,
    "https://shop.example.org/": None,
    "https://twin.example/1": "twin-a",
    "https://none.example/": None,
    "/catalog/1": None,
    "": None,
    None: None,
    "https://shop.example/" + "long/" * 5000: "shop",
}


def rules(spark, rows):
    return spark.createDataFrame(rows, rule_table.RULES)


def test_rules_by_host_path_and_priority(spark):
    rows = [(n, url, "body") for n, url in enumerate(URLS)]
    # Repeated pages stay repeated.
    pages = spark.createDataFrame([*rows, *rows], "n long, page_url string, host string")
    got = rule_table.route_by_table(pages, rules(spark, RULES))
    assert got.columns == ["n", "page_url", "host", "rule", "shop_base_url"]
    found = got.collect()
    assert len(found) == 2 * len(URLS)
    assert {r.page_url: r.rule for r in found} == URLS
    assert all((r.rule is None) == (r.shop_base_url is None) for r in found)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([("https://shop.example/",)], "page_url string")
    assert [r.rule for r in rule_table.route_by_table(pages, rules(spark, [])).collect()] == [None]
    assert rule_table.route_by_table(pages.limit(0), rules(spark, RULES)).count() == 0


def test_rules_meet_urls_by_equal_keys(spark):
    pages = spark.createDataFrame([(url, "b") for url in URLS], "page_url string, body string")
    plan = rule_table.route_by_table(pages, rules(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_functions_of_sql(spark):
    names = sql.register(spark)
    assert "pt_page_links" in names and sql.register(spark) == names
    pages = spark.createDataFrame(
        [("https://magnit.ru/catalog/1", '<a href="/p/1"> Чай &amp; 1,50 ₽</a>'), (None, None), ("x", "")], "url string, body string"
    )
    rows = spark.sql(
        "SELECT url, pt_host(url) AS host, pt_page_links(body, url) AS links, pt_first_price(body) AS price FROM {pages}", pages=pages
    )
    first, null, empty = rows.collect()
    assert [tuple(link) for link in first.links] == [(0, "/p/1", "https://magnit.ru/p/1", "Чай & 1,50 ₽")]
    assert first.host == "magnit.ru" and str(first.price) == "1.50"
    assert null.host == "" and null.links is None and null.price is None
    assert empty.links == [] and empty.price is None
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_json_ld_facts_in_sql(spark):
    sql.register(spark)
    page = '<script type="application/ld+json">{"name": "Чай", "sku": "7", "offers": {"price": "1.50"}}</script>'
    pages = spark.createDataFrame([(page,), ("",)], "body string")
    rows = spark.sql("SELECT pt_product_facts(pt_ld_json_scripts(body)) AS facts FROM {pages}", pages=pages).collect()
    assert "7" in list(rows[0].facts) and "7" not in list(rows[1].facts)
