"""Golden rows of our own per shop, with the corner cases that decide results."""

from datetime import datetime
from decimal import Decimal

import pytest

from pricetrail import schemas
from pricetrail.operators.extract import extract_catalog, extract_product, offers, rejects
from pricetrail.operators.routing import Rule

T0 = datetime(2024, 5, 1, 12)


def pages(spark, *rows):
    full = [(url, T0, status, "text/html", body) for url, status, body in rows]
    return spark.createDataFrame(full, schemas.PAGE_SNAPSHOTS)


def catalog_rows(spark, url, body):
    found = offers(extract_catalog(pages(spark, (url, 200, body)))).orderBy("position").collect()
    return [(r.name, r.price, r.url, r.internal_product_id, r.manufacturer_code, r.is_in_stock) for r in found]


def product_row(spark, url, body):
    rows = offers(extract_product(pages(spark, (url, 200, body)))).collect()
    return [(r.name, r.price, r.internal_product_id, r.manufacturer_code, r.is_in_stock) for r in rows]


def reject_rows(spark, frame):
    return {(r.page_url, r.stage, r.reason) for r in rejects(frame).collect()}


MAGNIT = "https://magnit.ru/catalog/77-chai?shopCode=1"


def test_magnit_catalog(spark):
    body = """<html><!-- <a href="/product/1-x">1 ₽ hidden</a> --><script>var a = '<a href="/product/2-x">2 ₽ x</a>'</script>
    <a class="c" href="/product/501-chai-chernyj?shopCode=1"><b>По карте</b> 99.90 ₽ -25% 133,20 ₽ Новинка Чай&nbsp;чёрный &quot;Гора&quot; 100 г 4.7 · 12 отзывов</a>
    <a href='/product/502-kofe'>1 299 ₽ Кофе &#1074; зёрнах Нет отзывов</a>
    <a href=/product/503-sahar >50 ₽ Сахар 3.2% 4.8 · 1 отзыв</a>
    <a href="/product/501-chai-chernyj?shopCode=1">45 ₽ Повтор</a>
    <a href="/product/504-x">нет цены</a><a href="/product/504-x">7,5 &#x20BD; Соль</a>
    <a href="/catalog/78">10 ₽ Раздел</a><a href="#top">10 ₽ Вверх</a><a href="">1 ₽ Пусто</a><a name="q">2 ₽</a>
    <a href="product/505-x" title="a > b">8 &#8381; Мыло <span>туалетное</span></a></html>"""
    assert catalog_rows(spark, MAGNIT, body) == [
        ("Чай чёрный \"Гора\" 100 г", Decimal("99.90"), "https://magnit.ru/product/501-chai-chernyj?shopCode=1", "501", None, True),
        ("Кофе в зёрнах", Decimal("299.00"), "https://magnit.ru/product/502-kofe", "502", None, True),
        ("Сахар 3.2%", Decimal("50.00"), "https://magnit.ru/product/503-sahar", "503", None, True),
        ("Соль", Decimal("7.50"), "https://magnit.ru/product/504-x", "504", None, True),
    ]


def test_relative_link_goes_below_the_page_url_with_its_query(spark):
    rows = catalog_rows(spark, "https://magnit.ru/catalog/x/", '<a href="product/9-z">5 ₽ Ложка</a>')
    assert rows == [("Ложка", Decimal("5.00"), "https://magnit.ru/catalog/x/product/9-z", "9", None, True)]


PEREKRESTOK = "https://www.perekrestok.ru/cat/c/9/chai"


def test_perekrestok_links(spark):
    body = """<a href="/cat/9/p/chai-100g-3001" aria-label="Чай  чёрный">Цена 0,00 ₽ 99,90 ₽</a>
    <a href="https://promo.perekrestok.ru/cat/c/9/p/kofe-3002/" title="Кофе">Цена 150 ₽ Нет в наличии</a>
    <a href="/cat/9/p/sahar-3003">Цена 50,00 ₽ Старая цена 60,00 ₽ Сахар песок В корзину 12 оценок 4.9</a>
    <a href="/cat/9/p/nol-3004">Цена 0,00 ₽ Ноль</a>
    <a href="/cat/9/sol-3005">Цена 5,00 ₽ Не товар</a>
    <a href="/cat/9/p/chai-100g-3001" aria-label="Другой">Цена 1,00 ₽</a>"""
    assert catalog_rows(spark, PEREKRESTOK, body) == [
        ("Чай чёрный", Decimal("99.90"), "https://www.perekrestok.ru/cat/9/p/chai-100g-3001", "3001", None, True),
        ("Кофе", Decimal("150.00"), "https://promo.perekrestok.ru/cat/c/9/p/kofe-3002/", "3002", None, False),
        ("Старая Сахар песок", Decimal("50.00"), "https://www.perekrestok.ru/cat/9/p/sahar-3003", "3003", None, True),
    ]


def test_perekrestok_json_ld_suppresses_links(spark):
    body = """<script type="application/ld+json">not json</script>
    <script type='application/ld+json'>{"@graph": [
      {"name": "Чай", "url": "/cat/9/p/chai-1", "price": "", "offers": [{"price": null, "lowPrice": "12,50"}], "mpn": "M1"},
      {"name": "Кофе", "url": "https://www.perekrestok.ru/cat/9/p/kofe-2", "offers": {"price": 99.9, "availability": "https://schema.org/OutOfStock"}},
      {"name": "Повтор", "url": "/cat/9/p/chai-1", "price": 1},
      {"name": "Не товар", "url": "/about", "price": 1},
      {"name": "Без цены", "url": "/cat/9/p/x-3"}]}</script>
    <a href="/cat/9/p/sahar-3003" title="Сахар">Цена 50,00 ₽</a>"""
    assert catalog_rows(spark, PEREKRESTOK, body) == [
        ("Чай", Decimal("12.50"), "https://www.perekrestok.ru/cat/9/p/chai-1", "1", "M1", True),
        ("Кофе", Decimal("99.90"), "https://www.perekrestok.ru/cat/9/p/kofe-2", "2", None, False),
    ]


PYATEROCHKA = "https://5ka.ru/catalog/chai--1/"


def test_pyaterochka_json(spark):
    body = """{"name": "Чай", "products": [
      {"plu": 11, "name": " Чай  чёрный ", "is_available": true, "prices": {"regular": "99.9", "discount": null}},
      {"plu": "12", "name": "Кофе", "is_available": false, "prices": {"regular": "99.9", "discount": "", "cpd_promo_price": "80,5"}},
      {"plu": 13, "name": "Сахар", "prices": {"discount": "нет", "regular": 50}},
      {"plu": 13, "name": "Сахар", "is_available": 1, "prices": {"discount": 49.994, "regular": 50}},
      {"plu": null, "name": "Без кода", "prices": {"regular": 1}},
      {"plu": 14, "name": "", "prices": {"regular": 1}}, {"plu": 15, "name": "Без цены", "prices": {}},
      {"plu": 16, "name": "Пустые цены", "prices": []}, {"plu": 17, "name": 5, "prices": {"regular": 1}}, 7, null, "x",
      {"plu": 18, "name": "Хлеб", "is_available": "false", "prices": {"regular": "1e1"}},
      {"plu": 19, "name": "Вода", "is_available": [], "prices": {"regular": " 3"}}]}"""
    assert catalog_rows(spark, PYATEROCHKA, body) == [
        ("Чай чёрный", Decimal("99.90"), None, "11", None, True),
        ("Кофе", Decimal("80.50"), None, "12", None, False),
        ("Сахар", Decimal("50.00"), None, "13", None, False),
        ("Сахар", Decimal("49.99"), None, "13", None, True),
        ("Хлеб", Decimal("10.00"), None, "18", None, True),
        ("Вода", Decimal("3.00"), None, "19", None, False),
    ]


def test_pyaterochka_products_may_be_an_object(spark):
    body = '{"products": {"a": {"plu": 1, "name": "Чай", "is_available": true, "prices": {"regular": 2}}}}'
    assert catalog_rows(spark, PYATEROCHKA, body) == [("Чай", Decimal("2.00"), None, "1", None, True)]


def test_another_shop_joins_with_a_rule_and_an_expression(spark):
    rule = Rule("corner_shop", "Corner", "https://corner.example", "corner.example", path_part="/list")
    offers_of = (
        "array(named_struct('position', 0, 'name', regexp_extract(body, '^(.*)=', 1), 'price',"
        " try_cast(regexp_extract(body, '=(.*)$', 1) AS decimal(38,2)), 'url', page_url, 'internal_product_id',"
        " 'x', 'manufacturer_code', cast(NULL AS string), 'is_in_stock', true))"
    )
    frame = pages(spark, ("https://corner.example/list", 200, "Tea=3.5"), (PYATEROCHKA, 200, "no"))
    got = extract_catalog(frame, [rule], {"corner_shop": offers_of})
    assert [(r.shop_base_url, r.name, r.price) for r in offers(got).collect()] == [
        ("https://corner.example", "Tea", Decimal("3.50"))
    ]


def test_catalog_rejects(spark):
    frame = extract_catalog(
        pages(
            spark,
            ("https://example.com/catalog/1", 200, "x"),
            ("https://magnit.ru/catalog/404", 404, "<a href='/product/1'>5 ₽ x</a>"),
            ("https://magnit.ru/catalog/empty", 200, "<a href='/about'>5 ₽ x</a>"),
            ("https://5ka.ru/catalog/html", 200, "<html>blocked</html>"),
            ("https://5ka.ru/catalog/scalar", 200, "5"),
            ("https://5ka.ru/catalog/tail", 200, '{"products": []} x'),
            ("https://5ka.ru/catalog/list", 200, "[]"),
            ("https://5ka.ru/catalog/none", 200, '{"products": []}'),
            ("https://5ka.ru/catalog/bad", 200, '{"products": [{"plu": 1}]}'),
            ("https://5ka.ru/catalog/big", 200, '{"products": [{"plu": 1, "name": "a", "prices": {"regular": "123456789.00"}}]}'),
        )
    )
    assert reject_rows(spark, frame) == {
        ("https://example.com/catalog/1", "route", "no rule for this catalogue URL"),
        ("https://magnit.ru/catalog/404", "http", "page did not load: HTTP 404"),
        ("https://magnit.ru/catalog/empty", "extract", "no offers found"),
        ("https://5ka.ru/catalog/html", "decode", "HTML instead of JSON"),
        ("https://5ka.ru/catalog/scalar", "decode", "HTML instead of JSON"),
        ("https://5ka.ru/catalog/tail", "decode", "HTML instead of JSON"),
        ("https://5ka.ru/catalog/list", "extract", "catalogue holds no products"),
        ("https://5ka.ru/catalog/none", "extract", "catalogue holds no products"),
        ("https://5ka.ru/catalog/bad", "extract", "no offers found"),
        ("https://5ka.ru/catalog/big", "price", "price out of range at position 0"),
    }
    assert offers(frame).count() == 0


PRODUCT = "https://magnit.ru/product/900/?shop=1"
LD = '<script type="application/ld+json">%s</script>'


@pytest.mark.parametrize(
    "body, expected",
    [
        (
            '<title>Т</title><meta property="og:title" content="OG"><meta itemprop="price" content="129,5 руб.">'
            '<h1>Другой</h1><h1 data-test-id="v-product-details-name"> Чай <i>чёрный</i></h1>'
            + LD % '{"sku": "S1", "mpn": "M1", "offers": {"price": "1"}}',
            ("Чай чёрный", Decimal("129.50"), "S1", "M1", True),
        ),
        (
            '<h1></h1><meta content="Имя &amp; сорт" property="og:title"><span itemprop="price">1<span>2</span>9 <span>₽</span></span> 77',
            ("Имя & сорт", Decimal("129.00"), "900", None, True),
        ),
        (
            '<div itemprop="price" content="0">15,2 ₽</div>' + LD % '[{"headline": "Н"}, {"name": "Поздно"}]',
            ("Н", Decimal("15.20"), "900", None, True),
        ),
        (
            LD % "{broken" + LD % '{"name": {"x": 1}, "z": {"sku": "", "gtin": "G", "lowPrice": 3.456}, "a": {"name": "Глубже", "productID": 7, "mpn": "M", "price": 2}}',
            ("Глубже", Decimal("3.46"), "7", "G", True),
        ),
        (
            '<title>Цена в JSON</title>' + LD % '{"b": {"price": "скоро", "lowPrice": "от 1 050 руб"}, "price": null}',
            ("Цена в JSON", Decimal("1050.00"), "900", None, True),
        ),
    ],
)
def test_product_page(spark, body, expected):
    assert product_row(spark, PRODUCT, body) == [expected]


def test_product_rejects(spark):
    frame = extract_product(
        pages(
            spark,
            ("https://5ka.ru/product/1", 200, ""),
            ("https://magnit.ru/product/1", 500, ""),
            ("https://magnit.ru/product/2", 200, "<p>x</p>"),
            ("https://magnit.ru/product/3", 200, "<title>Чай</title>"),
        )
    )
    assert reject_rows(spark, frame) == {
        ("https://5ka.ru/product/1", "route", "no rule for this product URL"),
        ("https://magnit.ru/product/1", "http", "page did not load: HTTP 500"),
        ("https://magnit.ru/product/2", "extract", "no product name"),
        ("https://magnit.ru/product/3", "extract", "no product price"),
    }
