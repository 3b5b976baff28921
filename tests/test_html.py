"""HTML, URL and text expressions on awkward input."""

import pytest

from pricetrail.functions import html, quoted, text, urls


def value(spark, expression, **columns):
    names = ", ".join(f"{quoted(v)} AS {k}" for k, v in columns.items())
    return spark.sql(f"SELECT {expression} AS v FROM (SELECT {names})").collect()[0].v


@pytest.mark.parametrize(
    "coded, plain",
    [
        ("a &amp; b &lt;i&gt; &quot;q&quot;", 'a & b <i> "q"'),
        ("&#8381;&#x20BD;&#X20bd", "₽₽₽"),
        ("&nbsp;&laquo;x&raquo;", " «x»"),
        ("&amp;lt; &unknown; &amp", "&lt; &unknown; &amp"),
        ("5 & 6 &; &#; &#x; &#99999999; &#xD800;", "5 & 6 &; &#; &#x; &#99999999; &#xD800;"),
        ("&#128512;", "😀"),
        ("none", "none"),
    ],
)
def test_entities(spark, coded, plain):
    assert value(spark, html.decode_entities("x"), x=coded) == plain


@pytest.mark.parametrize(
    "tag, name, expected",
    [
        ('<a href="x>y" title=\'z "q"\'>', "href", "x>y"),
        ('<a href="x>y" title=\'z "q"\'>', "title", 'z "q"'),
        ("<a href=/p/1>", "href", "/p/1"),
        ('<a data-href="no" title="href=no" HREF = "yes">', "href", "yes"),
        ("<a disabled href>", "href", ""),
        ('<a aria-label=""  title="t">', "aria-label", ""),
        ("<a title=it's href='u'>", "href", "u"),
    ],
)
def test_attributes(spark, tag, name, expected):
    assert value(spark, html.attribute(html.tag_attributes("x"), name), x=tag) == expected


def test_anchors_stop_at_the_next_anchor_or_the_end(spark):
    found = value(spark, html.anchors("x"), x='<a href="1">one<a href="2">two</a><b>no</b><abbr>n</abbr><a href="3">three')
    assert [(a.position, a.markup) for a in found] == [
        (0, '<a href="1">one'), (1, '<a href="2">two</a>'), (2, '<a href="3">three')
    ]


def test_long_pages_do_not_overflow_the_stack(spark):
    page = "<a href='/x'" + " data-x='1'" * 20000 + ">" + "<i>t</i>" * 20000 + "</a>" + "<!--" + "-" * 100000 + "-->"
    found = spark.createDataFrame([(page,)], "body string").selectExpr(
        f"size({html.anchors('body')}) AS n", f"length({html.text_content('body')}) AS chars"
    ).collect()[0]
    assert (found.n, found.chars) == (1, 20000)


@pytest.mark.parametrize(
    "url, host, path",
    [
        ("https://user:pw@www.x.ru:8080/a/b?c#d", "www.x.ru", "/a/b"),
        ("//x.ru/a", "x.ru", "/a"),
        ("/cat/1 2/п?x", "", "/cat/1 2/п"),
        ("https://x.ru", "x.ru", ""),
        ("mailto:a@b", "", "a@b"),
        ("", "", ""),
    ],
)
def test_url_parts(spark, url, host, path):
    assert value(spark, urls.host("x"), x=url) == host
    assert value(spark, urls.path("x"), x=url) == path


@pytest.mark.parametrize(
    "raw, expected",
    [("12", 12.0), ("1 299,50 ₽", 1299.5), ("1 299 руб.", 1299.0), ("-5", -5.0), ("1e2", 100.0), ("от 3.5", 3.5), ("", None), ("нет", None), (" 7 ", 7.0)],
)
def test_scalar_price(spark, raw, expected):
    got = value(spark, text.scalar_price("x"), x=raw)
    assert (None if got is None else float(got)) == expected


def test_normalize_takes_unicode_space(spark):
    assert value(spark, text.normalize("x"), x="  a \tb \n") == "a b"
    assert value(spark, text.normalize("x"), x="   ") is None
