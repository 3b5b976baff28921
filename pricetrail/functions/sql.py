"""The expression builders as functions of a session, for those who query pages in SQL.

Most are SQL functions: Spark puts their expression into the query, so they run as the DataFrame forms do, without Python.
What holds several things is an array of structs, for ``SELECT inline(links) FROM (SELECT pt_page_links(body, url) AS links
FROM pages)``: this stays inside the page's row, while a table function over a column would join the pages with their own
bodies. JSON-LD facts are read in Arrow batches.
"""

from pyspark.sql import SparkSession

from pricetrail.functions import html, jsonld, text, urls

PREFIX = "pt_"

_LABELLED = (
    f"transform({html.anchors('body')}, a -> named_struct('position', a.position,"
    f" 'href', {urls.trimmed_href(html.attribute_text('a.attributes', 'href'))},"
    f" 'label', {text.normalize(html.text_content('a.markup'))}))"
)
_LINKS = (
    f"transform({_LABELLED}, l -> named_struct('position', l.position, 'href', l.href,"
    f" 'url', {urls.absolute('l.href', 'page_url', urls.page_origin('page_url'))}, 'label', l.label))"
)
_PRICE = text.RAW_PRICE
#: Function: parameters, type, expression.
FUNCTIONS = {
    "host": ("url STRING", "STRING", urls.host("url")),
    "path": ("url STRING", "STRING", urls.path("url")),
    "absolute_url": ("href STRING, page_url STRING", "STRING", urls.absolute("href", "page_url", urls.page_origin("page_url"))),
    "normal_text": ("words STRING", "STRING", text.normalize("words")),
    "html_text": ("markup STRING", "STRING", text.normalize(html.text_content("markup"))),
    "first_price": ("words STRING", _PRICE, text.first_price("words")),
    "first_positive_price": ("words STRING", _PRICE, text.first_positive_price("words")),
    "scalar_price": ("words STRING", _PRICE, text.scalar_price("words")),
    "numeric_price": ("words STRING", _PRICE, text.numeric_price("words")),
    "name_after_price": ("words STRING", "STRING", text.name_after_price("words")),
    "cleaned_name": ("words STRING", "STRING", text.cleaned_name("words")),
    "page_links": (
        "body STRING, page_url STRING",
        "ARRAY<STRUCT<position: INT, href: STRING, url: STRING, label: STRING>>",
        _LINKS,
    ),
    "ld_json_scripts": ("body STRING", "ARRAY<STRING>", html.ld_json_scripts("body")),
}
#: Functions of an array of JSON-LD scripts, in Arrow batches.
FACTS = {"product_facts": jsonld.product_facts, "listed_facts": jsonld.listed_facts}


def register(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Make the functions known to the session's SQL, under the prefix; returns their names."""
    for name, (parameters, returned, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {returned} RETURN {expression}")
    for name, function in FACTS.items():
        spark.udf.register(prefix + name, function)
    return [prefix + name for name in (*FUNCTIONS, *FACTS)]
