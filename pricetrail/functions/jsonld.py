"""JSON-LD facts from a page's scripts, in Arrow batches.

Spark's JSON functions do not keep key order at unknown depth, and order decides here. Only the
script texts cross to Python, and only small lists of facts come back; URLs, prices and filters
stay Column expressions.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrail.functions import fixed

_MAX_DEPTH = fixed.JSON_DEPTH


class _Number(float):
    """A JSON number with a fraction or exponent that remembers how it was written."""

    def __new__(cls, text: str):
        number = super().__new__(cls, text)
        number.text = text
        return number


def _reject(_name: str):
    raise ValueError("not a JSON number")


def _children(node) -> list:
    """Arrays and objects directly inside a node, in document order."""
    values = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
    return [value for value in values if isinstance(value, dict | list)]


def _too_deep(document) -> bool:
    level, depth = [document], 0
    while level and depth <= _MAX_DEPTH:
        level = [child for node in level for child in _children(node)]
        depth += 1
    return depth > _MAX_DEPTH


def _decode(script: str):
    """Decoded document, or None for what does not decode (or decodes to null)."""
    try:
        document = json.loads(script, parse_float=_Number, parse_constant=_reject)
        if "\\u" in script:
            json.dumps(document, ensure_ascii=False).encode()  # half a surrogate pair is no text
    except (ValueError, RecursionError):
        return None
    return None if _too_deep(document) else document


def _nodes(document) -> Iterator:
    """The document and all arrays and objects inside it, parents first, in document order."""
    stack = [document]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(_children(node)))


def _text(value) -> str | None:
    """A scalar as text; None for arrays and objects."""
    if isinstance(value, dict | list):
        return None
    if value is None or value is False:
        return ""
    if value is True:
        return "1"
    if isinstance(value, float):
        return f"{value:.14G}"
    return str(value)


def _price_text(value) -> str | None:
    """A price candidate as written; only numbers and strings count."""
    if isinstance(value, _Number):
        return value.text
    if isinstance(value, str) or (isinstance(value, int) and not isinstance(value, bool)):
        return str(value)
    return None


def _first_scalar(nodes: list[dict], keys: tuple[str, ...]) -> str | None:
    """First non-empty scalar: an earlier node wins over an earlier key."""
    for node in nodes:
        for key in keys:
            value = _text(node.get(key))
            if value is not None and (value := " ".join(value.split())):
                return value
    return None


def _documents(scripts) -> Iterator:
    for script in scripts:
        document = _decode(script)
        if document is not None:
            yield document


def _objects(scripts) -> Iterator[dict]:
    for document in _documents(scripts):
        for node in _nodes(document):
            if isinstance(node, dict):
                yield node


def _product(scripts) -> dict:
    nodes = list(_objects(scripts))
    prices = [_price_text(node[key]) for node in nodes for key in fixed.PRICE_KEYS if key in node]
    return {
        "name": _first_scalar(nodes, fixed.NAME_KEYS),
        "internal_product_id": _first_scalar(nodes, fixed.ID_KEYS),
        "manufacturer_code": _first_scalar(nodes, fixed.MAKER_CODE_KEYS),
        "prices": [price for price in prices if price],
    }


def _offer_prices(node: dict) -> list[str]:
    values = [node.get("price")]
    offers = node.get("offers")
    if isinstance(offers, dict):
        offers = list(offers.values()) if offers.get("0") is not None else [offers]
    elif not (isinstance(offers, list) and offers and offers[0] is not None):
        offers = []
    for offer in offers:
        if isinstance(offer, dict):
            values += [offer.get(key) for key in fixed.PRICE_KEYS]
    texts = [_price_text(value) if value is not True else "1" for value in values]
    return [text for text in texts if text]


def _listed(scripts) -> list[dict]:
    found = []
    for node in _objects(scripts):
        name, url = _text(node.get("name")), _text(node.get("url"))
        prices = _offer_prices(node)
        if name and url and prices:
            found.append(
                {
                    "name": name,
                    "url": url,
                    "manufacturer_code": _text(node.get("mpn")),
                    "prices": prices,
                    "sold_out": fixed.OUT_OF_STOCK_MARK in json.dumps(node, ensure_ascii=False).lower(),
                }
            )
    return found


PRODUCT_FACTS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("internal_product_id", T.StringType()),
        T.StructField("manufacturer_code", T.StringType()),
        T.StructField("prices", T.ArrayType(T.StringType())),
    ]
)
LISTED_FACTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("manufacturer_code", T.StringType()),
            T.StructField("prices", T.ArrayType(T.StringType())),
            T.StructField("sold_out", T.BooleanType()),
        ]
    )
)


@F.pandas_udf(PRODUCT_FACTS)
def product_facts(scripts: pd.Series) -> pd.DataFrame:
    """Name, id, maker code and price candidates of a product page."""
    rows = [_product(page if page is not None else ()) for page in scripts]
    return pd.DataFrame(rows, columns=PRODUCT_FACTS.names)


@F.pandas_udf(LISTED_FACTS)
def listed_facts(scripts: pd.Series) -> pd.Series:
    """Named nodes with a URL and price candidates on a catalogue page, in document order."""
    return pd.Series([_listed(page if page is not None else ()) for page in scripts], dtype=object)
