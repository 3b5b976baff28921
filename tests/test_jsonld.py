"""JSON-LD facts: decoding, document order, precedence of nodes and keys."""

import pytest

from pricetrail.functions.jsonld import _decode, _listed, _nodes, _product


@pytest.mark.parametrize(
    "script",
    ["", "{", "nul", "null", '{"a": NaN}', '{"a": "\\ud800"}', '{"a": 1} x', '{"a": "\n"}', "[" * 513 + "]" * 513, "[" * 100000],
)
def test_what_does_not_decode(script):
    assert _decode(script) is None


def test_depth_limit_is_inclusive():
    assert _decode("[" * 512 + "]" * 512) is not None


def test_nodes_come_parents_first_in_document_order():
    document = {"z": {"n": 1, "y": [{"n": 2}]}, "a": [{"n": 3}, 5, [{"n": 4}]]}
    assert [node["n"] for node in _nodes(document) if isinstance(node, dict) and "n" in node] == [1, 2, 3, 4]


def test_an_earlier_node_wins_over_an_earlier_key():
    facts = _product(['{"a": {"productID": " 7 "}, "b": {"sku": "S"}, "mpn": "", "gtin13": 460, "name": ["x"], "headline": "H\\u00a0 h"}'])
    assert facts == {"name": "H h", "internal_product_id": "7", "manufacturer_code": "460", "prices": []}


def test_price_candidates_keep_their_order_and_spelling():
    facts = _product(['[{"offers": [{"price": null, "lowPrice": 12.50}, {"price": true}]}, {"price": "1 000 руб"}]', '{"price": 3}'])
    assert facts["prices"] == ["12.50", "1 000 руб", "3"]


def test_listed_nodes():
    script = """{"name": "root", "url": "/r", "offers": {"price": "5,5", "lowPrice": 4},
      "itemListElement": [{"name": "A", "url": "/a", "price": 0, "offers": [{"availability": "OUTOFSTOCK"}]},
                          {"name": "B", "url": {"x": 1}, "price": 1}, {"name": "C", "url": "/c", "offers": []}]}"""
    rows = _listed([script, "broken"])
    assert [(r["name"], r["url"], r["prices"], r["sold_out"]) for r in rows] == [
        ("root", "/r", ["5,5", "4"], True), ("A", "/a", ["0"], True)
    ]
