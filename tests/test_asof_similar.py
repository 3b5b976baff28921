"""Prices at a time, and products with similar names, against plain versions."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from pricetrail.operators import asof, similar
from pricetrail.operators.linked import groups

T0 = datetime(2024, 1, 1)


def test_price_as_of(spark):
    rng = random.Random(1)
    # One product has half of all rows.
    prices = [(rng.choice([1, 1, 1, 1, 2, 3, 4, None]), Decimal(rng.randint(1, 9)), rng.random() < 0.5, T0 + timedelta(hours=rng.randint(0, 300)), n) for n in range(2000)]
    asked = [(n, rng.choice([1, 1, 2, 3, 4, 5, None]), rng.choice([None, *[T0 + timedelta(hours=rng.randint(-5, 310)) for _ in range(9)]])) for n in range(1500)]
    asked += asked[:5]
    history = spark.createDataFrame(prices, "product_id long, price decimal(10,2), is_in_stock boolean, parsed_at timestamp, id long").repartition(8)
    questions = spark.createDataFrame(asked, "n long, product_id long, at timestamp").repartition(5)
    want = []
    for n, product, at in asked:
        rows = [p for p in prices if product is not None and at is not None and p[0] == product and p[3] <= at]
        best = max(rows, key=lambda p: (p[3], p[4]), default=(None,) * 5)
        want.append((n, product, at, best[1], best[2], best[3]))
    got = [(r.n, r.product_id, r.at, r.price, r.is_in_stock, r.parsed_at) for r in asof.price_as_of(history, questions).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert asof.price_as_of(history.limit(0), questions).where("price IS NULL").count() == len(asked)
    assert asof.price_as_of(history, questions.limit(0)).collect() == []


def plain_groups(rows, likeness=0.8):
    import re

    sets = {}
    for i, name in rows:
        if i is not None:
            sets.setdefault(i, set()).add(frozenset(w for w in re.split(r"[^\w]+|_", (name or "").lower()) if w))
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and len(x & y) >= likeness * len(x | y) - 1e-9 for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((i, root(i), sum(root(j) == root(i) for j in ids)) for i in ids)


def result(df):
    return sorted((r.id, r.group_id, r.group_size) for r in similar.similar_products(df).collect())


def test_similar_products(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 16)
    rng = random.Random(2)
    words = [f"w{n}" for n in range(30)]
    rows = [(n, " ".join(rng.choices(words[: rng.choice([6, 30])], k=rng.randint(1, 7)))) for n in range(300)]
    rows += [(400, "Чай Зелёный, 100 г!"), (401, "100 г чай зелёный"), (402, None), (403, " - "), (None, "w1 w2"), (5, rows[5][1]), (404, ""), (405, "a b c d e"), (406, "a b c d")]
    assert result(spark.createDataFrame(rows, "id long, name string").repartition(4)) == plain_groups(rows)
    assert result(spark.createDataFrame([], "id long, name string")) == []


def test_one_large_group_of_a_template(spark):
    """Links stay in proportion to the products though each pair of a block is compared."""
    rows = [(n, f"fresh farm milk bottle one litre brand {n % 700} size {n % 3}") for n in range(3000)]
    got = result(spark.createDataFrame(rows, "id long, name string"))
    # Nine or so words, one or two of them apart: likeness 9/11 and 8/12, so sizes and brands split them.
    assert len(got) == 3000 and sum(1 for i, g, _ in got if i == g) < 3000
    assert got == sorted(got)


def test_groups_of_links(spark):
    rng = random.Random(3)
    links = [(n, n + 1) for n in range(150)] + [(1000, 1000 + n) for n in range(1, 200)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)]
    up = {x: x for pair in links for x in pair}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.id: r.group_id for r in groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for pair in links if pair[0] != pair[1] for i in pair}
