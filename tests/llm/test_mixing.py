import duckdb
import pytest

from pricetrail.llm import mixing
from pricetrail.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, source string, size string, target string"


def expected(rows):
    """Targets by resharing in rounds, and the nearest prefix in hash order."""
    import hashlib

    size = {}
    for i, text, source in rows:
        size[source] = size.get(source, 0) + len((text or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        for s in over or open_:
            target[s] = 2.0 * size[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    taken = []
    for source in order:
        mine = {}
        for i, text, s in rows:
            if s == source:
                h = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:12], 16)
                mine.setdefault(h, []).append((i, len((text or "").encode().split())))
        whole = target[source] > size[source]
        budget, run, inside = target[source] - size[source] * whole, 0, True
        for h in sorted(mine):
            here = sum(n for _, n in mine[h])
            if inside and run + here > budget:
                inside = False
                take = (budget - run) * 2 > here
            else:
                take = inside
            run += here
            taken += [(i, n, size[source], round(target[source], 6), n * (whole + take)) for i, n in mine[h]]
    return sorted(taken, key=str)


@pytest.mark.parametrize("case", ["mixed", "one", "empty_texts"])
def test_against_rounds(spark, case):
    if case == "mixed":
        rows = [(i if i % 17 else None, None if i % 11 == 0 else "w\x0bé x " * (i * 7919 % 40), ["a", "é", None, "Z", "a"][i % 5]) for i in range(300)]
        rows += [(5, "one two three", "a")] * 3 + [(1000, "long " * 3000, "Z")]
    elif case == "one":
        rows = [(1, "a b c d", "s"), (2, "", None)]
    else:
        rows = [(1, None, "s"), (2, "", "t")]
    docs = spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(spark, tmp_path):
    from pricetrail.llm.queries import QUERIES

    rows = [(i, "wx20\\\t" * (i % 23), f"s{i % 7}" if i % 7 else None) for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_mixing"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLES['op10_mixing']})").fetchall()
    assert sorted(tuple(r) for r in got.select("doc_id", "size", "source_size", "target", "taken").collect()) == sorted(want)
