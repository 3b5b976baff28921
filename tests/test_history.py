"""The split fold against a plain loop, over many slices, hot keys and stored last prices."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from pricetrail.operators.history import change_history, last_written

T0 = datetime(2024, 1, 1)
SCHEMA = "product_id long, price decimal(10,2), is_in_stock boolean, observed_at timestamp, page_url string, position int"


def brute_force(rows, last=None):
    """Plain loop over the rows in order; ``last`` holds stored (price, stock, time) per product."""
    state = dict(last or {})
    written = []
    for row in sorted(rows, key=lambda r: (r[0], r[3], r[4], r[5])):
        known = state.get(row[0])
        if last and row[0] in last and row[3] <= last[row[0]][2]:
            continue
        if known is None or abs(float(known[0]) - float(row[1])) > 0.01 or known[1] != row[2]:
            written.append(row)
            state[row[0]] = (row[1], row[2], row[3])
    return written


def walk(seed, products, rows, hot_share=0.0, stock_flip=0.02, start=T0):
    """Random price walks in one-cent steps, so that most rows depend on earlier ones."""
    rnd = random.Random(seed)
    cents = {p: rnd.randrange(100, 20000) for p in range(products)}
    stock = dict.fromkeys(cents, True)
    out = []
    for n in range(rows):
        p = 0 if rnd.random() < hot_share else rnd.randrange(products)
        cents[p] = max(1, cents[p] + rnd.choice([-2, -1, -1, 0, 0, 0, 1, 1, 2]))
        stock[p] ^= rnd.random() < stock_flip
        out.append(
            (p, Decimal(cents[p]) / 100, stock[p], start + timedelta(seconds=n // 3), f"page{n % 2}", n)
        )
    return out


@pytest.fixture
def many_slices(spark):
    """Keep adaptive execution from merging small slices, as it does not at real sizes."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("products, hot_share", [(1, 0), (2, 0.5), (40, 0.6), (3000, 0)])
def test_equals_plain_loop(spark, many_slices, products, hot_share):
    rows = walk(products, products, 4000, hot_share)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in change_history(frame, ["product_id"]).collect()]
    assert sorted(got) == sorted(brute_force(rows))


def test_many_arrow_batches_in_one_slice(spark):
    rows = walk(7, 3, 3000, 0.3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = [tuple(r) for r in change_history(spark.createDataFrame(rows, SCHEMA), ["product_id"]).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(brute_force(rows))


def test_loads_in_sequence_and_replay(spark, many_slices):
    rows = walk(11, 25, 3000, 0.4)
    early, late = rows[:1600], rows[1600:]
    first = change_history(spark.createDataFrame(early, SCHEMA), ["product_id"])
    written = [tuple(r) for r in first.collect()]
    stored = first.withColumnRenamed("observed_at", "parsed_at")
    last = last_written(stored, ["product_id"], ["parsed_at", "page_url", "position"])
    known = {r.product_id: (r.last_price, r.last_stock, r.last_parsed_at) for r in last.collect()}
    second = change_history(spark.createDataFrame(late, SCHEMA), ["product_id"], last=last)
    got = [tuple(r) for r in second.collect()]
    assert sorted(got) == sorted(brute_force(late, known))
    assert sorted(written) == sorted(brute_force(early))
    replay = change_history(spark.createDataFrame(early, SCHEMA), ["product_id"], last=last)
    assert replay.count() == 0


def test_drift_is_measured_from_the_last_written_row(spark):
    prices = ["10.00", "10.00", "10.01", "10.02", "10.02", "10.00"]
    rows = [(1, Decimal(p), True, T0 + timedelta(hours=n), "p", 0) for n, p in enumerate(prices)]
    got = change_history(spark.createDataFrame(rows, SCHEMA), ["product_id"]).orderBy("observed_at").collect()
    expected = [r[1] for r in brute_force(rows)]
    assert [r.price for r in got] == expected


def test_one_cent_steps_follow_the_doubles(spark):
    """2.24 to 2.25 is less than a cent in doubles' arithmetic or more, by value; both kinds occur."""
    steps = [(c, c + 1) for c in range(100, 400)]
    rows = []
    for n, (a, b) in enumerate(steps):
        rows += [(n, Decimal(a) / 100, True, T0, "p", 0), (n, Decimal(b) / 100, True, T0, "p", 1)]
    got = change_history(spark.createDataFrame(rows, SCHEMA), ["product_id"]).count()
    expected = len(brute_force(rows))
    assert got == expected and len(steps) < expected < 2 * len(steps)


def test_copies_are_split_and_write_once(spark, many_slices):
    """A third of all rows are copies of one observation, in many input partitions."""
    rows = walk(5, 10, 1500) + [(4, Decimal("3.00"), True, T0, "page0", 0)] * 900
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = [tuple(r) for r in change_history(frame, ["product_id"]).collect()]
    ordered = sorted(rows, key=lambda r: (r[0], r[3], r[4], r[5], r[1], r[2]))
    assert sorted(got) == sorted(brute_force(ordered))


def test_empty_input(spark):
    assert change_history(spark.createDataFrame([], SCHEMA), ["product_id"]).count() == 0
