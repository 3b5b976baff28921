import itertools
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from pricetrail import schemas
from pricetrail.plans import batch, store
from pricetrail.plans.batch import load_snapshots
from pricetrail.session import shared_dir
from pricetrail.sources import snapshots
from pricetrail.streaming import jobs

T0 = datetime(2024, 1, 1)


def page(hour, *items, at="https://magnit.ru/catalog/1-x"):
    body = "".join(f'<a href="/product/{key}-x">{price} ₽ {name}</a>' for key, name, price in items)
    return (at, T0 + timedelta(hours=hour), 200, "text/html", body)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.PAGE_SNAPSHOTS)


def state(spark, root):
    prices = sorted((r.parsed_at.hour, r.price, r.product_id) for r in store.read_prices(spark, root).collect())
    products = sorted((r.id, r.name, r.created_at.hour, r.updated_at.hour) for r in store.read(spark, root, "products").collect())
    return prices, products


PAGES = [
    page(1, ("11", "Чай", 10), ("12", "Кофе", 20)),
    page(2, ("11", "Чай 2", 12), ("12", "Кофе", 20)),
    page(3, ("11", "Чай 3", 12), ("12", "Кофе", 21)),
    page(3, ("11", "Чай 3b", 10), at="https://magnit.ru/catalog/2-y"),
    page(4, ("11", "Чай 4", 10)),
]


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4), (4, 3, 2, 1, 0), (2, 0, 4, 1, 3)])
def test_any_cut_into_loads_gives_one_history(spark, tmp_path, order):
    load_snapshots(spark, frame(spark, *PAGES), str(tmp_path / "one"))
    want = state(spark, str(tmp_path / "one"))
    assert [(h, p) for h, p, _ in want[0]] == [(1, 10), (1, 20), (2, 12), (3, 10), (3, 21)]
    root = str(tmp_path / "many")
    for i in order:
        load_snapshots(spark, frame(spark, PAGES[i]), root)
    assert state(spark, root) == want
    load_snapshots(spark, frame(spark, *PAGES[1:3]), root)  # a replay adds nothing
    assert state(spark, root) == want


def test_a_load_that_dies_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    load_snapshots(spark, frame(spark, PAGES[0]), root)
    before = state(spark, root)
    with monkeypatch.context() as m:
        m.setattr(batch.load, "load_counters", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            load_snapshots(spark, frame(spark, PAGES[1]), root)
    assert state(spark, root) == before and store.latest(spark, root) == 0
    load_snapshots(spark, frame(spark, *PAGES[1:]), root)
    load_snapshots(spark, frame(spark, *PAGES), str(tmp_path / "one"))
    assert state(spark, root) == state(spark, str(tmp_path / "one"))


def test_replayed_batches_and_new_checkpoints(spark, tmp_path):
    root, folder = str(tmp_path / "tables"), str(tmp_path / "pages")
    frame(spark, PAGES[0]).coalesce(1).write.mode("append").parquet(folder)
    jobs.stream_load(snapshots.stream_snapshots(spark, folder), root, str(tmp_path / "a")).awaitTermination()
    first = state(spark, root)
    # A new checkpoint numbers its micro-batches from 0 again: it goes on behind the stored versions.
    jobs.stream_load(snapshots.stream_snapshots(spark, folder), root, str(tmp_path / "b")).awaitTermination()
    assert store.latest(spark, root) == 1 and state(spark, root) == first
    sources = {c.source for c in store.commits(spark, root)}
    assert len(sources) == 2
    assert load_snapshots(spark, frame(spark, PAGES[1]), root, source=sources.pop(), batch=0) in (0, 1)
    assert state(spark, root) == first


def test_intermediates_are_removed(spark, tmp_path):
    from pathlib import Path

    before = set(Path(shared_dir(spark)).glob("slices-*"))
    load_snapshots(spark, frame(spark, *PAGES), str(tmp_path))
    assert set(Path(shared_dir(spark)).glob("slices-*")) == before


def test_products_without_key_do_not_stop_the_fold(spark):
    from pricetrail.operators.history import change_history

    rows = [(k, T0 + timedelta(hours=h), Decimal(p), True) for k, h, p in itertools.product(["a", None, "b"], range(3), [1])]
    seen = spark.createDataFrame(rows, "k string, t timestamp, price decimal(10,2), is_in_stock boolean")
    assert sorted((r.k or "", r.t.hour) for r in change_history(seen, ["k"], ["t"]).collect()) == [("", 0), ("a", 0), ("b", 0)]
