"""Loads that cost what they touch: buckets, late rows, compaction, loads side by side."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest

from pricetrail.plans import store
from pricetrail.plans.batch import load_snapshots
from pricetrail.session import fresh_path, scratch
from test_store import PAGES, frame, page, state

T0 = datetime(2024, 1, 1)
SCHEMA = "k long, t timestamp, price decimal(10,2), is_in_stock boolean"


def plain(rows):
    out, last = [], {}
    for r in sorted(set(rows)):
        before = last.get(r[0])
        if before is None or abs(float(before[2]) - float(r[2])) > 0.01 or before[3] != r[3]:
            out.append(r)
            last[r[0]] = r
    return out


def fold(spark, root, rows, batch=None):
    version = store.Load(spark, root, "test", batch, 4)
    with scratch(spark):
        store.fold(version, spark.createDataFrame(rows, SCHEMA), ["k"], ["t"], "yyyy-MM-dd")
        return version.commit()


def written(spark, root):
    return sorted(tuple(r) for r in store.read_written(spark, root).select("k", "t", "price", "is_in_stock").collect())


def files_of(root, table):
    return {p: p.stat().st_mtime_ns for p in Path(root, table).rglob("*.parquet")}


def test_late_rows_over_many_slices(spark, tmp_path):
    rng, root = random.Random(5), str(tmp_path)
    rows = [
        (k, T0 + timedelta(hours=rng.randint(0, 24 * 20)), Decimal(rng.choice(["1.00", "1.01", "1.02", "2.00"])), rng.random() < 0.9)
        for k in range(5) for _ in range(rng.randint(1, 50))
    ]
    rng.shuffle(rows)
    seen = []
    for part in (rows[::2], rows[1::2], rows[::2]):
        fold(spark, root, part)
        seen += part
        assert written(spark, root) == plain(seen)
    assert store.compact(spark, root, 2) == 3
    assert written(spark, root) == plain(seen)


def test_a_late_row_reads_its_own_slices_only(spark, tmp_path):
    """A price that comes back the same day leaves all later days as they were."""
    root = str(tmp_path)
    days = [(k, T0 + timedelta(days=d), Decimal(d % 2 + 1), True) for k in range(8) for d in range(40)]
    fold(spark, root, days)
    late = [(3, T0 + timedelta(days=10, hours=1), Decimal("7.00"), True), (3, T0 + timedelta(days=10, hours=2), Decimal("1.00"), True)]
    version = store.Load(spark, root, "test", None, 4)
    with scratch(spark):
        store.fold(version, spark.createDataFrame(late, SCHEMA), ["k"], ["t"], "yyyy-MM-dd")
        version.commit()
    assert written(spark, root) == plain(days + late)
    # What this load wrote lies in that day and bucket only.
    assert {s for s, _ in version.slices("written")} == {"2024-01-11"} and len(version.touched("written")) == 1
    plan = store.appended(spark, store.state(spark, root), root, "observed").where("slice = '2024-01-11' AND bucket = 1")
    assert "PartitionFilters: [isnotnull(slice" in plan._jdf.queryExecution().toString()


def test_untouched_buckets_stay(spark, tmp_path):
    root = str(tmp_path)
    many = [page(1, *[(str(n), f"Чай {n}", n) for n in range(1, 120)])]
    load_snapshots(spark, frame(spark, *many), root, n_buckets=8)
    first = {t: files_of(root, t) for t in ("products", "last_prices", "urls")}
    before = store.state(spark, root)
    load_snapshots(spark, frame(spark, page(2, ("7", "Чай 7", 70), at="https://magnit.ru/catalog/2-y")), root)
    now = store.state(spark, root)
    for table in ("products", "last_prices"):
        moved = [b for b in range(8) if before.buckets[table][b] != now.buckets[table][b]]
        assert len(moved) == 1, table
        assert {p: m for p, m in files_of(root, table).items() if p in first[table]} == first[table]
    assert store.read_prices(spark, root).count() == 120
    names = sorted(r.name for r in store.read(spark, root, "products").collect())
    assert len(names) == 119
    # The old version is still what it was.
    assert store.read(spark, root, "products", 0).count() == 119


def test_fewer_files_after_compaction(spark, tmp_path):
    root = str(tmp_path)
    for i, batch in enumerate(PAGES):
        load_snapshots(spark, frame(spark, batch), root, source="s", batch=i, n_buckets=2)
    want, was = state(spark, root), store.state(spark, root)
    assert store.compact(spark, root, 99) is None
    assert store.compact(spark, root, 2) == len(PAGES)
    now = store.state(spark, root)
    assert len(now.folders["written"]) < len(was.folders["written"]) and state(spark, root) == want
    before = files_of(root, "written")
    assert store.remove_unread(spark, root)
    assert set(files_of(root, "written")) < set(before) and state(spark, root) == want
    # Batches are known still, and later loads go on.
    assert load_snapshots(spark, frame(spark, PAGES[0]), root, source="s", batch=1) == len(PAGES) and store.latest(spark, root) == len(PAGES)
    load_snapshots(spark, frame(spark, page(2, ("12", "Кофе", 30), at="https://magnit.ru/catalog/3-z")), root)
    load_snapshots(spark, frame(spark, *PAGES, page(2, ("12", "Кофе", 30), at="https://magnit.ru/catalog/3-z")), str(tmp_path / "one"))
    assert state(spark, root) == state(spark, str(tmp_path / "one"))


def test_two_loads_side_by_side(spark, tmp_path):
    roots = [str(tmp_path / name) for name in "ab"]

    def run(root, pages):
        for p in pages:
            load_snapshots(spark, frame(spark, p), root, n_buckets=2)
        return state(spark, root)

    with ThreadPoolExecutor(2) as pool:
        got = [f.result() for f in [pool.submit(run, roots[0], PAGES[:3]), pool.submit(run, roots[1], PAGES[2:])]]
    assert got == [run(str(tmp_path / "c"), PAGES[:3]), run(str(tmp_path / "d"), PAGES[2:])]


def test_the_second_of_two_loads_from_one_version_fails(spark, tmp_path):
    root = str(tmp_path)
    load_snapshots(spark, frame(spark, PAGES[0]), root, n_buckets=2)
    before = state(spark, root)
    other = store.Load(spark, root, "other")
    load_snapshots(spark, frame(spark, PAGES[1]), root)
    after = state(spark, root)
    with pytest.raises(store.ConcurrentLoad):
        other.commit()
    assert state(spark, root) == after != before and not list(Path(root, "commits").glob("*.draft"))


def test_scopes_of_threads_do_not_meet(spark, tmp_path):
    def make(n):
        with scratch(spark):
            path = fresh_path(spark, f"scope-{n}")
            spark.range(3).write.parquet(path)
            if n:
                return path
        return path

    with scratch(spark):
        outer = fresh_path(spark, "outer")
        spark.range(2).write.parquet(outer)
        with ThreadPoolExecutor(1) as pool:
            inner = pool.submit(make, 0).result()
        assert not Path(inner).exists() and spark.read.parquet(outer).count() == 2
    assert not Path(outer).exists()
