"""Reports that loads keep, and offers of pages that come in any order."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from pricetrail.operators import extract
from pricetrail.plans import reports, seen, store
from pricetrail.session import scratch
from test_buckets import SCHEMA, plain
from test_store import frame, page as shop_page

T0 = datetime(2024, 1, 1)


def fold(spark, root, rows, pattern="yyyy-MM-dd", months=True):
    version = store.Load(spark, root, "test", None, 4)
    beside = (lambda written: reports.keep_months(version, written, ["k"], ["t"])) if months else None
    with scratch(spark):
        store.fold(version, spark.createDataFrame(rows, SCHEMA), ["k"], ["t"], pattern, beside)
        return version.commit()


def by_month(rows):
    out = {}
    for k, t, price, _ in sorted(rows, key=lambda r: (r[0], r[1] or datetime.min)):
        month = t and datetime(t.year, t.month, 1)
        first, _, n = out.get((k, month), (price, price, 0))
        out[k, month] = (first, price, n + 1)
    last, found = {}, set()
    for (k, month), (first, final, n) in out.items():
        before = last.get(k)
        found.add((k, month, first, final, before, None if before is None else final - before, n))
        last[k] = final
    return found


def report(spark, root):
    return {tuple(r) for r in reports.monthly_change(spark, root, ["k"]).collect()}


@pytest.mark.parametrize("pattern", ["yyyy-MM-dd", "yyyy"])
def test_months_after_late_rows(spark, tmp_path, pattern):
    rng, root = random.Random(len(pattern)), str(tmp_path)
    prices = [Decimal(p) for p in ("1.00", "1.01", "1.02", "2.00")]
    rows = [(k, T0 + timedelta(days=rng.randint(0, 90), seconds=k), rng.choice(prices), rng.random() < 0.9) for k in range(5) for _ in range(30)]
    rows = list({r[:2]: r for r in rows}.values())
    rng.shuffle(rows)
    done = []
    # The first load keeps no report, so the second one counts what is there.
    for number, part in enumerate((rows[::3], rows[1::3], rows[2::3])):
        fold(spark, root, part, pattern, number > 0)
        done += part
        if number:
            assert report(spark, root) == by_month(plain(done))
    retracted = store.appended(spark, store.state(spark, root), root, "retracted")
    assert retracted.count() > 0


def test_months_of_rows_without_time_and_of_a_load_without_rows(spark, tmp_path):
    root = str(tmp_path)
    rows = [(1, None, Decimal("1.00"), True), (1, T0, Decimal("2.00"), True), (2, T0, Decimal("3.00"), False)]
    fold(spark, root, rows)
    assert report(spark, root) == by_month(rows)
    fold(spark, root, [])
    assert report(spark, root) == by_month(rows)


def test_a_report_reads_no_prices(spark, tmp_path):
    root = str(tmp_path)
    fold(spark, root, [(k, T0 + timedelta(days=d), Decimal(d + 1), True) for k in range(4) for d in range(40)])
    files = reports.monthly_change(spark, root, ["k"]).inputFiles()
    assert files and all("/months/" in f for f in files)


def test_a_load_leaves_months_of_other_buckets(spark, tmp_path):
    root = str(tmp_path)
    fold(spark, root, [(k, T0, Decimal("1.00"), True) for k in range(40)])
    before = store.state(spark, root).buckets["months"]
    fold(spark, root, [(7, T0 + timedelta(days=1), Decimal("2.00"), True)])
    after = store.state(spark, root).buckets["months"]
    assert sum(a != b for a, b in zip(before, after)) == 1


def test_a_store_without_months_says_so(spark, tmp_path):
    fold(spark, str(tmp_path), [(1, T0, Decimal("1.00"), True)], months=False)
    with pytest.raises(ValueError, match="keep_months"):
        reports.monthly_change(spark, str(tmp_path))


def page(key, price, hour):
    return shop_page(hour, (str(key), f"Товар {key}", price), at=f"https://magnit.ru/catalog/{key}-x")


def load(spark, root, pages):
    version = store.Load(spark, root, "test", None, 4)
    with scratch(spark):
        seen.load_offers(version, extract.extract_catalog(frame(spark, *pages)))
        version.commit()
    found = {name: store.read(spark, root, name) for name in ("offers", "rejects", "counters")}
    return (
        sorted((r.name, str(r.price)) for r in found["offers"].collect()),
        sorted(r.reason for r in found["rejects"].collect()),
        {r.outcome: r.n_pages for r in found["counters"].collect()},
    )


DIFFER = "snapshots of one page and time differ"


def test_late_pages_copies_and_differing_copies(spark, tmp_path):
    root = str(tmp_path)
    new, late, other = page(1, "1.00", 20), page(2, "2.00", 1), page(2, "9.00", 1)
    assert load(spark, root, [new, new]) == ([("Товар 1", "1.00")], [], {"new": 1})
    # Weeks behind: loaded all the same.
    assert load(spark, root, [late]) == ([("Товар 2", "2.00")], [], {"new": 1})
    assert load(spark, root, [late, new]) == ([], [], {"copy": 2})
    assert load(spark, root, [other]) == ([], [DIFFER], {"differs": 1})
    assert load(spark, root, []) == ([], [], {})


def test_differing_copies_in_one_batch(spark, tmp_path):
    offers, rejects, counters = load(spark, str(tmp_path), [page(3, "1.00", 2), page(3, "2.00", 2), page(4, "1.00", 2)])
    assert len(offers) == 2 and rejects == [DIFFER] and counters == {"new": 2}


def test_a_failed_page_is_loaded_when_a_good_one_comes(spark, tmp_path):
    root, good = str(tmp_path), page(5, "4.00", 3)
    failed = (*good[:2], 503, *good[3:])
    offers, rejects, counters = load(spark, root, [failed])
    assert not offers and len(rejects) == 1 and counters == {"new": 1}
    assert load(spark, root, [good]) == ([("Товар 5", "4.00")], [], {"new": 1})
    assert load(spark, root, [good]) == ([], [], {"copy": 1})
    assert load(spark, root, [failed]) == ([], [DIFFER], {"differs": 1})


def test_pages_without_time(spark, tmp_path):
    root = str(tmp_path)
    bare = (page(6, "4.00", 3)[0], None, *page(6, "4.00", 3)[2:])
    assert load(spark, root, [bare, bare])[2] == {"new": 1}
    assert load(spark, root, [bare])[2] == {"copy": 1}
