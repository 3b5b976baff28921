"""What keeps loads and made streams cheap on large tables: narrow folds, one pass for shops, several files a part."""

from datetime import datetime, timedelta

from pricetrail import schemas
from pricetrail.operators import load
from pricetrail.plans import queries, store
from pricetrail.plans.batch import load_snapshots
from pricetrail.session import fresh_path

T0 = datetime(2024, 5, 1)


def tables(spark, root, lines):
    spark.createDataFrame([(k, f"part {k}") for k in (1, 2, 5)], "p_partkey long, p_name string").write.parquet(f"{root}/part.parquet")
    spark.createDataFrame(
        lines,
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_shipdate timestamp",
    ).write.parquet(f"{root}/lineitem.parquet")
    return str(root)


def test_counters_fold_no_names_and_urls(spark, tmp_path, monkeypatch):
    folded = []
    monkeypatch.setattr(queries, "change_history", lambda rows, keys, f=queries.change_history: folded.append(rows.columns) or f(rows, keys))
    root = tables(
        spark,
        tmp_path,
        [
            (1, 1, 3, 1, 10.0, "N", T0),
            (2, 1, 3, 1, 10.0, "N", T0 + timedelta(days=1)),
            (3, 1, 3, 3, 12.0, "N", T0 + timedelta(days=2)),
            (4, 5, 4, 1, 7.0, "N", T0 - timedelta(days=9999)),
            (5, 2, 4, 1, 7.0, "N", None),
            (None, 2, None, 1, 7.0, "R", T0),
        ],
    )
    got = {(r.page_url and r.page_url[-22:], r.offers_found, r.products_created, r.history_rows) for r in queries.QUERIES["load_counters"](spark, root).collect()}
    assert got == {
        ("000000000001/000000003", 1, 1, 1), ("000000000002/000000003", 1, 0, 0), ("000000000003/000000003", 1, 0, 1),
        ("000000000004/000000004", 1, 1, 1), (None, 1, 1, 1),
    }
    assert folded == [["product_id", "observed_at", "page_url", "position", "price", "is_in_stock"]]


def test_known_urls_meet_once_each(spark):
    rows = [("s", f"u{n % 2}", str(n % 2) if n % 5 else None) for n in range(40)]
    offers = spark.createDataFrame(rows, "shop_id string, url string, internal_product_id string")
    offers = offers.selectExpr("*", "'p' AS page_url")
    found = load.with_identity(offers)
    assert {(r.url, r.product_key) for r in found.collect()} == {("u0", "id:0"), ("u1", "id:1")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    semi = plan[plan.index("Join LeftSemi"):]
    # Offers with one URL and product are one row before the join.
    assert semi.splitlines()[1].strip(" :+-").startswith("Aggregate")


def pages(spark, *rows):
    return spark.createDataFrame(
        [(f"https://magnit.ru/catalog/{n}-a", T0 + timedelta(hours=n), 200, "text/html", f'<a href="/product/{key}-x">{price} ₽ Чай</a>') for n, key, price in rows],
        schemas.PAGE_SNAPSHOTS,
    )


def test_shops_come_from_one_pass_and_ids_need_no_look_up(spark, monkeypatch):
    passes, looked_up = [], []
    monkeypatch.setattr(load, "new_shops", lambda *a, f=load.new_shops: passes.append(1) or f(*a))
    monkeypatch.setattr(load, "with_identity", lambda *a, f=load.with_identity: looked_up.append(1) or f(*a))
    root = fresh_path(spark, "one-pass")
    load_snapshots(spark, pages(spark, (0, "11", "10"), (1, "12", "20")), root)
    load_snapshots(spark, pages(spark, (2, "11", "11")), root)
    assert (len(passes), looked_up) == (2, [])
    assert {r.base_url for r in store.read(spark, root, "shops").collect()} == {"https://magnit.ru"}
    assert sorted(r.product_key for r in store.read(spark, root, "products").collect()) == ["id:11", "id:12"]


def test_made_stream_has_several_files_a_part(spark, tmp_path):
    spark.range(1000).selectExpr("id AS event_id", "id % 7 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    stream = queries._stream(spark, str(tmp_path), "events", file_rows=60)
    batches, files = [], []

    def take(batch, number):
        batches.append(sorted(r[0] for r in batch.collect()))
        files.append(len({r[0] for r in batch.selectExpr("input_file_name()").collect()}))

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 4 and batches[0] == batches[3] and sorted(sum(batches[:3], [])) == list(range(1000))
    assert files == [6] * 4
