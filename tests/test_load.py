"""Whole loads: identity, upsert, replay, rejects, streams in several micro-batches."""

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from pricetrail import schemas
from pricetrail.operators import load, relations, responses, routing
from pricetrail.operators.analytics import price_validity
from pricetrail.plans import store
from pricetrail.plans.batch import CAPTURE_RULES, load_snapshots
from pricetrail.sources import snapshots, tables
from pricetrail.streaming import jobs

T0 = datetime(2024, 5, 1)
MAGNIT = "https://magnit.ru/catalog/1-a"


def magnit(hour, *items, url=MAGNIT, status=200):
    body = "".join(f'<a href="/product/{key}-x">{price} ₽ {name}</a>' for key, name, price in items)
    return (url, T0 + timedelta(hours=hour), status, "text/html", body)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.PAGE_SNAPSHOTS)


def stored_prices(spark, root, version):
    joined = relations.products_with_prices(
        store.read(spark, root, "products", version), store.read_prices(spark, root)
    )
    return sorted((r.internal_product_id, r.parsed_at.hour, r.price) for r in joined.collect())


def test_load_and_replay(spark, tmp_path):
    root = str(tmp_path)
    day = frame(
        spark,
        magnit(0, ("11", "Чай", "10"), ("12", "Кофе", "20")),
        magnit(1, ("11", "Чай", "10"), ("12", "Кофе", "25")),
        magnit(2, url="https://magnit.ru/catalog/empty"),
        magnit(2, url="https://example.com/"),
        ("https://www.perekrestok.ru/cat/1", T0, 503, "text/html", ""),
    )
    load_snapshots(spark, day, root)
    expected = [("11", 0, Decimal("10.00")), ("12", 0, Decimal("20.00")), ("12", 1, Decimal("25.00"))]
    assert stored_prices(spark, root, 0) == expected
    # A shop exists even when its page did not load.
    shops = {r.base_url for r in store.read(spark, root, "shops", 0).collect()}
    assert shops == {"https://magnit.ru", "https://www.perekrestok.ru"}
    stages = {(r.page_url, r.stage) for r in store.read(spark, root, "rejects", 0).collect()}
    assert stages == {
        ("https://magnit.ru/catalog/empty", "extract"), ("https://example.com/", "route"), ("https://www.perekrestok.ru/cat/1", "http")
    }
    counters = {
        (r.observed_at.hour, r.offers_found, r.products_created, r.history_rows)
        for r in store.read(spark, root, "counters", 0).collect()
    }
    assert counters == {(0, 2, 2, 2), (1, 2, 0, 1)}

    load_snapshots(spark, day, root)
    assert stored_prices(spark, root, 1) == expected
    load_snapshots(spark, frame(spark, magnit(3, ("11", "Чай новый", "9"))), root)
    assert stored_prices(spark, root, 2) == [expected[0], ("11", 3, Decimal("9.00")), *expected[1:]]
    products = {r.internal_product_id: r for r in store.read(spark, root, "products", 2).collect()}
    assert products["11"].name == "Чай новый" and products["12"].name == "Кофе"
    assert products["11"].created_at == T0 and products["11"].updated_at == T0 + timedelta(hours=3)


def test_same_product_twice_in_a_page_is_taken_in_sequence(spark, tmp_path):
    body = '{"products": [%s]}' % ", ".join(
        f'{{"plu": 5, "name": "n{p}", "is_available": true, "prices": {{"regular": {p}}}}}' for p in (10, 12, 10)
    )
    page = ("https://5ka.ru/catalog/1/", T0, 200, "application/json", body)
    load_snapshots(spark, frame(spark, page), str(tmp_path))
    assert [p for _, _, p in stored_prices(spark, str(tmp_path), 0)] == [10, 10, 12]
    assert [r.name for r in store.read(spark, str(tmp_path), "products", 0).collect()] == ["n10"]


def test_copies_of_a_snapshot_count_once(spark, tmp_path):
    page = magnit(0, ("11", "Чай", "10"))
    load_snapshots(spark, frame(spark, *[page] * 50), str(tmp_path), drop_copies=True)
    counters = store.read(spark, str(tmp_path), "counters", 0).collect()
    assert [(r.offers_found, r.products_created, r.history_rows) for r in counters] == [(1, 1, 1)]


def test_differing_copies_leave_a_reject(spark, tmp_path):
    """Of two snapshots of one page and time the one with more offers is loaded, and the difference is told."""
    pages = [magnit(0, ("11", "Чай", "10")), magnit(0, ("11", "Чай", "10"), ("12", "Кофе", "20")), magnit(1, ("11", "Чай", "9"))]
    load_snapshots(spark, frame(spark, *pages, pages[2]), str(tmp_path), drop_copies=True, index_words=True)
    assert [p for _, _, p in stored_prices(spark, str(tmp_path), 0)] == [10, 9, 20]
    rejects = store.read(spark, str(tmp_path), "rejects", 0).collect()
    assert [(r.page_url, r.fetched_at, r.stage) for r in rejects] == [(MAGNIT, T0, "copy")]
    load_snapshots(spark, frame(spark, magnit(2, ("11", "Чай зелёный", "9"), ("13", "Кофе чёрный", "5"))), str(tmp_path))
    names = {r.id: r.name for r in store.read(spark, str(tmp_path), "products").collect()}

    def found(*words, **how):
        return sorted(names[r.id] for r in store.search(spark, str(tmp_path), list(words), **how).collect())

    assert found("КОФЕ") == ["Кофе", "Кофе чёрный"] and found("чай", "зелёный") == ["Чай зелёный"] and found("нет") == []
    best = store.search(spark, str(tmp_path), ["кофе", "чёрный"], all_words=False).orderBy(F.desc("score")).collect()
    assert [names[r.id] for r in best] == ["Кофе чёрный", "Кофе"] and best[1].score == 0.5


OFFER = "shop_base_url string, page_url string, observed_at timestamp, position int, name string, price decimal(10,2), url string, internal_product_id string, manufacturer_code string, is_in_stock boolean"


def test_offer_without_id_keeps_the_id_of_its_url(spark):
    def offer(hour, pid, maker, url="u1"):
        return ("https://s", "p", T0 + timedelta(hours=hour), 0, f"n{hour}", Decimal(1), url, pid, maker, True)

    first = load.upsert_products(
        load.with_identity(spark.createDataFrame([offer(0, "7", "M"), offer(1, None, None), offer(0, None, None, "u2")], OFFER))
    ).drop("created")
    rows = {(r.product_key, r.internal_product_id, r.manufacturer_code, r.name) for r in first.collect()}
    assert rows == {("id:7", "7", None, "n1"), ("url:u2", None, None, "n0")}
    later = spark.createDataFrame([offer(5, "8", "N", "u2"), offer(6, None, "K", "u2"), offer(6, None, None, None)], OFFER)
    second = load.upsert_products(load.with_identity(later, first), first)
    rows = {(r.product_key, r.internal_product_id, r.manufacturer_code, r.created) for r in second.collect()}
    assert rows == {("id:7", "7", None, False), ("url:u2", None, "K", False), ("id:8", "8", "N", True), ("url:p", None, None, True)}
    assert relations.colliding_hashes(second).count() == 0


def test_shop_rows_are_never_updated(spark):
    routed = routing.route(frame(spark, magnit(5)), "catalog")
    stored = load.new_shops(routing.route(frame(spark, magnit(0, url="https://magnit.ru/product/1")), "product"))
    after = load.get_or_create_shops(routed, stored).collect()
    assert [(r.base_url, r.parser_config, r.created_at) for r in after] == [
        ("https://magnit.ru", {"product_parser": "magnit_product"}, T0)
    ]


def test_captured_catalogue(spark, tmp_path):
    url = "https://5ka.ru/catalog/1/"
    pages = frame(
        spark,
        (url, T0, 200, "text/html", "<html>ok</html>"),
        (url, T0 + timedelta(hours=1), 200, "text/html", "Проблемы со связью"),
        (url, T0 + timedelta(hours=2), 200, "text/html", "<html>ok</html>"),
        (url, T0 + timedelta(hours=3), 200, "text/html", "<html>ok</html>"),
        magnit(0, ("1", "Чай", "3")),
    )
    good = '{"products": [{"plu": 1, "name": "Чай", "is_available": true, "prices": {"regular": "5"}}]}'
    api = "https://5d.5ka.ru/api/catalog/v2/x"
    answers = spark.createDataFrame(
        [
            (url, T0, 3, api, 200, "application/json", '{"products": []}'),
            (url, T0, 2, api, 500, "application/json", good),
            (url, T0, 1, "https://5ka.ru/logo.png", 200, "image/png", ""),
            (url, T0 + timedelta(hours=1), 1, api, 200, "application/json", good),
            (url, T0 + timedelta(hours=2), 1, api, 429, "application/json", good),
        ],
        schemas.NETWORK_RESPONSES,
    )
    load_snapshots(spark, pages, str(tmp_path), responses=answers)
    assert [p for _, _, p in stored_prices(spark, str(tmp_path), 0)] == [3, 5]
    reasons = {r.fetched_at.hour: r.reason for r in store.read(spark, str(tmp_path), "rejects", 0).collect()}
    assert reasons == {
        1: "page is blocked before the catalogue loads",
        2: "catalogue API is blocked after the page loads",
        3: "timeout waiting for the catalogue response",
    }
    captured = responses.capture(pages.where("page_url like '%5ka%'"), answers)
    report = responses.diagnostics(captured, answers).where(f"fetched_at = '{T0}'").orderBy("line_no").collect()
    assert [(r.label, r.text) for r in report] == [
        ("page", url),
        ("kind", "json"),
        ("block stage", "-"),
        ("matched", f"{api} [status 500]"),
        ("content type", "application/json"),
        ("preview", good),
        ("network", "https://5ka.ru/logo.png [200] image/png"),
        ("network", f"{api} [500] application/json"),
        ("network", f"{api} [200] application/json"),
    ]
    assert len(CAPTURE_RULES) == 1


def test_streamed_loads_equal_one_batch_load(spark, tmp_path):
    hours = [magnit(h, ("11", "Чай", 10 + h // 2), ("12", "Кофе", 20)) for h in range(6)]
    folder = str(tmp_path / "pages")
    for row in hours:
        frame(spark, row).coalesce(1).write.mode("append").parquet(folder)
    pages = snapshots.stream_snapshots(spark, folder, max_files=2)
    root = str(tmp_path / "tables")
    jobs.stream_load(pages, root, str(tmp_path / "ck")).awaitTermination()
    last = store.latest(spark, root)
    assert last == 2
    load_snapshots(spark, frame(spark, *hours), str(tmp_path / "batch"))
    assert stored_prices(spark, root, last) == stored_prices(spark, str(tmp_path / "batch"), 0)
    # New files continue from the stored checkpoint and versions.
    frame(spark, magnit(9, ("12", "Кофе", 21))).coalesce(1).write.mode("append").parquet(folder)
    jobs.stream_load(snapshots.stream_snapshots(spark, folder), root, str(tmp_path / "ck")).awaitTermination()
    assert ("12", 9, Decimal("21.00")) in stored_prices(spark, root, last + 1)


def test_streamed_offers_drop_copies(spark, tmp_path):
    folder = str(tmp_path / "pages")
    rows = [magnit(h, ("11", "Чай", 10 + h)) for h in (0, 0, 1)]
    for row in rows:
        frame(spark, row).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.offers_stream(snapshots.stream_snapshots(spark, folder, max_files=1))
    jobs.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.price for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [10, 11]


def test_snapshots_and_responses_from_json_lines(spark, tmp_path):
    pages = frame(spark, magnit(0, ("1", "Чай", "3")))
    pages.write.json(str(tmp_path / "pages"))
    read = snapshots.read_snapshots(spark, str(tmp_path / "pages"), "json")
    assert read.schema == schemas.PAGE_SNAPSHOTS and read.collect() == pages.collect()
    answers = spark.createDataFrame([("u", T0, 1, "x", 200, "t", "b")], schemas.NETWORK_RESPONSES)
    answers.write.parquet(str(tmp_path / "answers"))
    assert snapshots.read_responses(spark, str(tmp_path / "answers")).collect() == answers.collect()


def test_html_files_as_snapshots(spark, tmp_path):
    (tmp_path / "catalog").mkdir()
    (tmp_path / "catalog" / "7-x.html").write_text(magnit(0, ("1", "Чай", "3"))[4], encoding="utf-8")
    rows = snapshots.read_html_files(spark, f"file:{tmp_path}", "https://magnit.ru").collect()
    assert [(r.page_url, r.http_status) for r in rows] == [("https://magnit.ru/catalog/7-x", 200)]


def test_validity_over_slices(spark):
    rows = [(n % 3, T0 + timedelta(minutes=n), n) for n in range(300)]
    prices = spark.createDataFrame(rows, "product_id long, parsed_at timestamp, id long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = price_validity(prices).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r.id: r.valid_to for r in got} == {
        n: T0 + timedelta(minutes=n + 3) if n + 3 < 300 else None for n in range(300)
    }
