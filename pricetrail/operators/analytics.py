"""Reports over the history: averages, monthly change, one product across shops, search."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pricetrail.functions import quoted, text
from pricetrail.operators.runs import SLICE, key_at, settle_edges, sorted_slices, starts_new_key


def canonical_key(maker_code: str = "manufacturer_code", name: str = "name") -> str:
    """Identity of a product across shops: the maker code, else the normalised lower-case name."""
    return f"coalesce(concat('code:', {maker_code}), concat('name:', lower({text.normalize(name)})))"


def product_across_shops(products: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per canonical product and shop: cheapest latest price, number of listings.

    Grouping, not pairing: equal products meet in one group that is reduced before the shuffle.
    """
    priced = products.join(
        latest.selectExpr("product_id AS id", "price", "is_in_stock"), "id"
    ).selectExpr(f"{canonical_key()} AS canonical_key", "shop_id", "price", "is_in_stock")
    return priced.groupBy("canonical_key", "shop_id").agg(
        F.min("price").alias("min_price"),
        F.count("*").alias("listings"),
        F.max("is_in_stock").alias("any_in_stock"),
    )


def average_price(products: DataFrame, latest: DataFrame) -> DataFrame:
    """Average, least and greatest latest price and number of shops per canonical product.

    Sums are in whole cents, so the average does not depend on the order of addition.
    """
    priced = products.join(latest.selectExpr("product_id AS id", "price"), "id").selectExpr(
        f"{canonical_key()} AS canonical_key", "shop_id", "price", "cast(price * 100 AS bigint) AS cents"
    )
    per_shop = priced.groupBy("canonical_key", "shop_id").agg(
        F.sum("cents").alias("cents"),
        F.count("*").alias("listings"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )
    return (
        per_shop.groupBy("canonical_key")
        .agg(
            (F.sum("cents").cast("double") / F.sum("listings") / F.lit(100)).alias("avg_price"),
            F.min("min_price").alias("min_price"),
            F.max("max_price").alias("max_price"),
            F.count("*").alias("n_shops"),
        )
    )


def monthly_change(prices: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """First and last price per product and month, and the change against the month before.

    Months are reduced before the shuffle; the window then sees at most one row per month.
    """
    keys = keys or ["product_id"]
    order = order or ["parsed_at", "id"]
    position = F.struct(*order)
    months = (
        prices.withColumn("month", F.date_trunc("month", F.col(order[0])))
        .groupBy(*keys, "month")
        .agg(
            F.min_by("price", position).alias("first_price"),
            F.max_by("price", position).alias("last_price"),
            F.count("*").alias("n_changes"),
        )
    )
    before = F.lag("last_price").over(Window.partitionBy(*keys).orderBy("month"))
    return months.withColumn("previous_price", before).withColumn(
        "change", F.col("last_price") - F.col("previous_price")
    )


def search(products: DataFrame, words: list[str]) -> DataFrame:
    """Products whose name holds every word, as whole tokens, in any case."""
    tokens = "split(lower(name), '[^\\\\p{L}\\\\p{N}]+')"
    tests = " AND ".join(f"array_contains({tokens}, {quoted(word.lower())})" for word in words)
    return products.where(tests)


def compare_shops(products: DataFrame, latest: DataFrame, shop_ids: list) -> DataFrame:
    """Cheapest latest price per canonical product, one column per given shop."""
    found = product_across_shops(products, latest)
    columns = [
        F.min(F.when(F.col("shop_id") == shop, F.col("min_price"))).alias(f"price_shop_{number}")
        for number, shop in enumerate(shop_ids)
    ]
    return found.groupBy("canonical_key").agg(*columns)


def _next_times(keys: list[str], time: str):
    """Task: each row's next time within its key; a slice's last row waits for the next slice."""

    def task(number: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        first = None
        schema = None

        def out(rows: pa.RecordBatch, next_time: pa.Array, last: bool) -> pa.RecordBatch:
            count = rows.num_rows
            edge = pa.nulls(count, pa.string())
            arrays = rows.columns + [
                next_time,
                pa.array(np.full(count, number), pa.int32()),
                pa.array(np.full(count, last), pa.bool_()),
                edge,
                edge,
            ]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            if schema is None:
                stamp = batch.schema.field(time).type
                schema = batch.schema
                for field in (
                    pa.field("_next", stamp),
                    pa.field(SLICE, pa.int32()),
                    pa.field("_last", pa.bool_()),
                    pa.field("_first_key", pa.string()),
                    pa.field("_last_key", pa.string()),
                ):
                    schema = schema.append(field)
                first = batch.slice(0, 1)
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            new_key = starts_new_key(rows, keys, None)
            if rows.num_rows > 1:
                following = rows.column(time).slice(1)
                blank = pa.array(new_key[1:])
                next_time = pc.if_else(blank, pa.nulls(len(following), following.type), following)
                yield out(rows.slice(0, rows.num_rows - 1), next_time, False)
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield out(held, pa.nulls(1, schema.field("_next").type), True)
            edge = [pa.nulls(1, field.type) for field in first.schema]
            edge += [
                first.column(time),
                pa.array([number], pa.int32()),
                pa.array([False], pa.bool_()),
                pa.array([repr(key_at(first, keys, 0))]),
                pa.array([repr(key_at(held, keys, 0))]),
            ]
            yield pa.RecordBatch.from_arrays(edge, schema=schema)

    return task


def _settle_next(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Next time of each slice's last row: the first time of the next slice when the key goes on."""
    before = None
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            number, first_time, first_key, last_key = row
            if before is not None:
                out.append((before[0], first_time if before[1] == first_key else None))
            before = (number, last_key)
        yield pd.DataFrame(out, columns=[SLICE, "_next_slice"])


def price_validity(
    prices: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, time: str = "parsed_at"
) -> DataFrame:
    """History with ``valid_to``: the time of the product's next row, null for the current one.

    A plain ``lead`` window would put a product's whole history into one task; slices do not.
    """
    keys = keys or ["product_id"]
    order = order or ["parsed_at", "id"]
    names = prices.columns
    stamp = prices.schema[time].dataType
    schema = T.StructType(
        list(prices.schema)
        + [
            T.StructField("_next", stamp),
            T.StructField(SLICE, T.IntegerType()),
            T.StructField("_last", T.BooleanType()),
            T.StructField("_first_key", T.StringType()),
            T.StructField("_last_key", T.StringType()),
        ]
    )
    for field in schema:
        field.nullable = True
    slices = sorted_slices(prices, keys, order, _next_times(keys, time), schema)
    edges = slices.where("_first_key IS NOT NULL").select(SLICE, "_next", "_first_key", "_last_key")
    settled = settle_edges(
        edges, _settle_next, f"{SLICE} int, _next_slice {stamp.simpleString()}"
    )
    # At most one row per slice, so the broadcast is bounded by the number of shuffle partitions.
    return (
        slices.where("_first_key IS NULL")
        .join(F.broadcast(settled), SLICE, "left")
        .selectExpr(*names, "CASE WHEN _last THEN _next_slice ELSE _next END AS valid_to")
    )
