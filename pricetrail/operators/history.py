"""Change-only price history: a row is written when price or stock differs from the last written row.

The comparison is with the last *written* row, so the result of one row depends on all rows before
it. Still the work splits: an unwritten row lies within one cent of the last written price and has
the same stock, so after any row the last written price is that row's price minus, plus or exactly
zero cents. Three cases cover everything a slice may need to know about the rows before it. A
slice is therefore computed for all three cases at once, and one edge row per slice tells later
which case holds.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrail.functions import fixed
from pricetrail.operators.runs import (
    EDGE,
    SLICE,
    key_at,
    settle_edges,
    sorted_slices,
    starts_new_key,
)

ORDER = ["observed_at", "page_url", "position"]
_CASES = np.array([-1, 0, 1])
_EDGE_SCHEMA = T.StructType(
    [
        T.StructField("first_key", T.StringType()),
        T.StructField("last_key", T.StringType()),
        T.StructField("first_cents", T.LongType()),
        T.StructField("first_stock", T.BooleanType()),
        T.StructField("first_writes", T.BooleanType()),
        T.StructField("first_case", T.IntegerType()),
        T.StructField("end_cents", T.ArrayType(T.LongType())),
        T.StructField("end_stock", T.BooleanType()),
    ]
)
_ADDED = [
    (SLICE, pa.int32()),
    ("_mask", pa.int32()),
    ("_open", pa.bool_()),
    ("_head", pa.bool_()),
    (
        EDGE,
        pa.struct(
            [
                ("first_key", pa.string()),
                ("last_key", pa.string()),
                ("first_cents", pa.int64()),
                ("first_stock", pa.bool_()),
                ("first_writes", pa.bool_()),
                ("first_case", pa.int32()),
                ("end_cents", pa.list_(pa.int64())),
                ("end_stock", pa.bool_()),
            ]
        ),
    ),
]


def price_changed(before: Column, after: Column) -> Column:
    """Price step test on doubles; a step of exactly one cent counts or not as the doubles fall."""
    return F.abs(before.cast("double") - after.cast("double")) > F.lit(fixed.PRICE_STEP)


def is_change(last_price: Column, last_stock: Column, price: Column, stock: Column) -> Column:
    """Write test for one observation against the last written row (nulls: nothing written yet)."""
    return last_price.isNull() | price_changed(last_price, price) | (last_stock != stock)


def order_key(order: list[str]) -> Column:
    """The order columns as one value."""
    return F.struct(*[F.col(name).alias(_FIELD.format(n)) for n, name in enumerate(order)])


def last_written(prices: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Last written price, stock and time per key, and its whole order key as ``last_seen``.

    A load replaces ``last_seen`` by that of the last row it observed, written or not. Prices and
    stock settle rows of one order key, as in the fold.
    """
    order = order or ["parsed_at"]
    position = order_key(order)
    newest = F.max(F.struct(position.alias("position"), "price", "is_in_stock", "parsed_at"))
    return (
        prices.groupBy(*keys)
        .agg(newest.alias("_newest"))
        .select(
            *keys,
            F.col("_newest.price").alias("last_price"),
            F.col("_newest.is_in_stock").alias("last_stock"),
            F.col("_newest.parsed_at").alias("last_parsed_at"),
            F.col("_newest.position").alias("last_seen"),
        )
    )


def is_late(order: list[str]) -> Column:
    """Does an observation not come strictly behind the last one seen of its key (``last_seen``)?

    The two are compared field by field, so that stored and new order columns may differ in name.
    """
    behind, equal = F.lit(False), F.lit(True)
    for n, name in enumerate(order):
        seen = F.col("last_seen")[_FIELD.format(n)]
        known, before = F.coalesce(F.col(name) > seen, F.col(name).isNotNull() & seen.isNull()), equal
        behind = behind | (before & known)
        equal = before & F.col(name).eqNullSafe(seen)
    return F.col("last_seen").isNotNull() & ~behind


_FIELD = "o{}"


def _counts(from_cents: np.ndarray, to_cents: np.ndarray) -> np.ndarray:
    return np.abs(from_cents / 100.0 - to_cents / 100.0) > fixed.PRICE_STEP


def _heads(batch: pa.RecordBatch, cents: np.ndarray, stock: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write test and following case if a row is its key's first: it meets the stored last price, if any."""
    stored = batch.column("_last_cents").is_valid().to_numpy(zero_copy_only=False)
    last = batch.column("_last_cents").fill_null(0).to_numpy()
    last_stock = batch.column("last_stock").fill_null(True).to_numpy(zero_copy_only=False)
    writes = ~stored | (last_stock != stock) | _counts(last, cents)
    return writes, np.where(writes, 0, last - cents)


def _scan(steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Case before each row and after the last, for every starting case.

    ``steps[i, c]`` is the case after row i when case c holds before it. Rows are folded in
    blocks side by side, then the blocks are joined.
    """
    rows = len(steps)
    width = max(1, int(np.sqrt(rows)))
    blocks = -(-rows // width)
    padded = np.tile(np.arange(3), (blocks * width, 1))
    padded[:rows] = steps
    padded = padded.reshape(blocks, width, 3)
    inside = np.empty((blocks, width + 1, 3), dtype=np.int64)
    inside[:, 0] = np.arange(3)
    for column in range(width):
        inside[:, column + 1] = np.take_along_axis(padded[:, column], inside[:, column], axis=1)
    before = np.empty((blocks, width, 3), dtype=np.int64)
    carry = start
    for block in range(blocks):
        before[block] = inside[block, :width][:, carry]
        carry = inside[block, width][carry]
    return np.vstack([before.reshape(-1, 3)[:rows], carry])


def _fold_slice(keys: list[str]):
    def task(number: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first_key = None
        carry = np.arange(3)
        last_cents = last_stock = None
        edge = None
        for batch in batches:
            new_key = starts_new_key(batch, keys, key)
            key = key_at(batch, keys, batch.num_rows - 1)
            cents = batch.column("_cents").to_numpy()
            stock = batch.column("is_in_stock").to_numpy(zero_copy_only=False).astype(bool)
            head_writes, head_case = _heads(batch, cents, stock)

            first_in_slice = edge is None
            if first_in_slice:
                first_key = key_at(batch, keys, 0)
                edge = {
                    "first_key": repr(first_key),
                    "first_cents": int(cents[0]),
                    "first_stock": bool(stock[0]),
                    "first_writes": bool(head_writes[0]),
                    "first_case": int(head_case[0]),
                }
                last_cents, last_stock = int(cents[0]), bool(stock[0])
            before_cents = np.concatenate([[last_cents], cents[:-1]])
            before_stock = np.concatenate([[last_stock], stock[:-1]])

            held = before_cents[:, None] + _CASES
            writes = (before_stock != stock)[:, None] | _counts(held, cents[:, None])
            case = np.where(writes, 0, held - cents[:, None])
            writes[new_key] = head_writes[new_key, None]
            case[new_key] = head_case[new_key, None]
            if first_in_slice:
                # Whether the slice's first row is written is open: keep it, start all cases behind it.
                writes[0] = True
                case[0] = _CASES
            cases = _scan(case + 1, carry)
            written = np.take_along_axis(writes, cases[:-1], axis=1)
            carry = cases[-1]
            last_cents, last_stock = int(cents[-1]), bool(stock[-1])

            mask = written @ np.array([1, 2, 4])
            keep = np.flatnonzero(mask)
            in_first_key = np.zeros(batch.num_rows, dtype=bool)
            if key == first_key or key_at(batch, keys, 0) == first_key:
                starts = np.flatnonzero(new_key[1:]) + 1
                in_first_key[: starts[0] if len(starts) else batch.num_rows] = True
            at_head = np.zeros(batch.num_rows, dtype=bool)
            at_head[0] = first_in_slice
            kept = batch.take(pa.array(keep))
            added = [
                pa.array(np.full(len(keep), number), pa.int32()),
                pa.array(np.where(in_first_key, mask, 7)[keep], pa.int32()),
                pa.array(in_first_key[keep], pa.bool_()),
                pa.array(at_head[keep], pa.bool_()),
                pa.nulls(len(keep), _ADDED[-1][1]),
            ]
            schema = batch.schema
            for name_and_type in _ADDED:
                schema = schema.append(pa.field(*name_and_type))
            yield pa.RecordBatch.from_arrays(kept.columns + added, schema=schema)
        if edge is not None:
            edge |= {
                "last_key": repr(key),
                "end_cents": [int(last_cents + _CASES[c]) for c in carry],
                "end_stock": last_stock,
            }
            row = {f.name: pa.nulls(1, f.type) for f in schema}
            row[SLICE] = pa.array([number], pa.int32())
            row[EDGE] = pa.array([edge], _ADDED[-1][1])
            yield pa.RecordBatch.from_arrays([row[f.name] for f in schema], schema=schema)

    return task


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per slice: does its first row get written, and which case holds behind it?"""
    key = cents = stock = None
    for frame in batches:
        out = []
        for row in frame.itertuples(index=False):
            if key == row.first_key:
                head = stock != row.first_stock or bool(_counts(np.int64(cents), np.int64(row.first_cents)))
                case = 0 if head else cents - row.first_cents
            else:
                head, case = row.first_writes, row.first_case
            key, stock = row.last_key, row.end_stock
            cents = row.end_cents[case + 1]
            out.append((row[0], head, 1 << (case + 1)))
        yield pd.DataFrame(out, columns=[SLICE, "_head_writes", "_case_bit"])


def change_history(
    observations: DataFrame,
    keys: list[str],
    order: list[str] | None = None,
    last: DataFrame | None = None,
) -> DataFrame:
    """Observations that get written, in the columns of the input.

    ``observations`` need ``keys``, ``price`` decimal(10,2), ``is_in_stock`` and the ``order``
    columns (first of them the time). ``last`` is the output of ``last_written`` for what is stored
    already. Rows that do not come strictly behind the last one seen of their key are left out:
    they change what follows them, so ``plans.store`` folds such keys again from a point before them.
    """
    order = order or ORDER
    names = observations.columns
    usable = observations.where(F.col("price").isNotNull() & F.col("is_in_stock").isNotNull())
    if last is None:
        return fold_rows(with_state(usable), keys, order).select(*names)
    known = usable.join(last.select(*keys, "last_price", "last_stock", "last_seen"), keys, "left").where(~is_late(order))
    return fold_rows(known.drop("last_seen"), keys, order).select(*names)


def with_state(rows: DataFrame) -> DataFrame:
    """Observations of products that have nothing written yet, as ``fold_rows`` takes them."""
    return rows.withColumns({"last_price": F.lit(None).cast("decimal(10,2)"), "last_stock": F.lit(None).cast("boolean")})


def fold_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Observations that get written; each row carries what was last written before (``last_price``, ``last_stock``)."""
    names = [name for name in rows.columns if name not in ("last_price", "last_stock")]
    # Prices go through the fold as whole cents only; the decimal is made again behind it.
    sent = [name for name in names if name != "price"] + ["_cents", "_last_cents", "last_stock"]
    in_cents = rows.withColumns({"_cents": (F.col("price") * 100).cast("long"), "_last_cents": (F.col("last_price") * 100).cast("long")})
    prepared = in_cents.select(*sent)
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in prepared.schema]
        + [
            T.StructField(SLICE, T.IntegerType()),
            T.StructField("_mask", T.IntegerType()),
            T.StructField("_open", T.BooleanType()),
            T.StructField("_head", T.BooleanType()),
            T.StructField(EDGE, _EDGE_SCHEMA),
        ]
    )
    # Rows with equal order values are taken by price and stock; full copies never write twice.
    slices = sorted_slices(prepared, keys, [*order, "_cents", "is_in_stock"], _fold_slice(keys), schema)
    edges = slices.where(F.col(EDGE).isNotNull()).select(SLICE, f"{EDGE}.*")
    settled = settle_edges(edges, _settle, f"{SLICE} int, _head_writes boolean, _case_bit int")
    candidates = slices.where(F.col(EDGE).isNull())
    # One settled row per slice: the broadcast is bounded by the number of shuffle partitions.
    resolved = candidates.join(F.broadcast(settled), SLICE)
    return resolved.where(
        ~F.col("_open")
        | (F.col("_head") & F.col("_head_writes"))
        | (~F.col("_head") & (F.col("_mask").bitwiseAND(F.col("_case_bit")) != 0))
    ).withColumn("price", (F.col("_cents").cast("decimal(12,0)") / 100).cast("decimal(10,2)")).select(*names)
