"""What did it cost at that time: questions answered from the history by an as-of join on range slices.

History rows and questions are sorted together by product and time and read once, front to back; each question takes
the last history row before it. The rows are cut into slices by range, so a product with half of all rows or questions is many
tasks' work; what a slice's first product had before it is carried in one edge row per slice.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrail.operators.runs import SLICE, key_at, settle_edges, sorted_slices, starts_new_key

_AT, _ASKED, _QUESTION, _PRICE = "_at", "_asked", "_question", "_price"


def _answers(keys: list[str], number: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions with the last price row before them in this slice; then the slice's edge."""
    key = first = carry = None
    runs = 0
    for batch in batches:
        new = starts_new_key(batch, keys, key)
        first = key_at(batch, keys, 0) if first is None else first
        key = key_at(batch, keys, batch.num_rows - 1)
        asked = batch.column(_ASKED).to_numpy(zero_copy_only=False)
        prices = batch.column(_PRICE)
        rows = np.arange(batch.num_rows)
        start = np.maximum.accumulate(np.where(new, rows, -1))
        known = np.maximum.accumulate(np.where(asked, -1, rows))
        # A price row before the product's own rows is another product's; what was carried is the same product's.
        here = known >= np.maximum(start, 0)
        held = pa.concat_arrays([pa.array([None], prices.type) if carry is None else carry, prices])
        at = np.where(here, known + 1, 0)
        found = held.take(pa.array(at))
        carried = ~here & (start < 0) & (carry is not None)
        answered = here | carried
        opened = (runs + np.cumsum(new) <= 1) & ~answered
        found = pa.array(np.where(answered, at, -1)).to_numpy()
        found = held.take(pa.array(np.where(found < 0, None, found), pa.int64()))
        wanted = pa.array(asked)
        out = pa.RecordBatch.from_arrays([batch.column(_QUESTION), found], names=[_QUESTION, _PRICE]).filter(wanted)
        n = out.num_rows
        more = [np.full(n, number, np.int32), opened[asked]]
        nothing = [pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(more[0]), pa.array(more[1]), *nothing], names=_NAMES)
        runs += int(new.sum())
        # What the last product has had so far.
        if known[-1] >= max(start[-1], 0):
            carry = prices.slice(int(known[-1]), 1)
        elif start[-1] >= 0:
            carry = None
        kinds = batch.column(_QUESTION).type, prices.type
    if first is not None:
        edge = [pa.nulls(1, kinds[0]), carry if carry is not None else pa.nulls(1, kinds[1]), pa.array([number], pa.int32()), pa.array([False])]
        yield pa.RecordBatch.from_arrays([*edge, pa.array([repr(first)]), pa.array([repr(key)]), pa.array([runs == 1])], names=_NAMES)


_NAMES = [_QUESTION, _PRICE, SLICE, "_open", "_first", "_last", "_only"]


def _carried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slice whose last price row holds at the start of each slice's first product, if one does."""
    key = source = None
    for frame in frames:
        out = []
        for number, first, last, only, has in frame.itertuples(index=False):
            held = source if key == first else None
            if held is not None:
                out.append((number, held))
            source = number if has else (held if only else None)
            key = last
        yield pd.DataFrame(out, columns=[SLICE, "_source"]).astype({SLICE: "int32", "_source": "int32"})


def price_as_of(
    prices: DataFrame, questions: DataFrame, time: str = "at", keys: list[str] | None = None, order: list[str] | None = None, known: str = "parsed_at"
) -> DataFrame:
    """``questions`` with the ``price``, ``is_in_stock`` and ``known`` time of the last price row at or before their time.

    Price rows are taken in ``order``, whose first column is their time; one at the very time of a question counts.
    Questions before the first row, of an unknown product, without a time or with a null key get nulls. Equal questions
    give a row each.
    """
    keys, order = keys or ["product_id"], order or ["parsed_at", "id"]
    kind = T.TimestampType()
    rest = [F.col(name).alias(f"_o{n}") for n, name in enumerate(order[1:])]
    price = F.struct("price", "is_in_stock", F.col(known).alias("_known"))
    answer = prices.select("price", "is_in_stock", F.col(known).alias("_known")).schema
    key = [F.col(name).alias(f"_k{n}") for n, name in enumerate(keys)]
    question = F.struct(*questions.columns)
    asked_schema = questions.schema
    there = prices.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).select(
        *key, F.col(order[0]).cast(kind).alias(_AT), F.lit(False).alias(_ASKED), *rest, F.lit(None).cast(asked_schema).alias(_QUESTION), price.alias(_PRICE)
    )
    blank = [F.lit(None).cast(there.schema[f"_o{n}"].dataType).alias(f"_o{n}") for n in range(len(rest))]
    good = " AND ".join(f"{name} IS NOT NULL" for name in [*keys, time])
    here = questions.where(good).select(
        *key, F.col(time).cast(kind).alias(_AT), F.lit(True).alias(_ASKED), *blank, question.alias(_QUESTION), F.lit(None).cast(answer).alias(_PRICE)
    )
    schema = T.StructType(
        [
            T.StructField(_QUESTION, asked_schema),
            T.StructField(_PRICE, answer),
            T.StructField(SLICE, T.IntegerType()),
            T.StructField("_open", T.BooleanType()),
            T.StructField("_first", T.StringType()),
            T.StructField("_last", T.StringType()),
            T.StructField("_only", T.BooleanType()),
        ]
    )
    # At one time a question (true) comes behind the price rows (false).
    sorted_by = [_AT, _ASKED, *[f"_o{n}" for n in range(len(rest))]]
    by = [f"_k{n}" for n in range(len(keys))]
    slices = sorted_slices(there.unionByName(here), by, sorted_by, partial(_answers, by), schema)
    edges = slices.where("_first IS NOT NULL")
    settled = settle_edges(edges.select(SLICE, "_first", "_last", "_only", F.col(_PRICE).isNotNull().alias("_has")), _carried, f"{SLICE} int, _source int")
    before = edges.select(F.col(SLICE).alias("_source"), F.col(_PRICE).alias("_before"))
    # One row per slice on this side.
    carried = settled.join(before, "_source").select(SLICE, "_before")
    rows = slices.where("_first IS NULL").join(F.broadcast(carried), SLICE, "left")
    found = F.when(F.col("_open"), F.col("_before")).otherwise(F.col(_PRICE))
    answered = rows.withColumn(_PRICE, found).select(
        f"{_QUESTION}.*", F.col(f"{_PRICE}.price").alias("price"), F.col(f"{_PRICE}.is_in_stock").alias("is_in_stock"), F.col(f"{_PRICE}._known").alias(known)
    )
    open_ = questions.where(f"NOT coalesce({good}, false)")
    blank = [F.lit(None).cast(answer[n].dataType).alias(m) for n, m in (("price", "price"), ("is_in_stock", "is_in_stock"), ("_known", known))]
    return answered.unionByName(open_.select(*questions.columns, *blank))
