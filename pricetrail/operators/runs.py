"""Work along an order inside keys, split so that no key has to fit in one task.

Rows are range-partitioned by (keys, order). The order goes into the range bounds, so a key that
holds a third of all rows is cut into as many partitions as its size asks for. Copies with the
same order values are told apart by the input partition they came from, so they are cut too. Each partition is
sorted and read once, front to back; what it cannot know alone (how the key's part in earlier or
later partitions ends or begins) is left open and settled from one edge row per partition.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrail.session import fresh_path

SLICE = "_slice"
EDGE = "_edge"
_TIE = "_tie"


def sorted_slices(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    task: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType,
) -> DataFrame:
    """Run ``task(slice number, sorted batches)`` over range slices and keep the result as a table.

    The table, in the shared folder, pins which rows met in which slice: edge rows and data rows
    are read from the same run even when executors are lost in between.
    """
    spark = df.sparkSession
    bounds = [*keys, *order, _TIE]
    # The input partition is the same again when a task is repeated; a random number need not be.
    tied = df.withColumn(_TIE, F.spark_partition_id())
    sliced = tied.repartitionByRange(*bounds).sortWithinPartitions(*bounds).drop(_TIE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(TaskContext.get().partitionId(), (b for b in batches if b.num_rows))

    path = fresh_path(spark, "slices")
    sliced.mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def settle_edges(edges: DataFrame, settle: Callable, schema: str) -> DataFrame:
    """Chain the edge rows in slice order; their number is at most the number of slices."""
    return edges.repartition(1).sortWithinPartitions(SLICE).mapInPandas(settle, schema)


def starts_new_key(batch: pa.RecordBatch, keys: list[str], previous: tuple | None) -> np.ndarray:
    """For each row: does its key differ from the row before (``previous`` for the first row)?"""
    new = np.zeros(batch.num_rows, dtype=bool)
    for key in keys:
        column = batch.column(key)
        if batch.num_rows > 1:
            later, earlier = column.slice(1), column.slice(0, batch.num_rows - 1)
            # Null keys are a key like others: two nulls are equal, a null and a value are not.
            changed = pc.or_(pc.fill_null(pc.not_equal(later, earlier), False), pc.xor(later.is_null(), earlier.is_null()))
            new[1:] |= changed.to_numpy(zero_copy_only=False)
    new[0] = previous is None or key_at(batch, keys, 0) != previous
    return new


def key_at(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(key)[row].as_py() for key in keys)


