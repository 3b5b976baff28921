"""Helpers shared by the training-data operators."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.session import fresh_path

#: Least key in an ascending order; a null id sorts there.
NULL_ID = -(2**63)
#: Texts are worked on in pieces of about so many bytes, so that a task's memory doesn't grow with its input.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends here, lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(folds: int, fold: int):
    """Is the row outside the learning rows: crc32 of the id as text, modulo; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(True))


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has."""
    taken = {name.lower() for name in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Record batches cut where their texts reach the limit, each with its texts as UTF-8 bytes (null: empty)."""
    for batch in batches:
        texts = [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]
        start, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= limit:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.bitwise_xor(x, x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = np.bitwise_xor(x, x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.bitwise_xor(x, x >> np.uint64(32))


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space) in order, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    white = WHITE[data]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, np.r_[0, text_ends]))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    letters = np.flatnonzero(~white)
    firsts = np.r_[0, np.cumsum(lengths)[:-1]]
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    powers = np.full(int(lengths.max()), _STEP, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    return mixed(np.add.reduceat(_BYTE[data[letters]] * powers[place], firsts) + lengths.astype(np.uint64)), counts


def sums_by_text(values: np.ndarray, counts: np.ndarray, ufunc=np.add, empty=0) -> np.ndarray:
    """A reduction over each text's run of rows; texts without rows get ``empty``."""
    out = np.full((len(counts), *values.shape[1:]), empty, values.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = ufunc.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return out
