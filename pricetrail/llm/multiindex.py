"""Inverted multi-index over vectors: a codebook for each half of the components, cells as pairs of codewords.

A vector's cell is its nearest codeword in either half. Cells are visited by the multi-sequence algorithm: two sorted
lists of half costs are merged through a heap into an ascending list of sums, as far as the caller wants to go.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that codebooks are fitted on, about; all rows are indexed.
SAMPLE = 8192
#: Vectors of a cell, about, and the most codewords of a half.
OCCUPANCY, MOST_CODEWORDS = 128, 256
ROUNDS = 8


def usable(column: str) -> Column:
    """Is the vector there, with all components finite?"""
    return F.expr(f"coalesce(NOT exists({column}, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')), false)")


def width_of(df: DataFrame, column: str) -> int:
    """Components of the longest vector, made even; shorter ones are filled up with zeros."""
    return -(-max(2, df.agg(F.max(F.size(column))).first()[0] or 0) // 2) * 2


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def sampled(df: DataFrame, key: str, column: str, n: int, width: int) -> np.ndarray:
    """About SAMPLE rows, at most twice as many, chosen by a hash of their number ``key``."""
    share = F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    rows = df.where(share).select(column).limit(2 * SAMPLE).toArrow().column(0).combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) and rows.num_chunks else rows
    return matrix(rows, width) if len(rows) else np.zeros((0, width))


def codewords_for(n: int) -> int:
    return int(np.clip(round(np.sqrt(n / OCCUPANCY)), 1, MOST_CODEWORDS))


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means on the rows of ``x``; empty clusters keep their place."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = distances(x, words).argmin(axis=1)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(words))
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def codebooks(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Independent codebooks of the two halves."""
    half = x.shape[1] // 2
    return codebook(x[:, :half], k, 1), codebook(x[:, half:], k, 2)


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of rows to codewords."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (words * words).sum(axis=1) - 2.0 * x @ words.T, 0.0)


def half_distances(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    half = x.shape[1] // 2
    return distances(x[:, :half], books[0]), distances(x[:, half:], books[1])


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) in ascending order of ``first[i] + second[j]``, as far as ``limit``."""
    order, other = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    a, b = first[order].tolist(), second[other].tolist()
    heap = [(a[0] + b[0], 0, 0)]
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > limit:
            return
        yield cost, order[i], other[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        # Each row of the grid is opened once, by its first cell.
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def pieces_of(count: str, most: int) -> Column:
    """Into how many pieces a group of ``count`` rows is split."""
    return F.greatest(F.lit(1), F.ceil(F.col(count) / most)).cast("int")
