"""Hard negatives: exact top rows by inner product inside score windows, by an inverted multi-index.

Two half-space codebooks form cells. For an anchor, a cell's rows score at most the sum of two half bounds: the half
anchor times the codeword, plus its length times the codeword's radius. The multi-sequence heap gives cells in falling
order of that bound; all that can matter have been visited once the bound falls below a certified floor.

Three passes keep what is put out small: a few best cells give the floor of the positives; the cells that reach it give
the exact positives; the cells that reach the windows' floor give the exact negatives. Each pass joins rows and anchors
by shards of a first codeword's rows, both sides cut to a bounded size.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetrail.llm.common import arrow_map, stored
from pricetrail.llm.multiindex import codebooks, codewords_for, half_distances, matrix, multi_sequence, pieces_of, sampled, usable, width_of

SCALE = 256
POSITIVES = NEGATIVES = 5
EVERY = 100
#: Rows in the cells that the first pass visits for an anchor, at least.
SEED_ROWS = 512
#: Rows of a shard, anchors that meet them in one task, anchors scored at once.
SHARD, ANCHORS, CHUNK = 8192, 8192, 128
_EXACT = float(2**53)


def whole(x: np.ndarray) -> np.ndarray:
    """Components as whole numbers: floor(256 x)."""
    return np.floor(SCALE * x)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while they hold them, else in Python's integers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= _EXACT:
        exact = np.vectorize(int, otypes=[object])
        return exact(a).dot(exact(b).T)
    return a @ b.T


class Cells:
    """Codebooks, the largest distance of a row from each codeword, and the number of rows by cell."""

    def __init__(self, books, radii, counts):
        self.books, self.radii, self.counts = books, radii, counts

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most that the half products of each row of ``x`` with the rows of each codeword can be."""
        half = x.shape[1] // 2
        out = []
        for part, words, radius in zip((x[:, :half], x[:, half:]), self.books, self.radii):
            length = np.sqrt((part * part).sum(axis=1))[:, None]
            most = part @ words.T + length * radius
            # Rounding, far above that of doubles.
            out.append(most + 1e-9 * length * (np.sqrt((words * words).sum(axis=1)) + radius) + 1e-6)
        return out[0], out[1]

    def seed(self, a: np.ndarray, b: np.ndarray, rows: int) -> float:
        """Bound of the cell at which the cells visited so far hold ``rows`` rows."""
        held, bound = 0, np.inf
        for cost, i, j in multi_sequence(-a, -b, np.inf):
            held, bound = held + int(self.counts[i, j]), -cost
            if held >= rows:
                break
        return bound

    def visited(self, a: np.ndarray, b: np.ndarray, floor: float) -> list[int]:
        """First codewords of the cells whose bound reaches the floor."""
        seen, all_of = set(), int(self.counts.any(axis=1).sum())
        for _, i, j in multi_sequence(-a, -b, -floor):
            if self.counts[i, j]:
                seen.add(i)
            if len(seen) == all_of:
                break
        return sorted(seen)


def _indexed(rows: DataFrame, width: int) -> tuple[DataFrame, Cells]:
    """Rows with their cell (first, second), and the index."""
    n = rows.count()
    books = codebooks(whole(sampled(rows, "node", "embedding", n, width)), codewords_for(n))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = half_distances(whole(matrix(batch.column("embedding"), width)), books)
                more = [pa.array(a.argmin(axis=1), pa.int32()), pa.array(b.argmin(axis=1), pa.int32()), pa.array(np.sqrt(a.min(axis=1))), pa.array(np.sqrt(b.min(axis=1)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "first", "second", "da", "db"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = stored(arrow_map(rows, run, f"{schema}, first int, second int, da double, db double"), "negatives-cells")
    # At most a row per cell, so bounded by the codebooks.
    cells = placed.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"), F.max("da").alias("da"), F.max("db").alias("db")).collect()
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    radii = np.zeros(len(books[0])), np.zeros(len(books[1]))
    for c in cells:
        counts[c["first"], c["second"]] = c["n"]
        radii[0][c["first"]] = max(radii[0][c["first"]], c["da"])
        radii[1][c["second"]] = max(radii[1][c["second"]], c["db"])
    # The squared distances are differences of large numbers: leave room for what they lose.
    radii = tuple(r + 1e-6 * (r + np.sqrt((w * w).sum(axis=1))) for r, w in zip(radii, books))
    return placed, Cells(books, radii, counts)


def _visits(anchors: DataFrame, cells: Cells, width: int, seed_rows: int | None) -> DataFrame:
    """Anchors with ``floor`` (set from the first cells where ``seed_rows`` is given) and the first codewords to visit."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = cells.bounds(whole(matrix(batch.column("embedding"), width)))
            if seed_rows is None:
                floors = batch.column("floor").to_numpy()
            else:
                floors = np.array([cells.seed(p, q, seed_rows) for p, q in zip(a, b)])
            at = pa.array([cells.visited(p, q, f) for p, q, f in zip(a, b, floors)], pa.list_(pa.int32()))
            kept = [n for n in batch.schema.names if n != "floor"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(floors, pa.float64()), at], names=[*kept, "floor", "visits"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema if f.name != "floor")
    return arrow_map(anchors, run, f"{schema}, floor double, visits array<int>")


def _firsts(scores: np.ndarray, allowed: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` greatest allowed scores, of equal ones the first, greatest first."""
    at = np.flatnonzero(allowed)
    if len(at) > most:
        values = scores[at]
        least = np.partition(values, len(at) - most)[len(at) - most]
        above = at[values > least]
        at = np.r_[above, at[values == least][: most - len(above)]]
    return at[np.argsort(-scores[at], kind="stable")]


_HITS = pa.schema([("anchor", pa.int64()), ("rank", pa.int32()), ("node", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_HIT_SCHEMA = "anchor long, rank int, node long, id long, score long"


def _scored(cells: Cells, width: int, pick):
    """Rows of a shard and the anchors that visit it -> what ``pick`` keeps of each anchor's scores.

    Only rows of cells that reach an anchor's floor are scored. ``pick(scores, seen, same, own, anchor)`` gives (rank,
    places) lists.
    """

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _HITS.empty_table()
        rows = rows.combine_chunks().sort_by([("vec_id", "ascending"), ("node", "ascending")])
        anchors = anchors.combine_chunks()
        x = whole(matrix(rows.column("embedding").combine_chunks(), width))
        node, label, second = (rows.column(n).to_numpy() for n in ("node", "label", "second"))
        ids = rows.column("vec_id").combine_chunks()
        groups = [(j, np.flatnonzero(second == j)) for j in np.unique(second)]
        first = rows.column("first")[0].as_py()
        out = []
        for start in range(0, anchors.num_rows, CHUNK):
            some = anchors.slice(start, CHUNK)
            y = whole(matrix(some.column("embedding").combine_chunks(), width))
            a, b = cells.bounds(y)
            open_ = a[:, [first]] + b >= some.column("floor").to_numpy()[:, None]
            scores = None
            seen = np.zeros((len(y), len(x)), bool)
            for j, members in groups:
                who = np.flatnonzero(open_[:, j])
                if not len(who):
                    continue
                found = _products(y[who], x[members])
                if scores is None or (found.dtype == object and scores.dtype != object):
                    scores = np.zeros(seen.shape, found.dtype) if scores is None else scores.astype(object)
                scores[np.ix_(who, members)] = found
                seen[np.ix_(who, members)] = True
            if scores is None:
                continue
            for q, anchor in enumerate(some.select([n for n in some.column_names if n != "embedding"]).to_pylist()):
                own = node == anchor["node"]
                for rank, places in pick(scores[q], seen[q], label == anchor["label"], own, anchor):
                    if len(places):
                        out.append((anchor["node"], rank, places, scores[q][places]))
        if not out:
            return _HITS.empty_table()
        places = np.concatenate([o[2] for o in out])
        sizes = [len(o[2]) for o in out]
        values = np.concatenate([np.asarray(o[3], object) for o in out])
        return pa.table(
            [
                pa.array(np.repeat([o[0] for o in out], sizes), pa.int64()),
                pa.array(np.repeat([o[1] for o in out], sizes), pa.int32()),
                pa.array(node[places], pa.int64()),
                ids.take(pa.array(places)),
                # What does not fit in 64 bits is put out as the end of their range.
                pa.array([max(-(2**63), min(2**63 - 1, int(v))) for v in values], pa.int64()),
            ],
            schema=_HITS,
        )

    return run


def _pass(rows: DataFrame, shards: DataFrame, anchors: DataFrame, cells: Cells, width: int, pick, seed_rows: int | None = None, one_piece: bool = False) -> DataFrame:
    """Hits of all anchors in the shards that they visit."""
    turns = max(1, -(-anchors.count() // ANCHORS))
    visits = _visits(anchors, cells, width, seed_rows).withColumn("first", F.explode("visits")).drop("visits").join(shards, "first")
    if one_piece:
        # A floor from one piece of a large group of rows is a floor too.
        visits = visits.withColumn("piece", F.pmod(F.hash("node"), "pieces"))
    else:
        visits = visits.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    visits = visits.drop("pieces").withColumn("turn", F.pmod(F.hash("node", F.lit(1)), F.lit(turns)))
    dealt = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))) if turns > 1 else rows.withColumn("turn", F.lit(0))
    at = ["first", "piece", "turn"]
    return dealt.groupBy(*at).cogroup(visits.groupBy(*at)).applyInArrow(_scored(cells, width, pick), _HIT_SCHEMA)


def _best(hits: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first hits of each key: higher scores first, then smaller ids; ranked from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "node")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def _positives(scores, seen, same, own, anchor):
    return [(0, _firsts(scores, seen & same & ~own, POSITIVES))]


def _around(scores, seen, same, own, anchor):
    """For the first pass: best of the same label (0), and of the others (1) not above the fifth of those."""
    near = _firsts(scores, seen & same & ~own, POSITIVES)
    if len(near) < POSITIVES:
        return [(0, near)]
    return [(0, near), (1, _firsts(scores, seen & ~same & (scores <= scores[near[-1]]), NEGATIVES))]


def _negatives(scores, seen, same, own, anchor):
    """For each positive's score p: best of the other labels with 80 p <= 100 score <= 100 p."""
    out = []
    for rank, p in enumerate(anchor["positives"]):
        inside = seen & ~same & (5 * scores >= 4 * p) & (scores <= p)
        out.append((rank + 1, _firsts(scores, inside, NEGATIVES)))
    return out


def relabelled(vectors: DataFrame) -> DataFrame:
    """The label plus one, modulo ten, where the id is divisible by seven."""
    label = F.col("label").cast("long")
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors of ``vectors``.

    ``vectors`` are (vec_id, label, embedding); anchors have an id divisible by EVERY. Rows with a null label, a null
    vector, or null or non-finite components take no part. Scores are inner products of floor(256 x), exact. Each of a
    row's first five others of its label is a positive; its negatives are the first five rows of other labels with 0.8
    to 1 times its score. Equal scores go by the smaller id, null ids last. Each repeated row is a row of its own;
    shorter vectors are filled up with zeros; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("label").isNotNull() & usable("embedding")).withColumn("node", F.monotonically_increasing_id())
    rows = stored(rows, "negatives-rows")
    width = width_of(rows, "embedding")
    placed, cells = _indexed(rows, width)
    shards = placed.groupBy("first").agg(F.count(F.lit(1)).alias("c")).select("first", pieces_of("c", SHARD).alias("pieces"))
    shards = stored(shards, "negatives-shards")
    dealt = placed.drop("da", "db").join(shards, "first").withColumn("piece", F.pmod(F.hash("node"), "pieces")).drop("pieces")
    dealt = stored(dealt, "negatives-dealt")
    anchors = stored(rows.where(F.col("vec_id") % EVERY == 0).select("node", "vec_id", "label", "embedding"), "negatives-anchors")

    def run(anchors: DataFrame, pick, seed_rows: int | None = None, one_piece: bool = False) -> DataFrame:
        return _pass(dealt, shards, anchors, cells, width, pick, seed_rows, one_piece)

    seeds = stored(_best(run(anchors.drop("vec_id"), _around, SEED_ROWS, True), ["anchor", "rank"], POSITIVES), "negatives-seeds")
    # The fifth positive seen, and the fifth of the others not above it: no final one lies below.
    known = seeds.groupBy(F.col("anchor").alias("node")).agg(
        F.max(F.when((F.col("rank") == 0) & (F.col("place") == POSITIVES), F.col("score"))).alias("low"),
    )
    under = seeds.where("rank = 1").join(known.withColumnRenamed("node", "anchor"), "anchor").where("score <= low")
    under = under.groupBy(F.col("anchor").alias("node")).agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("g")).where(F.col("c") >= NEGATIVES)
    begun = stored(anchors.join(known, "node", "left").join(under.select("node", "g"), "node", "left"), "negatives-floors")
    floored = begun.drop("vec_id", "g", "low").join(begun.select("node", F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))).alias("floor")), "node")
    positives = stored(_best(run(floored, _positives), ["anchor"], POSITIVES), "negatives-positives")
    # Below zero a window is empty: its lower end lies above its upper one.
    asked = positives.where("score >= 0").groupBy(F.col("anchor").alias("node")).agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("p"))
    asked = asked.select("node", F.col("p.score").alias("positives")).join(begun, "node")
    low = F.array_min("positives") * F.lit(0.8) - 1
    asked = asked.select("node", "label", "embedding", "positives", F.greatest(low, F.coalesce(F.col("g").cast("double"), low)).alias("floor"))
    hits = _best(run(stored(asked, "negatives-asked"), _negatives), ["anchor", "rank"], NEGATIVES)
    named = positives.select("anchor", F.col("place").alias("rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("node").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = hits.join(named, ["anchor", "rank"]).join(ids, "anchor")
    return out.select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
