"""Near-duplicate embeddings: cells of an inverted multi-index visited by multi-sequence, links verified by cosine.

Vectors that lie close together in a cell are gathered in balls first. Two balls whose centres are near enough, or far
enough apart, for all their members are settled by one look; only balls between are compared member by member. So a
group of near copies that holds a third of all rows costs little more than its number of rows, and no pairs of it are
ever put out: counts are added up where they are found, and links for the components are thinned to a spanning forest.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import arrow_map, stored
from pricetrail.llm.components import components
from pricetrail.llm.multiindex import (
    codebooks,
    codewords_for,
    half_distances,
    matrix,
    multi_sequence,
    pieces_of,
    sampled,
    units,
    usable,
    width_of,
)

LIKENESS = 0.9
#: Share of the links that cells are visited for, at the lowest likeness that counts.
RECALL = 0.98
#: Angle around its centre that a ball holds; twice as much is well below that of LIKENESS.
BALL = 0.1
#: Rows that meet in a task: vectors gathered in balls at once, balls of a cell, balls that visit it.
BLOCK, MEMBERS, VISITORS = 512, 1024, 2048
#: Rounding of angles.
SLACK = 1e-7


def reach(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], likeness: float, recall: float) -> float:
    """How much farther than the nearest cell the visited ones may lie.

    Sampled vectors are turned by the angle of ``likeness`` in random directions, the hardest links there are; either
    end may find the other. Links inside the sample count as well. The excess that finds ``recall`` of each is taken.
    """
    if not len(sample):
        return 0.0
    rng = np.random.default_rng(3)
    u = np.repeat(sample[:1024], 4, axis=0)
    turn = rng.normal(size=u.shape)
    turn -= np.einsum("ij,ij->i", turn, u)[:, None] * u
    turn /= np.maximum(np.sqrt(np.einsum("ij,ij->i", turn, turn)), 1e-300)[:, None]
    ends = [(u, likeness * u + np.sqrt(1 - likeness**2) * turn)]
    few = sample[:2048]
    a, b = np.nonzero(np.triu(few @ few.T >= likeness, 1))
    # A group of copies must not outvote the rest: each vector gives the link to its least like partner.
    if len(a):
        worst = np.lexsort((np.einsum("ij,ij->i", few[a], few[b]), a))
        a, b = a[worst], b[worst]
        one = np.r_[True, a[1:] != a[:-1]]
        ends.append((few[a[one]], few[b[one]]))
    found = 0.0
    for u, v in ends:
        (ua, ub), (va, vb) = half_distances(u, books), half_distances(v, books)
        r = np.arange(len(u))
        there = ua[r, va.argmin(axis=1)] + ub[r, vb.argmin(axis=1)] - ua.min(axis=1) - ub.min(axis=1)
        back = va[r, ua.argmin(axis=1)] + vb[r, ub.argmin(axis=1)] - va.min(axis=1) - vb.min(axis=1)
        found = max(found, float(np.quantile(np.minimum(there, back), recall)))
    return found + 1e-9


def _placed(kinds: DataFrame, books, excess: float, width: int) -> DataFrame:
    """Kinds with their cell and all cells they visit, nearest first."""
    k = len(books[1])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = half_distances(units(matrix(batch.column("embedding"), width)), books)
            visits = [
                [i * k + j for _, i, j in multi_sequence(p, q, low + excess)]
                for p, q, low in zip(a, b, a.min(axis=1) + b.min(axis=1))
            ]
            cells = pa.array(visits, pa.list_(pa.int32()))
            home = pa.array([v[0] for v in visits], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, home, cells], names=[*batch.schema.names, "cell", "cells"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.schema)
    return arrow_map(kinds, run, f"{schema}, cell int, cells array<int>")


def _balls(width: int):
    """Group of vectors of one cell -> balls around their first vectors, each member in the first that holds it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        x = units(matrix(table.column("embedding").combine_chunks(), width))
        angles = np.arccos(np.clip(x @ x.T, -1.0, 1.0))
        left = np.ones(len(x), bool)
        centres, held = [], []
        while left.any():
            centre = int(left.argmax())
            inside = left & (angles[centre] <= BALL)
            inside[centre] = True
            left &= ~inside
            centres.append(centre)
            held.append(np.flatnonzero(inside))
        node, m = table.column("node").to_numpy(), table.column("m").to_numpy()
        out = table.take(pa.array(centres)).select(["node", "embedding", "cell", "cells"]).rename_columns(["ball", "embedding", "cell", "cells"])
        alone = [len(h) == 1 for h in held]
        radius = [0.0 if one else float(angles[c][h].max()) + SLACK for c, h, one in zip(centres, held, alone)]
        vectors = table.column("embedding").combine_chunks().to_pylist()
        more = {
            "radius": pa.array(radius, pa.float64()),
            "weight": pa.array([int(m[h].sum()) for h in held], pa.int64()),
            "nodes": pa.array([node[h] for h in held], pa.list_(pa.int64())),
            "ms": pa.array([m[h] for h in held], pa.list_(pa.int64())),
            # The vector of a ball's only member is its centre.
            "vectors": pa.array([[] if one else [vectors[i] for i in h] for h, one in zip(held, alone)], pa.list_(table.schema.field("embedding").type)),
        }
        for name, values in more.items():
            out = out.append_column(name, values)
        return out

    return run


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least row or column number (rows first) of each row's and column's part of a bipartite graph."""
    rows, cols = linked.shape
    a, b = np.arange(rows), np.arange(rows, rows + cols)
    i, j = np.nonzero(linked)
    while True:
        low = np.minimum(a[i], b[j])
        a2, b2 = a.copy(), b.copy()
        np.minimum.at(a2, i, low)
        np.minimum.at(b2, j, low)
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def _met(likeness: float, width: int):
    """Balls of a cell and balls that visit it -> counts of links by ball, links for components, balls to look into.

    Rows are (kind, a, b, n): 0 adds n links to all members of ball a; 1 joins balls a and b; 2 leaves them open.
    """
    limit = np.arccos(likeness)

    def run(key: tuple[pa.Scalar, ...], there: pa.Table, here: pa.Table) -> pa.Table:
        empty = _FOUND.empty_table()
        if not there.num_rows or not here.num_rows:
            return empty
        mb, qb = there.column("ball").to_numpy(), here.column("ball").to_numpy()
        mr, qr = there.column("radius").to_numpy(), here.column("radius").to_numpy()
        mw, qw = there.column("weight").to_numpy(), here.column("weight").to_numpy()
        x = units(matrix(there.column("embedding").combine_chunks(), width))
        y = units(matrix(here.column("embedding").combine_chunks(), width))
        dots = y @ x.T
        linked = dots >= likeness
        open_ = np.zeros_like(linked)
        wide = (qr[:, None] + mr) > 0
        if wide.any():
            q, m = np.nonzero(wide)
            angle, both = np.arccos(np.clip(dots[q, m], -1.0, 1.0)), qr[q] + mr[m]
            all_of, some = angle + both <= limit - SLACK, angle - both <= limit + SLACK
            linked[q, m] = all_of
            open_[q, m] = some & ~all_of
        same = qb[:, None] == mb
        linked &= ~same
        open_ &= ~same
        if not linked.any() and not open_.any():
            return empty
        out = []
        n = linked @ mw
        out.append((0, qb[n > 0], None, n[n > 0]))
        # A member that does not visit its visitor's cell would never count it.
        q, m = np.nonzero(linked)
        cells = there.column("cells").combine_chunks()
        sizes = np.diff(cells.offsets.to_numpy())
        codes = np.sort(np.repeat(np.arange(len(mb), dtype=np.int64), sizes) << 32 | cells.flatten().to_numpy().astype(np.int64))
        wanted = m.astype(np.int64) << 32 | here.column("home").to_numpy()[q].astype(np.int64)
        at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        one_way = codes[at] != wanted
        back = np.zeros(len(mb), np.int64)
        np.add.at(back, m[one_way], qw[q[one_way]])
        out.append((0, mb[back > 0], None, back[back > 0]))
        a, b = _forest(linked)
        names = np.r_[qb, mb]
        parts = np.r_[a, b]
        child = np.flatnonzero(parts != np.arange(len(names)))
        out.append((1, names[child], names[parts[child]], None))
        q, m = np.nonzero(open_)
        out.append((2, np.minimum(qb[q], mb[m]), np.maximum(qb[q], mb[m]), None))
        return pa.concat_tables(_found(*rows) for rows in out)

    return run


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _found(kind: int, a, b, n) -> pa.Table:
    size = len(a)
    columns = [np.full(size, kind), a, b, n]
    return pa.table([pa.nulls(size, f.type) if c is None else pa.array(c).cast(f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def _looked_into(likeness: float, width: int):
    """Pairs of balls with their members -> counts of links by vector (kind 3), links between balls (kind 1)."""

    def members(row) -> np.ndarray:
        return units(matrix(pa.array(row["vectors"] or [row["embedding"]], pa.list_(pa.float64())), width))

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                left, right = (batch.column(side)[n].as_py() for side in ("x", "y"))
                linked = members(left) @ members(right).T >= likeness
                if not linked.any():
                    continue
                found = [_found(1, np.array([left["ball"]]), np.array([right["ball"]]), None)]
                for side, hits in ((left, linked @ np.array(right["ms"])), (right, np.array(left["ms"]) @ linked)):
                    some = hits > 0
                    found.append(_found(3, np.array(side["nodes"])[some], None, hits[some]))
                yield from pa.concat_tables(found).combine_chunks().to_batches()

    return run


def near_duplicates(vectors: DataFrame, likeness: float = LIKENESS, recall: float = RECALL, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): how many other vectors are alike, and each one's class.

    Vectors are linked at a cosine of ``likeness`` or more, in doubles; about ``recall`` of the links at exactly that
    likeness are looked for, and nearly all of the closer ones. ``component_id`` is the least id reachable by links.
    Vectors that are null, all zero or hold null or non-finite components link with nothing. Shorter vectors are
    filled up with zeros. Each repeated row is a vector of its own; a null id names a class only of null ids. An empty
    table gives no rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    linkable = usable("embedding") & F.expr("exists(embedding, x -> x <> 0)")
    rows = stored(rows.withColumn("ok", linkable).withColumns({"h": F.xxhash64("embedding"), "g": F.hash("embedding")}), "vectors")
    apart = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    good = rows.where("ok")
    kinds = good.groupBy("h", "g").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("m"), F.first("embedding").alias("embedding"))
    kinds = stored(kinds.withColumn("node", F.monotonically_increasing_id()), "vector-kinds")
    n, width = kinds.count(), width_of(kinds, "embedding")
    sample = sampled(kinds, "node", "embedding", n, width)
    sample = units(sample) if len(sample) else sample
    books = codebooks(sample, codewords_for(n))
    placed = _placed(kinds.select("node", "m", "embedding"), books, reach(sample, books, likeness, recall), width)
    placed = stored(placed, "vector-cells")
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).select("cell", pieces_of("c", BLOCK).alias("pieces"))
    cut = placed.join(counts, "cell").withColumn("piece", F.pmod(F.hash("node"), "pieces"))
    kind = kinds.schema["embedding"].dataType.simpleString()
    schema = f"ball long, embedding {kind}, cell int, cells array<int>, radius double, weight long, nodes array<long>, ms array<long>, vectors array<{kind}>"
    balls = stored(cut.drop("pieces").groupBy("cell", "piece").applyInArrow(_balls(width), schema), "vector-balls")
    found = stored(_meetings(balls, likeness, width), "vector-links")
    pairs = found.where("kind = 2").select("a", "b").distinct()
    whole = F.struct("ball", "embedding", "nodes", "ms", "vectors")
    open_ = pairs.join(balls.select(F.col("ball").alias("a"), whole.alias("x")), "a").join(balls.select(F.col("ball").alias("b"), whole.alias("y")), "b")
    closer = stored(arrow_map(open_.select("x", "y"), _looked_into(likeness, width), "kind int, a long, b long, n long"), "vector-members")
    edges = found.where("kind = 1").union(closer.where("kind = 1")).select("a", "b")
    joined = stored(components(edges), "vector-components").withColumnRenamed("node", "ball")
    by_ball = found.where("kind = 0").groupBy(F.col("a").alias("ball")).agg(F.sum("n").alias("of_ball"))
    by_node = closer.where("kind = 3").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("of_node"))
    member = balls.select("ball", "weight", F.explode("nodes").alias("node")).join(by_ball, "ball", "left").join(joined, "ball", "left")
    member = member.join(by_node, "node", "left").join(kinds.select("node", "h", "g", "first_id"), "node")
    links = F.col("weight") - 1 + F.coalesce("of_ball", F.lit(0)) + F.coalesce("of_node", F.lit(0))
    member = stored(member.select("h", "g", "first_id", links.alias("n_links"), F.coalesce("component", "ball").alias("component")), "vector-members")
    least = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stored(member.join(least, "component").select("h", "g", "n_links", "component_id"), "vector-classes")
    out = good.join(named, ["h", "g"]).select("vec_id", "n_links", "component_id").union(apart)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _meetings(balls: DataFrame, likeness: float, width: int) -> DataFrame:
    """Every ball with the balls of the cells it visits; cells with many of either are cut into blocks."""
    member = balls.select(F.col("cell").alias("at"), "ball", "embedding", "radius", "weight", "cells")
    # Columns of their own: both sides of the meeting come from one table.
    visitor = balls.select(F.explode("cells"), "ball", "embedding", "radius", "weight", "cell").toDF("at", "ball", "embedding", "radius", "weight", "home")
    sizes = member.groupBy("at").agg(F.count(F.lit(1)).alias("c")).select("at", pieces_of("c", MEMBERS).alias("s"))
    visits = balls.select(F.explode("cells").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("c")).select("at", pieces_of("c", VISITORS).alias("t"))
    # Visits of empty cells end here.
    sizes = stored(sizes.join(visits, "at"), "vector-blocks")
    member = member.join(sizes, "at").withColumn("s", F.pmod(F.hash("ball"), "s")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    visitor = visitor.join(sizes, "at").withColumn("t", F.pmod(F.hash("ball", F.lit(1)), "t")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    at = ["at", "s", "t"]
    return member.groupBy(*at).cogroup(visitor.groupBy(*at)).applyInArrow(_met(likeness, width), "kind int, a long, b long, n long")


def true_links(vectors: DataFrame, queries: int = 256, likeness: float = LIKENESS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, n) of about ``queries`` vectors, chosen by hash: their links counted against all rows, to measure recall."""
    good = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("embedding")).where(usable("embedding") & F.expr("exists(embedding, x -> x <> 0)"))
    n, width = good.count(), width_of(good, "embedding")
    share = F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(1 << 30)) < int(min(1.0, queries / max(n, 1)) * (1 << 30))
    asked = good.where(share & F.col("vec_id").isNotNull()).limit(2 * queries).toArrow().combine_chunks()
    if not asked.num_rows:
        return good.select("vec_id", F.lit(0).cast("long").alias("n")).limit(0)
    ids, x = asked.column(0).to_numpy(), units(matrix(asked.column(1).chunk(0), width))

    def run(batches):
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += (x @ units(matrix(batch.column("embedding"), width)).T >= likeness).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["vec_id", "n"])

    return arrow_map(good.select("embedding"), run, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
