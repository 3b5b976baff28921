"""Prefix trie of conversations: ROLLUP over positional turn-id columns counts all prefixes together.

A conversation becomes one row with its turns' ids in columns t1, t2, ...; ``GROUP BY prior, ROLLUP (t1, ...)`` with
``grouping_id`` gives every prefix one row. Columns come in blocks: a conversation that goes on behind a block is a row
of the next one, keyed by the node that the block ended in. Counts and sums are reduced before each shuffle, so a first
turn that a third of all conversations share is no hot spot.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrail.llm.common import arrow_map, stored
from pricetrail.operators.runs import SLICE, key_at, settle_edges, sorted_slices, starts_new_key

#: Columns of the first blocks; later blocks have as many as the last one. Most conversations end in the first block.
WIDTHS = (8, 16, 32)
#: Conversations that begin with turns of the first one of their group of so many; at most MOST_SHARED turns.
GROUP, MOST_SHARED = 20, 3
#: Ids are joined to strings of about so many characters before they are hashed.
CHUNK = 1 << 16
ROOT = "root"


def _numbered(number: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place and the words before it in its conversation, as far as this slice knows; then the slice's edge."""
    key = first = None
    place = words = 0
    runs = 0
    for batch in batches:
        new = starts_new_key(batch, ["conv_id"], key)
        if first is None:
            first = key_at(batch, ["conv_id"], 0)
        key = key_at(batch, ["conv_id"], batch.num_rows - 1)
        size = batch.column("words").to_numpy()
        rows = np.arange(batch.num_rows)
        before = np.cumsum(size) - size
        head = np.maximum.accumulate(np.where(new, rows, -1))
        inside = head >= 0
        at = np.where(inside, rows - head, rows + place)
        run = np.where(inside, before - before[head], before + words)
        opened = runs + np.cumsum(new) <= 1
        runs += int(new.sum())
        place, words = int(at[-1]) + 1, int(run[-1] + size[-1])
        extra = [pa.array(at + 1, pa.int64()), pa.array(run, pa.int64()), pa.array(np.full(len(rows), number), pa.int32()), pa.array(opened)]
        edge = [pa.nulls(len(rows), pa.int64())] * 2 + [pa.nulls(len(rows), pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("conv_id", "mark", "words")] + extra + edge, names=_NUMBERED)
    if first is not None:
        values = [None, None, None, place, words, number, None, first[0], key[0], runs == 1]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], names=_NUMBERED)


_NUMBERED = ["conv_id", "mark", "words", "pos", "before", SLICE, "_open", "_first", "_last", "_only"]
_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]


def _carried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns and words that each slice's first conversation has in the slices before."""
    key, place, words = None, 0, 0
    for frame in frames:
        out = []
        for number, first, last, only, n, w in frame.itertuples(index=False):
            if key != first:
                place = words = 0
            out.append((number, place, words))
            place, words = (place + n, words + w) if only else (n, w)
            key = last
        yield pd.DataFrame(out, columns=[SLICE, "_place", "_words"])


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, mark, words, before): turns counted from 1 in the order of ``turn`` (null first).

    ``mark`` is a digest of role and text, equal for equal turns; it settles turns of one number. ``words`` are runs
    without ASCII white space, ``before`` those of earlier turns. Null roles and texts become empty; rows without a
    ``conv_id`` belong to no conversation and are left out; a repeated row is a turn of its own. Texts are not
    shuffled, and a conversation that holds a third of all turns is cut into slices.
    """
    marks = conversations.where("conv_id IS NOT NULL").selectExpr(
        "cast(conv_id AS bigint) AS conv_id",
        "turn",
        "unhex(md5(encode(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')), 'UTF-8'))) AS mark",
        r"cast(size(filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> '')) AS bigint) AS words",
    )
    kinds = {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.bool_(): T.BooleanType(), pa.binary(): T.BinaryType()}
    schema = T.StructType([T.StructField(n, kinds[t]) for n, t in zip(_NUMBERED, _TYPES)])
    slices = sorted_slices(marks, ["conv_id"], ["turn", "mark"], _numbered, schema)
    edges = slices.where("_first IS NOT NULL").select(SLICE, "_first", "_last", "_only", "pos", "before")
    settled = settle_edges(edges, _carried, f"{SLICE} int, _place long, _words long")
    # One row per slice.
    rows = slices.where("_first IS NULL").join(F.broadcast(settled), SLICE)
    return rows.selectExpr("conv_id", "pos + if(_open, _place, 0) AS pos", "mark", "words", "before + if(_open, _words, 0) AS before")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and their turns with a shared beginning.

    Conversation c has the first h turns of conversation c - c % 20, then its own behind its first h, where h is
    crc32(c) % 4. It may be left without any turn.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)
    convs = turns.select("conv_id").distinct().select("conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    convs = stored(convs, "trie-convs")
    firsts = stored(turns.where(F.col("pos") <= MOST_SHARED), "trie-firsts")
    begins = firsts.withColumnRenamed("conv_id", "base").join(convs, "base").where("pos <= h")
    # What the own turns move by: turns and words of the beginning, less those left out.
    given = begins.groupBy("conv_id").agg(F.max("pos").alias("given"), F.sum("words").alias("words"))
    left = firsts.withColumn("h", head).where("pos <= h").groupBy("conv_id").agg(F.sum("words").alias("lost"))
    moves = convs.join(given, "conv_id", "left").join(left, "conv_id", "left").fillna(0, ["given", "words", "lost"])
    moves = stored(moves.selectExpr("conv_id", "h", "given - h AS by", "words - lost AS more"), "trie-moves")
    own = turns.join(moves, "conv_id").where("pos > h").selectExpr("conv_id", "pos + by AS pos", "mark", "words", "before + more AS before")
    return convs.select("conv_id"), begins.select(own.columns).unionByName(own)


def with_turn_ids(turns: DataFrame) -> DataFrame:
    """Turns with ``turn_id``, equal for equal turns."""
    turns = stored(turns, "trie-turns")
    ids = stored(turns.select("mark").distinct().withColumn("turn_id", F.monotonically_increasing_id()), "trie-ids")
    return stored(turns.join(ids, "mark").select("conv_id", "pos", "turn_id", "words", "before"), "trie-numbered")


def _key(columns: list[str], depth) -> str:
    """Name of a node: the block's prior node and the turns behind it; the prior itself at depth 0."""
    path = f"concat_ws(',', prior, {', '.join(f'if({n} < {depth}, cast({c} AS string), NULL)' for n, c in enumerate(columns))})"
    return f"if({depth} = 0, prior, md5({path}))"


def blocks(convs: DataFrame, turns: DataFrame) -> tuple[list[tuple[int, int, DataFrame]], DataFrame | None]:
    """The blocks of columns as (turns before, width, rows), and the conversations that need no further one.

    A row is (conv_id, prior, t1, t2, ...); every conversation is a row of the first block, even one without turns. A
    conversation that is alone in the node where a block ends shares no prefix behind it: it leaves the blocks as
    (conv_id, prior, start), and its further prefixes are its own turns.
    """
    out: list[tuple[int, int, DataFrame]] = []
    alone = None
    start, prior, left = 0, convs.select("conv_id", F.lit(ROOT).alias("prior")), turns
    while not out or not prior.isEmpty():
        width = WIDTHS[min(len(out), len(WIDTHS) - 1)]
        names = [f"t{n + 1}" for n in range(width)]
        here = left.where((F.col("pos") > start) & (F.col("pos") <= start + width))
        # A column has one value of a conversation at most, so a row is bounded by the width.
        columns = here.groupBy("conv_id").agg(*(F.max(F.when(F.col("pos") == start + n + 1, F.col("turn_id"))).alias(c) for n, c in enumerate(names)))
        rows = stored(prior.join(columns, "conv_id", "left"), "trie-block")
        out.append((start, width, rows))
        start += width
        left = stored(left.where(F.col("pos") > start), "trie-left")
        on = rows.join(left.where(F.col("pos") == start + 1).select("conv_id"), "conv_id", "left_semi").selectExpr("conv_id", f"{_key(names, width)} AS prior")
        # The number of conversations in a node counts those that end there too: only equal ones behind it matter.
        on = stored(on, "trie-on")
        met = on.groupBy("prior").agg(F.count(F.lit(1)).alias("n"))
        prior = stored(on.join(met.where("n > 1"), "prior", "left_semi").select("conv_id", "prior"), "trie-prior")
        single = on.join(met.where("n = 1"), "prior", "left_semi").select("conv_id", "prior", F.lit(start).alias("start"))
        alone = single if alone is None else alone.unionByName(single)
    return out, stored(alone, "trie-alone")


def _depth(names: list[str]) -> str:
    """Depth of a row's grouping set: columns that it left out have their bit set."""
    return f"{len(names)} - length(replace(bin(grouping_id()), '0', ''))"


def _last(names: list[str]) -> str:
    """The turn at the row's depth: null where no conversation of the group goes so far."""
    return f"CASE depth {' '.join(f'WHEN {n + 1} THEN {c}' for n, c in enumerate(names))} END"


def rolled_up(parts: list[tuple[int, int, DataFrame]], values: DataFrame, aggregates: list[str]) -> DataFrame:
    """(node, parent, depth, aggregates...) of every prefix inside the blocks, from ``values`` of its conversations."""
    found = None
    for start, width, rows in parts:
        names = [f"t{n + 1}" for n in range(width)]
        # Depth 0 of a later block is a node of the block before.
        wanted = f"{_last(names)} IS NOT NULL" + (" OR depth = 0" if start == 0 else "")
        rolled = rows.sparkSession.sql(
            f"SELECT prior, {', '.join(names)}, {_depth(names)} AS depth, {', '.join(aggregates)}"
            f" FROM {{block}} GROUP BY prior, ROLLUP ({', '.join(names)})",
            block=rows.join(values, "conv_id"),
        ).where(wanted)
        labels = [a.rsplit(" AS ", 1)[1] for a in aggregates]
        rolled = rolled.selectExpr(f"{_key(names, 'depth')} AS node", f"{_key(names, '(depth - 1)')} AS parent", f"depth + {start} AS depth", *labels)
        found = rolled if found is None else found.unionByName(rolled)
    return found


def chains(alone: DataFrame, turns: DataFrame) -> DataFrame:
    """(node, parent, depth, conv_id) of the prefixes of conversations that left the blocks, behind those."""
    here = turns.join(alone, "conv_id").where("pos > start")
    return here.selectExpr(
        "concat(prior, '/', pos) AS node", "if(pos = start + 1, prior, concat(prior, '/', pos - 1)) AS parent", "cast(pos AS int) AS depth", "conv_id"
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) -> (node, first, ids): ids of one node joined by commas."""
    node, first, ids, held = None, 0, [], 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["node", "first", "ids"])

    for batch in batches:
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != node or held >= CHUNK:
                if ids:
                    yield row()
                node, first, ids, held = n, c, [], 0
            ids.append(str(c))
            held += len(ids[-1]) + 1
    if ids:
        yield row()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, first, ids) -> (node, ends_sha256); holds one chunk at a time."""
    node, digest = None, None
    for batch in batches:
        nodes, hashes = [], []
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if n == node:
                digest.update(b",")
            else:
                if node is not None:
                    nodes.append(node)
                    hashes.append(digest.hexdigest())
                node, digest = n, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(hashes, pa.string())], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def ends(parts: list[tuple[int, int, DataFrame]], lengths: DataFrame, alone: DataFrame) -> DataFrame:
    """(node, ends_sha256): hash of the comma-joined ids, ascending, of the conversations that end in a node.

    Ids are sorted by ranges, so that a node with very many is cut; only joined chunks of them meet in one task, which
    hashes them one by one.
    """
    found = alone.join(lengths, "conv_id").selectExpr("concat(prior, '/', length) AS node", "conv_id")
    for start, width, rows in parts:
        names = [f"t{n + 1}" for n in range(width)]
        here = rows.join(lengths, "conv_id").where(F.col("length") <= start + width)
        found = found.unionByName(here.selectExpr(f"{_key(names, f'(length - {start})')} AS node", "conv_id"))
    cut = found.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = arrow_map(cut, _chunks, "node string, first long, ids string")
    met = joined.repartition("node").sortWithinPartitions("node", "first")
    return arrow_map(met, _hashes, "node string, ends_sha256 string")


def nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie over (conv_id, pos, mark, words, before) turns of the conversations ``convs``.

    Returns (node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); ``node``
    names a prefix. Every prefix belongs to its least conversation, so what a subtree sums over its nodes is what its
    conversations sum over the nodes that are theirs. No conversations give no rows, not even a root.
    """
    turns = with_turn_ids(turns)
    parts, alone = blocks(convs, turns)
    lengths = turns.groupBy("conv_id").agg(F.sum("words").alias("total"), F.max("pos").alias("length"))
    lengths = stored(convs.join(lengths, "conv_id", "left").fillna(0), "trie-lengths")
    found = rolled_up(parts, lengths, ["min(conv_id) AS conv_id", "count(*) AS n_convs", "sum(total) AS total"])
    chained = chains(alone, turns)
    chain = chained.join(lengths, "conv_id").select("node", "parent", "depth", "conv_id", F.lit(1).cast("long").alias("n_convs"), "total")
    found = stored(found.unionByName(chain), "trie-nodes")
    children = found.where("depth > 0").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    # The last turn of a node is that of its least conversation at this depth.
    last = turns.select("conv_id", F.col("pos").cast("int").alias("depth"), "words", "before")
    known = found.join(last, ["conv_id", "depth"], "left").join(children.withColumnRenamed("parent", "node"), "node", "left")
    known = stored(known.fillna(0, ["words", "before", "n_children"]), "trie-known")
    own = known.groupBy("conv_id").agg(F.sum("words").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    own = stored(lengths.select("conv_id", "total").join(own, "conv_id", "left").fillna(0), "trie-own")
    below = rolled_up(parts, own, ["sum(own) AS owns", "sum(leaf) AS n_leaves"]).select("node", "owns", "n_leaves")
    below = below.unionByName(chained.join(own, "conv_id").select("node", F.col("own").alias("owns"), F.col("leaf").alias("n_leaves")))
    parent = known.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    least = own.select("conv_id", F.col("own").alias("_own"), F.col("total").alias("_total"))
    # Words of all members behind the parent, less those of each node once.
    saved = "(total - n_convs * before) - (owns - _own + _total - before)"
    joined = known.join(below, "node").join(parent, "parent", "left").join(least, "conv_id").join(ends(parts, lengths, alone), "node", "left")
    return joined.selectExpr(
        "node", "conv_id", "cast(depth AS bigint) AS depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        f"{saved} AS saved_tokens", f"coalesce(ends_sha256, '{hashlib.sha256().hexdigest()}') AS ends_sha256",
    )


def trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: see ``ordered``, ``rebuilt`` and ``nodes``. An empty table gives no rows."""
    return nodes(*rebuilt(ordered(conversations)))
