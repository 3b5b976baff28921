"""Committed versions of a price store whose loads cost what they touch.

Rows that are current (shops, products, their URLs, last prices) lie in key buckets. A load reads the buckets of its
own keys, writes those again, and its commit names the folder that holds each bucket now; the other buckets stay as
they are. What loads add (observations, written prices, retractions, offers, rejects, counters) lies in a folder per load, by
time slice and bucket where it is read again.

A commit is one small file, written last and never over another: a load that dies leaves nothing that a reader sees,
and of two loads that start from one version the second to end fails with ``ConcurrentLoad``. It holds all that a reader
needs, so neither reads nor loads look at older ones. A stream's micro-batch is known by its query and number, so a replayed
one is not loaded twice; a new checkpoint or a second stream goes on behind the newest version.

The change test depends on all rows before it. Rows that come strictly behind everything seen of their product fold on
from its stored state. The state keeps, for each time slice, the last price written in it. A late row folds its product
again from the state before its slice on, and only as far as the outcome differs from the stored one: rows that are new
then are written, rows that are no longer right are retracted. Full copies of stored observations are not late rows, so
a replay adds nothing.
"""

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrail.operators.history import fold_rows, is_late, order_key, with_state
from pricetrail.session import fresh_path, side_by_side
from pricetrail.sources import files

ROW, SLICE, BUCKET, PART = "row_id", "slice", "bucket", "part"
#: Key buckets of a new store; a store keeps the number it was made with.
BUCKETS = 16
#: Time slices of observations and prices. Finer ones make late rows cheaper and folders more.
SLICE_FORMAT = "yyyy-MM"
#: So many folders of one table are merged by ``compact``; a merged one is left alone until the newer ones are as large.
MANY_FOLDERS = 8
COMPACTION = "compaction"


class ConcurrentLoad(RuntimeError):
    """Another load committed first; this one left nothing behind and can be run again."""


@dataclass
class Commit:
    """State of the store: ranges of batches of each source, current folder of each bucket, folders of appended tables."""

    version: int = -1
    source: str = ""
    batch: int | None = None
    n_buckets: int = BUCKETS
    sources: dict[str, list[list[int]]] = field(default_factory=dict)
    buckets: dict[str, list[str | None]] = field(default_factory=dict)
    folders: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)


def _commit_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/commits/v{version:012d}.json"


def _versions(spark: SparkSession, root: str) -> list[int]:
    found = files.names(spark, f"{root.rstrip('/')}/commits")
    return [int(name[1:13]) for name in found if name.endswith(".json")]


def state(spark: SparkSession, root: str, version: int | None = None) -> Commit:
    """The newest committed state (or a given one); an empty one before the first load."""
    found = _versions(spark, root)
    if version is None:
        version = max(found, default=-1)
    return Commit(**json.loads(files.read_text(spark, _commit_path(root, version)))) if version in found else Commit()


def commits(spark: SparkSession, root: str) -> list[Commit]:
    """All commits that are kept, in order."""
    return [state(spark, root, version) for version in _versions(spark, root)]


def latest(spark: SparkSession, root: str) -> int:
    """Newest committed version, -1 before the first load."""
    return max(_versions(spark, root), default=-1)


def committed(done: Commit, source: str, batch: int | None) -> bool:
    """Is this batch of the source loaded already?"""
    return batch is not None and any(first <= batch <= last for first, last in done.sources.get(source, []))


def _with_batch(ranges: list[list[int]], batch: int) -> list[list[int]]:
    """Ranges of batch numbers with one more; neighbours are joined, so a stream's batches are one range."""
    out: list[list[int]] = []
    for first, last in sorted([*ranges, [batch, batch]]):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def bucket_of(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def slice_of(time: str, pattern: str = SLICE_FORMAT) -> Column:
    """The time slice of a row; rows without a time have one of their own, before all others."""
    return F.coalesce(F.date_format(time, pattern), F.lit("0000"))


def _scan(spark: SparkSession, done: Commit, root: str, table: str, parts: list[str], inside: str = "") -> DataFrame:
    base = f"{root.rstrip('/')}/{table}"
    paths = [f"{base}/{PART}={part}{inside}" for part in parts]
    return spark.read.schema(T.StructType.fromJson(json.loads(done.schemas[table]))).option("basePath", base).parquet(*paths)


def appended(spark: SparkSession, done: Commit, root: str, table: str) -> DataFrame | None:
    """Rows of an appended table; ``part``, and ``slice`` and ``bucket`` where it has them, are folders and prune the scan."""
    parts = done.folders.get(table)
    return _scan(spark, done, root, table, parts) if parts else None


def in_buckets(spark: SparkSession, done: Commit, root: str, table: str, wanted: list[int] | None = None) -> DataFrame | None:
    """Current rows of a bucketed table, of the wanted buckets only; None where nothing was ever stored."""
    if table not in done.buckets:
        return None
    base = f"{root.rstrip('/')}/{table}"
    found = [f"{base}/{PART}={part}/{BUCKET}={b}" for b, part in enumerate(done.buckets[table]) if part and (wanted is None or b in wanted)]
    schema = T.StructType.fromJson(json.loads(done.schemas[table]))
    frame = spark.read.schema(schema).option("basePath", base).parquet(*found) if found else spark.createDataFrame([], schema)
    return frame.drop(PART, BUCKET)


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame | None:
    """A table of the newest committed version (or of a given one); None before the first load.

    Of a bucketed table these are the rows that were current then, of an appended one those that the load added.
    """
    done = state(spark, root, version)
    if table in done.buckets:
        return in_buckets(spark, done, root, table)
    parts = [part for part in done.folders.get(table, []) if part.startswith(f"v{done.version:012d}")]
    return _scan(spark, done, root, table, parts).drop(PART) if parts else None


def _standing(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Rows that no later load has retracted."""
    if gone is None:
        return rows
    gone = gone.select(F.col(ROW).alias("_gone"), F.col("load").alias("_by"))
    return rows.join(gone, (F.col(ROW) == F.col("_gone")) & (F.col("_by") > F.col("load")), "left_anti")


def read_written(spark: SparkSession, root: str, done: Commit | None = None) -> DataFrame | None:
    """The history at the newest committed version, with ``row_id`` and the ``load`` that wrote each row."""
    done = done or state(spark, root)
    rows = appended(spark, done, root, "written")
    return rows if rows is None else _standing(rows, appended(spark, done, root, "retracted")).drop(PART)


def read_prices(spark: SparkSession, root: str) -> DataFrame | None:
    """The price rows at the newest committed version; ``month`` (the time slice) and ``bucket`` are folders and prune the scan."""
    rows = read_written(spark, root)
    if rows is None:
        return None
    return rows.selectExpr(
        f"{ROW} AS id", "product_id", "price", "is_in_stock", "observed_at AS parsed_at", "observed_at AS created_at",
        "observed_at AS updated_at", "load", f"{SLICE} AS month", BUCKET,
    )


def search(spark: SparkSession, root: str, words: list[str], all_words: bool = True) -> DataFrame | None:
    """(id, n_words, score) of products whose name has the words, as whole ones in any case; rare words score more.

    Reads the buckets of the words alone, from the table that loads keep with ``index_words``; None without it. The
    score is the sum of 1 / (products with the word); with ``all_words`` products without one of them are left out.
    """
    done = state(spark, root)
    wanted = sorted({w for w in (word.lower() for word in words) if w})
    if "words" not in done.buckets or not wanted:
        return None
    made = spark.createDataFrame([(w,) for w in wanted], "word string")
    buckets = [r[0] for r in made.select(bucket_of(["word"], done.n_buckets)).distinct().collect()]
    found = in_buckets(spark, done, root, "words", buckets).where(F.col("word").isin(wanted))
    common = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    scored = found.join(F.broadcast(common), "word").groupBy("id").agg(F.count(F.lit(1)).alias("n_words"), F.sum(1 / F.col("n")).alias("score"))
    return scored.where(F.col("n_words") == len(wanted)) if all_words else scored


class Load:
    """A version in the making: tables are written to folders of its own and shown by its commit."""

    def __init__(self, spark: SparkSession, root: str, source: str = "batch", batch: int | None = None, n_buckets: int = BUCKETS):
        self.spark, self.root, self.source, self.batch = spark, root.rstrip("/"), source, batch
        self.before = state(spark, root)
        self.version = self.before.version + 1
        # A name of its own: a load that died, or one that runs beside this one, is never written over.
        self.part = f"v{self.version:012d}-{uuid.uuid4().hex[:8]}"
        self.n = self.before.n_buckets if self.before.version >= 0 else n_buckets
        self.buckets = {k: list(v) for k, v in self.before.buckets.items()}
        self.folders = {k: list(v) for k, v in self.before.folders.items()}
        self.schemas = dict(self.before.schemas)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}/{PART}={self.part}"

    def _write(self, df: DataFrame, table: str, by: list[str]) -> DataFrame:
        writer = (df.hint("rebalance", *by) if by else df).write
        (writer.partitionBy(*by) if by else writer).parquet(self.path(table))
        inner = [f for f in df.schema if f.name not in by]
        schema = T.StructType([*inner, T.StructField(PART, T.StringType()), *(df.schema[n] for n in by)])
        self.schemas[table] = json.dumps(schema.jsonValue())
        return self.spark.read.schema(df.schema).option("basePath", self.path(table)).parquet(self.path(table))

    def append(self, table: str, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        """Add rows; returns them as stored."""
        out = self._write(df, table, by or [])
        self.folders.setdefault(table, []).append(self.part)
        return out

    def touched(self, table: str) -> list[int]:
        """Buckets that this load's rows of a table fell in, by the names of its folders."""
        return sorted({b for _, b in self.slices(table)} | {int(n.split("=")[1]) for n in files.names(self.spark, self.path(table)) if n.startswith(f"{BUCKET}=")})

    def slices(self, table: str) -> list[tuple[str, int]]:
        """(slice, bucket) folders of this load's rows of a table."""
        out = []
        for name in files.names(self.spark, self.path(table)):
            if name.startswith(f"{SLICE}="):
                out += [(name.split("=", 1)[1], int(b.split("=")[1])) for b in files.names(self.spark, f"{self.path(table)}/{name}") if b.startswith(f"{BUCKET}=")]
        return out

    def retracted(self) -> DataFrame | None:
        """Rows of older loads that this one took back; None if it met no late rows."""
        if self.part not in self.folders.get("retracted", []):
            return None
        return _scan(self.spark, Commit(schemas=self.schemas), self.root, "retracted", [self.part])

    def current(self, table: str, wanted: list[int] | None = None) -> DataFrame | None:
        """Stored rows of a bucketed table before this load."""
        return in_buckets(self.spark, self.before, self.root, table, wanted)

    def replace(self, table: str, df: DataFrame, keys: list[str], wanted: list[int]) -> DataFrame:
        """Write the wanted buckets of a table anew: ``df`` holds all their rows."""
        out = self._write(df.withColumn(BUCKET, bucket_of(keys, self.n)), table, [BUCKET])
        there = set(self.touched(table))
        held = self.buckets.setdefault(table, [None] * self.n)
        for b in wanted:
            held[b] = self.part if b in there else None
        return out.drop(BUCKET)

    def commit(self) -> int:
        sources = dict(self.before.sources)
        if self.batch is not None:
            sources[self.source] = _with_batch(sources.get(self.source, []), self.batch)
        done = Commit(self.version, self.source, self.batch, self.n, sources, self.buckets, self.folders, self.schemas)
        if not files.write_new(self.spark, _commit_path(self.root, self.version), json.dumps(asdict(done))):
            raise ConcurrentLoad(f"version {self.version} of {self.root} was committed by another load")
        return self.version


_SAME = ["price", "is_in_stock"]


def _kept(df: DataFrame, label: str) -> DataFrame:
    """An intermediate table, removed with the load's scope."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stamped(rows: DataFrame, keys: list[str], order: list[str], load: "Load", time_slices: str) -> DataFrame:
    """Written rows with their id, the load that wrote them, slice and bucket."""
    return rows.select(
        *keys, *order, *_SAME, F.xxhash64(*keys, *order, *_SAME).alias(ROW), F.lit(load.version).alias("load"),
        slice_of(order[0], time_slices).alias(SLICE), bucket_of(keys, load.n).alias(BUCKET),
    )


def _points(written: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, points): the last written price of each time slice, in order. At most one per slice and key."""
    last = F.max(F.struct(order_key(order).alias("o"), *_SAME, F.col(order[0]).alias("parsed_at"))).alias("l")
    by_slice = written.groupBy(*keys, SLICE).agg(last)
    point = F.struct(SLICE, "l.price", "l.is_in_stock", F.col("l.parsed_at"))
    return by_slice.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("points"))


def fold(
    load: Load, rows: DataFrame, keys: list[str], order: list[str], time_slices: str = SLICE_FORMAT, beside: Callable[[DataFrame], object] | None = None
) -> DataFrame:
    """Add observations to the history: ``observed``, ``written``, ``last_prices`` and, where rows came late, ``retracted``.

    ``rows`` are stored already, with ``keys``, ``order``, ``price`` and ``is_in_stock``. Returns the rows written;
    ``beside`` is called with them while the state is written.
    """
    narrow = [*keys, *order, *_SAME]
    usable = rows.select(*narrow).where("price IS NOT NULL AND is_in_stock IS NOT NULL")
    seen = usable.withColumns({SLICE: slice_of(order[0], time_slices), BUCKET: bucket_of(keys, load.n)})
    observed = load.append("observed", seen, [SLICE, BUCKET])
    touched = load.touched("observed")
    last = load.current("last_prices", touched)
    late = None
    if last is None or not any(load.before.buckets["last_prices"][b] for b in touched):
        ahead, last = with_state(observed.select(*narrow)), None
    else:
        # One join tells which rows are late and gives the others what they fold on from.
        known = last.select(*keys, "last_price", "last_stock", "last_seen")
        labelled = observed.select(*narrow, SLICE, BUCKET).join(known, keys, "left").withColumn("late", F.coalesce(is_late(order), F.lit(False)))
        labelled = _kept(labelled.drop("last_seen"), "labelled")
        if not labelled.where("late").isEmpty():
            late = _LateRows(load, labelled, keys, order, last, time_slices)
            if late.keys is None:
                late = None
        ahead = labelled.where("NOT late")
        if late is not None:
            ahead = ahead.join(late.keys, keys, "left_anti")
    folded = _stamped(fold_rows(ahead, keys, order), keys, order, load, time_slices)
    if late is not None:
        late.refold()
        folded = folded.unionByName(late.added.select(folded.columns))
    written = load.append("written", folded, [SLICE, BUCKET])
    if late is not None:
        load.append("retracted", late.gone, [SLICE, BUCKET])
    behind = observed.groupBy(*keys).agg(F.max(order_key(order)).alias("_seen"))
    if late is None:
        new = behind.join(_points(written, keys, order).withColumnRenamed("points", "_new"), keys, "left")
    else:
        fresh = _points(written.join(late.keys, keys, "left_anti"), keys, order).unionByName(late.points()).withColumnRenamed("points", "_new")
        new = behind.join(fresh, keys, "left")
    kept = F.col("_new")
    if last is not None:
        new = last.select(*keys, "points", "last_seen").join(new, keys, "full_outer")
        # New points replace those of their slices; a late product's points are whole already.
        older = F.expr(f"filter(points, p -> NOT array_contains(transform(_new, n -> n.{SLICE}), p.{SLICE}))")
        kept = F.when(F.col("_new").isNull(), F.col("points")).when(F.col("points").isNull(), F.col("_new")).otherwise(F.array_sort(F.concat(older, "_new")))
        if late is not None:
            new = new.join(late.keys.withColumn("_whole", F.lit(True)), keys, "left")
            kept = F.when(F.col("_whole"), F.col("_new")).otherwise(kept)
        new = new.withColumn("_seen", F.greatest("_seen", "last_seen"))
    newest = F.try_element_at("_points", F.lit(-1))
    current = new.withColumn("_points", kept).where("size(_points) > 0").select(
        *keys,
        newest["price"].alias("last_price"),
        newest["is_in_stock"].alias("last_stock"),
        newest["parsed_at"].alias("last_parsed_at"),
        F.col("_seen").alias("last_seen"),
        F.col("_points").alias("points"),
    )
    jobs = [lambda: load.replace("last_prices", current, keys, touched)]
    side_by_side(*jobs, *([lambda: beside(written)] if beside else []))
    return written


class _LateRows:
    """Products with rows that came late, folded again from a point before them as far as the outcome differs."""

    def __init__(self, load: Load, labelled: DataFrame, keys: list[str], order: list[str], last: DataFrame, time_slices: str):
        self.load, self.names, self.order, self.time_slices = load, keys, order, time_slices
        self.narrow = [*keys, *order, *_SAME]
        self.stored = appended(load.spark, load.before, load.root, "observed")
        late = labelled.where("late")
        places = [tuple(r) for r in late.select(SLICE, BUCKET).distinct().collect()]
        known = self._observed({s for s, _ in places}, {b for _, b in places})
        same = F.lit(True)
        for name in self.narrow:
            same = same & F.col(f"n.{name}").eqNullSafe(F.col(f"k.{name}"))
        known = known.join(late.select(*keys).distinct(), keys, "left_semi").select(*self.narrow).distinct()
        new = late.alias("n").join(known.alias("k"), same, "left_anti").select(*self.narrow, SLICE, BUCKET).distinct()
        new = _kept(new, "late")
        #: None where all were copies of stored rows.
        self.keys = None
        if not new.isEmpty():
            self.keys = new.select(*keys).distinct()
            ahead = labelled.where("NOT late").join(self.keys, keys, "left_semi").select(*self.narrow, SLICE, BUCKET)
            self.fresh = _kept(new.unionByName(ahead), "late-fresh")
            self.last = _kept(last.join(self.keys, keys, "left_semi").select(*keys, "points"), "late-last")

    def _observed(self, slices: set[str], buckets: set[int]) -> DataFrame:
        """Stored observations of some folders."""
        return self.stored.where(F.col(SLICE).isin(sorted(slices)) & F.col(BUCKET).isin(sorted(buckets)))

    def _all_slices(self) -> list[str]:
        found = {s for s, _ in self.load.slices("observed")}
        for part in self.load.before.folders.get("observed", []):
            found |= {n.split("=", 1)[1] for n in files.names(self.load.spark, f"{self.load.root}/observed/{PART}={part}") if n.startswith(f"{SLICE}=")}
        return sorted(found)

    def refold(self) -> None:
        """Windows of slices per product, twice as long each round, until what is written ends as it did before.

        Sets ``added`` (rows to write) and ``gone`` (rows that are no longer right).
        """
        keys, order, load = self.names, self.order, self.load
        slices = self._all_slices()
        axis = "array(" + ", ".join(f"'{s}'" for s in slices) + ")"
        buckets = load.touched("observed")
        reached: list[str] = []
        before = F.expr(f"try_element_at(filter(points, p -> p.{SLICE} < at), -1)")
        ended = F.expr(f"try_element_at(filter(points, p -> p.{SLICE} <= until), -1)")
        open_ = self.fresh.groupBy(*keys).agg(F.min(SLICE).alias("at")).join(self.last, keys, "left").withColumn("_from", before)
        self.windows, self.folded, width = None, None, 1
        while True:
            window = open_.withColumn("until", F.expr(f"element_at({axis}, cast(least({len(slices)}, array_position({axis}, at) + {width - 1}) AS int))"))
            window = window.select(
                *keys, "at", "until", F.col("_from.price").alias("last_price"), F.col("_from.is_in_stock").alias("last_stock"), ended.alias("_end")
            )
            window = _kept(window, "late-window")
            edge = window.agg(F.min("at"), F.max("until")).first()
            reached += [edge[0], edge[1]]
            span = {s for s in slices if edge[0] <= s <= edge[1]}
            rows = self._observed(span, set(buckets)).select(*self.narrow, SLICE).unionByName(self.fresh.select(*self.narrow, SLICE))
            inside = rows.join(window, keys).where(f"{SLICE} BETWEEN at AND until").select(*self.narrow, "last_price", "last_stock").distinct()
            again = _kept(_stamped(fold_rows(inside, keys, order), keys, order, load, self.time_slices), "refolded")
            self.windows = window if self.windows is None else self.windows.unionByName(window)
            self.folded = again if self.folded is None else self.folded.unionByName(again)
            now = _points(again, keys, order).withColumnRenamed("points", "_now")
            state = window.join(now, keys, "left").withColumn("_out", F.expr("coalesce(try_element_at(_now, -1).price, last_price)"))
            state = state.withColumn("_stock", F.expr("coalesce(try_element_at(_now, -1).is_in_stock, last_stock)"))
            agrees = F.col("_out").eqNullSafe(F.col("_end.price")) & F.col("_stock").eqNullSafe(F.col("_end.is_in_stock"))
            state = state.select(*keys, "until", "_out", "_stock", agrees.alias("agrees"))
            later = self.fresh.select(*keys, F.col(SLICE).alias("_s")).join(state.select(*keys, "until"), keys).where("_s > until")
            later = later.groupBy(*keys).agg(F.min("_s").alias("_next"))
            on = state.join(later, keys, "left").join(self.last, keys, "left")
            following = F.expr(f"get({axis}, cast(array_position({axis}, until) AS int))")
            on = on.withColumn("at", F.when(F.col("agrees"), F.col("_next")).otherwise(following)).where("at IS NOT NULL")
            going = F.struct(F.col("_out").alias("price"), F.col("_stock").alias("is_in_stock"))
            old = before
            at_rest = F.struct(old["price"].alias("price"), old["is_in_stock"].alias("is_in_stock"))
            open_ = _kept(on.withColumn("_from", F.when(F.col("agrees"), at_rest).otherwise(going)).select(*keys, "at", "points", "_from"), "late-open")
            if open_.isEmpty():
                break
            width *= 2
        spans = self.windows.select(*keys, "at", "until")
        rows = appended(load.spark, load.before, load.root, "written")
        rows = rows.where(F.col(SLICE).isin([s for s in slices if min(reached) <= s <= max(reached)]) & F.col(BUCKET).isin(buckets))
        gone = appended(load.spark, load.before, load.root, "retracted")
        gone = gone if gone is None else gone.where(F.col(BUCKET).isin(buckets))
        was = _standing(rows, gone).join(spans, keys).where(f"{SLICE} BETWEEN at AND until").select(ROW, SLICE, BUCKET)
        was = _kept(was, "late-was")
        self.added = self.folded.join(was.select(ROW), ROW, "left_anti")
        self.gone = was.join(self.folded.select(ROW), ROW, "left_anti").select(ROW, F.lit(load.version).alias("load"), SLICE, BUCKET)

    def points(self) -> DataFrame:
        """(keys, points) of the late products: stored ones outside their windows, new ones inside."""
        keys = self.names
        spans = self.windows.groupBy(*keys).agg(F.collect_list(F.struct("at", "until")).alias("_spans"))
        outside = self.last.join(spans, keys).select(
            *keys, F.expr(f"filter(points, p -> NOT exists(_spans, w -> p.{SLICE} BETWEEN w.at AND w.until))").alias("_old")
        )
        now = _points(self.folded, keys, self.order).withColumnRenamed("points", "_now")
        both = outside.join(now, keys, "full_outer")
        return both.select(*keys, F.array_sort(F.concat(F.coalesce("_old", F.expr("filter(_now, p -> false)")), F.coalesce("_now", F.expr("filter(_old, p -> false)")))).alias("points"))


def compact(spark: SparkSession, root: str, many: int = MANY_FOLDERS) -> int | None:
    """Merge small folders of appended tables, and apply retractions to the prices among them, as a commit of its own.

    The newest folders are merged, back to the first one that holds more rows than all behind it; so a row is
    rewritten a logarithmic number of times. Nothing is done while no table has ``many`` folders. Old folders stay for
    readers of older commits until ``remove_unread``.
    """
    load = Load(spark, root, COMPACTION)
    merged = False
    for table in ("observed", "written"):
        parts = load.before.folders.get(table, [])
        if len(parts) < many:
            continue
        rows = [_scan(spark, load.before, root, table, [p]).count() for p in parts]
        first = len(parts) - 1
        while first and rows[first - 1] <= sum(rows[first:]):
            first -= 1
        if len(parts) - first < 2:
            first = max(0, len(parts) - 2)
        tail = _scan(spark, load.before, root, table, parts[first:])
        columns = [c for c in tail.columns if c != PART]
        gone = appended(spark, load.before, root, "retracted") if table == "written" else None
        load.folders[table] = parts[:first]
        # A replay's observations come once.
        load.append(table, (_standing(tail, gone) if table == "written" else tail.select(columns).distinct()).select(columns), [SLICE, BUCKET])
        if gone is not None:
            load.folders["retracted"] = []
            if first:
                hit = tail.select(F.col(ROW).alias("_row"), F.col("load").alias("_load"))
                left = gone.join(hit, (F.col(ROW) == F.col("_row")) & (F.col("load") > F.col("_load")), "left_anti")
                load.append("retracted", left.drop(PART), [SLICE, BUCKET])
            else:
                load.folders.pop("retracted")
        merged = True
    return load.commit() if merged else None


def remove_unread(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete the folders that none of the newest ``keep`` commits names, and older commits; returns what was deleted.

    Readers of older commits must have ended, and no load may be running.
    """
    root = root.rstrip("/")
    versions = _versions(spark, root)
    kept = [state(spark, root, v) for v in versions[-keep:]]
    gone = []
    for table in {t for c in kept for t in (*c.buckets, *c.folders)}:
        live = {p for c in kept for p in (*c.buckets.get(table, []), *c.folders.get(table, []))}
        for name in files.names(spark, f"{root}/{table}"):
            if name.startswith(f"{PART}=") and name.split("=", 1)[1] not in live:
                gone.append(f"{root}/{table}/{name}")
    gone += [_commit_path(root, v) for v in versions[:-keep]]
    for path in gone:
        files.delete(spark, path)
    return gone

