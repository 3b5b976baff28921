"""Repeated passages by a logarithmic family of suffix tables.

A byte goes if it lies in a string of LENGTH bytes that also starts anywhere else. Suffixes are sampled by content:
of each stretch of SAMPLE places, the one whose next eight bytes hash lowest. Equal strings of LENGTH bytes choose the
same place in them, and the CONTEXT bytes from there lie inside the string; so strings can only repeat where a sampled
suffix repeats its first CONTEXT bytes. A batch's suffix table holds those beginnings, sorted, by hash. It is
merge-scanned against the levels of the family, and levels of one size merge into one of twice the size.

Sampled suffixes that repeat are then settled exactly. Those whose whole surroundings (all strings of LENGTH bytes that
choose them) repeat are covered. Where surroundings differ, at the ends of passages, one of each kind is compared with
the others by the hashes of their strings: few within one row, many in Spark, where blocks of strings come first.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import NULL_ID, arrow_map, chunks, free, mixed, stored
from pricetrail.session import fresh_path

LENGTH, SAMPLE = 200, 100
CONTEXT = LENGTH - SAMPLE + 1
BATCHES = 2
#: At most so many different surroundings of one beginning are compared with each other, in one row; beyond that each
#: is compared with the most frequent one, and the strings that these two don't share are hashed.
FEW = 512
#: Strings in a block, in the rounds in which those of many different surroundings are compared.
BLOCKS = (16, 4, 1)


def samples(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined bytes, text starts; of each sampled place: itself, its text, first and last start of a string that
    chooses it) over texts of LENGTH bytes or more."""
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    strings = np.maximum(sizes - LENGTH + 1, 0)
    if not strings.any():
        return data, starts, *[np.zeros(0, np.int64)] * 4
    n = len(data)
    eight = np.ndarray((n,), "<u8", buffer=data + bytes(8), strides=(1,))
    value = (eight ^ (eight >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    # The place in the low half makes the first of equal hashes the lowest.
    value = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // SAMPLE) * SAMPLE + SAMPLE, np.uint64(2**64 - 1))
    padded[:n] = value
    blocks = padded.reshape(-1, SAMPLE)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    text = np.repeat(np.arange(len(texts)), strings)
    at = np.arange(len(text)) - np.repeat(np.cumsum(strings) - strings, strings) + starts[text]
    place = (np.minimum(back[at], ahead[at + SAMPLE - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    return data, starts, place[new], text[new], at[new], at[np.r_[new[1:], len(at)] - 1]


def keys_at(data: bytes, places: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(data[p : p + CONTEXT]) for p in places.tolist()], np.uint64)


def rows_of(docs: DataFrame) -> DataFrame:
    """(id, same, text): a row is known by its id and the hash of its text; rows equal in both are settled alike."""
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("same"), "text")


class Levels:
    """The family: sorted tables of distinct keys, bucketed by key, whose sizes in batches double."""

    def __init__(self, spark):
        self.spark, self.levels, self.found, self.names = spark, [], [], []

    def _table(self, rows: DataFrame) -> DataFrame:
        name = "suffixes_" + fresh_path(self.spark, "x").rpartition("-")[2]
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = fresh_path(self.spark, "suffix-level")
        rows.write.bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def insert(self, keys: DataFrame) -> None:
        """A batch of keys: sorted, scanned against every level by merge joins, and put in as a level of size 1."""
        batch = self._table(keys.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("twice")))
        self.found.append(stored(batch.filter("twice").select("key"), "suffix-repeats"))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            merged = a.select("key").join(b.select("key"), "key", "full").select("key", F.lit(False).alias("twice"))
            self.levels.append((2 * size, self._table(merged)))
        for _, level in self.levels:
            self.found.append(stored(batch.select("key").join(level.select("key"), "key"), "suffix-repeats"))
        self.levels.append((1, batch))

    def repeated(self) -> DataFrame:
        out = self.found[0]
        for more in self.found[1:]:
            out = out.union(more)
        return stored(out.distinct(), "suffix-keys")

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def bloom(keys: DataFrame, least_bits: int = 10, most_bits: int = 27) -> np.ndarray:
    """Bits of hashed long keys as 64-bit words, two of 32 bits a key up to a fixed 16 MB. It only spares rows a
    shuffle; with more keys more rows pass, and none that is needed is lost."""
    n = keys.count()
    bits = min(most_bits, max(least_bits, int(32 * n).bit_length()))
    both = keys.select(F.explode(F.array("key", F.shiftrightunsigned("key", 32))).alias("key"))
    place = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    words = both.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def _in(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    def bit(keys):
        place = keys & np.uint64(len(words) * 64 - 1)
        return ((words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)

    return bit(keys) & bit(keys >> np.uint64(32))


def _marks(ids: np.ndarray, same: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of (row, place in the text)."""
    return mixed(mixed(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) ^ same.view(np.uint64) ^ mixed(places.astype(np.uint64)))


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _sampled(batches, words: list[np.ndarray], by_mark: bool):
    """Sampled suffixes that pass one of the filters by their key or mark, chunk by chunk: (joined bytes, columns),
    where columns hold which filters they pass, their row, key, surroundings' hash, mark and places in the bytes."""
    digest = xxhash.xxh3_64_intdigest
    for batch, texts in chunks(batches):
        data, starts, places, text, low, high = samples(texts)
        ids, same = _longs(batch, "id"), _longs(batch, "same")
        if by_mark:
            keys, mark = None, _marks(ids[text], same[text], places - starts[text])
            passed = [_in(w, mark) for w in words]
        else:
            keys, mark = keys_at(data, places), None
            passed = [_in(w, keys) for w in words]
        ok = np.logical_or.reduce(passed)
        passed = [x[ok] for x in passed]
        places, text, low, high = places[ok], text[ok], low[ok], high[ok]
        keys = keys_at(data, places) if keys is None else keys[ok]
        mark = _marks(ids[text], same[text], places - starts[text]) if mark is None else mark[ok]
        around = [digest(data[a : b + LENGTH], (p - a) << 16 | (b - a)) for a, b, p in zip(low.tolist(), high.tolist(), places.tolist())]
        around = np.array(around, np.uint64)
        yield data, passed, ids[text], same[text], keys, around, mark, starts[text], places, low, high


def _batch(**columns) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(id, same, spans): for each row with repeated strings the sorted [start, end) bytes they cover."""
    spark = docs.sparkSession
    rows = rows_of(docs)

    def keys(parts):
        for _, texts in chunks(parts):
            data, _, places, *_ = samples(texts)
            yield _batch(key=keys_at(data, places))

    family = Levels(spark)
    for number in range(batches):
        part = rows.filter(F.pmod(F.hash("id"), F.lit(batches)) == number).select("text")
        family.insert(arrow_map(part, keys, "key long"))
    words = spark.sparkContext.broadcast(bloom(family.repeated()))
    family.close()

    def hits(parts):
        for _, _, ids, same, key, around, mark, base, _, low, high in _sampled(parts, [words.value], False):
            yield _batch(id=ids, same=same, key=key, around=around, mark=mark, low=low - base, high=high - base)

    hit = stored(arrow_map(rows, hits, "id long, same long, key long, around long, mark long, low long, high long"), "suffix-hits")
    # A class: suffixes with equal surroundings. Its least mark stands for it.
    classes = stored(hit.groupBy("key", "around").agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("mark")), "suffix-classes")
    kinds = classes.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", "mark")).alias("most")).filter("kinds > 1")
    few_or_many = classes.join(kinds, "key").select(
        F.col("mark").alias("key"), (F.col("kinds") <= FEW).alias("few"), (F.col("mark") == F.col("most.mark")).alias("first")
    )
    found = stored(_surroundings(rows, stored(few_or_many, "suffix-unlike")), "suffix-surroundings")
    spans = _whole(hit, classes).union(_compared(found.filter("few")))
    many = found.filter("NOT few")
    for more in [] if many.isEmpty() else _by_strings(many):
        spans = spans.union(more)
    spans = spans.distinct()
    return stored(spans.groupBy("id", "same").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "suffix-spans")


def _whole(hit: DataFrame, classes: DataFrame) -> DataFrame:
    """Spans of suffixes whose whole surroundings occur again.

    Most are known without a join: those that pass a filter of the classes with one member only. A row's suffixes
    stand together in ``hit``, so their spans are joined up before they are shuffled.
    """
    alone = hit.sparkSession.sparkContext.broadcast(bloom(classes.filter("n = 1").select(F.col("around").alias("key"))))

    def sure(parts):
        for batch in parts:
            ok = ~_in(alone.value, _longs(batch, "around").view(np.uint64))
            ids, same, low, high = (_longs(batch, n)[ok] for n in ("id", "same", "low", "high"))
            if len(ids):
                ends = high + LENGTH
                new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (same[1:] != same[:-1]) | (low[1:] > ends[:-1]) | (low[1:] < low[:-1])])
                yield _batch(id=ids[new], same=same[new], start=low[new], end=np.maximum.reduceat(ends, new))

    def unsure(parts):
        for batch in parts:
            yield batch.filter(pa.array(_in(alone.value, _longs(batch, "around").view(np.uint64))))

    spans = arrow_map(hit.select("id", "same", "around", "low", "high"), sure, "id long, same long, start long, end long")
    rest = hit.select("id", "same", "key", "around", "low", "high")
    rest = arrow_map(rest, unsure, "id long, same long, key long, around long, low long, high long")
    again = rest.join(classes.filter("n > 1").select("key", "around"), ["key", "around"])
    return spans.union(again.select("id", "same", F.col("low").alias("start"), (F.col("high") + LENGTH).alias("end")))


def _compared(found: DataFrame) -> DataFrame:
    """Spans of strings that the few different surroundings of one beginning have in common.

    Equal strings stand at one distance from the place, so a kind of surroundings has each only once: a string that is
    met again is shared. The work grows with the number of kinds, not of their pairs.
    """

    def compare(parts):
        digest = xxhash.xxh3_128_intdigest
        for batch in parts:
            out = set()
            for group in batch.column("g").to_pylist():
                seen = {}
                for x in group:
                    around = x["around"]
                    for i in range(x["last"] + 1):
                        span = (x["id"], x["same"], x["low"] + i, x["low"] + i + LENGTH)
                        earlier = seen.setdefault(digest(around[i : i + LENGTH], x["place"] - i), span)
                        if earlier is not span:
                            out.update((earlier, span))
            if out:
                yield _batch(**dict(zip(("id", "same", "start", "end"), map(np.array, zip(*_joined(sorted(out)))))))

    groups = found.groupBy("key").agg(F.collect_list(F.struct("id", "same", "low", "place", "last", "around")).alias("g"))
    return arrow_map(groups.filter(F.size("g") > 1).select("g"), compare, "id long, same long, start long, end long")


def _joined(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Sorted (id, same, start, end) with those that overlap joined up."""
    out = []
    for span in spans:
        if out and out[-1][:2] == span[:2] and span[2] <= out[-1][3]:
            out[-1] = (*out[-1][:3], max(out[-1][3], span[3]))
        else:
            out.append(span)
    return out


def _equal(difference: int) -> int:
    """Bytes before the first that differ; without a difference more than any text has."""
    return ((difference & -difference).bit_length() - 1) // 8 if difference else 1 << 40


def _ends(x: dict) -> tuple[int, int]:
    """What stands before and from the sampled place, as numbers whose low bytes are next to it."""
    return int.from_bytes(x["around"][: x["place"]], "big"), int.from_bytes(x["around"][x["place"] :], "little")


def _common(x: dict, y: dict, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """First and last start, in x's and in y's surroundings, of the strings both have: these grow from the place both
    ways."""
    left = min(_equal(a[0] ^ b[0]), x["place"], y["place"])
    right = min(_equal(a[1] ^ b[1]), len(x["around"]) - x["place"], len(y["around"]) - y["place"])
    # A string that chooses the place in one text chooses it in the other, so both have the same ones.
    out = tuple((max(0, z["place"] - left), min(z["last"], z["place"] + right - LENGTH)) for z in (x, y))
    return out if all(first <= last for first, last in out) else None


def _surroundings(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The surroundings of the suffixes with the chosen marks (column ``key``), one row for each mark, with the other
    columns of ``chosen``.

    A filter spares most rows the shuffle; what passes it by chance is left out by the marks themselves.
    """
    words = rows.sparkSession.sparkContext.broadcast(bloom(chosen.select("key")))

    def run(parts):
        for data, _, ids, same, key, _, mark, base, places, low, high in _sampled(parts, [words.value], True):
            around = pa.array([data[a : b + LENGTH] for a, b in zip(low.tolist(), high.tolist())], pa.binary())
            yield _batch(id=ids, same=same, key=key, mark=mark, low=low - base, place=places - low, last=high - low, around=around)

    found = arrow_map(rows, run, "id long, same long, key long, mark long, low long, place long, last long, around binary")
    # Rows equal in id and text have one mark: they are reduced before the shuffle.
    row = F.struct("id", "same", "key", "low", "place", "last", "around")
    found = found.groupBy("mark").agg(F.first(row).alias("x")).join(chosen.withColumnRenamed("key", "mark"), "mark")
    return found.select("x.id", "x.same", "x.key", "mark", "x.low", "x.place", "x.last", "x.around", *(c for c in chosen.columns if c != "key"))


def _by_strings(found: DataFrame) -> list[DataFrame]:
    """Spans of strings that occur in several of the many different surroundings of one beginning.

    Each is compared with the ``first`` of its beginning, the most frequent. A string that these two don't share can
    only be shared with surroundings that don't share it with the first either. Such strings are looked at in blocks,
    by what all strings of a block have in common; only blocks in which some but not all are shared are parted into
    smaller ones, down to single strings.
    """
    heads = found.filter("first").groupBy("key").agg(F.first(F.struct("mark", "place", "last", "around", "id", "same", "low")).alias("head"))

    def compared(parts):
        for batch in parts:
            out = []
            for x in batch.to_pylist():
                y = x.pop("head")
                if x["mark"] == y["mark"]:
                    mine, own = (0, x["last"]), None
                else:
                    mine, own = _common(x, y, _ends(x), _ends(y)) or ((x["last"] + 1, x["last"]), None)
                spans = [(z["id"], z["same"], z["low"] + s[0], z["low"] + s[1] + LENGTH) for z, s in ((x, mine), (y, own)) if own]
                spans = [dict(zip(("id", "same", "start", "end"), s)) for s in spans]
                out.append({k: x[k] for k in ("id", "same", "low", "place", "last", "around")} | {"before": mine[0], "after": mine[1], "spans": spans})
            yield pa.RecordBatch.from_pylist(out, schema=form)

    span = [("id", pa.int64()), ("same", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
    form = [(n, pa.int64()) for n in ("id", "same", "low", "place", "last")] + [("around", pa.binary())]
    form = pa.schema([*form, ("before", pa.int64()), ("after", pa.int64()), ("spans", pa.list_(pa.struct(span)))])
    fields = "id long, same long, low long, place long, last long, around binary, before long, after long"
    both = found.drop("few", "first").join(heads, "key")
    both = stored(arrow_map(both, compared, f"{fields}, spans array<struct<id:long,same:long,start:long,end:long>>"), "suffix-compared")
    spans = [both.select(F.explode("spans").alias("s")).select("s.*").distinct()]
    wider: list = []
    for width in BLOCKS:
        string = stored(_blocks(both.filter("before > 0 OR after < last"), width, wider), "suffix-strings")
        # The same strings in two classes start at two places; in one class only, they were settled with the class.
        kinds = string.groupBy("h1", "h2").agg(*(f(c).alias(f"{n}_{c}") for c in ("kind", "whole") for f, n in ((F.min, "min"), (F.max, "max"))))
        kinds = stored(kinds.filter("min_kind <> max_kind"), "suffix-again")
        again = kinds.filter("min_whole = max_whole").select("h1", "h2")
        spans.append(string.join(again, ["h1", "h2"]).select("id", "same", "start", "end"))
        if width > 1:
            parted = bloom(kinds.filter("min_whole <> max_whole").select(F.col("h1").alias("key")))
            if not parted.any():
                break
            wider = [*wider, (width, found.sparkSession.sparkContext.broadcast(parted))]
    return spans


def _blocks(both: DataFrame, width: int, wider: list) -> DataFrame:
    """(id, same, start, end, h1, h2, whole, kind): a row for each block of strings that the first of its beginning
    doesn't share, if it lies in blocks to be parted.

    Strings are numbered by how far before the sampled place they start. ``h1`` and ``h2`` hash the bytes that all
    strings of a block hold, so one can only be shared where these are; where the hash ``whole`` of those that stand
    here is the same too, all are shared.
    """

    def run(parts):
        digest, short = xxhash.xxh3_128_intdigest, xxhash.xxh3_64_intdigest
        for batch in parts:
            out = []
            for x in batch.to_pylist():
                around, place, last = x["around"], x["place"], x["last"]
                kind = short(around, place << 16 | last) - (1 << 63)
                for first, end in ((0, x["before"] - 1), (x["after"] + 1, last)):
                    for n in range((place - end) // width, (place - first) // width + 1) if first <= end else ():
                        least, most = n * width, (n + 1) * width - 1
                        if not all(_holds(w.value, digest(_core(around, place, n * width // size * size, size), n * width // size)) for size, w in wider):
                            continue
                        h = digest(_core(around, place, least, width), n)
                        a, b = max(first, place - most), min(end, place - least)
                        whole = short(around[a : b + LENGTH], (place - a) << 16 | (b - a)) - (1 << 63)
                        out.append((x["id"], x["same"], x["low"] + a, x["low"] + b + LENGTH, (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63), whole, kind))
            if out:
                yield _batch(**dict(zip(("id", "same", "start", "end", "h1", "h2", "whole", "kind"), map(np.array, zip(*out)))))

    return arrow_map(both, run, "id long, same long, start long, end long, h1 long, h2 long, whole long, kind long")


def _core(around: bytes, place: int, least: int, width: int) -> bytes:
    """The bytes that all strings hold which start ``least`` to ``least + width - 1`` bytes before the place."""
    return around[place - least : place + LENGTH - least - width + 1]


def _holds(words: np.ndarray, h: int) -> bool:
    """Does the filter of the upper halves of such hashes hold this one?"""
    key = ((h >> 64) - (1 << 63)) & (2**64 - 1)
    here = len(words) * 64 - 1
    return all(int(words[(k & here) >> 6]) >> (k & 63) & 1 for k in (key, key >> 32))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out = []
    for span in spans or []:
        a, b = span["start"], span["end"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def with_spans(docs: DataFrame, spans: str) -> DataFrame:
    """``docs`` with a column ``spans``: what repeats in each row's text, null where nothing does. ``text`` is
    compressed binary, for it goes through a shuffle here."""
    known, there, key, same = free(docs.withColumn(spans, F.lit(None)), "span_id", "span_same", "span_key", "span_hash")
    found = repeats(docs.select("doc_id", "text")).withColumnsRenamed({"id": known, "same": there, "spans": spans})
    marked = docs.withColumns({key: F.coalesce("doc_id", F.lit(NULL_ID)), same: F.xxhash64("text")})
    names = [n for n in marked.columns if n != "text"]

    def squeeze(parts):
        for batch, texts in chunks(parts):
            pack = zstandard.ZstdCompressor(level=3).compress
            small = pa.array([None if z else pack(t) for z, t in zip(batch.column("text").is_null().to_pylist(), texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), small], names=[*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema if f.name != "text")
    small = arrow_map(marked, squeeze, f"{schema}, text binary")
    hit = (F.col(key) == F.col(known)) & (F.col(same) == F.col(there))
    return small.join(found, hit, "left").select(*docs.columns, spans)


def _texts(parts):
    """Batches with their texts again, and those as they were, null or not."""
    for batch in parts:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            unpack = zstandard.ZstdDecompressor().decompress
            yield part, [b"" if t is None else unpack(t) for t in part.column("text").to_pylist()]


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary), one row per document.

    Null texts are empty; texts under LENGTH bytes lose nothing; of repeated rows all lose what repeats, and so do
    null ids' texts; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for batch, texts in _texts(batches):
            runs = [_merged(s) for s in batch.column("_spans").to_pylist()]
            kept = [_kept(t, r) for t, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()),
                    pa.array([len(r) for r in runs], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return arrow_map(with_spans(docs.select("doc_id", "text"), "_spans"), run, schema)


def rows_without_repeats(docs: DataFrame, lost: str) -> DataFrame:
    """``docs`` with what repeats cut from ``text``, whole characters at a time, and a column ``lost``: was anything cut."""
    (marks,) = free(docs, "spans")

    def run(batches):
        for batch, texts in _texts(batches):
            out = []
            for was_null, text, spans in zip(batch.column("text").is_null().to_pylist(), texts, batch.column(marks).to_pylist()):
                runs = [(_character(text, a, -1), _character(text, b, 1)) for a, b in _merged(spans)]
                runs = _merged([{"start": a, "end": b} for a, b in runs])
                out.append(None if was_null else _kept(text, runs).decode())
            columns = {n: batch.column(n) for n in batch.schema.names if n != marks}
            columns["text"] = pa.array(out, pa.string())
            columns[lost] = batch.column(marks).is_valid()
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{lost}` boolean"
    return arrow_map(with_spans(docs, marks), run, schema)


def _character(text: bytes, at: int, step: int) -> int:
    """The nearest place before (step -1) or after (step 1) where a character starts."""
    while 0 < at < len(text) and 0x80 <= text[at] < 0xC0:
        at += step
    return at
