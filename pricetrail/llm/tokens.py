"""Token ids of a corpus as files: blocks of canonical Huffman codes in ascending order of doc_id, and their reader."""

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.llm import huffman
from pricetrail.llm.common import NULL_ID, arrow_map, chunks, mixed, stored
from pricetrail.llm.neighbours import id_cuts
from pricetrail.session import fresh_path

END = 2
#: Ids in a block; a longer document makes a longer block.
BLOCK = 1 << 18

#: Classes of characters by which a byte-level vocabulary of this kind parts a text before it looks for merges:
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTER, NUMBER, WHITE, OTHER, END_OF_TEXT = range(5)
#: Stands after each text, beyond all characters.
_STOP = 0x110000
#: Parts of more characters are hashed one by one.
_SHORT = 32


def _character_classes() -> np.ndarray:
    out = np.full(_STOP + 1, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, _STOP))))
    for number, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for run in regex.finditer(pattern, every):
            out[ord(every[run.start()]) : ord(every[run.end() - 1]) + 1] = number
    out[_STOP] = END_OF_TEXT
    return out


def pretokens(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where parts start, over the code points of texts that each end with _STOP; one that follows a part counts to it."""
    kind = np.r_[classes[points], np.full(3, END_OF_TEXT, np.uint8)]
    new = np.r_[True, kind[1:-3] != kind[:-4]] & (kind[:-3] != END_OF_TEXT)
    # The last of white space that does not end the text stands alone; a space goes to what follows.
    last = np.flatnonzero((kind[:-3] == WHITE) & (kind[1:-2] != WHITE) & (kind[1:-2] != END_OF_TEXT))
    new[last] = True
    new[last[points[last] == 32] + 1] = False
    # A part that starts with an apostrophe and a letter has no other characters of its kind.
    at = np.flatnonzero((points == 39) & new & (kind[1:-2] == LETTER))
    if len(at):
        more = np.r_[points, np.full(3, _STOP, points.dtype)]
        one, two = more[at + 1], more[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
        new[at[short | long] + 1] = False
        ends = np.r_[at[short] + 2, at[long] + 3]
        new[ends[kind[ends] == LETTER]] = True
    return np.flatnonzero(new)


class Encoder:
    """The tokenizers library, whose model is asked once for each distinct part of the texts.

    Parts are known by 64-bit hashes of their characters and forgotten when there are too many.
    """

    def __init__(self, path: str, most: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        # Texts that hold the string of an added token are left to the library whole.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model, self.most = self.tokenizer.model, most
        # The library's names of bytes: its own where they can be printed, later characters in order for the others.
        names = sorted(ByteLevel.alphabet(), key=ord)
        printed = [ord(c) for c in names if ord(c) < 256]
        rest = iter(names[len(printed) :])
        self.names = {b: b if b in printed else ord(next(rest)) for b in range(256)}
        self.classes = _character_classes()
        self.values = mixed(np.arange(1, _STOP + 2, dtype=np.uint64))
        self.values[_STOP] = 0
        self.powers = np.cumprod(np.r_[np.uint64(1), np.full(_SHORT, 0x9E3779B97F4A7C15, np.uint64)], dtype=np.uint64)
        self._forget()

    def _forget(self) -> None:
        # Sorted hashes with their places in ``starts``; ids of the part at a place are those up to the next start.
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def _merge(self, parts: list[str]) -> None:
        """Appends the ids of new parts."""
        tokenize, names = self.model.tokenize, self.names
        found = [[x.id for x in tokenize(p.encode().decode("latin-1").translate(names))] for p in parts]
        number = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(number)]
        self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(found), np.uint16, int(number.sum()))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text."""
        if self.added is None or not any(map(self.added.search, texts)):
            return self._encode(texts)
        odd = [n for n, t in enumerate(texts) if self.added.search(t)]
        plain = iter(self._encode([t for t in texts if not self.added.search(t)]) if len(odd) < len(texts) else [])
        whole = iter(self.tokenizer.encode_batch_fast([texts[n] for n in odd], add_special_tokens=False))
        held = set(odd)
        return [np.array(next(whole).ids, np.uint16) if n in held else next(plain) for n in range(len(texts))]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4").copy()
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        points[text_ends - 1] = _STOP
        starts = pretokens(points, self.classes)
        parts = np.diff(np.r_[0, np.searchsorted(starts, text_ends)])
        places = self._places(joined, points, starts) if len(starts) else np.zeros(0, np.int64)
        first = self.starts[places]
        many = self.starts[places + 1] - first
        ends = np.cumsum(many)
        ids = self.ids[np.repeat(first - (ends - many), many) + np.arange(int(many.sum()))]
        run = np.r_[0, ends]
        return np.split(ids, run[np.cumsum(parts)][:-1])

    def _places(self, joined: str, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(self.hashes) > self.most:
            self._forget()
        following = np.r_[starts[1:], len(points)]
        stops = np.r_[0, np.cumsum(points == _STOP)]
        lengths = following - starts - (stops[following] - stops[starts])
        place = np.arange(starts[0], len(points)) - np.repeat(starts, following - starts)
        values = self.values[points[starts[0] :]] * self.powers[np.minimum(place, _SHORT)]
        key = mixed(np.add.reduceat(values, starts - starts[0]) + lengths.astype(np.uint64))
        for n in np.flatnonzero(lengths > _SHORT).tolist():
            key[n] = xxhash.xxh3_64_intdigest(joined[starts[n] : starts[n] + lengths[n]])
        key, first, code = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, key)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == key[known]
        new = np.flatnonzero(~known)
        if len(new):
            before = len(self.starts) - 1
            self._merge([joined[a:b] for a, b in zip(starts[first[new]].tolist(), (starts + lengths)[first[new]].tolist())])
            self.hashes = np.insert(self.hashes, at[new], key[new])
            self.places = np.insert(self.places, at[new], np.arange(before, before + len(new), dtype=np.int32))
            at = np.searchsorted(self.hashes, key)
        return self.places[at][code]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each Python worker, which goes on to the next task with what it has learned."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _squeezed(ids: np.ndarray) -> bytes:
    planes = ids.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(2, -1)
    return np.ascontiguousarray(planes.T).view("<u2")[:, 0]


def tokenized(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """(part, start, doc_id, n_tokens, ids), stored: ``part`` numbers ascending ranges of doc_id, ``start`` counts the
    ids before the document in its part. Null ids come first, rows of one id in the order of their text hash."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NULL_ID)).alias("_key"))
    cuts = [c for c in id_cuts(keyed.select("_key"), tasks) if c > NULL_ID]
    part = F.expr(f"size(filter(array({', '.join(f'{c}L' for c in cuts)}), c -> c < _key))") if cuts else F.lit(0)

    def run(batches):
        for batch, texts in chunks(batches):
            found = [np.r_[i, np.uint16(end)] for i in _encoder(tokenizer).encode([t.decode() for t in texts])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("part"),
                    batch.column("_key"),
                    batch.column("_tie"),
                    batch.column("doc_id"),
                    pa.array([len(i) for i in found], pa.int64()),
                    pa.array([_squeezed(i) for i in found], pa.binary()),
                ],
                names=["part", "_key", "_tie", "doc_id", "n_tokens", "ids"],
            )

    rows = keyed.select(part.cast("int").alias("part"), "_key", F.xxhash64("text").alias("_tie"), "doc_id", "text")
    rows = arrow_map(rows, run, "part int, _key long, _tie long, doc_id long, n_tokens long, ids binary")
    rows = rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("_key", "_tie")

    def starts(batches):
        before = 0
        for batch in batches:
            number = batch.column("n_tokens").to_numpy()
            ends = before + np.cumsum(number)
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), pa.array(ends - number), *(batch.column(n) for n in ("doc_id", "n_tokens", "ids"))],
                names=["part", "start", "doc_id", "n_tokens", "ids"],
            )
            before = int(ends[-1]) if len(ends) else before

    return stored(arrow_map(rows, starts, "part int, start long, doc_id long, n_tokens long, ids binary"), "token-ids")


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> dict:
    """Writes the id files under ``path``: ``blocks`` (one folder for each range of ids) and ``codes``.

    Codes come from the counts of all ids. A block is independent: it holds its documents' ids and lengths, the bits,
    and a bit offset for every 128th id.
    """
    spark = docs.sparkSession
    rows = tokenized(docs, tokenizer, end)

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            ids = [_unsqueezed(data) for data in batch.column("ids").to_pylist()]
            total += np.bincount(np.concatenate(ids), minlength=1 << 16) if ids else 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    # At most one row for each id of the vocabulary and one for each range come back.
    found = arrow_map(rows.select("ids"), count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << 16, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    lengths = huffman.code_lengths(counts)
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    spark.createDataFrame([(bytearray(lengths.tobytes()), sorted(sizes.items()))], "lengths binary, parts array<struct<part:int,n:bigint>>").write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((huffman.canonical(lengths), lengths))

    def blocks(batches):
        codes, sizes = shared.value
        run, place, held = [], None, 0

        def block():
            ids = np.concatenate([i for _, i in run])
            data = huffman.write_block([d for d, _ in run], np.array([len(i) for _, i in run]), ids, codes, sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int64()), pa.array([data], pa.binary())], names=["part", "start", "block"]
            )

        for batch in batches:
            for p, s, d, z in zip(*(batch.column(n).to_pylist() for n in ("part", "start", "doc_id", "ids"))):
                if run and (held >= BLOCK or (p, s) != (place[0], place[1] + held)):
                    yield block()
                    run, held = [], 0
                if not run:
                    place = (p, s)
                run.append((d, _unsqueezed(z)))
                held += len(run[-1][1])
        if run:
            yield block()

    done = arrow_map(rows.select("part", "start", "doc_id", "ids"), blocks, "part int, start long, block binary")
    done.write.partitionBy("part").option("compression", "none").parquet(f"{path}/blocks")
    return sizes


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone."""
    codes = spark.read.schema("lengths binary, parts array<struct<part:int,n:bigint>>").parquet(f"{path}/codes").first()
    lengths = np.frombuffer(codes["lengths"], np.uint8)
    before, offsets = 0, {}
    for part, n in codes["parts"]:
        offsets[part] = before
        before += n
    shared = spark.sparkContext.broadcast((huffman.decoding_table(lengths), offsets))

    def run(batches):
        table, offsets = shared.value
        for batch in batches:
            for part, start, data in zip(*(batch.column(n).to_pylist() for n in ("part", "start", "block"))):
                doc_ids, counts, ids = huffman.read_block(data, table)
                ends = np.cumsum(counts)
                wide = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(offsets[part] + start + ends - counts),
                        pa.array(counts),
                        pa.array([zlib.crc32(wide[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    if not offsets:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    blocks = spark.read.schema("start long, block binary, part int").parquet(f"{path}/blocks")
    return arrow_map(blocks.select("part", "start", "block"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def coded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Writes the id files to the shared folder and reads them back.

    (doc_id, start, n_tokens, ids_crc32), one row per document. Null texts have the end id alone; null ids come
    first; rows of one id come in the order of their text hash; an empty table gives no rows.
    """
    path = fresh_path(docs.sparkSession, "id-files")
    write(docs, path, tokenizer, end)
    return read(docs.sparkSession, path)
