"""Exact BM25 top-k: block-max WAND pruning over an inverted index of each shard, merged under global statistics.

A query is the set of words of a text (lower-cased ASCII, parted at ASCII white space). Shards are runs of documents
inside a task. The walk goes by blocks of documents: a shard's postings of the queries' words carry maxima by block, and a
block is a pivot of a query if the maxima of the query's words in it sum up to its floor, the k-th best score known so far.
Postings of other blocks are not looked at. Words that many documents of a shard have are kept as dense rows, whose sums in
the pivot blocks of many queries come from one matrix product; with them the bounds are taken again, and only in blocks that
still may reach the floor are the postings of the other words added up. A document is scored exactly only if its own sum can
reach the floor. So only documents that can't be in the result are passed over. The bounds of some queries are taken first:
where they leave most blocks as pivots, as with long queries, bounds by block cost as much as the sums themselves, and all
sums of that group of queries are made instead.

The floor of the k-th best score comes from a hundredth of the documents, then from a tenth, before all are searched:
with it, tasks send on about ten times k documents a query in each round, however many tasks there are.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.llm.common import CHUNK_BYTES, arrow_map, chunks, stored, word_hashes

K1, B = 1.2, 0.75
#: Words of all queries that are worked on at once, in four bytes each; more queries take more passes over the documents.
MOST_ENTRIES = 6_000_000
SHARD_BYTES, BLOCK = 16 << 20, 64
#: Words of at least one in so many documents of a shard are dense; queries are multiplied by them in such blocks.
DENSE, TOGETHER = 32, 256
#: Queries of such a block whose bounds tell whether bounds spare work, and one in how many blocks are many pivots.
PROBES, MANY = 8, 10
#: Documents of a shard are put into so many parts of like texts, in so many rounds.
PARTS, ROUNDS = 12, 4
#: Shares of the documents searched for the floor, and at last all.
SHARES = (0.01, 0.1, 1)
#: The shares are dealt out to so many tasks at least.
LEAST_TASKS = 10
#: Scores have so many decimals, so that sums in another order tie.
DECIMALS = 9


class Queries:
    """Queries as rows of a sparse matrix over their own words."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray):
        order = np.lexsort((terms, ids))
        ids, terms = ids[order], terms[order]
        self.words, place = np.unique(terms, return_inverse=True)
        self.ids, counts = np.unique(ids, return_counts=True)
        self.terms, self.ends = place.astype(np.int32), np.cumsum(counts)
        self.weight = np.zeros(len(self.words))
        self.mean = 1.0
        # Hashes are spread evenly: of those with the same first bits, about one each, this is the first.
        bits = max(1, len(self.words).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.words, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def known(self, documents: int, words: int, frequency: np.ndarray) -> None:
        self.weight = np.log1p((documents - frequency + 0.5) / (frequency + 0.5))
        self.mean = words / max(1, documents) or 1.0

    def row(self, i: int) -> np.ndarray:
        return self.terms[self.ends[i - 1] if i else 0 : self.ends[i]]

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are words of the queries, and their places among these."""
        out = np.full(len(hashes), -1, np.int64)
        left, at = np.arange(len(hashes)), self.first[(hashes >> self.shift).astype(np.int64)].astype(np.int64)
        while True:
            here = at < len(self.words)
            left, at, hashes = left[here], at[here], hashes[here]
            if not len(left):
                found = np.flatnonzero(out >= 0)
                return found, out[found]
            words = self.words[at]
            out[left[words == hashes]] = at[words == hashes]
            more = words < hashes
            left, at, hashes = left[more], at[more] + 1, hashes[more]


def _parts(texts: list[bytes]):
    """Runs of texts of about CHUNK_BYTES."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK_BYTES or i + 1 == len(texts):
            yield start, texts[start : i + 1]
            start, held = i + 1, 0


def _postings(queries: Queries, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, document, frequency) of the queries' words by word and document, and all documents' lengths."""
    pairs, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, part in _parts(texts):
        hashes, counts = word_hashes([t.lower() for t in part])
        found, place = queries.places(hashes)
        pairs.append(place * len(texts) + np.repeat(np.arange(start, start + len(part)), counts)[found])
        lengths.append(counts)
    pair, frequency = np.unique(np.concatenate(pairs), return_counts=True)
    word = pair // max(1, len(texts))
    return word, pair - word * len(texts), frequency, np.concatenate(lengths)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


_NOTHING = np.zeros(0, np.int64), np.zeros(0)


def _room(score):
    """Dense sums have single precision, so bounds are compared with room for rounding."""
    return 0.01 + 1e-4 * np.abs(score)


class Shard:
    """Inverted and forward index of a run of documents, for the queries' words, with block and word maxima."""

    def __init__(self, queries: Queries, texts: list[bytes]):
        word, doc, frequency, lengths = _postings(queries, texts)
        self.size = len(texts)
        norm = K1 * (1 - B + B * lengths / queries.mean)
        value = queries.weight[word] * frequency * (K1 + 1) / (frequency + norm[doc])
        # Sums of these only tell which documents are scored exactly.
        self.doc, self.value = doc.astype(np.int32), value.astype(np.float32)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
        self.local = np.full(len(queries.words), -1, np.int64)
        self.local[word[first]] = np.arange(len(first))
        self.start, self.count = first, np.diff(np.r_[first, len(word)])
        block = doc // BLOCK
        cut = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])]) if len(word) else first
        self.block, self.block_most = block[cut], np.maximum.reduceat(value, cut) if len(cut) else np.zeros(0)
        self.cut_start, self.cut_count = cut, np.diff(np.r_[cut, len(word)])
        self.block_start = np.searchsorted(cut, first)
        self.block_count = np.diff(np.r_[self.block_start, len(cut)])
        # By document, then by word.
        order = np.sort(doc << 32 | np.arange(len(doc))) & 0xFFFFFFFF
        self.by_doc, self.doc_value = self.local[word[order]], value[order]
        self.doc_count = np.bincount(doc, minlength=self.size)
        self.doc_start = np.cumsum(self.doc_count) - self.doc_count
        self.wanted = np.zeros(len(first))
        # Frequent words as dense rows over documents, filled up to whole blocks.
        often = np.flatnonzero(self.count * DENSE >= self.size)
        self.row = np.full(len(first), -1, np.int64)
        self.row[often] = np.arange(len(often))
        self.blocks = -(-self.size // BLOCK)
        self.dense = np.zeros((len(often), self.blocks * BLOCK), np.float32)
        at = _ranges(self.start[often], self.count[often])
        self.dense[np.repeat(np.arange(len(often)), self.count[often]), doc[at]] = value[at]
        self.dense_most = self.dense.reshape(len(often), self.blocks, BLOCK).max(axis=2)
        #: Postings looked at so far; each dense row counts all documents of a block.
        self.looked = 0

    def _wanted(self, queries: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """The words that some queries have here, and which of the dense ones each has."""
        counts = np.array([len(terms) for terms in queries], np.int64)
        here, query = self.local[np.concatenate(queries)], np.repeat(np.arange(len(queries)), counts)
        here, query = here[here >= 0], query[here >= 0]
        wanted = np.zeros((len(queries), len(self.dense)), np.float32)
        row = self.row[here]
        wanted[query[row >= 0], row[row >= 0]] = 1
        return np.split(here, np.searchsorted(query, np.arange(1, len(queries)))), wanted

    def alike(self, queries: list[np.ndarray]) -> np.ndarray:
        """An order of the queries in which those are together that have most in common with one block."""
        near = [np.zeros(0, np.int64)]
        for begin in range(0, len(queries) if self.blocks else 0, TOGETHER):
            near.append((self._wanted(queries[begin : begin + TOGETHER])[1] @ self.dense_most).argmax(axis=1))
        return np.argsort(np.concatenate(near), kind="stable") if self.blocks else np.arange(len(queries))

    def search(self, queries: list[np.ndarray], least: np.ndarray, k: int):
        """For each query (documents, scores) of all that may be among its best k and score ``least`` or more."""
        for begin in range(0, len(queries), TOGETHER):
            part, wanted = self._wanted(queries[begin : begin + TOGETHER])
            # Nothing but maxima is looked at before it is known which blocks may hold a result.
            floors = least[begin : begin + len(part)] - _room(least[begin : begin + len(part)])
            probes = np.arange(0, len(part), -(-len(part) // PROBES))
            live = wanted[probes] @ self.dense_most + self._bounds_of([part[i] for i in probes]) >= floors[probes, None]
            if MANY * live.sum() > live.size:
                yield from self._rare_first(part, wanted, least[begin : begin + len(part)], k)
                continue
            bounds = self._bounds_of(part)
            live = wanted @ self.dense_most + bounds >= floors[:, None]
            some = np.flatnonzero(live.any(axis=0))
            if 2 * len(some) > self.blocks:
                # Most blocks are a pivot of one of these queries: the dense rows are taken as they are, not copied.
                some = np.arange(self.blocks)
            asked = np.flatnonzero(live.any(axis=1))
            sums = wanted[asked] @ (self.dense if len(some) == self.blocks else self._columns(some))
            self.looked += len(some) * BLOCK * len(self.dense)
            sums = sums.reshape(len(asked), len(some), BLOCK)
            highest = sums.max(axis=2) if len(some) else np.zeros((len(asked), 0))
            row = np.full(len(part), -1, np.int64)
            row[asked] = np.arange(len(asked))
            for i, here in enumerate(part):
                if row[i] < 0:
                    yield _NOTHING
                    continue
                # The sums of the dense words are known in these blocks, which tightens their bound.
                bound = highest[row[i]] + bounds[i, some]
                slots = np.flatnonzero(live[i, some] & (bound >= floors[i]))
                yield self._search(here, some[slots], sums[row[i], slots].ravel(), least[begin + i], k) if len(slots) else _NOTHING

    def _bounds_of(self, part: list[np.ndarray]) -> np.ndarray:
        return np.array([self._bounds(here)[1] for here in part]).reshape(len(part), self.blocks)

    def _columns(self, blocks: np.ndarray) -> np.ndarray:
        """Dense rows of some blocks."""
        return self.dense.reshape(len(self.dense), self.blocks, BLOCK)[:, blocks].reshape(len(self.dense), len(blocks) * BLOCK)

    def _bounds(self, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block entries of a query's words that are not dense, and the sum of their maxima by block."""
        rare = here[self.row[here] < 0]
        at = _ranges(self.block_start[rare], self.block_count[rare])
        return at, np.bincount(self.block[at], self.block_most[at], minlength=self.blocks)

    def _search(self, here: np.ndarray, blocks: np.ndarray, total: np.ndarray, least: float, k: int):
        """Best documents of the live blocks; ``total`` has the sums of the dense words of their documents."""
        docs = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        slot = np.full(self.blocks, -1, np.int64)
        slot[blocks] = np.arange(len(blocks))
        at, _ = self._bounds(here)
        at = at[slot[self.block[at]] >= 0]
        at = _ranges(self.cut_start[at], self.cut_count[at])
        self.looked += len(at)
        doc = self.doc[at]
        total = total + np.bincount(slot[doc // BLOCK] * BLOCK + doc % BLOCK, self.value[at], minlength=len(docs))
        return self._exact(here, docs, total, least, k)

    def _rare_first(self, part: list[np.ndarray], wanted: np.ndarray, least: np.ndarray, k: int):
        """``search`` for a group of queries for which many blocks are pivots: their sums of words that are not dense
        are made for all documents, and with them and the dense words' maxima it is known which blocks are needed."""
        total = np.empty((len(part), self.blocks * BLOCK), np.float32)
        for i, here in enumerate(part):
            rare = here[self.row.take(here) < 0]
            at = _ranges(self.start.take(rare), self.count.take(rare))
            self.looked += len(at)
            total[i] = np.bincount(self.doc.take(at), self.value.take(at), minlength=total.shape[1])
        total = total.reshape(len(part), self.blocks, BLOCK)
        floors = least - _room(least)
        live = total.max(axis=2) + wanted @ self.dense_most >= floors[:, None]
        # Most queries of a group need the same blocks; those that need others are looked at by themselves.
        others = (live & (live.sum(axis=0) * 8 < len(part))).any(axis=1)
        found = [_NOTHING] * len(part)
        for some in (np.flatnonzero(~others), np.flatnonzero(others)):
            blocks = np.flatnonzero(live[some].any(axis=0))
            if not len(blocks):
                continue
            used = np.flatnonzero(wanted[some].any(axis=0))
            dense = self.dense.reshape(len(self.dense), self.blocks, BLOCK)[used[:, None], blocks].reshape(len(used), len(blocks) * BLOCK)
            self.looked += dense.size
            sums = total[some[:, None], blocks].reshape(len(some), -1)
            sums += wanted[some[:, None], used] @ dense
            docs = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            query, place = np.nonzero(sums >= np.maximum(floors[some], 1e-6)[:, None])
            ends = np.searchsorted(query, np.arange(len(some) + 1))
            for j in np.flatnonzero(np.diff(ends)):
                mine, i = place[ends[j] : ends[j + 1]], some[j]
                found[i] = self._exact(part[i], docs[mine], sums[j, mine], least[i], k)
        yield from found

    def _exact(self, here: np.ndarray, docs: np.ndarray, total: np.ndarray, least: float, k: int):
        """Those of the documents whose sums may be among the best k, with their scores."""
        ok = (total > 0) & (total >= least - _room(least))
        if len(total) > k:
            floor = np.partition(total, len(total) - k)[len(total) - k]
            ok &= total >= floor - 2 * _room(floor)
        found = docs[ok]
        if not len(found):
            return _NOTHING
        self.wanted[here] = 1
        counts = self.doc_count[found]
        at = _ranges(self.doc_start[found], counts)
        scores = np.add.reduceat(self.doc_value[at] * self.wanted[self.by_doc[at]], np.cumsum(counts) - counts)
        self.wanted[here] = 0
        return found, scores.round(DECIMALS)


def _like_together(texts: list[bytes]) -> np.ndarray:
    """An order of texts in which those of like bytes, as in one language, are together: blocks' maxima are closer then.

    Byte frequencies are parted around texts that are far from one another.
    """
    counts = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts], np.float32)
    profile = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    centres = profile[:1]
    for _ in range(PARTS - 1):
        centres = np.r_[centres, profile[[(profile @ centres.T).max(axis=1).argmin()]]]
    for _ in range(ROUNDS):
        part = (profile @ centres.T).argmax(axis=1)
        sums = np.array([profile[part == c].sum(axis=0) for c in range(PARTS)])
        centres = sums / np.maximum(np.sqrt((sums**2).sum(axis=1, keepdims=True)), 1e-9)
    return np.argsort((profile @ centres.T).argmax(axis=1), kind="stable")


def _shards(batches):
    """(ids, which of them are null, texts) of runs of documents of about SHARD_BYTES."""
    ids, null, texts, held = [], [], [], 0
    for batch, some in chunks(batches):
        column = batch.column("doc_id")
        null.append(column.is_null().to_numpy(zero_copy_only=False))
        ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        texts += some
        held += sum(map(len, some))
        if held >= SHARD_BYTES:
            yield np.concatenate(ids), np.concatenate(null), texts
            ids, null, texts, held = [], [], [], 0
    if texts:
        yield np.concatenate(ids), np.concatenate(null), texts


def _best(docs: DataFrame, shared, k: int) -> DataFrame:
    """(query_id, doc_id, score): the best k of each task for each query that may be among the best k of all."""

    def run(batches):
        queries, least = shared.value
        n = len(queries.ids)
        least = np.array(least)
        kept = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))] * n
        names, rows = None, [queries.row(i) for i in range(n)]
        for ids, null, texts in _shards(batches):
            order = _like_together(texts)
            ids, null = ids[order], null[order]
            shard = Shard(queries, [texts[i] for i in order])
            if names is None:
                order = shard.alike(rows)
                names, rows, least = queries.ids[order], [rows[i] for i in order], least[order]
            for i, (found, scores) in enumerate(shard.search(rows, least, k)):
                ok = scores >= least[i]
                found, scores = found[ok], scores[ok]
                if not len(found):
                    continue
                s, d, z = np.r_[kept[i][0], scores], np.r_[kept[i][1], ids[found]], np.r_[kept[i][2], null[found]]
                order = np.lexsort((d, z, -s))[:k]
                kept[i] = (s[order], d[order], z[order])
                if len(order) == k:
                    least[i] = max(least[i], s[order[-1]])
        for i in range(0, n, 4096):
            part = kept[i : i + 4096]
            counts = [len(s) for s, _, _ in part]
            if sum(counts):
                s, d, z = (np.concatenate(x) for x in zip(*part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names[i : i + 4096], counts)), pa.array(d, mask=z), pa.array(s)], names=["query_id", "doc_id", "score"]
                )

    found = arrow_map(docs.select("doc_id", "text"), run, "query_id long, doc_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _frequencies(docs: DataFrame, queries: Queries) -> None:
    """Document frequencies of the queries' words, the number of documents and of words, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        queries = shared.value
        n = len(queries.words)
        total = np.zeros(n + 2, np.int64)
        for _, texts in chunks(batches, limit=4 * CHUNK_BYTES):
            word, _, _, lengths = _postings(queries, texts)
            total[:n] += np.bincount(word, minlength=n)
            total[n] += len(texts)
            total[n + 1] += lengths.sum()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["at", "n"])

    found = arrow_map(docs.select("text"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(queries.words) + 2, np.int64)
    total[found["at"].to_numpy()] = found["n"].to_numpy()
    queries.known(int(total[-2]), int(total[-1]), total[:-2].astype(float))
    shared.unpersist()


def top_k(docs: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents for each text whose id is divisible by ``every``.

    Only documents that share a word with the query are found; of equal scores (to 9 decimals) the lower id comes first, null ids
    last. Rows with one query id make one query; a null or empty text finds nothing and is found by none; repeated
    rows are documents of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    asked = docs.filter(F.col("doc_id") % every == 0).select("doc_id", "text")

    def words(batches):
        for batch, texts in chunks(batches):
            hashes, counts = word_hashes([t.lower() for t in texts])
            ids = np.repeat(batch.column("doc_id").to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes.view(np.int64))], names=["id", "term"])

    entries = stored(arrow_map(asked, words, "id long, term long").distinct(), "query-words")
    # Blocks of queries are bounded in size, and each is sent to all tasks.
    blocks = -(-entries.count() // MOST_ENTRIES)
    tasks = docs.rdd.getNumPartitions()
    out = []
    for block in range(blocks):
        part = entries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        queries = Queries(part["id"].to_numpy(), part["term"].to_numpy().view(np.uint64))
        if not len(queries.ids):
            continue
        _frequencies(docs, queries)
        least = np.zeros(len(queries.ids))
        for share in SHARES:
            shared = spark.sparkContext.broadcast((queries, least))
            if share == 1:
                out.append(stored(_best(docs, shared, k), "search"))
                shared.unpersist()
                break
            some = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(1000)) < int(1000 * share))
            # All tasks read, few search: each sends on up to k documents a query.
            some = some.repartition(max(LEAST_TASKS, int(tasks * share)))
            # The k-th best of some documents is a floor for the k-th best of all.
            first = _best(some, shared, k).filter(F.col("rank") == k).select("query_id", "score").toArrow()
            shared.unpersist()
            place = np.searchsorted(queries.ids, first["query_id"].to_numpy())
            least[place] = np.maximum(least[place], first["score"].to_numpy())
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found
