"""Masked pseudo-likelihood: a bidirectional window network predicts every word from the words on both sides.

Words (lower-cased ASCII, parted at white space) have ids by their frequency in the corpus; how many grows with its
size. A word outside this vocabulary has the id RARE, and its probability is that id's times that of its bytes, each
given the one before. An id is a row of digits of base CLASSES, each predicted by its own softmax with a term for the
digits before. A text's score is the sum of all its words' conditional log probabilities. Every document takes part in
learning, and every word is masked in one of the rounds: in each all tasks start from the same weights, mask one word
in ROUNDS of their documents and follow the gradient; their weights are then averaged.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import WHITE, arrow_map, chunks, mixed, stored, sums_by_text, word_hashes

CLASSES, WINDOW, WIDTH, HIDDEN = 64, 2, 16, 32
#: Ids of two digits, the least that weights are made for.
IDS = CLASSES * CLASSES
EDGE = IDS  # stands before and after each text, where there are IDS ids
RARE = 0
#: A word has an id of its own if it occurs twice and in a share of 1 / (SPREAD * root of all words) of them.
SPREAD = 50
ROUNDS = 2
BATCH, RATE = 512, 0.08
#: Weights travel as whole numbers of this fraction, so that their sums don't depend on the order.
FRACTION = 1 << 20
#: Weights that travel in one row.
BLOCK = 1 << 13
#: Bytes of a rare word, and what stands after its last and before its first.
END = 256


def shapes(ids: int = IDS) -> dict[str, tuple[int, ...]]:
    """Shapes of the weights for so many ids. ``member`` has the terms of the second digit, ``member2`` and so on those
    of the further ones, a row for each row of digits before."""
    digits = _digits(ids)
    further = {f"member{d}": (-(-ids // CLASSES ** (digits - d)), CLASSES) for d in range(2, digits)}
    return {
        "embed": (ids + 1, WIDTH),
        "inner": (2 * WINDOW * WIDTH, HIDDEN),
        "inner_bias": (HIDDEN,),
        "outer": (HIDDEN, digits * CLASSES),
        "outer_bias": (digits * CLASSES,),
        "member": (CLASSES, CLASSES),
    } | further


def _digits(ids: int) -> int:
    digits = 2
    while CLASSES**digits < ids:
        digits += 1
    return digits


def _parts(w: dict, ids: np.ndarray) -> tuple[np.ndarray, list]:
    """The column of each digit's own value, and of each digit after the first: its columns, table and rows of terms."""
    digits = w["outer"].shape[1] // CLASSES
    before = [ids // CLASSES ** (digits - d) for d in range(1, digits)] + [ids]
    own = np.empty((len(ids), digits), np.int64)
    own[:, 0] = before[0]
    for d in range(1, digits):
        own[:, d] = before[d] - CLASSES * (before[d - 1] - d)
    return own, [(slice(d * CLASSES, (d + 1) * CLASSES), "member" if d == 1 else f"member{d}", before[d - 1]) for d in range(1, digits)]


def initial(seed: int = 7, ids: int = IDS) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = {"embed": 0.1, "inner": 0.15, "outer": 0.1}
    return {k: (rng.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in shapes(ids).items()}


class Vocabulary:
    """Ids of frequent words, from 1 by falling frequency, and log probabilities of the bytes of other words."""

    def __init__(self, hashes: np.ndarray, pairs: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.places = hashes[order], (order + 1).astype(np.int32)
        self.size = max(IDS, len(hashes) + 1)
        # Every pair counts once more, so that none is impossible.
        self.spelling = np.log((pairs + 1.0) / (pairs + 1.0).sum(axis=1, keepdims=True))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), RARE, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.places[at], RARE).astype(np.int32)

    def spelled(self, texts: list[bytes], rare: np.ndarray) -> np.ndarray:
        """Log probability of the bytes of each rare word given that it is one; 0 for other words."""
        out = np.zeros(len(rare))
        before, here, word = spelling_pairs(texts, rare)
        return np.bincount(word, self.spelling[before, here], len(out)) if len(word) else out


def spelling_pairs(texts: list[bytes], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte before or END, byte or END, number of the word) for all bytes of the chosen words and their ends."""
    data = np.frombuffer(b"\n" + b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    white = WHITE[data]
    edges = np.flatnonzero(white[1:] != white[:-1])  # before each word, and its last byte
    word = np.flatnonzero(chosen)
    starts, pairs = edges[::2][word], (edges[1::2] - edges[::2])[word] + 1
    at = np.arange(pairs.sum()) + np.repeat(starts - np.cumsum(pairs) + pairs, pairs)
    before, here = (np.where(white[x], END, data[x].astype(np.int64)) for x in (at, at + 1))
    return before, here, np.repeat(word, pairs)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """From the counts of all words; bytes are counted over all occurrences of the words that have no id."""

    def words(batches):
        for _, texts in chunks(batches):
            found, n = np.unique(word_hashes([t.lower() for t in texts])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    counted = arrow_map(docs.select("text"), words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    frequent = counted.filter(F.col("n") >= max(2, total**0.5 / SPREAD)).orderBy(F.col("n").desc(), "word").select("word").toArrow()
    hashes = frequent["word"].to_numpy().view(np.uint64)
    known = Vocabulary(hashes, np.zeros((END + 1, END + 1)))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def pairs(batches):
        sums = np.zeros((END + 1) ** 2, np.int64)
        for _, texts in chunks(batches):
            before, here, _ = spelling_pairs(texts, shared.value.ids(word_hashes([t.lower() for t in texts])[0]) == RARE)
            sums += np.bincount(before * (END + 1) + here, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["at", "n"])

    found = arrow_map(docs.select("text"), pairs, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((END + 1) ** 2)
    sums[found["at"].to_numpy()] = found["n"].to_numpy()
    return Vocabulary(hashes, sums.reshape(END + 1, END + 1))


def numbered(texts: list[bytes], known: Vocabulary | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, words by text); without a vocabulary ids are ends of hashes."""
    hashes, counts = word_hashes([t.lower() for t in texts])
    return known.ids(hashes) if known else (hashes >> np.uint64(52)).astype(np.int32), counts


def windows(ids: np.ndarray, counts: np.ndarray, edge: int = EDGE, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The ids around the chosen words; ``edge`` stands where a text has no more words."""
    # All words in a line, with edges between the texts.
    at = np.arange(WINDOW, len(ids) + WINDOW) + WINDOW * np.repeat(np.arange(len(counts)), counts)
    line = np.full(len(ids) + WINDOW * (len(counts) + 1), edge, np.int32)
    line[at] = ids
    return line[at[chosen, None] + np.r_[-WINDOW:0, 1 : WINDOW + 1]]


def examples(texts: list[bytes], known: Vocabulary | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all words, the ids in their windows, words by text); without a vocabulary ids are ends of hashes."""
    ids, counts = numbered(texts, known)
    return ids, windows(ids, counts, known.size if known else EDGE), counts


class _Room:
    """Arrays of a batch, used again for the next: fresh ones of this size cost more time than the work on them."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, like: np.ndarray, *shape: int) -> np.ndarray:
        held = self.kept.get(name)
        if held is None or len(held) < shape[0] or held.shape[1:] != shape[1:] or held.dtype != like.dtype:
            held = self.kept[name] = np.empty(shape, like.dtype)
        return held[: shape[0]]


def _rows(table: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Rows of a table; without ``mode`` numpy would write them to a copy first. All places are inside the table."""
    return np.take(table, at, axis=0, out=out, mode="clip")


def _below_tops(out: np.ndarray, room: _Room) -> np.ndarray:
    """Outputs less the greatest of their digit, in place, digit by digit."""
    cells = out.reshape(-1, CLASSES)
    # Halves against each other, then by columns: numpy reduces many short rows slowly.
    half = np.maximum(cells[:, : CLASSES // 2], cells[:, CLASSES // 2 :], out=room("half", out, len(cells), CLASSES // 2))
    quarter = np.maximum(half[:, : CLASSES // 4], half[:, CLASSES // 4 :], out=room("quarter", out, len(cells), CLASSES // 4))
    cells -= np.ascontiguousarray(quarter.T).max(axis=0)[:, None]
    return cells


def _ahead(w: dict, around: np.ndarray, parts: list, room: _Room):
    """(embedded windows, hidden values, outputs); they stand in ``room`` until its next batch."""
    n, outer = len(around), w["outer"]
    x = _rows(w["embed"], around, room("x", w["embed"], n, 2 * WINDOW, WIDTH)).reshape(n, -1)
    hidden = np.matmul(x, w["inner"], out=room("hidden", outer, n, HIDDEN))
    hidden += w["inner_bias"]
    np.tanh(hidden, out=hidden)
    out = np.matmul(hidden, outer, out=room("out", outer, n, outer.shape[1]))
    out += w["outer_bias"]
    for columns, name, before in parts:
        out[:, columns] += _rows(w[name], before, room("terms", outer, n, CLASSES))
    return x, hidden, out


def log_probabilities(w: dict, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Of each word given the words around it."""
    result, room = np.zeros(len(ids)), _Room()
    for s in range(0, len(ids), BATCH):
        i = ids[s : s + BATCH]
        own, parts = _parts(w, i)
        out = _ahead(w, around[s : s + BATCH], parts, room)[2]
        cells = _below_tops(out, room)
        owns = np.take_along_axis(out, own, axis=1)
        logs = np.log(np.exp(cells, out=cells).sum(axis=1)).reshape(own.shape)
        for d in range(own.shape[1]):
            result[s : s + BATCH] += owns[:, d] - logs[:, d]
    return result


class Learner:
    """Adaptive gradient steps on a task's own copy of the weights."""

    def __init__(self, weights: dict):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.seen = {k: np.full(v.shape, 1e-2, np.float32) for k, v in weights.items()}
        self.words = 0
        self.room = _Room()

    def _move(self, name: str, slope: np.ndarray) -> None:
        self.seen[name] += slope * slope
        self.w[name] -= RATE * slope / np.sqrt(self.seen[name])

    def _move_rows(self, name: str, rows: np.ndarray, slopes: np.ndarray) -> None:
        """Only the rows that have a slope: the work does not grow with the table."""
        # Sorted together with their places, rows keep the order of the batch.
        n = len(rows)
        bits = n.bit_length()
        keys = rows.astype(np.int64) << bits
        keys |= np.arange(n)
        keys.sort()
        order, rows = keys & ((1 << bits) - 1), keys >> bits
        first = np.ones(n, bool)
        np.not_equal(rows[1:], rows[:-1], out=first[1:])
        cut = np.flatnonzero(first)
        touched = rows[cut]
        slope = np.add.reduceat(_rows(slopes, order, self.room(name, slopes, n, slopes.shape[1])), cut, axis=0)
        seen = self.seen[name].take(touched, axis=0) + slope * slope
        self.seen[name][touched] = seen
        self.w[name][touched] -= RATE * slope / np.sqrt(seen)

    def step(self, ids: np.ndarray, around: np.ndarray) -> None:
        w, n, room = self.w, len(ids), self.room
        own, parts = _parts(w, ids)
        x, hidden, slope = _ahead(w, around, parts, room)
        cells = _below_tops(slope, room)
        np.exp(cells, out=cells)
        cells /= cells.sum(axis=1, keepdims=True)
        slope.reshape(-1)[own + np.arange(0, slope.size, slope.shape[1])[:, None]] -= 1
        slope /= np.float32(np.sqrt(n))
        inner = np.matmul(slope, w["outer"].T, out=room("inner", slope, n, HIDDEN))
        inner *= 1 - hidden * hidden
        back = np.matmul(inner, w["inner"].T, out=room("back", slope, n, x.shape[1])).reshape(-1, WIDTH)
        for columns, name, before in parts:
            part = room("part", slope, n, CLASSES)
            part[:] = slope[:, columns]
            if name == "member":
                member = np.zeros_like(w["member"])
                # One sum for each digit that comes in the batch; numpy's sums at given rows are far slower.
                for digit in np.flatnonzero(np.bincount(before)):
                    part[before == digit].sum(axis=0, out=member[digit])
                self._move("member", member)
            else:
                self._move_rows(name, before, part)
        self._move("outer", np.ascontiguousarray(hidden.T) @ slope)
        self._move("outer_bias", slope.sum(axis=0))
        self._move("inner", x.T @ inner)
        self._move("inner_bias", inner.sum(axis=0))
        self._move_rows("embed", around.ravel(), back)
        self.words += n


def _squeezed(values: np.ndarray) -> bytes:
    """Compressed whole numbers, all their lowest bytes first."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8")[:, 0]


def _sums(batches):
    """(block, sums) of rows sorted by block: how far each task moved the weights, times its words."""
    at, high, low = None, 0, 0

    def row():
        # Two halves of the words, so that no product or sum of whole numbers is too large.
        sums = high.astype(np.longdouble) * 65536 + low
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sums.astype(np.float64).tobytes()], pa.binary())], names=["block", "sums"])

    for batch in batches:
        for block, words, data in zip(*(batch.column(n).to_pylist() for n in ("block", "words", "moved"))):
            if block != at:
                if at is not None:
                    yield row()
                at, high, low = block, 0, 0
            moved = _unsqueezed(data)
            high, low = high + moved * (words >> 16), low + moved * (words & 0xFFFF)
    if at is not None:
        yield row()


def learn(docs: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights learned from all words of all documents; those of an empty table are the initial ones."""
    context, weights = docs.sparkSession.sparkContext, initial(ids=known.size)
    sizes = shapes(known.size)
    size = sum(int(np.prod(s)) for s in sizes.values())
    dictionary = context.broadcast(known)
    for number in range(rounds):
        start = context.broadcast(weights)

        def run(batches, number=number):
            learner, rest = Learner(start.value), []

            def steps(least: int) -> None:
                ids, around = (np.concatenate(x) for x in zip(*rest))
                full = len(ids) // least * least if least > 1 else len(ids)
                for s in range(0, full, BATCH):
                    learner.step(ids[s : min(s + BATCH, full)], around[s : min(s + BATCH, full)])
                rest[:] = [(ids[full:], around[full:])]

            done = np.uint64(0)
            for _, texts in chunks(batches):
                ids, counts = numbered(texts, dictionary.value)
                places = np.arange(len(ids), dtype=np.uint64) + done
                done += np.uint64(len(ids))
                masked = mixed(places) % np.uint64(rounds) == number
                if masked.any():
                    rest.append((ids[masked], windows(ids, counts, dictionary.value.size, masked)))
                    steps(BATCH)
            if rest and len(rest[0][0]):
                steps(1)
            if learner.words:
                flat = np.concatenate([(learner.w[k].astype(np.float64) - start.value[k]).ravel() for k in sizes])
                moved = np.r_[np.rint(flat * FRACTION).astype(np.int64), 1]
                # Blocks of weights that the task did not move need not be sent.
                for n, part in enumerate(np.split(moved, range(BLOCK, len(moved), BLOCK))):
                    if part.any():
                        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([learner.words]), pa.array([_squeezed(part)], pa.binary())], names=["block", "words", "moved"])

        rows = arrow_map(docs.select("text"), run, "block int, words long, moved binary")
        rows = rows.repartition("block").sortWithinPartitions("block")
        # One number for each weight comes back, whatever the number of documents.
        found = arrow_map(rows, _sums, "block int, sums binary").toArrow()
        start.unpersist()
        if not found.num_rows:
            break
        total = np.zeros(size + 1)
        for n, sums in zip(found["block"].to_pylist(), found["sums"].to_pylist()):
            total[n * BLOCK : (n + 1) * BLOCK] = np.frombuffer(sums)
        moved = total[:-1] / total[-1] / FRACTION
        ends = np.cumsum([int(np.prod(s)) for s in sizes.values()])
        weights = {k: (weights[k] + x.reshape(s)).astype(np.float32) for (k, s), x in zip(sizes.items(), np.split(moved, ends[:-1]))}
    return weights


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_probability, per_word), one row per document, over all words of its whole text.

    ``per_word`` is the mean, null for a text without words, whose sum is 0. Null texts are empty; null ids and
    repeated rows keep a row each; an empty table gives no rows; other columns are ignored.
    """
    known = vocabulary(docs)
    shared = docs.sparkSession.sparkContext.broadcast((known, learn(docs, known)))

    def run(batches):
        for batch, texts in chunks(batches):
            known, weights = shared.value
            ids, around, counts = examples(texts, known)
            sums = sums_by_text(log_probabilities(weights, ids, around) + known.spelled(texts, ids == RARE), counts)
            mean = pa.array(sums / np.maximum(counts, 1), mask=counts == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums), mean], names=["doc_id", "n_words", "log_probability", "per_word"]
            )

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_words long, log_probability double, per_word double")
