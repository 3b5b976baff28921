"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum,
over all its segmentations into pieces, of the product of the pieces' probabilities (a forward algorithm); a text's
is the product over its words. Piece probabilities are learned by expectation-maximisation over all segmentations.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import arrow_map, chunks, held_out, stored
from pricetrail.llm.pieces import Grown, Vocabulary, by_length, character_lengths, matrix, walk

#: Bound of the fitting sample, in documents of each language.
MOST_OF_A_LANGUAGE = 1_500
FOLDS, FOLD = 4, 2
ROUNDS = 2
UNKNOWN = 1e-7
#: Sums are scaled at every so many bytes, so that long words don't underflow.
RESCALE = 16
#: Letters, and numbers that are no digits (as ½ or Ⅷ): those are cut out afterwards, for few runs hold any.
LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: bytes) -> list[bytes]:
    """Lower-case runs of letters, each after a word-start mark (a space here)."""
    runs = LETTERS.findall(text.decode().lower())
    if not all(map(str.isalpha, runs)):
        runs = [part for w in runs for part in ("".join(c if c.isalpha() else " " for c in w).split() if not w.isalpha() else (w,))]
    return [b" " + w.encode() for w in runs]


def forward(vocabulary: Vocabulary, words: list[bytes], shares: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations: (words, languages).

    A character without a piece of its own may also be passed over at a small fixed probability.
    """
    out = np.zeros((len(words), shares.shape[1]))
    for places in by_length(words):
        grid, lengths = matrix([words[i] for i in places])
        n, width = grid.shape
        sums = np.zeros((width + vocabulary.longest + 1, n, shares.shape[1]))
        sums[0] = 1
        logs = np.zeros((n, shares.shape[1]))
        for s in range(width):
            if s and s % RESCALE == 0:
                top = sums[s : s + vocabulary.longest].max(axis=0)
                top[(top == 0) | (lengths <= s)[:, None]] = 1
                sums[s : s + vocabulary.longest] /= top
                logs += np.log(top)
            for _, ends, rows, share in _steps(vocabulary, grid, lengths, s, shares):
                sums[ends, rows] += sums[s, rows] * share
            at = np.flatnonzero(lengths == s + 1)
            out[places[at]] = np.log(np.maximum(sums[s + 1, at], 1e-300)) + logs[at]
    return out


def _steps(vocabulary, grid, lengths, s, shares):
    """(piece ids or None, end, rows, probabilities) of what may be taken at byte ``s``."""
    whole = np.zeros(len(lengths), bool)
    char = character_lengths(grid[:, s])
    for length, rows, found in walk(vocabulary.trie, grid, lengths, s, vocabulary.longest):
        whole[rows] |= char[rows] == length
        yield found, s + length, rows, shares[found]
    rows = np.flatnonzero(~whole & (lengths > s))
    if len(rows):
        yield None, np.minimum(s + char[rows], lengths[rows]), rows, np.full((len(rows), shares.shape[1]), UNKNOWN)


def expected_pieces(vocabulary: Vocabulary, words: list[bytes], counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, over all segmentations (forward and backward sums)."""
    out = np.zeros(len(share))
    column = share[:, None]
    for places in by_length(words, 1 << 16):
        grid, lengths = matrix([words[i] for i in places])
        n, width = grid.shape
        # Forward sums are divided by ``tops`` at some places, so that long words don't underflow; a step over such a
        # place loses that factor. Backward sums carry the inverse, so that the products of the two need no scaling.
        ahead, back, steps, tops = np.zeros((width + vocabulary.longest + 1, n)), np.zeros((width + 1, n)), [], {}
        ahead[0] = 1
        for s in range(width):
            if s and s % RESCALE == 0:
                top = ahead[s : s + vocabulary.longest].max(axis=0)
                top[(top == 0) | (lengths <= s)] = 1
                ahead[s : s + vocabulary.longest] /= top
                tops[s] = top
            for found, ends, rows, p in _steps(vocabulary, grid, lengths, s, column):
                ahead[ends, rows] += ahead[s, rows] * p[:, 0]
                steps.append((s, found, ends, rows, p[:, 0]))
        back[lengths, np.arange(n)] = counts[places] / np.maximum(ahead[lengths, np.arange(n)], 1e-300)
        for s, found, ends, rows, p in reversed(steps):
            later = p * back[ends, rows]
            for at in range((s // RESCALE + 1) * RESCALE, int(np.max(ends)) + 1, RESCALE):
                if at in tops:
                    later = np.where(ends >= at, later / tops[at][rows], later)
            back[s, rows] += later
            if found is not None:
                out += np.bincount(found, ahead[s, rows] * later, minlength=len(out))
    return out


def learn(docs: DataFrame, vocabulary: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log shares of documents, piece probabilities): from a bounded sample of each language's learning rows."""
    spark = docs.sparkSession
    rows = docs.filter(~held_out(FOLDS, FOLD) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros(0), np.zeros((len(vocabulary.scores), 0))
    part = F.create_map(*(F.lit(x) for k in languages for x in (k, int(min(1, MOST_OF_A_LANGUAGE / sizes[k]) * 1_000_000))))
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < part[F.col("lang")])

    def count(batches):
        from collections import Counter

        for batch, texts in chunks(batches):
            found = Counter((k, w) for k, t in zip(batch.column("lang").to_pylist(), texts) for w in letters(t))
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys]), pa.array([w for _, w in keys], pa.binary()), pa.array(list(found.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    words = arrow_map(drawn, count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(words, "langid-words")
    shared = spark.sparkContext.broadcast(vocabulary)
    start = np.where(np.isfinite(vocabulary.scores), np.exp(vocabulary.scores), 0)
    shares = np.repeat(start[:, None], len(languages), axis=1)
    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(shares)

        def expect(batches):
            for batch in batches:
                lang = np.array(batch.column("lang").to_pylist(), object)
                word = np.array(batch.column("word").to_pylist(), object)
                n = batch.column("n").to_numpy().astype(float)
                for i, k in enumerate(languages):
                    at = np.flatnonzero(lang == k)
                    if len(at):
                        found = expected_pieces(shared.value, list(word[at]), n[at], now.value[:, i])
                        hit = np.flatnonzero(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(hit), i, np.int32)), pa.array(hit.astype(np.int32)), pa.array(found[hit])], names=["lang", "piece", "n"]
                        )

        sums = arrow_map(words, expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        # One number for each language and piece of the vocabulary comes back.
        total = np.zeros_like(shares)
        total[sums["piece"].to_numpy(), sums["lang"].to_numpy()] = sums["n"].to_numpy()
        smooth = total.round(6) + 0.5 * np.isfinite(vocabulary.scores)[:, None]
        shares = smooth / smooth.sum(axis=0)
    log = np.log(np.array([sizes[k] for k in languages]) / sum(sizes.values()))
    return languages, log, shares


def identify(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per document; every whole text counts.

    ``score`` is the posterior of the predicted language. A null text or one without a letter is ``und`` with score 0;
    so is every text where no language could be learned. Null ids are held out; an empty table gives no rows.
    """
    vocabulary = Vocabulary(path)
    languages, log, shares = learn(docs, vocabulary)
    context = docs.sparkSession.sparkContext
    shared, model = context.broadcast(vocabulary), context.broadcast((log, shares))

    def run(batches):
        log, shares = model.value
        known = Grown(lambda words: [forward(shared.value, words, shares)])
        for batch, texts in chunks(batches, limit=4 << 20):
            split = [letters(t) if languages else [] for t in texts]
            counts = np.array([len(x) for x in split], np.int64)
            codes = known.codes([w for x in split for w in x])
            total = np.zeros((len(texts), max(1, len(languages))))
            if len(codes):
                # By running sums of whole chunks, so that no array of words times languages is held twice.
                total = np.add.reduceat(np.vstack([known.parts[0][codes], np.zeros((1, len(languages)))]), np.minimum(np.cumsum(counts) - counts, len(codes)))
            total[counts == 0] = 0
            total = total + (log if len(languages) else 0)
            best = total.argmax(axis=1)
            weight = np.exp(total - total.max(axis=1, keepdims=True))
            score = np.where(counts > 0, 1 / weight.sum(axis=1), 0.0)
            names = [languages[b] if c else "und" for b, c in zip(best.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    found = arrow_map(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "lang_pred", "score")
