"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, marker decoding."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pricetrail.llm.common import arrow_map, chunks
from pricetrail.llm.pieces import Grown, Vocabulary, by_length, character_lengths, matrix, walk

#: No piece crosses a word's start or a line's end, so these parts are encoded one by one, equal ones once.
PARTS = re.compile(rb" *[^ \n]+| +|\n")


def viterbi(vocabulary: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """[number of pieces by word, score by word] and all piece ids in order, for distinct words.

    The best path maximises the sum of log scores; of equal paths to a place the one with the earlier last start
    wins. A character without a piece of its own may be taken as its bytes.
    """
    counts, scores, ids = np.zeros(len(words), np.int64), np.zeros(len(words)), [None] * len(words)
    for places in by_length(words):
        group = [words[i] for i in places]
        grid, lengths = matrix(group)
        n, width = grid.shape
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        piece, came = np.full((width + 1, n), -1, np.int32), np.zeros((width + 1, n), np.int32)
        for s in range(width):
            if s and not np.isfinite(best[s]).any():
                continue
            whole = np.zeros(n, bool)
            char = character_lengths(grid[:, s])
            for length, rows, found in walk(vocabulary.trie, grid, lengths, s, vocabulary.longest):
                whole[rows] |= char[rows] == length
                value = best[s, rows] + vocabulary.scores[found]
                better = value > best[s + length, rows]
                rows, found, value = rows[better], found[better], value[better]
                best[s + length, rows], piece[s + length, rows], came[s + length, rows] = value, found, s
            rows = np.flatnonzero(~whole & (lengths > s) & np.isfinite(best[s]))
            ends = np.minimum(s + char[rows], lengths[rows])
            value = best[s, rows] + vocabulary.unknown
            better = value > best[ends, rows]
            rows, ends, value = rows[better], ends[better], value[better]
            best[ends, rows], piece[ends, rows], came[ends, rows] = value, -1, s
        scores[places] = best[lengths, np.arange(n)]
        # All words are followed back at once; what is unknown becomes one id for each byte.
        at, rows, steps = lengths.copy(), np.arange(n), []
        while len(rows):
            got, start = piece[at, rows], came[at, rows]
            known = got >= 0
            steps.append((rows[known], start[known], got[known]))
            odd = np.flatnonzero(~known)
            for k in range(int((at[odd] - start[odd]).max()) if len(odd) else 0):
                more = odd[at[odd] - start[odd] > k]
                steps.append((rows[more], start[more] + k, vocabulary.bytes_at + grid[rows[more], start[more] + k].astype(np.int32)))
            at = start.astype(np.int64)
            rows, at = rows[at > 0], at[at > 0]
        row, start, got = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((start, row))
        number = np.bincount(row, minlength=n)
        counts[places] = number
        for i, part in zip(places.tolist(), np.split(got[order].astype(np.int32), np.cumsum(number)[:-1])):
            ids[i] = part
    return [counts, scores, np.concatenate(ids) if ids else np.zeros(0, np.int32)]


#: Distinct parts that an encoder keeps. The pipeline's workers are there beside a heap that earlier stages have grown.
MOST_PARTS = 150_000


class Encoder:
    """Whole texts to piece ids; parts seen before are not searched again."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.parts = Grown(lambda words: viterbi(vocabulary, words), MOST_PARTS)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids by text, score by text). A text gets a leading space; an empty
        text has no ids."""
        split = [PARTS.findall(b" " + t) if t else [] for t in texts]
        held = np.array([len(x) for x in split], np.int64)
        codes = self.parts.codes([w for x in split for w in x])
        if not len(codes):
            return np.zeros(0, np.int32), held, np.zeros(len(texts))
        number, score, flat = self.parts.parts
        starts = np.cumsum(number) - number
        many = number[codes]
        out = flat[np.repeat(starts[codes] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        ends = np.r_[0, np.cumsum(held)]
        run, sums = np.r_[0, np.cumsum(many)], np.r_[0, np.cumsum(score[codes])]
        return out, np.diff(run[ends]), np.diff(sums[ends])


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of piece ids: markers become spaces, byte pieces their bytes, the leading space goes."""
    surface = vocabulary.surface
    return b"".join([surface[i] for i in ids.tolist()])[1:]


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, score, ids_crc32, decoded_sha256, exact[, ids]), one row per document.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` over the text decoded
    from them, ``exact`` says that it is the input. Null texts are empty: no ids. Null ids and repeated rows keep a
    row each; an empty table gives no rows; other columns are ignored. Texts are cut only between rows, whole texts
    are encoded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches):
        vocabulary = shared.value
        encoder = Encoder(vocabulary)
        for batch, texts in chunks(batches):
            ids, number, score = encoder.encode(texts)
            parts = np.split(ids, np.cumsum(number)[:-1])
            back = [decode(vocabulary, p) for p in parts]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_pieces": pa.array(number, pa.int64()),
                "score": pa.array(score),
                "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                "decoded_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                "exact": pa.array([b == t for b, t in zip(back, texts)]),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(np.r_[0, np.cumsum(number)].astype(np.int32), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, n_pieces long, score double, ids_crc32 long, decoded_sha256 string, exact boolean"
    return arrow_map(docs.select("doc_id", "text"), run, schema + ", ids array<int>" * with_ids)
