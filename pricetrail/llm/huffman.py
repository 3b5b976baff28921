"""Canonical length-limited Huffman codes, and blocks of token ids coded with them."""

import struct

import numpy as np

LIMIT = 18
#: A bit offset is kept for every so many ids; decoding runs from all of them at once.
EVERY = 128
MAGIC = b"HID1"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Length of each symbol's code, 0 for those that don't occur: optimal under the limit (package-merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    items = counts[used].astype(np.int64)
    level, kinds = items, [np.ones(len(items), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.r_[items, pairs]
        order = np.argsort(both, kind="stable")
        level = both[order]
        kinds.append(order < len(items))
    take, lengths = 2 * len(items) - 2, np.zeros(len(items), np.int64)
    for is_item in reversed(kinds):
        single = int(is_item[:take].sum())
        lengths[:single] += 1
        take = 2 * (take - single)
    out[used] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol): the lengths alone rebuild them."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        longest = int(lengths.max())
        # In units of the longest code, each code starts where the one before it ends.
        steps = np.uint64(1) << (longest - lengths[order]).astype(np.uint64)
        starts = np.cumsum(steps, dtype=np.uint64) - steps
        codes[order] = starts >> (longest - lengths[order]).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, lengths, bits): what the next ``bits`` bits begin with."""
    bits = max(1, int(lengths.max())) if len(lengths) else 1
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (bits - lengths[order].astype(np.int64))
    symbols, sizes = np.zeros(1 << bits, np.uint16), np.ones(1 << bits, np.uint8)
    symbols[: spans.sum()] = np.repeat(order, spans)
    sizes[: spans.sum()] = np.repeat(lengths[order], spans)
    return symbols, sizes, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits in 32-bit big-endian words, bit offset of every EVERY-th id)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    out = np.zeros(int(ends[-1] >> 5) + 3 if len(ids) else 2, np.uint64)
    if len(ids):
        word = at >> 5
        wide = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
        firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        # The codes' bits don't overlap, so sums join them.
        out[word[firsts]] += np.add.reduceat(wide >> np.uint64(32), firsts)
        out[word[firsts] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), firsts)
    return out.astype(">u4").tobytes(), at[::EVERY].astype(np.uint32)


def unpack(bits: bytes, offsets: np.ndarray, number: int, table: tuple) -> np.ndarray:
    """The ids back: all checkpoints' runs are decoded side by side."""
    symbols, sizes, width = table
    words = np.frombuffer(bits, ">u4").astype(np.uint64)
    at = offsets.astype(np.int64)
    out = np.zeros((EVERY, len(at)), np.uint16)
    last = len(words) - 2
    for step in range(min(EVERY, number)):
        word = np.minimum(at >> 5, last)
        window = (words[word] << np.uint64(32)) | words[word + 1]
        key = (window << (at & 31).astype(np.uint64)) >> np.uint64(64 - width)
        out[step] = symbols[key]
        at += sizes[key]
    return out.T.reshape(-1)[:number]


def write_block(doc_ids: list, counts: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """One independent block: header, document ids with a null mask, ids per document, checkpoints, bits."""
    bits, offsets = pack(ids, codes, lengths)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    return b"".join(
        [
            MAGIC,
            struct.pack("<III", len(doc_ids), len(ids), len(offsets)),
            np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
            known.tobytes(),
            counts.astype("<u4").tobytes(),
            offsets.astype("<u4").tobytes(),
            bits,
        ]
    )


def read_block(block: bytes, table: tuple) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, ids per document, ids) of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of coded ids")
    docs, number, marks = struct.unpack_from("<III", block, 4)
    at = 16
    doc_ids = np.frombuffer(block, "<i8", docs, at)
    known = np.frombuffer(block, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(block, "<u4", docs, at + 9 * docs)
    offsets = np.frombuffer(block, "<u4", marks, at + 13 * docs)
    ids = unpack(block[at + 13 * docs + 4 * marks :], offsets, number, table)
    return [int(i) if k else None for i, k in zip(doc_ids, known)], counts.astype(np.int64), ids
