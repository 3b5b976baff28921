"""Pieces of a fixed public vocabulary in a double-array trie, walked for many words at once in numpy."""

from collections.abc import Iterator
from itertools import islice

import numpy as np

#: The white-space marker of piece vocabularies; inside this module it is the plain space.
MARKER = "▁"


class Trie:
    """Double array: from state ``s`` byte ``b`` leads to ``base[s] + b`` if ``check`` there is ``s``."""

    def __init__(self, keys: dict[bytes, int]):
        """Keys to values (0 or more). Children are placed at the first free base, node by node in breadth order."""
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys.items():
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][b]
            values[node] = value
        room = 2 * len(children) + 4096
        base, check, value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
        check[0] = 0
        free = np.ones(room, bool)
        free[0] = False
        level, low = [(0, 0)], 1
        while level:
            following = []
            for node, at in level:
                value[at] = values[node]
                marks = np.array(sorted(children[node]), np.int64)
                if not len(marks):
                    continue
                while not free[low]:
                    low += 1
                start = max(1, low - int(marks[0]))
                while True:
                    if start + 4352 > len(free):
                        grow = len(free)
                        base, check, value = (np.r_[x, np.full(grow, f, np.int32)] for x, f in ((base, 0), (check, -1), (value, -1)))
                        free = np.r_[free, np.ones(grow, bool)]
                    window = np.ones(4096, bool)
                    for b in marks:
                        window &= free[start + b : start + b + 4096]
                    hit = int(window.argmax())
                    if window[hit]:
                        start += hit
                        break
                    start += 4096
                base[at] = start
                for b in marks.tolist():
                    check[start + b] = at
                    free[start + b] = False
                    following.append((children[node][b], start + b))
            level = following
        used = int(np.flatnonzero(~free)[-1]) + 257
        self.base, self.check, self.value = (np.r_[x[:used], np.full(max(0, used - len(x)), f, np.int32)] for x, f in ((base, 0), (check, -1), (value, -1)))

    def get(self, key: bytes) -> int:
        state = 0
        for b in key:
            state, last = int(self.base[state]) + b, state
            if self.check[state] != last:
                return -1
        return int(self.value[state])


class Vocabulary:
    """Pieces, their log scores and the trie; read once on the driver and broadcast (its size is the file's)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.bytes_at = min(i for i in range(n) if model.is_byte(i))
        if [names[self.bytes_at + b] for b in range(256)] != [f"<0x{b:02X}>" for b in range(256)]:
            raise ValueError("the vocabulary has no run of 256 byte pieces")
        texts = {i: names[i].replace(MARKER, " ") for i in plain}
        if any("\n" in t or " " in t.lstrip(" ") for t in texts.values()):
            raise ValueError("a piece crosses a word's start or a line's end")
        self.surface = [b""] * n
        for i, t in texts.items():
            self.surface[i] = t.encode()
        for b in range(256):
            self.surface[self.bytes_at + b] = bytes([b])
        # The file orders pieces by how common they are; by Zipf's law a piece's share falls with its place.
        rank = {i: r for r, i in enumerate(plain)}
        total = np.log((1 / np.arange(1, len(plain) + 1)).sum())
        self.scores = np.full(n, -np.inf)
        self.scores[plain] = [-np.log(rank[i] + 1) - total for i in plain]
        #: A character in no piece costs ten more than the rarest piece and becomes its bytes.
        self.unknown = float(self.scores[plain].min() - 10)
        self.trie = Trie({self.surface[i]: i for i in plain})
        self.longest = max(len(self.surface[i]) for i in plain)


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes, and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(lengths.max())), np.uint8)
    data = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), lengths)
    out[row, np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = data
    return out, lengths


def by_length(words: list[bytes], cells: int = 1 << 19) -> Iterator[np.ndarray]:
    """Places of the words in groups of like length, so that a group's matrix has few empty cells and a bounded size."""
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        least = int(lengths[order[start]])
        end = int(np.searchsorted(lengths[order], max(least + 2, least * 5 // 4), side="right"))
        widest = max(1, int(lengths[order[end - 1]]))
        end = min(end, start + max(1, cells // widest))
        yield order[start:end]
        start = end


def character_lengths(grid: np.ndarray) -> np.ndarray:
    """Length of the UTF-8 character that starts at each byte."""
    return np.where(grid < 0xC0, 1, np.where(grid < 0xE0, 2, np.where(grid < 0xF0, 3, 4)))


def walk(trie: Trie, grid: np.ndarray, lengths: np.ndarray, start: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, piece ids) of all pieces that start at byte ``start`` of the rows, shortest first."""
    rows = np.flatnonzero(lengths > start)
    state = np.zeros(len(rows), np.int32)
    for length in range(1, min(longest, grid.shape[1] - start) + 1):
        following = trie.base[state] + grid[rows, start + length - 1]
        ok = (trie.check[following] == state) & (lengths[rows] >= start + length)
        rows, state = rows[ok], following[ok]
        if not len(rows):
            return
        found = trie.value[state]
        hit = found >= 0
        if hit.all():
            yield length, rows, found
        elif hit.any():
            yield length, rows[hit], found[hit]


class _Places(dict):
    """Keys to their places in first-seen order."""

    def __missing__(self, key):
        place = self[key] = len(self)
        return place


class Grown:
    """Values of words in first-seen order, each computed once; forgotten when they grow beyond a bound."""

    def __init__(self, compute, most: int = 400_000):
        self.compute, self.most, self.index, self.parts = compute, most, _Places(), None

    def codes(self, words: list) -> np.ndarray:
        """Places of the words in the values, which may have grown by then."""
        if len(self.index) > self.most:
            self.index, self.parts = _Places(), None
        known = len(self.index)
        out = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > known:
            new = self.compute(list(islice(self.index, known, None)))
            self.parts = new if self.parts is None else [np.concatenate(x) for x in zip(self.parts, new)]
        return out
