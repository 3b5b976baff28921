import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pricetrail.llm import huffman, tokens
from pricetrail.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, part string, ids string"


@pytest.mark.parametrize("case", ["one", "two", "many", "steep"])
def test_huffman_round_trip(case):
    rng = np.random.default_rng(0)
    counts = np.zeros(1 << 16, np.int64)
    if case == "steep":
        counts[:40] = 2 ** np.arange(40)  # without a limit the longest code would have 39 bits
    else:
        counts[rng.choice(1 << 16, {"one": 1, "two": 2, "many": 5000}[case], replace=False)] = rng.integers(1, 1000, {"one": 1, "two": 2, "many": 5000}[case])
    lengths = huffman.code_lengths(counts)
    used = np.flatnonzero(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= huffman.LIMIT
    assert (0.5 ** lengths[used].astype(float)).sum() <= 1
    ids = rng.choice(used, 3000).astype(np.uint16)
    codes, table = huffman.canonical(lengths), huffman.decoding_table(lengths)
    for n in (0, 1, 127, 128, 129, 3000):
        bits, offsets = huffman.pack(ids[:n], codes, lengths)
        assert (huffman.unpack(bits, offsets, n, table) == ids[:n]).all()
    block = huffman.write_block([5, None], np.array([1000, 2000]), ids, codes, lengths)
    doc_ids, sizes, back = huffman.read_block(block, table)
    assert doc_ids == [5, None] and sizes.tolist() == [1000, 2000] and (back == ids).all()


def test_lengths_are_optimal():
    import heapq

    counts = np.random.default_rng(2).integers(1, 500, 300)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        two = heapq.heappop(heap) + heapq.heappop(heap)
        cost += two
        heapq.heappush(heap, two)
    assert (huffman.code_lengths(counts) * counts).sum() == cost


def test_files_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 500)
    path = vocabulary("byte_bpe_50k.json")
    rng = random.Random(1)
    texts = ["".join(rng.choices(["the", " ", "  ", "\n", "\t", "'s", "'", "42", "é", " ", "\x1c", ".", "***", "漢"], k=rng.randint(0, 80))) for _ in range(200)]
    texts += [" lead", "trail ", " ", "\n ", "\n\n  x", "", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>y  <|endoftext",  "word " * 30_000, "it's they'll 'll"]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(7, "same id"), (None, "no id"), (5, None), (21, texts[3])]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], SCHEMA).repartition(5)
    tokenizer = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, tokens.END], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    got = tokens.coded(docs, path).orderBy("start").collect()
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]].tolist()
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_empty_table(spark):
    assert tokens.coded(spark.createDataFrame([], SCHEMA), vocabulary("byte_bpe_50k.json")).collect() == []


def test_parts_of_odd_texts_are_those_of_the_library():
    path, rng = vocabulary("byte_bpe_50k.json"), random.Random(3)
    encoder, tokenizer = tokens.Encoder(path, most=3000), Tokenizer.from_file(path)
    some = ["the", "  ", "'s", "'re", "'ll", "'v", " '", "42", "é", "ab" * 20, "\x1c", "\x85", " ", "漢", "٣", "é", "😀", "½", "ª", *map(chr, range(128))]
    for _ in range(100):
        texts = ["".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 40))]
        want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids.tolist() for ids in encoder.encode(texts)] == want


def test_many_distinct_parts_are_asked_once(monkeypatch):
    asked, merge = [], tokens.Encoder._merge
    monkeypatch.setattr(tokens.Encoder, "_merge", lambda self, parts: asked.append(len(parts)) or merge(self, parts))
    encoder = tokens.Encoder(vocabulary("byte_bpe_50k.json"))
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) + "qx"[n % 2] for n in range(450_000)] + ["zz" + "".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(200_000)]
    texts = [" ".join(words[i : i + 50_000]) for i in range(0, len(words), 50_000)]
    first = [encoder.encode([t])[0] for t in texts][0]
    distinct = len({(" " if i % 50_000 else "") + w for i, w in enumerate(words)})
    assert sum(asked) == distinct > 600_000
    assert (encoder.encode([texts[0]])[0] == first).all() and sum(asked) == distinct
