import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from pricetrail.llm import langid, sentencepieces
from pricetrail.llm.pieces import Trie, Vocabulary
from pricetrail.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, score string, ids string"
TEXTS = [
    "Hello  world,\tfoo\nbar ", " leading", "", "ñandú Ωmega 漢字 \U0001f600 end", "a▁b ▁", "\n\n x", "     ", "x" * 3000, "é",
    "The quick brown fox. " * 40, "internationalization un-believable 12345 <s> </s> <0x41>", "tab\there\r\nline\x0b",
]


@pytest.fixture(scope="module")
def path():
    return vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def known(path):
    return Vocabulary(path)


def test_trie():
    rng = random.Random(1)
    keys = {bytes(rng.choices(b"abc\xff\x00", k=rng.randint(1, 6))): i for i in range(500)}
    trie = Trie(keys)
    assert all(trie.get(k) == v for k, v in keys.items())
    assert all(trie.get(bytes(x)) == keys.get(bytes(x), -1) for n in (1, 2, 3, 4) for x in itertools.product(b"abc\xff\x00z", repeat=n))


def library(path, known):
    """The sentencepiece library's own unigram search over the same pieces and scores."""
    model_pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    proto = model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        p.score = known.scores[i] if np.isfinite(known.scores[i]) else 0
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def total(known, ids):
    """Sum of log scores; a run of byte pieces that make up a character costs one unknown."""
    ids = np.array(ids)
    raw = (ids >= known.bytes_at) & (ids < known.bytes_at + 256)
    lead = raw & ~((ids - known.bytes_at >= 0x80) & (ids - known.bytes_at < 0xC0))
    return known.scores[ids[~raw]].sum() + lead.sum() * known.unknown


def test_best_path_against_library(path, known):
    model = library(path, known)
    texts = [t for t in TEXTS if t and "▁" not in t]
    ids, number, scores = sentencepieces.Encoder(known).encode([t.encode() for t in texts])
    for t, mine, score in zip(texts, np.split(ids, np.cumsum(number)[:-1]), scores):
        theirs = model.encode(t)
        assert score == pytest.approx(total(known, mine)) and score == pytest.approx(total(known, theirs), rel=1e-5), t
        assert model.decode(mine.tolist()) == t


def test_encoded(spark, path, known):
    rows = [(i, t, "", "c", "c") for i, t in enumerate(TEXTS)] + [(None, None, None, None, None), (0, TEXTS[0], "", "", "")]
    got = sentencepieces.encoded(spark.createDataFrame(rows, SCHEMA), path, with_ids=True).collect()
    assert len(got) == len(rows) and all(r.exact for r in got)
    for r in got:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "").encode()
        assert r.decoded_sha256 == hashlib.sha256(text).hexdigest() and r.n_pieces == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert sentencepieces.decode(known, np.array(r.ids, int)) == text
    assert sentencepieces.encoded(spark.createDataFrame([], SCHEMA), path).collect() == []


def test_forward_sums_all_segmentations(known):
    rng = np.random.default_rng(0)
    shares = np.where(np.isfinite(known.scores), rng.random(len(known.scores)), 0)[:, None] * np.array([[1.0, 0.5]])
    words = [b" the", b" wort", " ñé".encode(), " \U0001f600a".encode(), b" thetheththe" * 12]

    def brute(word, column):
        sums = [1.0] + [0.0] * len(word)
        for s in range(len(word)):
            if sums[s] == 0:
                continue
            char = len(word[s:].decode()[0].encode())
            for e in range(s + 1, len(word) + 1):
                i = known.trie.get(word[s:e])
                if i >= 0:
                    sums[e] += sums[s] * shares[i, column]
            if known.trie.get(word[s : s + char]) < 0:
                sums[s + char] += sums[s] * langid.UNKNOWN
        return np.log(sums[-1])

    got = langid.forward(known, words, shares)
    assert got == pytest.approx(np.array([[brute(w, c) for c in (0, 1)] for w in words]))


def test_expected_pieces_are_the_gradient(known):
    share = np.where(np.isfinite(known.scores), np.exp(known.scores), 0)
    # The last word is long enough for several rescalings, and its plain sums underflow.
    words, counts = [b" the", b" then", b" " + b"then\xc3\xa9qth" * 120], np.array([2.0, 3.0, 4.0])
    got = langid.expected_pieces(known, words, counts, share)
    for piece in (known.trie.get(b" the"), known.trie.get(b"th"), known.trie.get(b"n")):
        moved = []
        for sign in (1, -1):
            other = share.copy()
            other[piece] *= 1 + sign * 1e-5
            moved.append((langid.forward(known, words, other[:, None])[:, 0] * counts).sum())
        assert got[piece] == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=1e-3, abs=1e-9)


def test_identify(spark, path):
    rng = random.Random(3)
    bags = {"aa": ["the", "and", "with", "house"], "bb": ["der", "und", "mit", "haus"], "cc": ["maison", "avec", "été"]}
    rows = [(i, " ".join(rng.choices(bags[k], k=30)), k, "", "") for i, k in enumerate(rng.choices(list(bags), k=300))]
    odd = [(1000, None, "aa", "", ""), (1001, "12 !", "aa", "", ""), (1003, "½ ² ① Ⅷ", "aa", "", ""), (None, "der und", None, "", ""), (1002, "the " * 80_000, None, "", ""), (0, *rows[0][1:])]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    got = langid.identify(docs, path).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: k for i, _, k, *_ in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]) == 1
    by_id = {r.doc_id: (r.lang_pred, r.held_out) for r in got}
    assert by_id[1000][0] == by_id[1001][0] == by_id[1003][0] == "und" and by_id[None] == ("bb", True) and by_id[1002][0] == "aa"
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert langid.identify(docs.limit(0), path).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("doc_id < 0"), path).collect()} == set()
