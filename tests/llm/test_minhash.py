import hashlib
import random

import numpy as np

from pricetrail.llm import minhash

SCHEMA = "doc_id long, text string, fingerprint string, _key string"


def runs(text):
    words = [None] * 4 + (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(1)
    words = [f"w{i}é" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 5, 30, 300]))) for _ in range(120)]
    texts += ["", None, " \n", "x" * 300_000, texts[5], texts[5], "a " * 40_000]
    ids = list(range(0, 3 * len(texts), 3))
    ids[7] = None
    return list(zip(ids, texts))


def test_fingerprints_against_sets(spark):
    rows = corpus() + [(30, "same id, other text"), (33, "twice"), (33, "twice")]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], SCHEMA).repartition(5)
    got = minhash.fingerprints(docs).collect()
    assert len(got) == len(rows)
    single = {i: t or "" for i, t in rows if [x for x, _ in rows].count(i) == 1}
    order = sorted(single, key=lambda i: (i is None, -(i or 0)))
    by_id = {r.doc_id: r for r in got if r.doc_id in single}
    errors = []
    for i, nxt in zip(order, order[1:] + order[:1]):
        if {30, 33} & {i, nxt} or nxt is not None and i is not None and any(nxt < x < i for x in (30, 33)):
            continue
        t, f = single[i], single[nxt]
        n = len(t) // 3
        changed = t[: len(t) - n] + f[:n]
        r = by_id[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        errors += [r.near_edited - jaccard(runs(t), runs(changed)), r.near_next - jaccard(runs(t), runs(f))]
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.02
    assert by_id[15].fingerprint == by_id[372].fingerprint == by_id[375].fingerprint
    assert len({r.fingerprint for r in got if r.n_chars < 3 and not r.n_chars}) == 1


def test_one_document_follows_itself(spark):
    r = minhash.fingerprints(spark.createDataFrame([(1, "a b c d e f", "", "")], SCHEMA)).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()


def test_empty_table(spark):
    assert minhash.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_near_duplicates(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(6):
        base = rng.choices(words, k=200)
        for copy in range(5):
            changed = list(base)
            changed[10 * copy] = "new"
            rows.append((group * 10 + copy, " ".join(changed if copy else base), "", ""))
    rows += [(100, "", "", ""), (101, None, "", ""), (102, "one two", "", ""), (103, "one  two", "", "")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: 100 if i in (100, 101) else 102 if i > 101 else i // 10 * 10 for i, *_ in rows}


def test_links_between_texts_of_one_template_are_not_lost(spark):
    rng = random.Random(4)
    fresh = iter(f"u{i}" for i in range(10**6))
    template = [next(fresh) for _ in range(260)]
    own = lambda n: [next(fresh) for _ in range(n)]
    # Two texts of the template have 256 of 328 shingles in common, pairs 276 of 308 or so.
    rows = [(i, template + own(36)) for i in range(150)]
    for i in range(60):
        tail = own(36)
        rows += [(1000 + 2 * i, template + tail), (1001 + 2 * i, template + tail[:20] + own(16))]
    rng.shuffle(rows)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in rows}
    near = [(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.8]
    assert {(1000 + 2 * i, 1001 + 2 * i) for i in range(60)} == set(near)
    docs = spark.createDataFrame([(i, " ".join(w), "", "") for i, w in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: i - 1 if i > 1000 and i % 2 else i for i in sets}


def test_few_words_alone(spark):
    """The last text of a list is hashed again by itself: its fingerprint is the one it has among others."""
    texts = [" ".join("abcdefg"[:n]).encode() for n in range(8)]
    for fill in (True, False):
        together = minhash.signatures(texts, fill)
        for text, row in zip(texts, together):
            assert (minhash.signatures([text], fill) == row).all()
            assert (minhash.signatures([b"", text, b" "], fill)[1] == row).all()
    for size in range(1, 7):
        for n in range(8):
            assert minhash.shingles([texts[n]], size)[1].tolist() == [n]
    for rows in ([(1, "two words")], [(2, "three short words"), (1, "a b")], [(3, "x"), (2, None), (1, "a b c")]):
        got = minhash.fingerprints(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect()
        by_id = {r.doc_id: r for r in got}
        for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
            n = len(t or "") // 3
            changed = (t or "")[: len(t or "") - n] + (nxt or "")[:n]
            assert by_id[i].fingerprint == minhash.signatures([(t or "").encode()])[0].tobytes().hex()
            assert by_id[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
