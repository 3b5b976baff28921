import random
import zlib

import numpy as np

from pricetrail.llm import quality

SCHEMA = "doc_id long, text string, score string, kind string"


def corpus(n=4000):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 120))]
        good = rng.random() < 0.8
        text = " ".join(words) + "." if good else " ".join(w + rng.choice(["***", "$$$"]) for w in words)
        rows.append((i, text, "c", "c"))
        if rng.random() < 0.5:
            labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(None, rows[0][1], "", ""), (None, None, "", ""), (9000, "", "", ""), (9001, "w " * 100_000, "", ""), (3, rows[3][1], "", "")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    marked = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None), labels[0]], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, marked).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 9000}
    hit = [by_id[i].predicted == q for i, q, _ in labels if by_id[i].held_out]
    assert np.mean(hit) > 0.97
    assert quality.classify(docs.limit(0), marked).collect() == []
    assert {r.score for r in quality.classify(docs.limit(9), marked.limit(0)).collect()} == {0.5}


def test_class_prior():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4000)
    unlabelled = np.r_[rng.normal(2, 1, 7000), rng.normal(-2, 1, 3000)]
    assert 0.6 < quality.class_prior(positive, unlabelled) <= 0.72


def test_whole_texts_count():
    a, b = quality.features([b"word " * 50_000, b"word " * 50_000 + b"*** " * 50_000])
    assert np.abs(a - b).max() > 0.1
