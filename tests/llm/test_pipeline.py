"""The pipeline against a plain version of each stage, on each stage's own input."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pricetrail.llm import quality, stages
from tests_llm_plain import hash_of, plain_classes, plain_times

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _score string, size string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeéßfgh", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(7)
    passage = words(rng, 70)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.85
        text = words(rng, rng.randint(40, 150))
        if i % 40 == 0:
            text += "\n" + passage + "\n" + words(rng, 20)
        if not good:
            text = " ".join(w + rng.choice(["***", "$$$"]) for w in text.split())
        rows.append((i, text))
        if rng.random() < 0.6:
            labels.append((i, int(good), 0))
    rows += [(1000 + i, rows[i][1]) for i in range(30)] + [(3, rows[3][1]), (5, "other text with an id used twice"), (None, rows[9][1]), (None, None)]
    rows += [(2000, ""), (2001, None), (2002, "long " * 20_000)]
    rows = [(i, t, "en", None if n % 50 == 0 else f"s{n % 3}", None if t is None else len(t), "x", "y") for n, (i, t) in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def key(row):
    return (row["doc_id"] is None, row["doc_id"] or 0, row["text"] or "")


def test_stages(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    names = docs.columns
    before = docs.collect()

    kept = stages.quality(spark, docs, made)
    assert kept.columns == names
    model = quality.learn(docs, spark.read.parquet(f"{made}/labels.parquet"))
    score = quality.predict(model, quality.features([(r.text or "").encode() for r in before]))
    rows = kept.collect()
    assert sorted(map(key, rows)) == sorted(key(r) for r, s in zip(before, score) if s >= stages.LEAST_QUALITY)
    good = [r for r in before if r.text and "***" not in r.text and "$$$" not in r.text and r.doc_id is not None and r.doc_id < 1000]
    assert len({key(r) for r in good} & {key(r) for r in rows}) >= 0.97 * len({key(r) for r in good})

    docs = spark.createDataFrame(rows, docs.schema)
    kept = stages.near_copies(spark, docs, made)
    assert kept.columns == names
    classes = plain_classes([(r.doc_id, r.text) for r in rows])
    got = kept.collect()
    assert len(got) == len(set(classes))
    by_class = {}
    for r, c in zip(rows, classes):
        by_class.setdefault(c, []).append(r)
    assert {key(r) for r in got} <= {key(r) for r in rows}
    for members in by_class.values():
        least = min((r.doc_id is None, r.doc_id or 0) for r in members)
        assert sum((r.doc_id is None, r.doc_id or 0) == least and any(key(r) == key(m) for m in members) for r in got) >= 1

    rows, docs = got, spark.createDataFrame(got, docs.schema)
    kept = stages.repeated_passages(spark, docs, made)
    assert kept.columns == names
    texts = [(r.text or "").encode() for r in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out, at = "", 0
        for c in r.text or "":
            size = len(c.encode())
            out += "" if gone[at : at + size].any() else c
            at += size
        if out or not gone.any():
            want.append((r.doc_id, None if r.text is None else out))
    got = kept.collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert any(len(w[1] or "") < len(r.text or "") for w, r in zip(want, rows))

    rows, docs = got, spark.createDataFrame(got, docs.schema)
    kept = stages.mixing(spark, docs, made)
    assert kept.columns == names
    times = plain_times([(r.doc_id, r.text, r.source) for r in rows])
    want = Counter()
    for r, n in zip(rows, times):
        want[key(r)] += n
    assert Counter(map(key, kept.collect())) == +want and hash_of(None) != hash_of(1)


CLASHES = "_id _hash _s _i _spans _lost _source _target _times _copy _score score times copy lost kept_row mix_hash span_id fp row component".split()


def test_columns_with_clashing_names_come_back_unchanged(spark, made):
    rows = [r for r in spark.read.parquet(f"{made}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    docs = spark.createDataFrame([(*r, *(f"{c}{n}" for c in CLASHES)) for n, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))
    known = {tuple(f"{c}{n}" for c in CLASHES) for n in range(len(rows))}
    for stage in (stages.quality, stages.near_copies, stages.repeated_passages, stages.mixing):
        out = stage(spark, docs, made)
        assert out.columns == docs.columns
        got = [tuple(r[c] for c in CLASHES) for r in out.select(*CLASHES).collect()]
        assert got and set(got) <= known
    assert "ids" in stages.pieces(spark, docs, made).columns


def test_run_gives_every_kept_row_encoded(spark, made):
    out = corpus_pipeline.run(spark, made).collect()
    assert out and all(r.exact and r.n_pieces == len(r.ids) for r in out)
    assert max(Counter(r.doc_id for r in out if r.doc_id is not None).values()) <= 4


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
