import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetrail.llm import suffixes

SCHEMA = "doc_id long, text string, spans string, same string"


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("seed,few", [(1, 32), (2, 2), (3, 0)])
def test_against_all_strings(spark, monkeypatch, seed, few):
    monkeypatch.setattr(suffixes, "FEW", few)
    rng = random.Random(seed)
    passages = [words(rng, 1000).encode()[:n].decode(errors="ignore") for n in (199, 200, 201, 202, 260, 300, 450, 900)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randrange(4), rng.choice(passages))
        rows.append((i, rng.choice(["", " "]).join(parts)))
    base = words(rng, 300)
    for i in range(20):  # near copies, each with its own edits
        cut = rng.randrange(len(base))
        rows.append((100 + i, base[:cut] + rng.choice(["", "X"]) + base[cut + 1 :]))
    rows += [(200, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, None), (201, ""), (202, "ab " * 400), (203, "x" * 5000), (204, "x" * 199)]
    rows += [(205, passages[3] + passages[3][:150]), (206, passages[4][:230] + passages[6][:230])]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], SCHEMA).repartition(4)
    got = suffixes.without_repeats(docs).drop("kept").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_empty_table(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_groups_hold_one_row_of_each_kind(spark, monkeypatch):
    rng = random.Random(5)
    # The filter lets everything through, as it nearly does for very many marks.
    monkeypatch.setattr(suffixes, "bloom", lambda keys, *bits: np.full(16, np.uint64(2**64 - 1)))
    sizes = spark.sparkContext.accumulator(0)
    batch = suffixes.arrow_map

    def counted(df, function, schema):
        if df.columns == ["g"]:
            df = df.select(F.udf(lambda g: sizes.add(len(g)) or g, df.schema["g"].dataType)("g").alias("g"))
        return batch(df, function, schema)

    monkeypatch.setattr(suffixes, "arrow_map", counted)
    passage = words(rng, 120)
    rows = [(i, passage) for i in range(300)] + [(300, passage[:-1] + "#"), (301, passage + " and more")]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], SCHEMA).repartition(4)
    got = suffixes.without_repeats(docs).drop("kept").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)
    assert 2 <= sizes.value <= 30


@pytest.mark.parametrize("many", [100, 200])
def test_strings_of_many_kinds_are_hashed_in_blocks(spark, monkeypatch, many):
    monkeypatch.setattr(suffixes, "FEW", 8)
    made, stored = [], suffixes.stored

    def counted(df, label):
        out = stored(df, label)
        if label == "suffix-strings":
            made.append(out.count())
        return out

    monkeypatch.setattr(suffixes, "stored", counted)
    rng = random.Random(6)
    passage, more = words(rng, 150), words(rng, 40)
    # All go on after a passage in their own way, half of them after a second passage.
    rows = [(i, f"{passage} {more if i % 2 else ''} {words(rng, 60)}") for i in range(many)]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], SCHEMA).repartition(4)
    got = suffixes.without_repeats(docs).drop("kept").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)
    assert 0 < sum(made) <= 20 * many


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcdefghij ", bytes(range(256))])
def test_no_string_is_left_out_by_the_chosen_places(letters):
    """Every string of 200 bytes has one chosen place, and one that occurs again has a key that occurs again."""
    rng = random.Random(len(letters))
    draw = lambda n: bytes(rng.choices(letters, k=n))
    passages = [draw(n) for n in (200, 201, 230, 320, 900)]
    texts = [b"".join(rng.choice([draw(rng.randint(0, 150)), rng.choice(passages)]) for _ in range(rng.randint(0, 6))) for _ in range(30)]
    texts += [b"", b"xy" * 300, b"z" * 199, b"z" * 700]
    data, starts, places, _, low, high = suffixes.samples(texts)
    keys = suffixes.keys_at(data, places).tolist()
    times = Counter(keys)
    key_of = {}
    for key, first, last in zip(keys, low.tolist(), high.tolist()):
        for at in range(first, last + 1):
            assert key_of.setdefault(at, key) == key
    seen = {}
    for base, text in zip(starts.tolist(), texts):
        for i in range(len(text) - 199):
            seen.setdefault(text[i : i + 200], []).append(key_of[base + i])
    again = [found for found in seen.values() if len(found) > 1]
    assert again and all(len(set(found)) == 1 and times[found[0]] > 1 for found in again)
