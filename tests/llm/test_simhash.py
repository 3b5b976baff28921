import random

import pytest
import xxhash

from pricetrail.llm import simhash
from pricetrail.llm.components import components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def slow_fingerprint(text):
    words, word = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, pairs):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def test_classes_against_all_pairs(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices(["Alpha", "beta", "gamma", "Δέλτα", "x"], k=n)) for n in (1, 2, 3, 4, 60, 400, 3000)]
    texts = base + [b.replace("beta", "BETA") for b in base] + [base[5] + " y", base[6] + " z", "", None, " \n\t", " "]
    texts += [base[4]] * 5 + ["".join(rng.choices("ab ", k=rng.randint(0, 12))) for _ in range(120)] + ["x" * 200_000]
    ids = [None if i == 3 else i for i in range(len(texts))]
    rows = [(i, t, "clash", "clash") for i, t in zip(ids, texts)] + [(4, texts[4], "c", "c")] * 2
    got = {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = union(range(len(fps)), pairs)
    least = {}
    for n, r in root.items():
        if ids[n] is not None:
            least[r] = min(least.get(r, 1 << 60), ids[n])
    assert got == {(ids[n], fps[n], least.get(root[n])) for n in root}


def test_empty_table(spark):
    assert simhash.classes(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(5)
    n = 200
    pairs = {
        "chain": [(i, i + 1) for i in range(n)],
        "star": [(n, i) for i in range(n)] + [(7, 7)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(110)],
    }[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == union(nodes, [(a, b) for a, b in pairs if a != b])
