import math
import random
from collections import Counter

import numpy as np
import pytest

from pricetrail.llm import search

SCHEMA = "doc_id long, text string, score string, rank string"


def brute(rows, k):
    texts = [(i, Counter((t or "").encode().lower().split())) for i, t in rows]
    n, mean = len(texts), sum(sum(c.values()) for _, c in texts) / len(texts)
    frequency = Counter(w for _, c in texts for w in c)
    queries = {}
    for i, c in texts:
        if i is not None and i % 100 == 0:
            queries.setdefault(i, set()).update(c)
    out = []
    for q, words in queries.items():
        found = []
        for i, c in texts:
            score = 0.0
            for w in words & set(c):
                idf = math.log1p((n - frequency[w] + 0.5) / (frequency[w] + 0.5))
                score += idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
            if score > 0:
                found.append((-round(score, 9), i is None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,entries", [(1 << 12, 300), (8 << 20, 2_000_000)])
def test_against_all_scores(spark, monkeypatch, shard, entries):
    monkeypatch.setattr(search, "SHARD_BYTES", shard)
    monkeypatch.setattr(search, "MOST_ENTRIES", entries)
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i * 25, " ".join(rng.choices(words, k=rng.choice([1, 3, 30, 200])))) for i in range(240)]
    rows += [(100, "w1 W2 w3"), (7, rows[8][1]), (7, rows[8][1]), (None, rows[8][1]), (None, None), (9000, None), (9100, " "), (3, "w1 " * 30_000)]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], SCHEMA).repartition(3)
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in search.top_k(docs, 10).collect())
    assert [g[:3] for g in got] == [b[:3] for b in brute(rows, 10)]
    assert [g[3] for g in got] == pytest.approx([b[3] for b in brute(rows, 10)])


def test_empty_table(spark):
    assert search.top_k(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_that_cannot_reach_the_floor_are_not_looked_into():
    """The queries' best documents lie in one run of the shard; with their floor the other runs stay unread."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"r{n // 128}x{i}" for i in range(60)], k=40) + rng.choices([f"s{i}" for i in range(400)], k=12) + ["all", f"c{n % 3}"]).encode() for n in range(1280)]
    hashes, counts = search.word_hashes(texts)
    ids = np.repeat(np.arange(len(texts)), counts)
    pairs = np.unique(np.stack([ids, hashes.view(np.int64)]), axis=1)
    queries = search.Queries(pairs[0], pairs[1].view(np.uint64))
    frequency = np.bincount(search._postings(queries, texts)[0], minlength=len(queries.words)).astype(float)
    queries.known(len(texts), int(counts.sum()), frequency)
    rows = [queries.row(i) for i in range(0, 128, 10)]

    def best(least):
        shard = search.Shard(queries, texts)
        assert len(shard.dense) > 1
        found = []
        for place, scores in shard.search(rows, least, 5):
            order = np.lexsort((place, -scores))[:5]
            found.append(list(zip(scores[order].tolist(), place[order].tolist())))
        return found, shard.looked

    all_found, all_looked = best(np.zeros(len(rows)))
    floors = np.array([f[-1][0] for f in all_found])
    again, looked = best(floors)
    assert again == all_found
    shard = search.Shard(queries, texts)
    inside = 0
    for row in rows:
        rare = [w for w in shard.local[row] if shard.row[w] < 0]
        inside += sum(int((shard.doc[shard.start[w] : shard.start[w] + shard.count[w]] < 128).sum()) for w in rare)
    # No block outside the run of the queries is looked into.
    assert looked <= inside + 128 * len(shard.dense) < all_looked
    # Beyond every score nothing is looked into.
    assert best(floors * 0 + 1e6) == ([[]] * len(rows), 0)


def test_rounds_for_the_floor_are_dealt_to_several_tasks(spark, monkeypatch):
    dealt, arrow_map = [], search.arrow_map

    def counted(df, function, schema):
        if "score" in schema:
            dealt.append(df.rdd.getNumPartitions())
        return arrow_map(df, function, schema)

    monkeypatch.setattr(search, "arrow_map", counted)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(50)], k=20))) for i in range(0, 4000, 20)]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], SCHEMA).repartition(4)
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in search.top_k(docs, 3).collect())
    assert got == [b[:3] for b in brute(rows, 3)]
    assert len(dealt) == 3 and min(dealt) >= 4


def test_long_queries_look_at_each_posting_once():
    """Where most blocks are pivots, no bounds by block are made: sums of all documents, each posting taken once."""
    rng = random.Random(9)
    kinds = [[f"{kind}{int(rng.paretovariate(0.6))}" for _ in range(3000)] for kind in "abc"]
    texts = [" ".join(rng.choices(kinds[n % 3], k=rng.choice([0, 5, 80, 150]))).encode() for n in range(900)]
    texts = [texts[i] for i in search._like_together(texts)]
    hashes, counts = search.word_hashes(texts)
    pairs = np.unique(np.stack([np.repeat(np.arange(len(texts)), counts), hashes.view(np.int64)]), axis=1)
    queries = search.Queries(pairs[0], pairs[1].view(np.uint64))
    word, doc, frequency, lengths = search._postings(queries, texts)
    assert lengths.tolist() == [len(t.split()) for t in texts]
    queries.known(len(texts), int(counts.sum()), np.bincount(word, minlength=len(queries.words)).astype(float))
    rows = [queries.row(i) for i in range(len(queries.ids))]
    shard = search.Shard(queries, texts)
    assert sorted(shard.alike(rows).tolist()) == list(range(len(rows)))
    norm = search.K1 * (1 - search.B + search.B * lengths / queries.mean)
    value = queries.weight[word] * frequency * (search.K1 + 1) / (frequency + norm[doc])
    for least in (np.zeros(len(rows)), np.full(len(rows), 40.0)):
        shard.looked = 0
        found = list(shard.search(rows, least, 4))
        assert len(found) == len(rows)
        for row, floor, (docs, scores) in zip(rows, least, found):
            mine = np.isin(word, row)
            total = np.bincount(doc[mine], value[mine], minlength=len(texts)).round(search.DECIMALS)
            best = [t for t in np.sort(total)[::-1][:4] if t > 0 and t >= floor]
            assert np.sort(scores)[::-1][: len(best)].tolist() == pytest.approx(best)
            assert scores.tolist() == pytest.approx(total[docs].tolist())
        groups = -(-len(rows) // search.TOGETHER)
        rare = sum(int(shard.count[w].sum()) for w in (x[shard.row[x] < 0] for x in (shard.local[r] for r in rows)))
        assert shard.looked <= rare + 2 * groups * shard.dense.size


def test_words_of_queries_are_found_by_their_first_bits():
    rng = np.random.default_rng(1)
    for words in (np.zeros(0, np.uint64), np.array([5], np.uint64), np.array([0, 1, 2, 3, 2**63, 2**64 - 2, 2**64 - 1], np.uint64), rng.integers(0, 2**64, 5000, np.uint64)):
        queries = search.Queries(np.zeros(len(words), np.int64), words)
        hashes = np.concatenate([words, words + np.uint64(1), rng.integers(0, 2**64, 300, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        found, place = queries.places(hashes)
        assert found.tolist() == np.flatnonzero(np.isin(hashes, words)).tolist()
        assert (queries.words[place] == hashes[found]).all()
