import random
import tracemalloc

import numpy as np
import pytest

from pricetrail.llm import pseudolikelihood as pl

SCHEMA = "doc_id long, text string, per_word string, n_words string"


def test_probabilities_sum_to_one():
    w = {k: v + 0.3 for k, v in pl.initial().items()}
    w["member"] += np.random.default_rng(0).normal(0, 1, w["member"].shape).astype(np.float32)
    around = np.repeat(np.array([[1, 2, pl.EDGE, 9]], np.int32), pl.IDS, axis=0)
    assert np.exp(pl.log_probabilities(w, np.arange(pl.IDS, dtype=np.int32), around)).sum() == pytest.approx(1, abs=1e-4)


def test_windows():
    ids, around, counts = pl.examples([b"a B c d", b"", b" a\n"])
    a, b, c, d, again = ids
    e = pl.EDGE
    assert again == a and counts.tolist() == [4, 0, 1]
    assert around.tolist() == [[e, e, b, c], [e, a, c, d], [a, b, d, e], [b, c, e, e], [e, e, e, e]]


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    ids, around = rng.integers(0, pl.IDS, 8).astype(np.int32), rng.integers(0, pl.IDS + 1, (8, 4)).astype(np.int32)
    start = {k: v.astype(np.float64) for k, v in pl.initial().items()}
    learner = pl.Learner(start)
    slopes = {}
    learner._move = lambda name, slope: slopes.__setitem__(name, slope)
    learner.step(ids, around)
    for name, place in (("outer", (3, 70)), ("inner", (5, 4)), ("inner_bias", (2,)), ("outer_bias", (int(ids[0]) // 64,)), ("member", (int(ids[0]) // 64, int(ids[0]) % 64))):
        moved = []
        for sign in (1, -1):
            w = {k: v.copy() for k, v in start.items()}
            w[name][place] += sign * 1e-5
            moved.append(-pl.log_probabilities(w, ids, around).sum())
        assert slopes[name][place] * np.sqrt(8) == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=1e-3, abs=1e-5)


def test_likely_texts_score_higher(spark):
    rng = random.Random(0)
    nouns, verbs = [f"n{i}" for i in range(20)], [f"v{i}" for i in range(20)]
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)} ."
    rows = [(i, " ".join(sentence() for _ in range(40)), "", "") for i in range(400)]
    odd = []
    for i in range(20):
        words = rows[i][1].split()
        rng.shuffle(words)
        odd.append((1000 + i, " ".join(words), "", ""))
    odd += [(None, None, "", ""), (2000, " ", "", ""), (2001, "the", "", ""), (2002, "the " * 50_000, "", ""), (2001, "the", "", "")]
    docs = spark.createDataFrame(rows + odd, SCHEMA).repartition(4)
    got = {}
    for r in pl.scored(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert np.mean([got[i][0].per_word for i in range(20)]) > np.mean([got[1000 + i][0].per_word for i in range(20)]) + 1
    assert got[None][0].per_word is None and got[2000][0].log_probability == 0 and len(got[2001]) == 2
    assert got[2002][0].n_words == 50_000


def test_empty_table(spark):
    assert pl.scored(spark.createDataFrame([], SCHEMA)).collect() == []


def test_vocabulary_grows_and_rare_words_are_spelled(spark):
    words = [f"w{i}" for i in range(6000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, 6000, 50)] * 3 + ["Zq9 w1", "w0"]
    known = pl.vocabulary(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA).repartition(3))
    ids, around, counts = pl.examples([" ".join(words).encode(), b"zq9 junk w1"], known)
    assert known.size == 6001 and sorted(ids[:6000]) == list(range(1, 6001)) and around.max() == 6001
    assert ids[6000:].tolist() == [pl.RARE, pl.RARE, ids[1]] and counts.tolist() == [6000, 3]
    spelled = known.spelled([b" Zq9  junk", b"w1"], np.array([True, True, False]))
    e, p = pl.END, known.spelling
    assert spelled == pytest.approx([p[e, 122] + p[122, 113] + p[113, 57] + p[57, e], p[e, 106] + p[106, 117] + p[117, 110] + p[110, 107] + p[107, e], 0])
    assert np.exp(p).sum(axis=1) == pytest.approx(np.ones(257)) and spelled[0] > spelled[1] * 3 / 4


def test_three_digits_sum_to_one_and_learn():
    n = 5000
    w = pl.initial(ids=n)
    assert w["member2"].shape == (79, 64) and w["outer"].shape[1] == 192
    around = np.repeat(np.array([[1, 2, n, 4999]], np.int32), 64**3, axis=0)[: 79 * 64]
    every = np.arange(79 * 64, dtype=np.int32)
    learner = pl.Learner(w)
    for _ in range(200):
        learner.step(np.array([4321, 77] * 8, np.int32), around[:16])
    after = np.exp(pl.log_probabilities(learner.w, every, around))
    assert after[4321] > 0.4 and after[77] > 0.4 and after.sum() <= 1.0001


def test_every_word_is_a_target_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    step = pl.Learner.step

    def counted(self, ids, around):
        seen.add(len(ids))
        step(self, ids, around)

    monkeypatch.setattr(pl.Learner, "step", counted)
    docs = spark.createDataFrame([(i, "a few words " * (i % 3), "", "") for i in range(100)], SCHEMA).repartition(3)

    known = pl.vocabulary(docs)
    inner = pl.arrow_map

    def patched(df, function, schema):
        def run(batches):
            pl.Learner.step = counted
            yield from function(batches)

        return inner(df, run, schema)

    monkeypatch.setattr(pl, "arrow_map", patched)
    pl.learn(docs, known)
    assert seen.value == 3 * sum(i % 3 for i in range(100))


def test_moved_weights_travel_compressed(spark, monkeypatch):
    sent = spark.sparkContext.accumulator(0)
    inner = pl.arrow_map

    def patched(df, function, schema):
        def run(batches):
            for batch in function(batches):
                if not {"at", "moved"}.isdisjoint(batch.schema.names):
                    sent.add(batch.nbytes)
                yield batch

        return inner(df, run, schema)

    monkeypatch.setattr(pl, "arrow_map", patched)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=200)), "", "") for i in range(60)], SCHEMA).repartition(3)
    known = pl.vocabulary(docs)
    sent.value = 0
    learned = pl.learn(docs, known)
    # Each of three tasks sends nearly all weights in both rounds; as pairs of numbers they would take 16 bytes each.
    weights = sum(w.size for w in learned.values())
    assert 0 < sent.value < 4 * 6 * weights


def test_sums_of_moved_weights_are_exact():
    big = np.array([1 << 40, -(1 << 31), 0, 5], np.int64)
    rows = [(0, 7, big), (0, (1 << 20) + 1, -big), (2, 3, big[:2])]
    columns = [[n for n, _, _ in rows], [w for _, w, _ in rows], [pl._squeezed(x) for *_, x in rows]]
    batch = pl.pa.RecordBatch.from_arrays([pl.pa.array(c) for c in columns], names=["block", "words", "moved"])
    got = {b.column("block")[0].as_py(): np.frombuffer(b.column("sums")[0].as_py()).tolist() for b in pl._sums([batch])}
    assert got == {0: [float(int(x) * (7 - (1 << 20) - 1)) for x in big], 2: [float(3 * int(x)) for x in big[:2]]}


def test_steps_are_those_of_plain_sums():
    rng = np.random.default_rng(5)
    n = 5000
    start = {k: v.astype(np.float64) for k, v in pl.initial(ids=n).items()}
    learner, w = pl.Learner(start), {k: v.copy() for k, v in start.items()}
    seen = {k: np.full(v.shape, 1e-2) for k, v in w.items()}
    # Smaller and larger batches in turn use the same room.
    for size in (pl.BATCH, 100, 1, pl.BATCH):
        ids, around = rng.integers(0, n, size).astype(np.int32), np.minimum(rng.zipf(1.3, (size, 4)), n).astype(np.int32)
        learner.step(ids, around)
        x = w["embed"][around].reshape(size, -1)
        hidden = np.tanh(x @ w["inner"] + w["inner_bias"])
        out = (hidden @ w["outer"] + w["outer_bias"]).reshape(size, 3, 64) + np.stack([np.zeros((size, 64)), w["member"][ids // 4096], w["member2"][ids // 64]], axis=1)
        slope = np.exp(out) / np.exp(out).sum(axis=2, keepdims=True)
        for d, own in enumerate((ids // 4096, ids // 64 % 64, ids % 64)):
            slope[np.arange(size), d, own] -= 1
        slope /= np.float32(np.sqrt(size))
        flat = slope.reshape(size, -1)
        inner = flat @ w["outer"].T * (1 - hidden * hidden)
        moves = {k: np.zeros_like(v) for k, v in w.items()}
        moves |= {"outer": hidden.T @ flat, "outer_bias": flat.sum(axis=0), "inner": x.T @ inner, "inner_bias": inner.sum(axis=0)}
        np.add.at(moves["member"], ids // 4096, slope[:, 1])
        np.add.at(moves["member2"], ids // 64, slope[:, 2])
        np.add.at(moves["embed"], around, (inner @ w["inner"].T).reshape(size, 4, -1))
        for k, v in moves.items():
            seen[k] += v * v
            w[k] -= pl.RATE * v / np.sqrt(seen[k])
    for k in w:
        # The state of the gradients is held in single precision.
        assert learner.w[k] == pytest.approx(w[k], rel=1e-5, abs=1e-6), k


def test_steps_and_scores_make_few_new_arrays():
    rng = np.random.default_rng(6)
    n = 5000
    learner = pl.Learner(pl.initial(ids=n))
    ids, around = rng.integers(0, n, pl.BATCH).astype(np.int32), np.minimum(rng.zipf(1.3, (pl.BATCH, 4)), n).astype(np.int32)
    learner.step(ids, around)
    outputs = ids.size * learner.w["outer"].shape[1] * 4
    tracemalloc.start()
    learner.step(ids, around)
    step = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    many = np.tile(ids, 20), np.tile(around, (20, 1))
    pl.log_probabilities(learner.w, *many)
    scores = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A batch's outputs stand in an array that the next one uses again.
    assert step < 2 * outputs and scores < 6 * outputs


def test_windows_of_chosen_words():
    texts = [b"a b c d e", b"", b" f\n", b"g h"]
    ids, around, counts = pl.examples(texts)
    chosen = np.array([True, False, False, True, False, True, False, True])
    assert pl.windows(ids, counts, chosen=chosen).tolist() == around[chosen].tolist()
