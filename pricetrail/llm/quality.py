"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk with an estimated class prior.

Trusted positives are texts labelled 1; the rest of the learning rows without a label are the unlabelled web text.
Labels 0 are never read. The model is fitted on a bounded sample drawn by hash; every text is scored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import arrow_map, chunks, held_out, sums_by_text, word_hashes

#: Bounds of the fitting sample: trusted positives and unlabelled texts.
MOST_POSITIVE, MOST_UNLABELLED = 8_000, 16_000
TRIGRAMS, HIDDEN = 512, 32
FOLDS, FOLD = 5, 0

_CLASS = np.full(256, 9, np.int64)  # other marks
for _value, _bytes in enumerate([range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b".,", b"|", b"!?", b"#*&%$@", (), range(128, 256)]):
    _CLASS[list(_bytes)] = _value
KINDS = 11


def features(texts: list[bytes]) -> np.ndarray:
    """Shape of each text and its hashed byte trigrams: float32 (texts, KINDS + 6 + TRIGRAMS); whole texts."""
    n = len(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(n), sizes)
    size = np.maximum(sizes, 1)[:, None]
    kinds = np.bincount(doc * KINDS + _CLASS[data], minlength=n * KINDS).reshape(n, KINDS) / size
    grams = np.zeros((n, TRIGRAMS))
    if len(data) > 2:
        wide = data.astype(np.uint32)
        mark = (wide[:-2] * np.uint32(2654435761) + wide[1:-1] * np.uint32(2246822519) + wide[2:] * np.uint32(3266489917)) >> np.uint32(23)
        same = doc[:-2] == doc[2:]
        grams = np.bincount(doc[:-2][same] * TRIGRAMS + mark[same], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    words, counts = word_hashes(texts)
    of = np.repeat(np.arange(n), counts)
    many = np.maximum(counts, 1)

    def repeats(back: int) -> np.ndarray:
        equal = np.zeros(len(words), np.float64)
        equal[back:] = (words[back:] == words[:-back]) & (of[back:] == of[:-back]) if len(words) > back else 0
        return sums_by_text(equal, counts) / many

    order = np.lexsort((words, of))
    new = np.ones(len(words), np.float64)
    new[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = sums_by_text(new, counts) / many
    shape = np.column_stack([np.log1p(sizes) / 10, np.log1p(counts) / 10, sizes / many / 100, distinct, repeats(1), repeats(2)])
    return np.hstack([kinds * 4, shape, np.sqrt(grams / size) * 4]).astype(np.float32)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(x / 2))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, errors: float = 3) -> float:
    """Share of positives among the unlabelled: the least ratio of the two samples' upper score tails.

    The cut is chosen by the ratio plus its standard errors and the ratio less them is returned: a prior that is too
    high makes the learner take junk for positive, one that is a little low costs nothing where the classes part.
    """
    cuts = np.quantile(positive, np.linspace(0, 0.8, 81))
    tail_p = np.array([(positive >= c).mean() for c in cuts])
    tail_u = np.maximum([(unlabelled >= c).mean() for c in cuts], 1 / len(unlabelled))
    ratio = tail_u / tail_p
    error = ratio * np.sqrt((1 - tail_u) / (tail_u * len(unlabelled)) + (1 - tail_p) / (tail_p * len(positive)))
    best = int(np.argmin(ratio + errors * error))
    return float(np.clip(ratio[best] - errors * error[best], 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, rounds: int = 20, seed: int = 1) -> dict:
    """A one-layer network. With a prior it minimises the non-negative unbiased risk; without, it only tells the
    two samples apart. Logistic loss, so the sigmoid of the output is a probability."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 0.05
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    w = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    steps = max(10, min(len(p), len(u)) // 128)
    for _ in range(rounds):
        for _ in range(steps):
            a, b = p[rng.integers(0, len(p), 128)], u[rng.integers(0, len(u), 256)]
            x = np.vstack([a, b])
            hidden = np.tanh(x @ w[0] + w[1])
            g = hidden @ w[2] + w[3]
            gp, gu = g[: len(a)], g[len(a) :]
            if prior is None:
                slope = np.r_[-_sigmoid(-gp) / len(a), _sigmoid(gu) / len(b)]
            else:
                negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
                down = np.r_[-prior * _sigmoid(gp) / len(a), _sigmoid(gu) / len(b)]
                up = np.r_[-prior * _sigmoid(-gp) / len(a), np.zeros(len(b))]
                # Where the estimated negative risk falls below zero, only that part is followed, uphill.
                slope = up + down if negative >= 0 else -down
            back = np.outer(slope, w[2]) * (1 - hidden**2)
            grads = [x.T @ back + 1e-4 * w[0], back.sum(axis=0), hidden.T @ slope + 1e-4 * w[2], np.array([slope.sum()])]
            t += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                w[i] = w[i] - 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "scale": scale, "w": [x.astype(np.float32) for x in w]}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    w = model["w"]
    return _sigmoid(np.tanh(((x - model["mean"]) / model["scale"]).astype(np.float32) @ w[0] + w[1]) @ w[2] + w[3]).astype(np.float64)


def _drawn(rows: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows, or all if they are fewer, by a hash of the id: the same rows in each run."""
    share = min(1.0, bound / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000))


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from the learning rows; without positives or unlabelled texts, one that scores all texts 0.5."""
    ids = labels.filter(F.col("doc_id").isNotNull() & ~held_out(FOLDS, FOLD))
    known = ids.select("doc_id").distinct()
    positive = _drawn(ids.filter("quality = 1").select("doc_id").distinct(), MOST_POSITIVE)
    free = docs.filter(~held_out(FOLDS, FOLD)).select("doc_id", "text")
    unlabelled = _drawn(free.select("doc_id").join(known, "doc_id", "left_anti").distinct(), MOST_UNLABELLED)
    # The drawn ids are bounded by the parameters above, so they may be broadcast; texts aren't shuffled.
    drawn = positive.select("doc_id", F.lit(1).alias("kind")).union(unlabelled.select("doc_id", F.lit(0).alias("kind")))

    def run(batches):
        for batch, texts in chunks(batches):
            found = features(texts).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("doc_id"), pa.array([x.tobytes() for x in found])], names=["kind", "doc_id", "x"]
            )

    chosen = free.join(F.broadcast(drawn), "doc_id").select("doc_id", "kind", "text")
    found = arrow_map(chosen, run, "kind int, doc_id long, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    kind = found["kind"].to_numpy()
    width = KINDS + 6 + TRIGRAMS
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float16).reshape(len(kind), width).astype(np.float32)
    p, u = x[kind == 1], x[kind == 0]
    if not len(p) or not len(u):
        return {"mean": np.zeros(width), "scale": np.ones(width), "w": [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)], "prior": 0.5}
    # The prior is read off scores that the scoring model hasn't seen: fitted on one half, taken on the other.
    half = fit(p[::2], u[::2], None, rounds=6)
    prior = class_prior(predict(half, p[1::2] if len(p) > 1 else p), predict(half, u[1::2] if len(u) > 1 else u))
    return fit(p, u, prior) | {"prior": prior}


def scored_rows(docs: DataFrame, model: dict, name: str) -> DataFrame:
    """``docs`` with a score column, of every whole text; null texts count as empty. One pass, no shuffle."""
    score = F.pandas_udf(_scorer(docs.sparkSession.sparkContext.broadcast(model)), "double")
    return docs.withColumn(name, score("text"))


def _scorer(shared):
    import pandas as pd

    def run(column: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(column, pa.string())], names=["text"])
        return pd.Series(np.concatenate([predict(shared.value, features(texts)) for _, texts in chunks([batch])] or [np.zeros(0)]))

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document; an empty table gives no rows, null ids are held out."""
    out = scored_rows(docs.select("doc_id", "text"), learn(docs, labels), "score")
    return out.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
