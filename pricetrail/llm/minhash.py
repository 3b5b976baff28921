"""Document fingerprints by MinHash: universal hash permutations over word shingles, in vectorised numpy."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import arrow_map, chunks, mixed, stored, sums_by_text, word_hashes
from pricetrail.llm.components import components
from pricetrail.llm.neighbours import by_descending_id, with_next

SHINGLE, PERMUTATIONS = 5, 128
#: Words hashed at once: the arrays of a permutation then stay in the processor's cache.
BLOCK_BYTES = 1 << 18
_A = mixed(np.arange(1, 2 * PERMUTATIONS, 2, dtype=np.uint64)) | np.uint64(1)
_B = mixed(np.arange(2, 2 * PERMUTATIONS + 1, 2, dtype=np.uint64))


def shingles(texts: list[bytes], size: int = SHINGLE, fill: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words, and their number by text.

    With ``fill`` each text is preceded by empty words, so that n words give n runs and short texts keep some likeness
    after an edit; without, only whole runs count, and a shorter text is one run.
    """
    words, counts = word_hashes(texts)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros(len(words), np.uint64)
    for back in range(size):
        moved = np.zeros(len(words), np.uint64)
        moved[back:] = words[: max(0, len(words) - back)]
        moved[place < back] = np.uint64(0x51ED270B)
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + moved
    if not fill:
        keep = place >= np.minimum(size, np.repeat(counts, counts)) - 1
        out, counts = out[keep], np.where(counts, np.maximum(counts - size + 1, 1), 0)
    return mixed(out), counts


def signatures(texts: list[bytes], fill: bool = True) -> np.ndarray:
    """(texts, permutations) 16-bit ends of the least permuted shingle hashes; all zero for a text without words."""
    out = np.zeros((len(texts), PERMUTATIONS), np.uint16)
    start = 0
    sizes = np.cumsum([len(t) for t in texts])
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + BLOCK_BYTES)))
        values, counts = shingles(texts[start:end], fill=fill)
        full = np.flatnonzero(counts)
        if len(full):
            at = (np.cumsum(counts) - counts)[full]
            for k in range(PERMUTATIONS):
                least = np.minimum.reduceat(values * _A[k] + _B[k], at)
                out[start + full, k] = (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)
        start = end
    return out


def edited(text: str, following: str) -> str:
    """The last third of the code points (rounded down) replaced by the first as many of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Likeness is the
    share of equal signature entries, which estimates the Jaccard likeness of the shingle sets: texts without words
    are alike. The next document is the one with the next lower id; null ids come last, equal ids in the order of
    their text hash, and after the last comes the first. Null texts are empty; an empty table gives no rows.
    """

    def run(batches):
        for rows in with_next(batches, 1 << 20):
            ids, texts, following = zip(*rows)
            plain = [t.decode() for t in texts]
            changed = [edited(t, f.decode()).encode() for t, f in zip(plain, following)]
            # Each document's successor is mostly the next row: only where it isn't is it hashed again.
            odd = [i for i in range(len(rows)) if i + 1 == len(rows) or following[i] is not texts[i + 1]]
            own, new = signatures(list(texts)), signatures(changed)
            after = np.empty_like(own)
            after[:-1] = own[1:]
            after[odd] = signatures([following[i] for i in odd])
            # Without words, a signature is all zero: it is like its own kind only.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in plain], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
                    pa.array([s.tobytes().hex() for s in own]),
                    pa.array([s.tobytes().hex() for s in new]),
                    pa.array((own == new).mean(axis=1)),
                    pa.array((own == after).mean(axis=1)),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow_map(by_descending_id(docs), run, schema)


def near_duplicates(docs: DataFrame, likeness: float = 0.8, bands: int = 32) -> DataFrame:
    """(doc_id, component_id): the classes of ``duplicate_classes``, by the least doc_id of each."""
    return duplicate_classes(docs, likeness, bands).select("doc_id", "component_id")


def duplicate_classes(docs: DataFrame, likeness: float = 0.8, bands: int = 32, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, more columns, component, component_id): classes of documents linked by a Jaccard likeness of their
    five-word shingle sets, by a number of their own and by the least doc_id of each.

    Texts with equal shingle sets are one class from the start. Of the others, signature bands are joined. First each
    member of a band bucket is paired with the least one, and the links found are joined to classes: this settles
    large groups of copies with few pairs. Then, in buckets whose members are still in several classes, every two
    members of different classes are paired. A pair's likeness is verified on the whole shingle sets. Empty texts are
    alike; null ids never name a class; an empty table gives no rows.
    """

    def run(batches):
        for batch, texts in chunks(batches):
            sets = _sets(texts)
            marks = signatures(texts, fill=False)
            # The entries of a band stand together.
            marks = marks.reshape(len(texts), -1, bands).transpose(0, 2, 1)
            kept = [batch.column(n) for n in ("doc_id", *more)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([_name(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), pa.array([m.tobytes() for m in marks], pa.binary())],
                names=["doc_id", *more, "same", "n", "signature"],
            )

    cols = docs.select("doc_id", *more, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != "text")
    rows = stored(arrow_map(cols, run, f"{schema}, same string, n long, signature binary"), "minhash")
    kinds = rows.groupBy("same").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    kinds = stored(kinds.withColumn("kind", F.xxhash64("same")), "minhash-kinds")
    width = 2 * PERMUTATIONS // bands
    cut = F.expr(f"transform(sequence(0, {bands - 1}), i -> substring(signature, i * {width} + 1, {width}))")
    placed = kinds.select("kind", F.posexplode(cut).alias("band", "mark"))
    stars = placed.groupBy("band", "mark").agg(F.min("kind").alias("a"), F.max("kind").alias("z")).filter("a <> z").drop("z")
    shared = stored(placed.join(stars, ["band", "mark"]), "minhash-shared")
    sets = _sets_of(docs, kinds.join(shared.select("kind").distinct(), "kind", "left_semi").select("same", "kind"))
    pairs = shared.filter("a <> kind").select("a", F.col("kind").alias("b")).distinct()
    alike = stored(_alike(pairs, sets, likeness), "minhash-alike")
    more_alike = _alike(_unsettled(shared, kinds, components(alike), likeness), sets, likeness)
    nodes = components(alike.union(more_alike)).withColumnRenamed("node", "kind")
    member = kinds.select("same", "kind", "first_id").join(nodes, "kind", "left").withColumn("component", F.coalesce("component", "kind"))
    member = stored(member, "minhash-member")
    lowest = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = member.join(lowest, "component").select("same", "component", "component_id")
    return rows.select("doc_id", *more, "same").join(found, "same").drop("same")


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    values, counts = shingles(texts, fill=False)
    return [np.unique(s) for s in np.split(values, np.cumsum(counts)[:-1])]


def _name(s: np.ndarray) -> str:
    return hashlib.sha256(s.tobytes()).hexdigest()


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(kind, set) of the wanted (same, kind): only sets of texts that share a bucket are written."""

    def run(batches):
        for _, texts in chunks(batches):
            sets = {_name(s): s for s in _sets(texts)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sets)), pa.array([s.view(np.int64) for s in sets.values()], pa.list_(pa.int64()))], names=["same", "set"]
            )

    found = arrow_map(docs.select("text"), run, "same string, set array<long>").join(wanted, "same").groupBy("kind")
    return stored(found.agg(F.first("set").alias("set")), "minhash-sets")


def _alike(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """The (a, b) whose whole shingle sets are alike."""
    left = sets.select(F.col("kind").alias("a"), F.col("set").alias("s"))
    right = sets.select(F.col("kind").alias("b"), F.col("set").alias("t"))
    checked = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("s", "t")))
    return checked.filter(F.col("both") >= likeness * (F.size("s") + F.size("t") - F.col("both"))).select("a", "b")


def _unsettled(shared: DataFrame, kinds: DataFrame, nodes: DataFrame, likeness: float) -> DataFrame:
    """Distinct (a, b) that share a bucket, are not of one class yet and may be alike.

    A bucket's largest class is not paired with itself. Sets whose sizes differ too much cannot be alike. Signatures
    equal in 20 points less of their entries than the likeness (over five standard deviations) are not looked into.
    """
    classed = shared.join(nodes.withColumnRenamed("node", "kind"), "kind", "left").withColumn("class", F.coalesce("component", "kind"))
    classed = stored(classed.drop("component"), "minhash-classed")
    largest = classed.groupBy("band", "mark", "class").agg(F.count(F.lit(1)).alias("c")).groupBy("band", "mark")
    largest = largest.agg(F.max(F.struct("c", "class")).alias("most"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    open_ = classed.join(largest.select("band", "mark", F.col("most.class").alias("largest")), ["band", "mark"])
    open_ = stored(open_.join(kinds.select("kind", "n", "signature"), "kind"), "minhash-open")
    # The least one of a bucket was compared with all others.
    open_ = open_.filter("kind <> a")
    left = open_.filter("class <> largest").select("band", "mark", F.col("kind").alias("a"), F.col("class").alias("c"), F.col("n").alias("m"), F.col("signature").alias("s"))
    right = open_.select("band", "mark", F.col("kind").alias("b"), F.col("class").alias("d"), "n", F.col("signature").alias("t"), F.col("class").eqNullSafe(F.col("largest")).alias("top"))
    sizes = F.least("m", "n") >= likeness * F.greatest("m", "n")
    pairs = left.join(right, ["band", "mark"]).filter((F.col("c") != F.col("d")) & sizes & (F.col("top") | (F.col("a") < F.col("b"))))

    def close(batches):
        for batch in batches:
            if batch.num_rows:
                s, t = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint16).reshape(-1, PERMUTATIONS) for n in ("s", "t"))
                near = pa.array((s == t).mean(axis=1) >= likeness - 0.2)
                yield batch.select(["a", "b"]).filter(near)

    found = arrow_map(pairs.select("a", "b", "s", "t"), close, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
