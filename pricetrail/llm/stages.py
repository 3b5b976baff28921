"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir); all but the last keep the columns of docs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.llm import mixing as mixing_op
from pricetrail.llm import quality as quality_op
from pricetrail.llm import sentencepieces, simhash, suffixes
from pricetrail.llm.common import free, stored, table
from pricetrail.llm.queries import vocabulary
from pricetrail.session import ship_package

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3
#: Words of a shingle of the near copies' fingerprints, which are alike at two differing bits at most.
SHINGLE = 3


def _filled(docs: DataFrame, name: str, value) -> DataFrame:
    """``docs`` with a column replaced, where it has one."""
    return docs.withColumn(name, value) if name in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is high enough. The model is learned from them and ``labels``; rows without an id
    are scored like others."""
    ship_package(spark)
    model = quality_op.learn(docs, table(spark, sf_dir, "labels"))
    # Scores are computed next to the rows, so that no join puts them together again.
    (score,) = free(docs, "score")
    return quality_op.scored_rows(docs, model, score).filter(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy class stays: the one with the least doc_id, of equal ids the least text hash.

    Classes are those of the SimHash operator: chains of fingerprints with two or fewer differing bits. Texts without
    words are one class with those whose fingerprint is as near to zero. Rows that are equal in id and text count once.
    """
    ship_package(spark)
    found = simhash.classes(docs.select("doc_id", F.xxhash64("text").alias("row"), "text"), SHINGLE, "row")
    copies = found.groupBy("component", "doc_id", "row").agg(F.count(F.lit(1)).alias("copies"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "copies")).alias("k")
    here, key, copy = free(docs, "kept_id", "kept_row", "kept_copies")
    keep = copies.groupBy("component").agg(best).select(F.col("k.doc_id").alias(here), F.col("k.row").alias(key), F.col("k.copies").alias(copy))
    keep = stored(keep, "kept")
    hit = F.col("doc_id").eqNullSafe(F.col(here)) & (F.xxhash64("text") == F.col(key))
    once = docs.join(keep.where(F.col(copy) == 1), hit, "left_semi")
    # Only rows that come more than once with id and text are shuffled, one of each kept.
    again = docs.join(keep.where(F.col(copy) > 1), hit, "left_semi").withColumn(key, F.xxhash64("text"))
    return once.unionByName(again.dropDuplicates(["doc_id", key]).drop(key)).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur again; a document that loses all its text goes.

    A character of which a byte goes goes whole; ``n_chars`` is that of the new text.
    """
    ship_package(spark)
    (lost,) = free(docs, "lost")
    left = suffixes.rows_without_repeats(docs, lost)
    out = _filled(left, "n_chars", F.length("text").cast("long")).filter(~(F.col(lost) & (F.col("text") == "")))
    return out.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice; empty ones as their source's others
    whose hash is as low."""
    ship_package(spark)
    times, copy = free(docs, "times", "copy")
    taken = mixing_op.times_taken(docs, times).filter(F.col(times) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, score, ids_crc32, decoded_sha256, exact, ids): every row encoded for training."""
    ship_package(spark)
    return sentencepieces.encoded(docs, vocabulary("piece_bpe_32k.model"), with_ids=True)
