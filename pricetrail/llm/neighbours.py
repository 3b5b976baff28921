"""Each row together with the next one in an order by id, without sorting all rows into one task."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import NULL_ID


def id_cuts(keys: DataFrame, pieces: int) -> list[int]:
    """Ids that cut the rows into about so many ranges: one pass over the ids alone, one short list back."""
    fractions = [i / pieces for i in range(1, pieces)]
    found = keys.select(F.percentile_approx("_key", fractions, 10 * pieces).alias("c")).first()["c"] if fractions else []
    return sorted(set(found or []))


def by_descending_id(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """(doc_id, text) -> (_range, _guest, doc_id, text), sorted in each partition so that the next document follows.

    Rows are dealt out by ranges of ids. After a range's own rows come, as guests, the documents with the highest id
    of the next range; after the last range those with the highest id of all. Texts are shuffled once. Null ids come
    last, equal ids in the order of their text hash.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NULL_ID)).alias("_key"))
    cuts = id_cuts(keyed.select("_key"), pieces or 4 * tasks)
    found = F.expr(f"size(filter(array({', '.join(f'{c}L' if c > NULL_ID else 'cast(-9223372036854775808 as bigint)' for c in cuts)}), c -> c >= _key))") if cuts else F.lit(0)
    ranged = keyed.withColumn("_range", found)
    heads = ranged.groupBy("_range").agg(F.max("_key").alias("k")).orderBy("_range").collect()
    if not heads:
        return ranged.select("_range", F.lit(False).alias("_guest"), "doc_id", "text")
    before = [r["_range"] for r in heads]
    visits = {h["k"]: before[i - 1] for i, h in enumerate(heads)}
    tag = F.create_map(*(x for k, r in visits.items() for x in (F.lit(k).cast("long"), F.lit(r))))
    guest = tag[F.col("_key")]
    both = F.when(
        guest.isNotNull(),
        F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g")), F.struct(guest.alias("r"), F.lit(True).alias("g"))),
    ).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g"))))
    rows = ranged.select("doc_id", "text", "_key", F.explode(both).alias("_p"))
    rows = rows.select("_p.r", "_p.g", "doc_id", "text", "_key").toDF("_range", "_guest", "doc_id", "text", "_key")
    return (
        rows.repartitionById(tasks, F.col("_range") % tasks)
        .sortWithinPartitions("_range", "_guest", F.col("_key").desc(), F.xxhash64("text"))
        .select("_range", "_guest", "doc_id", "text")
    )


def with_next(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    """Lists of (doc_id, text, next text) as bytes, each list of about ``limit`` bytes of text."""
    last, out, held = None, [], 0
    for batch in batches:
        ranges, guests, ids = (batch.column(i).to_pylist() for i in range(3))
        texts = batch.column(3).cast(pa.binary()).to_pylist()
        for r, g, i, t in zip(ranges, guests, ids, texts):
            t = t or b""
            if last is not None and last[0] == r:
                out.append((last[1], last[2], t))
                held += len(last[2])
                if held >= limit:
                    yield out
                    out, held = [], 0
            last = None if g else (r, i, t)
    if out:
        yield out
