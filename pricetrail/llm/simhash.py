"""SimHash near-duplicates: 64-bit majority fingerprints, linked by meet-in-the-middle ball hashing."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.common import arrow_map, chunks, stored
from pricetrail.llm.components import components

BITS, SEED = 64, 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The majority of the XXH64 hashes of a text's word shingles, repeats included; 0 for a text without words."""
    # bytes.lower() changes A-Z only, and bytes.split() parts at ASCII white space only.
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[: -shingle]]
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, *more: str) -> DataFrame:
    """(doc_id, fp long, more columns): null texts count as empty."""

    def run(batches):
        for batch, texts in chunks(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps)], names=[*(n for n in batch.schema.names if n != "text"), "fp"])

    cols = docs.select("doc_id", *more, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols.schema if f.name != "text")
    return arrow_map(cols, run, f"{schema}, fp long")


def linked(fps: DataFrame) -> DataFrame:
    """Distinct (fp) -> (a, b) pairs that join all fingerprints at 2 or fewer differing bits.

    Half the radius is one bit: each fingerprint emits itself and its 64 neighbours. Two fingerprints within two bits
    share a variant, and those that share one are within two bits, so each variant's least fingerprint is linked to
    its others (65 at most) and no chain is lost. Every link is checked.
    """
    flips = F.expr(f"transform(sequence(0, {BITS}), i -> if(i = {BITS}, fp, fp ^ shiftleft(1L, i)))")
    variants = fps.select("fp", F.explode(flips).alias("v"))
    least = variants.groupBy("v").agg(F.collect_set("fp").alias("near")).filter(F.size("near") > 1)
    pairs = least.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a <> b")
    return pairs.distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def classes(docs: DataFrame, shingle: int = 3, *more: str) -> DataFrame:
    """(doc_id, fp, component, component_id, more columns): documents joined by chains of links, by a fingerprint of
    their own and by the least doc_id of each.

    Texts without words have fingerprint 0 and are linked like others. Repeated rows give a row each; null ids take
    part and are never the least one unless all are null; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, shingle, *more), "simhash")
    first = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-fps")
    nodes = stored(components(linked(first.select("fp"))), "simhash-nodes")
    member = first.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    member = stored(member, "simhash-member")
    lowest = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    member = stored(member.select("fp", "component").join(lowest, "component").select("fp", "component", "component_id"), "simhash-class")
    return rows.join(member, "fp")
