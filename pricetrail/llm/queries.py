"""Registered queries of the training-data operators: each over its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.llm import embeddings, langid, minhash, mixing, negatives, pseudolikelihood, quality, search, sentencepieces, simhash, suffixes, tokens, trie
from pricetrail.llm.common import table
from pricetrail.session import ship_package

#: Folder of the public vocabularies; by default the installed package's.
TOKENIZERS: str | None = None
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_search(spark, sf_dir):
    """The ten best documents for each document whose id is divisible by 100."""
    return search.top_k(table(spark, sf_dir))


@query
def op2_quality(spark, sf_dir):
    """Quality score of every document."""
    return quality.classify(table(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op3_suffixes(spark, sf_dir):
    """What each document loses of repeated strings of 200 bytes."""
    return suffixes.without_repeats(table(spark, sf_dir)).drop("kept")


@query
def op4_langid(spark, sf_dir):
    """Language of every document."""
    return langid.identify(table(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@query
def op5_tokens(spark, sf_dir):
    """Every document's ids, written as Huffman-coded files and read back."""
    return tokens.coded(table(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@query
def op6_minhash(spark, sf_dir):
    """Fingerprints of every document and its edited text."""
    return minhash.fingerprints(table(spark, sf_dir))


@query
def op7_pseudolikelihood(spark, sf_dir):
    """Sum of the conditional log probabilities of every document's words."""
    return pseudolikelihood.scored(table(spark, sf_dir))


@query
def op8_sentencepiece(spark, sf_dir):
    """Every document encoded to pieces and decoded again."""
    return sentencepieces.encoded(table(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@query
def op9_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate class of every document."""
    out = simhash.classes(table(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_mixing(spark, sf_dir):
    """How many words the mix takes from every document."""
    return mixing.mix(table(spark, sf_dir))


@query
def op11_embeddings(spark, sf_dir):
    """Links, class and whether it stays, of every vector."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op13_negatives(spark, sf_dir):
    """Hard negatives of every vector whose id is divisible by 100."""
    return negatives.hard_negatives(negatives.relabelled(table(spark, sf_dir, "embeddings")))


@query
def op12_trie(spark, sf_dir):
    """Every prefix of the rebuilt conversations."""
    return trie.trie(table(spark, sf_dir, "conversations")).drop("node")


ORACLES["op10_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT a.source, a.source_size, a.w,
         (SELECT sum(source_size) FROM sources) * 3
           - coalesce(sum(b.source_size) FILTER (WHERE b.source_size * a.w < a.source_size * b.w), 0) * 4 AS level,
         sum(b.w) FILTER (WHERE b.source_size * a.w >= a.source_size * b.w) * 2 AS open
  FROM sources a CROSS JOIN sources b GROUP BY ALL),
free AS (
  SELECT level, open FROM levels WHERE source_size * 2 * open > level * w ORDER BY source_size / w LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN source_size * 2 * l.open <= l.level * w THEN (source_size * 2)::DOUBLE
              ELSE ((f.level * w)::BIGINT)::DOUBLE / (f.open::BIGINT)::DOUBLE END AS target
  FROM levels l LEFT JOIN free f ON true),
groups AS (
  SELECT source, h, sum(size) AS here FROM sized GROUP BY ALL),
runs AS (
  SELECT g.*, t.source_size, t.target, target > source_size AS whole,
         target - CASE WHEN target > source_size THEN source_size ELSE 0 END AS budget,
         sum(here) OVER (PARTITION BY g.source ORDER BY h) AS run
  FROM groups g JOIN targets t ON g.source IS NOT DISTINCT FROM t.source),
met AS (
  SELECT source, min(h) FILTER (WHERE run > budget) AS h FROM runs GROUP BY source)
SELECT s.doc_id, s.size::BIGINT AS size, r.source_size, r.target,
       (s.size * (r.whole::INT + CASE WHEN m.h IS NULL OR s.h < m.h THEN 1
                                      WHEN s.h = m.h AND (r.budget - (r.run - r.here)) * 2 > r.here THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s
JOIN runs r ON s.source IS NOT DISTINCT FROM r.source AND s.h = r.h
JOIN met m ON s.source IS NOT DISTINCT FROM m.source
"""

# CRC-32 of the decimal id: bytes reflected, polynomial 0xEDB88320, eight steps for each byte.
_CRC32 = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384::BIGINT * (xor(a, x) & 1))), 4294967295::BIGINT)"""

ORACLES["op12_trie"] = rf"""
WITH own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT conv_id, turns, conv_id - conv_id % 20 AS base, ({_CRC32}) % 4 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM heads c LEFT JOIN own b ON b.conv_id = c.base),
members AS (
  SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS ends FROM rebuilt, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(len(regexp_extract_all(path[d].t, '[^\x20\x09-\x0D]+')), 0) AS saved
  FROM members GROUP BY path, d),
children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.path = c.path),
below AS (
  SELECT path[1:k] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM known, LATERAL (SELECT unnest(range(depth + 1)) AS k) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM known n JOIN below b ON n.path = b.path LEFT JOIN known p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLES["op11_embeddings"] = rf"""
WITH RECURSIVE plain AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
         coalesce({_USABLE}, false) AS ok
  FROM embeddings),
good AS (
  SELECT n, vec_id, list_transform(v, lambda x: x / size) AS u
  FROM (SELECT *, sqrt(list_dot_product(v, v)) AS size FROM plain WHERE ok) WHERE size > 0),
links AS (
  SELECT a.n AS a, b.n AS b FROM good a JOIN good b ON a.n <> b.n AND list_dot_product(a.u, b.u) >= 0.9),
counts AS (SELECT a AS n, count(*) AS c FROM links GROUP BY a),
reached(n, seen) AS (
  SELECT n, n FROM good UNION SELECT r.n, l.b FROM reached r JOIN links l ON r.seen = l.a),
least AS (SELECT r.n, min(p.vec_id) AS component_id FROM reached r JOIN plain p ON r.seen = p.n GROUP BY r.n)
SELECT p.vec_id, coalesce(c.c, 0) AS n_links, CASE WHEN l.n IS NULL THEN p.vec_id ELSE l.component_id END AS component_id,
       p.vec_id IS NOT DISTINCT FROM (CASE WHEN l.n IS NULL THEN p.vec_id ELSE l.component_id END) AS kept
FROM plain p LEFT JOIN counts c ON p.n = c.n LEFT JOIN least l ON p.n = l.n
"""

ORACLES["op13_negatives"] = rf"""
WITH part AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
scored AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, b.n, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM part a JOIN part b ON a.n <> b.n WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, n) <= 5),
hits AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id NULLS LAST, s.n) AS rank
  FROM positives p JOIN scored s
    ON p.anchor = s.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM hits WHERE rank <= 5
"""
