"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import (
    decontaminate,
    divergence,
    langid,
    licenses,
    minhash,
    negatives,
    packing,
    pii,
    quality,
    repeats,
    secrets,
    spans,
    tokencount,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file of the packing query, or another; it lies beside the library on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), vocabulary())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.label(table(spark, folder, "documents"))


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


@query
def op4_personal(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(table(spark, folder, "documents")).select(
        "doc_id",
        *[spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        spans.digest(F.col("base"), pii.KINDS).alias("base_sha256"),
        spans.written(F.col("spans")).alias("spans"),
    )


@query
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = F.col("spans")
    base = ("assign", "access", "hex")
    return secrets.scan(table(spark, folder, "documents")).select(
        "doc_id",
        *[spans.count_of(found, k).alias(f"n_{k}") for k in base],
        spans.digest(found, base).alias("base_sha256"),
        spans.written(found).alias("spans"),
    )


@query
def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return repeats.kept_texts(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.per_document(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# Containment by comparing every shingle of every item; the words and shingles are those of the operator.
ORACLES["op8_decontamination"] = """
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT side, id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS words FROM t),
s AS (
  SELECT DISTINCT side, id, unnest(CASE
    WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
size AS (SELECT id, count(*) AS size FROM s WHERE side = 'b' GROUP BY id),
hit AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared
  FROM s d JOIN s b ON d.side = 'd' AND b.side = 'b' AND d.shingle = b.shingle GROUP BY 1, 2),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS item_ids,
    max(shared / CAST(size AS DOUBLE)) AS containment
  FROM hit JOIN size ON item_id = id WHERE shared * 100 >= size * 75 GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items,
  coalesce(item_ids, '') AS item_ids, coalesce(containment, 0) AS containment
FROM documents LEFT JOIN found USING (doc_id)
"""


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("spans")


@query
def op11_tokens(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokencount.count(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


# Every word of every group evaluated by itself, without cells.
ORACLES["op12_divergence"] = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
t AS (SELECT lang, term, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
l AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS total FROM t GROUP BY 1),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM d SEMI JOIN t USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // CAST(coalesce(s.total, 0) + 2 * l.v AS HUGEINT) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (t.n + 2) // CAST(l.total + 2 * l.v AS HUGEINT) AS q
  FROM g JOIN t USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
    LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
rows_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN summed m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM rows_)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query
def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mine(table(spark, folder, "embeddings"))


# All products of anchors and rows.
ORACLES["op13_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.*, other AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
