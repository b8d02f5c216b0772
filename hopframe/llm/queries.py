"""Queries op1 to op10 and the pipeline over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embdedup, findings, langid, licenses, minmax, mixing, secrets, toxicity, warc


def tokenizer_file() -> str:
    """The public word-level BPE file, found by the package that ships it on each machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _fold(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.fit(findings.known_findings(spark))
    found = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)
    return found.withColumn("value_sha256", F.sha2("value", 256)).drop("value")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(_fold(4) == 2, F.lit(False))
    model = langid.fit(docs.where(_fold(4) != 2))
    return langid.identify(docs.select("doc_id", "text", held.alias("held_out")), model, keep=("doc_id", "held_out"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(_fold(5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels.where(_fold(5) != 0))
    return toxicity.score(docs.select("doc_id", "text", held.alias("held_out")), model, keep=("doc_id", "held_out"))


def op5_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, F.col("vec_id") % 100 == 0)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    taken = (F.size("mix_draws") * F.col("mix_size")).cast("long").alias("taken")
    shards = F.transform("mix_draws", lambda d: d["shard"]).alias("shards")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken, shards)


def op8_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return minmax.near_duplicates(docs, width=4, percent=80)


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_language_id": op2_language_id,
        "op3_bpe_round_trip": op3_bpe_round_trip,
        "op4_toxicity": op4_toxicity,
        "op5_permutation_search": op5_permutation_search,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_splitting_tree_mix": op7_splitting_tree_mix,
        "op8_minmax_near_dedup": op8_minmax_near_dedup,
        "op9_warc_round_trip": op9_warc_round_trip,
        "op10_license_scan": op10_license_scan,
    }


#: A-Z to a-z alone: lower() would also map letters outside ASCII.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL8 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


#: The exact search. The index may miss a neighbour; on the smallest tables it finds them all, and distances are equal to the
#: last bit, as squares are added in the same order.
_SQL5 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_reduce(list_transform(range(1, len(a.e) + 1), lambda j: (b.e[j] - a.e[j]) * (b.e[j] - a.e[j])), lambda x, y: x + y)) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e))
SELECT query_id, r::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS r FROM d) WHERE r <= 10
"""

_SQL6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.r = link.a),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""

_SQL9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
t AS (SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN p.page_id <> t.top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id <> t.top THEN t.top END AS refers_to
FROM p LEFT JOIN t ON p.h = t.h AND p.n >= 1000
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_permutation_search": _SQL5, "op6_embedding_near_dedup": _SQL6, "op8_minmax_near_dedup": _SQL8, "op9_warc_round_trip": _SQL9, "op10_license_scan": licenses.oracle()}
