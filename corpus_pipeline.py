"""A corpus pipeline of five stages, each over all that the stage before kept; counted with the subpackage llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of docs, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.llm import bpe, findings, langid, minmax, mixing, queries, secrets
from hopframe.llm._runtime import materialize

#: A prediction under this score is no decision: with L languages 1/L is a guess.
LEAST_SCORE = 0.4
#: Ids, 8 bytes each, that are broadcast rather than joined by a shuffle of all texts.
MOST_BROADCAST = 2_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts, texts without letters, predictions under LEAST_SCORE. lang becomes
    the language found. The model learns from the documents' own lang; where none has one, all with letters stay."""
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # the columns go by numbers, so that none is in the way
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = langid.identify(docs.toDF(*places.values()), model, places["text"], keep=tuple(places.values()))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("lang_pred" if c == "lang" else k).alias(c) for c, k in places.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near-duplicates (5-word shingles, similarity of 0.8
    or more). Rows that repeat a kept doc_id stay, one for each text: of equal ids and texts that with the smallest hash of
    all columns. Null ids stay."""
    groups = minmax.near_duplicates(docs.select("doc_id", "text"))
    gone = materialize(groups.where(~F.col("kept")).select("doc_id").distinct(), "duplicates")
    if gone.count() <= MOST_BROADCAST:  # else both sides are shuffled by doc_id
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(row).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mask and set n_chars anew; no document goes."""
    model = secrets.fit(findings.known_findings(spark))
    out = secrets.redact(docs, model)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents that it takes more than once are repeated, in shuffled shards."""
    return mixing.shuffled(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every row's text, and decoded_sha256, the hash of what the ids decode to."""
    return bpe.round_trip(docs, queries.tokenizer_file())


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: The stages learn models and draw at random; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
