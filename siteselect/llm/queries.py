"""The registered queries of this package: one thin query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteselect.llm import divergence, languages, licenses, lines, minhash, mixing, packing, quality, ranges, scoring, search, simhash, spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = simhash.groups(documents(spark, sf_dir).select("doc_id", "text"))
    return held.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def _tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir).select("doc_id", "text"), _tokenizer())
    return pieces.withColumnRenamed("id", "doc_id").drop("ids")


@query
def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_edits(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = languages.fit(docs.where(~languages.held_out()))
    predicted = languages.predict(docs.select("doc_id", "text"), model)
    return predicted.select(F.col("id").alias("doc_id"), languages.held_out("id").alias("held_out"), "lang_pred", "score", "accepted", "bits")


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", search.quantised(F.col("embedding")).alias("v"))
    return search.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir).select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(documents(spark, sf_dir).select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumnRenamed("id", "doc_id")


@query
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnsRenamed({"id": "vec_id", "component": "component_id"})


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir).select("lang", "source", "text"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir).select("doc_id", "text"))


OP3 = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(len(q.v)), lambda i: q.v[i + 1] * c.v[i + 1])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""


ORACLES["op3_exact_top_k"] = OP3
ORACLES["op5_license_scan"] = licenses.oracle()
ORACLES["op10_line_dedup"] = lines.ORACLE
ORACLES["op11_embedding_near_dedup"] = ranges.ORACLE
ORACLES["op12_source_divergence"] = divergence.ORACLE
