"""A corpus from raw documents to packed sequences: language, repeated lines, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; its result is written
and read again before the next stage. All but the last keep the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteselect.llm import languages, lines, mixing, near, packing
from siteselect.llm.common import keep


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach; the others go."""
    return languages.accepted(docs, languages.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line leave their texts, however few words they have; texts that have nothing left go."""
    return lines.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose five-word shingles have a Jaccard similarity of 0.8 or more with those of an earlier one that stays go; op6's fingerprints, and MinHash bands
    for what they miss, name the pairs that are compared."""
    return near.deduplicate(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those that it does not take go."""
    return mixing.expand(docs, mixing.mix(docs.select("doc_id", "text", "source")))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence, with its token ids' CRC-32."""
    import public_tokenizers

    pieces = packing.pack(docs.select("doc_id", "text"), str(public_tokenizers.path("word_bpe_49k.json")))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", sequence_packing),
]

#: Trained models and Newton's iterations stand between the tables; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = keep(docs, name)
    return docs
