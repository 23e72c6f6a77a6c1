"""Resumable ingest: a stream over a folder of chunk files takes what is new and drops what it has seen."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def _committed(spark: SparkSession, target: str) -> list[str]:
    """The batches whose manifest stands. A row each: as many as there were batches."""
    try:
        return [r["batch"] for r in spark.read.schema("batch string").json(f"{target}/manifest").select("batch").distinct().collect()]
    except Exception as missing:  # nothing has been committed yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return []


def _read(spark: SparkSession, target: str, batches: Sequence[str]) -> DataFrame:
    return spark.read.option("basePath", f"{target}/data").parquet(*[f"{target}/data/batch={b}" for b in batches])


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all committed batches. What a batch wrote that did not end is not among them."""
    batches = _committed(spark, target)
    if not batches:
        raise ValueError(f"nothing has been ingested into {target}")
    return _read(spark, target, batches).drop("batch", "bucket")


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: Sequence[str], kind: str = "json", buckets: int = BUCKETS) -> int:
    """Take every file that an earlier call has not; append rows whose keys the target lacks, the first by file for each key. Returns the target's rows.

    The checkpoint holds which files are done, so a stopped run goes on where it was. A batch's rows are written under its own name, dealt to buckets by a hash of their
    keys, and count only once its manifest is written after them: one that was stopped halfway is invisible, and is written anew in its place. A batch reads the keys of
    those buckets alone that its own keys fall into. `buckets` must stay the same for a target.
    """
    stream = spark.readStream.schema(schema).format(kind).load(source).withColumn("source_file", F.col("_metadata.file_path"))
    run = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, number: int) -> None:
        name, done = f"{run}-{number}", _committed(spark, target)
        if name in done:
            return
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), "source_file").alias("r")).select("r.*")
        first = first.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        if done:
            touched = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # a number each, `buckets` at most
            known = _read(spark, target, done).where(F.col("bucket").isin(touched)).select("bucket", *keys)
            first = first.join(known, ["bucket", *keys], "left_anti")
        first.write.partitionBy("bucket").mode("overwrite").parquet(f"{target}/data/batch={name}")
        spark.createDataFrame([(name,)], "batch string").coalesce(1).write.mode("overwrite").json(f"{target}/manifest/of={name}")

    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return ingested(spark, target).count()
