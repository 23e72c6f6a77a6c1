"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own, for a local master alone: a cluster's machines would not share it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not at and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="siteselect-"))
        at = _own[0]
    return at.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write a table and read it again: its lineage ends here."""
    path = f"{folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in three parts for each core, by keys or in turn: for rows whose work is more than their bytes tell, which small files and merged shuffles leave to a few tasks."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(3 * cores, parts), *keys)
