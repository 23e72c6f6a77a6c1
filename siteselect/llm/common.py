"""Shared small helpers: the shared scratch folder, written intermediate tables and Arrow batch limits."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing that leaves every other character alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_scratch: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own, for a local master alone: a cluster's machines would not share it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="siteselect-"))
    return _own_scratch[0]


@contextlib.contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """While it lasts, an action's shuffle files go as soon as it is over: its result is written by then, so that nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def keep(df: DataFrame, name: str, codec: str = "zstd", options: dict[str, int] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_cleaned(spark):
        df.write.options(compression=codec, **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds at once; texts can be long, so the default of 10,000 rows is too many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def trim() -> None:
    """Give free memory of Arrow's pool and of the C heap back to the system; without effect where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, in small batches; a worker gives its memory back when its rows end, as it waits for its next task beside the JVM, which needs it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def partitions(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, read when the plan is built."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
