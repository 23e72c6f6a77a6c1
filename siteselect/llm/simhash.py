"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteselect.llm.common import keep, map_arrow
from siteselect.llm.components import connected

SEED = 42
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64 votes over the XXH64 of the text's word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        votes += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, row, fp long) for each row of docs; row is a hash of the text. Null and empty texts have fingerprint 0; repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, width) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["id", "row", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("binary").alias("text")), run, f"id {kind}, row long, fp long")


def _ball(half: str) -> F.Column:
    """A 32-bit segment value and its 32 neighbours at one bit, each as one long that also names the segment."""
    tag = 1 << 32 if half == "high" else 0
    value = F.shiftrightunsigned("fp", 32) if half == "high" else F.col("fp").bitwiseAND(0xFFFFFFFF)
    flips = F.array(F.lit(tag), *[F.lit(tag ^ (1 << i)) for i in range(32)])
    return F.transform(flips, lambda m: value.bitwiseXOR(m))


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at `distance` (3 at most) or fewer differing bits; each pair once.

    Two halves of 32 bits: of 3 differing bits, one half has at most one. Each fingerprint stands in the table under
    both halves and asks for the ball of radius 1 round each half. The whole distance is part of the join condition,
    so that nothing but true links leaves the join; pairs that both halves can find are taken from the high one.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32).bitwiseOR(1 << 32)
    table = fps.select(F.explode(F.array(high, low)).alias("key"), F.col("fp").alias("b"))
    asks = fps.select("fp", F.explode(F.concat(_ball("high"), _ball("low"))).alias("key")).withColumnRenamed("fp", "a")
    differ = F.expr("bit_count(a ^ b)")
    first = (asks["key"] >= (1 << 32)) | (F.expr("bit_count(shiftrightunsigned(a ^ b, 32))") > 1)
    return asks.join(table, (asks["key"] == table["key"]) & (F.col("a") < F.col("b")) & (differ <= distance) & first).select("a", "b")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """(id, row, fp, root, component): root names the group by a fingerprint of it, component is the smallest id reachable by links, the row's own included.

    Copies share a fingerprint and meet in one aggregate, so the join sees each fingerprint once, however many rows
    have it. Rows with a null id are grouped as others are; a group of null ids alone has a null component.
    """
    fps = keep(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = keep(fps.groupBy("fp").agg(F.min("id").alias("low")), "simhash-classes")
    found = connected(links(classes.select("fp"), distance)).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(lowest, "root").select("fp", "root", "component")
    return fps.join(named, "fp")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest id stays (of repeated ids that with the smaller hash of the text, of equal rows one).

    All columns of docs are kept. Rows without words form one group, as fingerprint 0 does. Rows with a null id take no part and stay.
    """
    named = docs.where(F.col(id_col).isNotNull())
    held = groups(named, id_col, text_col, width, distance)
    first = held.groupBy("root").agg(F.min(F.struct("id", "row")).alias("first")).select(F.col("first.id").alias("_simhash_id"), F.col("first.row").alias("_simhash_row"))
    stay = keep(first, "simhash-stays")
    rows = named.withColumn("_row", F.xxhash64(text_col))
    kept = rows.join(stay, (rows[id_col] == stay["_simhash_id"]) & (rows["_row"] == stay["_simhash_row"]), "left_semi").dropDuplicates([id_col, "_row"]).drop("_row")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
