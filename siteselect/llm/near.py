"""Near-duplicate documents: SimHash fingerprints of op6 and MinHash bands of five-word shingles name candidates, the exact Jaccard similarity of the shingle sets decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteselect.llm import simhash
from siteselect.llm.common import keep, map_arrow
from siteselect.llm.components import connected
from siteselect.llm.minhash import WordHashes, shingle_hashes

WIDTH = 5
#: Documents match at a Jaccard similarity of NUM / DEN or more; kept as integers, so that no comparison rounds.
NUM, DEN = 4, 5
#: Bands of ROWS minima each: a pair of similarity 0.8 shares no band, and is missed, once in (1 - 0.8^4)^-24, or about 300,000 times.
BANDS, ROWS = 24, 4
#: Rounds in which buckets are compared with their earliest document only. What is undecided then falls apart into groups that share buckets; groups up to
#: GROUP_DOCS documents and GROUP_SHINGLES shingles are settled in a task each, and for larger ones such rounds go on.
LEADER_ROUNDS, GROUP_DOCS, GROUP_SHINGLES = 5, 4096, 8_000_000
#: Words whose hashes a task keeps; shingles whose minima are taken at a time.
WORDS, _CHUNK = 100_000, 1024

_RNG = np.random.default_rng(5)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes | None, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    return np.unique(shingle_hashes(text or b"", words, WIDTH))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band: what two sets with the same minima in it share. Sets without shingles have none."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (hashes[at : at + _CHUNK, None] * _ODD + _ADD).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=band) - (1 << 63) for band, row in enumerate(least.reshape(BANDS, ROWS))]


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, cls, bands): `row` is a hash of the text, so that rows of one id stay apart unless they are equal; cls one of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes(WORDS)
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(2).to_pylist()]
            classes = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes, pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64()))], ["id", "row", "cls", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("binary").alias("text")), run, f"id {kind}, row long, cls long, bands array<long>")


def _simhash_posts(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, first, key): buckets that op6's operator names, beside the bands: a fingerprint of five-word shingles and those at 3 or fewer differing bits from it that are larger.

    Each class comes in with the fingerprint of its first row, once, whatever number of copies it has; those without words (fingerprint 0) have no bucket.
    """
    firsts = classes.select("cls", "first", F.col("first.id").alias("id"), F.col("first.row").alias("row"))
    fps = keep(simhash.fingerprints(docs, id_col, text_col, WIDTH).where("fp <> 0").join(firsts, ["id", "row"]).select("cls", "first", "fp").dropDuplicates(["cls"]), "near-simhash")
    pairs = simhash.links(fps.select("fp").distinct())
    met = fps.join(pairs.select(F.col("b").alias("fp"), F.col("a").alias("lead")), "fp").select("cls", "first", F.col("lead").alias("fp"))
    return fps.unionByName(met).select("cls", "first", F.xxhash64(F.lit("simhash"), "fp").alias("key"))


def _sets(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, set): the shingle hashes of the classes in firsts (cls, first), read from the text of their first rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes(WORDS)
        for batch in batches:
            sets = [shingles(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["cls", "set"])

    wanted = firsts.select("cls", F.col("first.id").alias("id"), F.col("first.row").alias("row"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(texts.join(wanted, ["id", "row"]).select("cls", "text"), run, "cls long, set array<long>").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets do have the similarity."""
    sizes = sets.select("cls", F.size("set").alias("n"))
    of = lambda side: sizes.toDF(side, f"n{side}")
    fitting = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM).select("a", "b")
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    shared = F.size(F.array_intersect("sa", "sb"))
    return fitting.join(left, "a").join(right, "b").where(shared * (NUM + DEN) >= (F.size("sa") + F.size("sb")) * NUM).select("a", "b")


def _greedy(table: pa.Table) -> pa.Table:
    """Of a group's rows (cls, first, keys, set) those that go: by id each is compared with the ones before that stay and share a bucket."""
    rows = sorted(zip(table.column("first").to_pylist(), *(table.column(c).to_pylist() for c in ("cls", "keys")), range(table.num_rows), strict=True), key=lambda r: (*r[0].values(), r[1]))
    sets = [np.asarray(v.values) for v in table.column("set")]
    held: dict[int, list[int]] = {}
    gone = []
    for _, cls, keys, at in rows:
        own = sets[at]
        met = {other for key in keys for other in held.get(key, ())}
        if any(len(np.intersect1d(own, sets[other], assume_unique=True)) * (NUM + DEN) >= (len(own) + len(sets[other])) * NUM for other in met):
            gone.append(cls)
        else:
            for key in keys:
                held.setdefault(key, []).append(at)
    return pa.table({"cls": pa.array(gone, pa.int64())})


def _settled(posts: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls) of the classes that go in groups small enough for a task, and the posts (key, cls, first) of the other groups."""
    groups = connected(posts, "cls", "key").withColumnsRenamed({"node": "cls", "component": "group"})
    members = posts.groupBy("cls").agg(F.first("first").alias("first"), F.collect_list("key").alias("keys"))  # BANDS keys and those of links
    named = members.join(groups, "cls").join(sets.select("cls", F.size("set").alias("n")), "cls")
    sizes = keep(named.groupBy("group").agg(((F.count("*") <= GROUP_DOCS) & (F.sum("n") <= GROUP_SHINGLES)).alias("fits")), "near-groups")
    dealt = keep(named.join(sizes, "group").select("cls", "first", "keys", "group", "fits"), "near-dealt")
    whole = dealt.where("fits").join(sets, "cls").select("group", "cls", "first", "keys", "set")
    gone = keep(whole.groupBy("group").applyInArrow(_greedy, "cls long"), "near-gone")
    return gone, keep(posts.join(dealt.where("not fits").select("cls"), "cls", "left_semi").select("key", "cls", "first"), "near-posts")


def _removed(classes: DataFrame, more: DataFrame, sets_of) -> DataFrame:
    """(cls): the classes like an earlier one that stays. classes is (cls, first, bands); more (cls, first, key) are further buckets.

    A class is decided once no earlier undecided one shares a bucket with it: it stays, and what is like it goes. In each round those that come first
    in all their buckets stay, and only they are compared with the others there, so that a large group of copies is compared with its first document alone.
    Every LEADER_ROUNDS rounds, groups of undecided classes that are small enough are settled at once, whatever number of rounds they would take.
    """
    posts = keep(classes.select("cls", "first", F.explode("bands").alias("key")).unionByName(more), "near-posts")
    shared = posts.groupBy("key").agg((F.count("*") > 1).alias("more")).where("more").select("key")
    posts = keep(posts.join(shared, "key", "left_semi"), "near-posts")
    sets = keep(sets_of(posts.groupBy("cls").agg(F.first("first").alias("first"))), "near-sets")
    gone, rounds = [], 0
    while not posts.isEmpty():
        if rounds and rounds % LEADER_ROUNDS == 0:
            settled, posts = _settled(posts, sets)
            gone.append(settled)
            if posts.isEmpty():
                break
        rounds += 1
        lead = posts.groupBy("key").agg(F.min(F.struct("first", "cls")).alias("l")).select("key", F.col("l.cls").alias("lead"))
        met = keep(posts.join(lead, "key"), "near-met")
        stay = keep(met.groupBy("cls").agg(F.every(F.col("cls") == F.col("lead")).alias("all")).where("all").select("cls"), "near-stay")
        pairs = met.where("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
        pairs = keep(pairs.join(stay.select(F.col("cls").alias("a")), "a", "left_semi"), "near-pairs")
        gone.append(keep(_verified(pairs, sets).select(F.col("b").alias("cls")).distinct(), "near-gone"))
        posts = keep(met.join(stay.union(gone[-1]), "cls", "left_anti").select("key", "cls", "first"), "near-posts")
    out = classes.select("cls").limit(0)
    for part in gone:
        out = out.union(part)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: a row goes if a row of a smaller id stays whose five-word shingles have a Jaccard similarity of 0.8 or more with its own.

    So no two rows that stay are near-duplicates, and for each that goes a near-duplicate stays. A text of fewer than five words is one shingle. Of rows with
    equal shingle sets the smallest id stays (of repeated ids the smaller hash of the text, of equal rows one); those without words have an empty set each.
    All columns are kept. Rows with a null id take no part and stay.
    """
    named = docs.where(F.col(id_col).isNotNull())
    sketches = keep(_sketches(named, id_col, text_col), "near-sketches")
    classes = keep(sketches.groupBy("cls").agg(F.min(F.struct("id", "row")).alias("first"), F.first("bands").alias("bands")), "near-classes")
    gone = _removed(classes, _simhash_posts(named, classes, id_col, text_col), lambda firsts: _sets(named, firsts, id_col, text_col))
    stay = keep(classes.select("cls", "first").join(gone, "cls", "left_anti").select(F.col("first.id").alias("_near_id"), F.col("first.row").alias("_near_row")), "near-stays")
    rows = named.withColumn("_row", F.xxhash64(text_col))
    kept = rows.join(stay, (rows[id_col] == stay["_near_id"]) & (rows["_row"] == stay["_near_row"]), "left_semi").dropDuplicates([id_col, "_row"]).drop("_row")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
