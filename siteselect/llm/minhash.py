"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siteselect.llm.common import keep, map_arrow, partitions

BINS, BITS, WIDTH = 256, 4, 5
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class WordHashes(dict):
    """Hash of each word, kept while there are fewer than `limit`."""

    def __init__(self, limit: int = 300_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(text: bytes, words: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Hashes of the text's word shingles (ASCII lower case, split at ASCII white space); the whole sequence if it is shorter."""
    split = text.lower().split()
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), dtype=np.uint64, count=len(split))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        out = _mix(out * _ODD + h[i : i + n])
    return out


def _ranks(bins: int) -> np.ndarray:
    """Bin by bin: the order in which an empty bin asks the others, a pseudo-random sequence of its own; the same for all documents."""
    at = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
    return _mix(at + np.uint64(77)).argsort(axis=1).argsort(axis=1)


_RANKS: dict[int, np.ndarray] = {}


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """Smallest hash in each bin; None without shingles. `bins` is a power of two and a hash's high bits are its bin.

    Empty bins take the value of another bin by optimal densification: each asks the bins in a fixed pseudo-random order of its own,
    and the first that was filled answers. Two sets with the same filled bin and value so agree in the copy too.
    """
    if not len(hashes):
        return None
    shift = np.uint64(64 - bins.bit_length() + 1)
    ordered = np.sort(hashes)
    at = ordered >> shift
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    filled = np.zeros(bins, bool)
    values = np.zeros(bins, np.uint64)
    filled[at[first].astype(np.int64)] = True
    values[at[first].astype(np.int64)] = ordered[first]
    empty, full = np.flatnonzero(~filled), np.flatnonzero(filled)
    if len(empty):
        if bins not in _RANKS:
            _RANKS[bins] = _ranks(bins)
        ranks = _RANKS[bins]
        values[empty] = values[full[ranks[np.ix_(empty, full)].argmin(axis=1)]]
    return values


def packed(values: np.ndarray | None, bits: int = BITS, bins: int = BINS) -> bytes:
    """The low-order bits of each bin, packed; empty bytes for a text without shingles.

    Value and bin are mixed first, so that values copied into many bins agree by chance in each bin on its own.
    """
    if values is None:
        return b""
    low = (_mix(values + _ODD * np.arange(1, bins + 1, dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    each = np.unpackbits(low[:, None], axis=1)[:, 8 - bits :]
    return np.packbits(each.reshape(-1)).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS, bins: int = BINS) -> float:
    """Estimated resemblance: the share of equal bins, freed from the 2**-bits that agree by chance; 0 to 1.

    Two texts without shingles are alike (1); such a text and another are not (0).
    """
    if not a or not b:
        return float(a == b)
    x = np.unpackbits(np.frombuffer(a, np.uint8)).reshape(bins, bits)
    y = np.unpackbits(np.frombuffer(b, np.uint8)).reshape(bins, bits)
    share = float((x == y).all(axis=1).mean())
    chance = 2.0**-bits
    return min(1.0, max(0.0, (share - chance) / (1 - chance)))


def fingerprint(text: bytes | None, words: WordHashes, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> bytes:
    return packed(sketch(shingle_hashes(text or b"", words, width), bins), bits, bins)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """(id, fingerprint binary) for each row; a text without words, or null, has an empty fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            prints = [fingerprint(t, words, bins, bits, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["id", "fingerprint"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), run, f"id {kind}, fingerprint binary")


def edited(text: str, following: str) -> str:
    """The text whose last third (of code points, rounded down) is replaced by as many first ones of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_RESULT = "doc_id {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(doc: object, text: str, own: bytes, following: str, next_print: bytes, words: WordHashes) -> tuple:
    changed = edited(text, following).encode("utf-8", "replace")
    other = fingerprint(changed, words)
    return (doc, len(text), hashlib.sha256(changed).hexdigest(), own.hex(), other.hex(), likeness(own, other), likeness(own, next_print))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its fingerprint, that of its edited text (see `edited`, with the next row by descending id, after the last the first), and likenesses.

    Null texts are empty. Ids keep their type. Rows of equal ids follow each other in the order of their texts' xxhash64, then of the texts; null ids come last. An only
    row follows itself. Texts may be of any length; other columns are not looked at.

    Texts are dealt out by range of id once and stand sorted in their partition, so that a row's follower is the next row; only
    each partition's first and last row are joined across partitions, through one small written table.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    result = _RESULT.format(rows.schema["doc_id"].dataType.simpleString())
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())
    names = ["kind", "part", *[f.split()[0] for f in result.split(", ")], "text"]
    kinds = [pa.string(), pa.int32(), to_arrow_type(rows.schema["doc_id"].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        last: tuple | None = None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out = []
            for doc, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = fingerprint(text.encode("utf-8", "replace"), words)
                if last is None:
                    out.append(("head", part, doc, None, None, None, None, None, None, text))
                else:
                    out.append(("row", part, *_compare(last[0], last[1], last[2], text, own, words), None))
                last = (doc, text, own, part)
            if out:
                yield batch_of(out)
        if last is not None:
            yield batch_of([("tail", last[3], last[0], None, None, None, None, None, None, last[1])])

    done = keep(map_arrow(ranged, run, f"kind string, part int, {result}, text string"), "edits")
    ends = done.where("kind <> 'row'").select("kind", "part", "doc_id", "text")
    # one head and one tail for each partition that has rows: the head after a tail is the next partition's, or the first
    parts = sorted(r["part"] for r in ends.where("kind = 'head'").select("part").collect())
    follow = docs.sparkSession.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, next_part int")
    heads = ends.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    pairs = ends.where("kind = 'tail'").join(follow, "part").join(heads, "next_part").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            out = []
            for doc, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, other = (fingerprint(t.encode("utf-8", "replace"), words) for t in (text, following))
                out.append(_compare(doc, text, own, following, other, words))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds[2:9], strict=True)], names[2:9])

    return done.where("kind = 'row'").select(*names[2:9]).unionByName(map_arrow(pairs, finish, result))
