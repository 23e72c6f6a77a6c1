"""Packing tokenised documents into fixed-length sequences along a Hilbert curve."""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteselect.llm.common import keep, map_arrow, partitions

#: Entries of a worker's cache of words and pieces; a full one is emptied, so that a worker's memory is bounded.
CACHE_PIECES = 1_000_000
#: Longer words and pieces are looked at each time.
CACHE_LENGTH = 64
#: Texts of these characters alone are cut into words and pieces here, after lower-casing, as `_word_level` tokenizers cut them.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\s0-9²³¹¼½¾a-zªµºß-öø-ÿ]+")
#: Fixed values of the tokenizer file format: how a tokenizer of the kind that `_PIECES` follows normalises and cuts texts.
_NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Byte-level vocabularies write each byte as a character: printable bytes as themselves, the others, in order, from 256 on.
_SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SEEN)}


def _word_level(tokenizer) -> bool:
    """Whether the tokenizer lower-cases, drops white space and cuts the rest as `_PIECES` does, and adds nothing."""
    told = json.loads(tokenizer.to_str())
    cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    regular = len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": _CUT} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
    bytewise = regular and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
    special = all(t["special"] and t["content"].startswith("<|") for t in told["added_tokens"])
    return bool(bytewise and special and told["post_processor"] is None and (told["normalizer"] or {}).get("normalizers") == _NORMALISERS)


class TextIds:
    """From texts to packed ids.

    A word-level tokenizer gives the ids of a text as those of its words, one after the other, and those of a word as its pieces'; a corpus repeats
    both, so that most words are looked up and only new pieces are encoded. Texts with characters beyond Latin ones, or with a
    special token, are cut at ASCII white space and those chunks encoded. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.word_level, self.model = _word_level(self.tokenizer), self.tokenizer.model
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece, which the model's merges alone decide."""
        written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        return array("H" if self.dtype == "<u2" else "I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _new(self, fresh: set[str]) -> dict[str, bytes]:
        """The ids of words, by way of their pieces; a word of letters is one piece."""
        known, found = self.known, {}
        for word in fresh:
            if word.isalpha():
                found[word] = self._piece(word)
                continue
            parts = []
            for piece in _PIECES.findall(word):
                ids = known.get(piece) or found.get(piece)
                if ids is None:
                    ids = found[piece] = self._piece(piece)
                parts.append(ids)
            found[word] = b"".join(parts)
        return found

    def _odd(self, text: str) -> bytes:
        return b"".join(map(self._encode, re.split("[ \t\n\r\x0b\x0c]+", text.strip(" \t\n\r\x0b\x0c"))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if not self.word_level:
            return [self._encode(t) for t in texts]
        cut = [t.lower().split() if _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        looked = [None if words is None else list(map(self.known.get, words)) for words in cut]
        found = self._new({w for words, ids in zip(cut, looked, strict=True) if ids and None in ids for w, i in zip(words, ids, strict=True) if i is None})
        out = []
        for text, words, ids in zip(texts, cut, looked, strict=True):
            if ids is None:
                out.append(self._odd(text))
            else:
                out.append(b"".join([found[w] if i is None else i for w, i in zip(words, ids, strict=True)] if None in ids else ids))
        if len(self.known) + len(found) > CACHE_PIECES:
            self.known.clear()
        self.known.update((w, i) for w, i in found.items() if len(w) <= CACHE_LENGTH)
        return out


@functools.lru_cache(maxsize=2)
def _ids(path: str) -> TextIds:
    return TextIds(path)


#: Hashed features, curve dimensions and bits for each dimension; dims * bits <= 62.
FEATURES, DIMS, BITS = 256, 4, 12


@functools.lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(7).choice([-1.0, 1.0], size=(FEATURES, DIMS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert key of each row of an (n, d) array of integers below 2**bits: axes to transposed index, then interleaved.

    Neighbours in key order differ by one step in one dimension.
    """
    x = points.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(token_ids: list[np.ndarray]) -> np.ndarray:
    """A key for each document: hashed bag of tokens, square-root damped and normalised, projected by signs to DIMS."""
    vectors = np.empty((len(token_ids), FEATURES))
    for row, ids in enumerate(token_ids):
        slots = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
        vectors[row] = np.sqrt(np.bincount(slots, minlength=FEATURES)[:FEATURES])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    flat = np.clip((vectors @ _projection()) / 4.0 + 0.5, 0, 1)
    return hilbert(np.minimum((flat * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenise(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """(id, key, n, wide, ids binary) for each row: its token ids with end_id after them, packed by 2 or 4 bytes, and its curve key."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _ids(tokenizer_path)
        wide = np.dtype(texts.dtype).itemsize
        end = np.asarray([end_id], dtype=texts.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = [p + end for p in texts.encode([t or "" for t in part.column(1).to_pylist()])]
                keys = curve_keys([np.frombuffer(p, dtype=texts.dtype) for p in packed])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.int64()), pa.array([len(p) // wide for p in packed], pa.int64()), pa.array([wide] * len(packed), pa.int32()), pa.array(packed, pa.binary())], ["id", "key", "n", "wide", "ids"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, key long, n long, wide int, ids binary")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's first token, counted within its partition."""
    total = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n, pa.int64())], [*batch.schema.names, "at"])
        total = int(ends[-1]) if len(ends) else total


def _tail(left: int) -> list[int]:
    """A last stretch of fewer tokens than a sequence, as powers of two from large to small: none of them is padded."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def cut(first: int, n: int, total: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a document whose tokens stand at first..first+n of total."""
    full = total // length
    bounds = [full * length]
    for size in _tail(total - full * length):
        bounds.append(bounds[-1] + size)
    at, stop = first, first + n
    while at < stop:
        if at < bounds[0]:
            sequence, low, high = at // length, at // length * length, (at // length + 1) * length
        else:
            k = next(i for i in range(len(bounds) - 1) if at < bounds[i + 1])
            sequence, low, high = full + k, bounds[k], bounds[k + 1]
        end = min(stop, high)
        yield at - first, end - at, sequence, at - low
        at = end


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece: id, start, length, ids (binary, unsigned 32-bit little-endian), ids_crc32, doc_tokens, sequence_id, offset.

    Documents stand in the order of their Hilbert keys (ties: by id) and form one stream, which is cut into sequences of `length`; the stream's
    rest is cut into powers of two. So no sequence needs padding and each document is cut once for each `length` tokens at most, and once more.
    A null text is empty: its only token is end_id. Repeated rows are packed as often as they occur. Null ids sort first.

    The tokenised rows are written once, dealt out by range on (key, id) and written again with their place in the partition; what reaches the
    driver's plan is one number for each partition.
    """
    spark = docs.sparkSession
    tokens = keep(tokenise(docs, tokenizer_path, id_col, text_col, end_id), "tokens")
    parts = max(partitions(docs), int(tokens.count() // 200_000) + 1)
    kind = docs.schema[id_col].dataType.simpleString()
    ranged = tokens.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    placed = ranged.mapInArrow(_number, f"id {kind}, key long, n long, wide int, ids binary, at long").withColumn("part", F.spark_partition_id())
    placed = keep(placed.select("id", "n", "wide", "ids", "at", "part"), "placed")
    sums = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each partition
    bases, total = {}, 0
    for part in sorted(sums):
        bases[part] = total
        total += sums[part]
    shared = spark.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for doc, n, wide, ids, at, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = np.frombuffer(ids, dtype="<u2" if wide == 2 else "<u4").astype("<u4")
                for start, size, sequence, offset in cut(base[part] + at, n, total, length):
                    piece = whole[start : start + size].tobytes()
                    rows.append((doc, start, size, piece, zlib.crc32(piece), n, sequence, offset))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, f"id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
