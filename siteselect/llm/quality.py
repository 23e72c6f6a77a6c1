"""Perplexity under an interpolated modified Kneser-Ney bigram model of trusted text, with thresholds by language."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteselect.llm.common import _shuffles_cleaned, keep, map_arrow
from siteselect.llm.minhash import _mix
from siteselect.llm.scoring import _DROP, _START, _bigrams, _pack, _pack_counts, _pack_keys, _unpack, _unpack_counts, _unpack_keys, block_tokens

#: Of the trusted documents, the share that trains; the others calibrate.
TRAINS = 0.8
#: Characters of text that a message is made of; characters of the corpus for each shard of the model; bits of a shard's number at least.
BLOCK_CHARS, SHARD_CHARS, SHARD_BITS = 8_000_000, 64_000_000, 4
#: What every task has of the model, whatever its size: a bit set of 2**FILTER_BITS and the values of so many of the most frequent bigrams and words. The shards have all.
FILTER_BITS, CACHED = 27, (1 << 20, 1 << 19)
#: A document passes up to this quantile of the bits of its language's trusted ones: so many of them in a thousand would not.
QUANTILE = 0.999
#: Steps of a doubling in which frequencies are told apart, and how many.
STEPS, BINS = 16, 640
_KEY = np.uint64(64) - _DROP
_WORD = np.uint64(0xA10E5EED0000B0B5)
#: Pairs, with their words where a block sends them; what a shard of pairs asks about its words; the answers; words; counts of counts.
STORE, ASK, REPLY, WORD, PAIR_STATS, WORD_STATS = range(6)
_MODEL = "kind int, shard int, sender int, n int, a binary, b binary, c binary, d binary"
_KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_NAMES = [f.split()[0] for f in _MODEL.split(", ")]


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(_NAMES), _KINDS, strict=True)], names=_NAMES)


def _lists(table: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(table.column(c).to_pylist() for c in names), strict=True)


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from the numbers of n-grams that occur 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


def _bin(n: np.ndarray) -> np.ndarray:
    return np.minimum(STEPS * np.log2(np.maximum(n, 1)), BINS - 1).astype(np.int64)


def _stats(n: np.ndarray, *frequencies: np.ndarray) -> bytes:
    """How many counts are 1, 2, 3, 4, all, and their sum; then how many entries have each frequency."""
    head = [*(int((n == k).sum()) for k in (1, 2, 3, 4)), len(n), int(n.sum())]
    return np.concatenate([head, *(np.bincount(_bin(f), minlength=BINS) for f in frequencies)]).astype(np.int64).tobytes()


def _cut(keys: np.ndarray, top: np.uint64, bits: int) -> list[tuple[int, slice]]:
    """(shard, its slice) of sorted keys of `top` bits, by their highest ones; shards without keys are left out."""
    at = np.searchsorted(keys >> (top - np.uint64(bits)), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(s, slice(int(at[s]), int(at[s + 1]))) for s in np.flatnonzero(np.diff(at)).tolist()]


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows in tables of about BLOCK_CHARS."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= BLOCK_CHARS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _counting(bits: int):
    """A block's distinct pairs by shard: its words once, pairs as places in them, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, "text"):
            token, before, _ = block_tokens(block.column("text").to_pylist())
            grams, first, n = np.unique(_bigrams(token, before), return_index=True, return_counts=True)
            v, w, rows = before[first], token[first], []
            for shard, c in _cut(grams, _KEY, bits):
                words = np.unique(np.concatenate((v[c], w[c])))
                vi, wi = np.searchsorted(words, v[c]), np.searchsorted(words, w[c])
                order = np.lexsort((wi, vi))
                rows.append((STORE, shard, len(words), len(order), _pack_keys(words), _pack_counts(n[c][order]), _pack(np.diff(vi[order], prepend=0).astype(np.uint32)), _pack(wi[order].astype(np.uint32))))
            yield from _rows(rows).to_batches()

    return run


def _merging(bits: int):
    """A shard of pairs: its pairs and their counts, and what it asks about these: what it knows of each as context (pairs once, twice, oftener, all) and as word (pairs, all)."""

    def run(table: pa.Table) -> pa.Table:
        shard, vs, ws, ns = table.column("shard")[0].as_py(), [], [], []
        for size, n, a, b, c, d in _lists(table, "sender", "n", "a", "b", "c", "d"):
            words = _unpack_keys(a, size)
            vs.append(words[np.cumsum(_unpack(c, n, np.uint32), dtype=np.int64)])
            ws.append(words[_unpack(d, n, np.uint32)])
            ns.append(_unpack_counts(b, n))
        v, w, n = np.concatenate(vs), np.concatenate(ws), np.concatenate(ns)
        del vs, ws, ns
        grams = _bigrams(w, v)
        order = np.argsort(grams, kind="stable")
        first = np.flatnonzero(np.diff(grams[order], prepend=~grams[order[0]]))
        n = np.add.reduceat(n[order], first)
        v, w = v[order][first], w[order][first]
        del grams, order
        words = np.unique(np.concatenate((v, w)))
        vi, wi = np.searchsorted(words, v), np.searchsorted(words, w)
        order = np.lexsort((wi, vi))
        n, vi, wi = n[order], vi[order], wi[order]
        add = lambda at, of=None: np.bincount(at, of, len(words)).astype(np.int64)
        known = np.stack((add(vi[n == 1]), add(vi[n == 2]), add(vi[n > 2]), add(vi, n), add(wi), add(wi, n)))
        rows = [(STORE, shard, len(words), len(n), None, _pack_counts(n), _pack(np.diff(vi, prepend=0).astype(np.uint32)), _pack(wi.astype(np.uint32)))]
        rows += [(ASK, to, shard, c.stop - c.start, _pack_keys(words[c]), _pack_counts(np.ascontiguousarray(known[:, c]).ravel()), None, None) for to, c in _cut(words, np.uint64(64), bits)]
        return _rows([*rows, (PAIR_STATS, shard, 0, 0, _stats(n, n), None, None, None)])

    return run


def _words(bits: int):
    """A shard of words: sums over all askers go back to each, and as entries to the shards that are asked for them."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        asked = [(sender, _unpack_keys(a, n), _unpack_counts(b, 6 * n).reshape(6, n)) for sender, n, a, b in _lists(table, "sender", "n", "a", "b")]
        words = np.unique(np.concatenate([k for _, k, _ in asked]))
        known = np.zeros((6, len(words)), np.int64)
        for _, keys, own in asked:
            known[:, np.searchsorted(words, keys)] += own
        rows = [(REPLY, sender, shard, len(keys), None, _pack_counts(known[:5][:, np.searchsorted(words, keys)].ravel()), None, None) for sender, keys, _ in asked]
        keys = _named(words)
        order = np.argsort(keys)
        rows += [(WORD, to, shard, c.stop - c.start, _pack_keys(keys[order[c]]), _pack_counts(known[:, order[c]].ravel()), None, None) for to, c in _cut(keys[order], _KEY, bits)]
        word = known[4] > 0
        return _rows([*rows, (WORD_STATS, shard, 0, 0, _stats(known[4][word], np.maximum(known[3], known[5])), None, None, None)])

    return run


def _named(words: np.ndarray) -> np.ndarray:
    """The key of a word's own entry."""
    return _mix(words ^ _WORD) >> _DROP


class _Rules:
    """What turns counts into the model in back-off form: log2 p(w | v) = backs(v) + alone(w), and the gain of v w more where the bigram was seen; backs is log2 of the mass
    that v leaves to the lower order, alone that of the continuation probability, itself discounted and mixed with a uniform share."""

    def __init__(self, pairs: np.ndarray, words: np.ndarray) -> None:
        self.pair, self.word = _discounts(pairs[:4]), _discounts(words[:4])
        self.kinds = float(words[5])
        left = float(self.word[1:] @ [words[0], words[1], words[4] - words[0] - words[1]])
        self.uniform = left / self.kinds / (float(words[4]) + 1) if words[4] else 1.0

    def alone(self, before: np.ndarray) -> np.ndarray:
        """The continuation probability of words by the number of words before them."""
        return (before - self.word[np.minimum(before, 3)]) / max(self.kinds, 1.0) + self.uniform

    def taken(self, once: np.ndarray, twice: np.ndarray, more: np.ndarray) -> np.ndarray:
        return self.pair[1] * once + self.pair[2] * twice + self.pair[3] * more

    def entries(self, table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, values, frequencies) of a shard's bigrams and words, from the rows that are dealt to it. A word's value is alone, above that of an unknown one, and backs: what stands in a text as
        word stands there as context, too."""
        kinds = table.column("kind").to_numpy()
        of = {k: list(_lists(table.filter(pa.array(kinds == k)), "sender", "n", "a", "b", "c", "d")) for k in (STORE, ASK, REPLY, WORD)}
        none, out = np.empty(0), []
        grams, n, gain = np.empty(0, np.uint64), np.empty(0, np.int64), none
        for size, many, _, b, c, d in of[STORE]:
            words = np.concatenate([_unpack_keys(r[2], r[1]) for r in sorted(of[ASK], key=lambda r: r[0])])
            known = np.concatenate([_unpack_counts(r[3], 5 * r[1]).reshape(5, r[1]) for r in sorted(of[REPLY], key=lambda r: r[0])], axis=1)
            if not len(words) == known.shape[1] == size:
                raise RuntimeError(f"{size} words, {len(words)} asked, {known.shape[1]} answers")
            n, vi, wi = _unpack_counts(b, many), np.cumsum(_unpack(c, many, np.uint32), dtype=np.int64), _unpack(d, many, np.uint32)
            grams, share = _bigrams(words[wi], words[vi]), self.taken(*known[:3])[vi] * self.alone(known[4])[wi]
            gain = np.log2(1 + (n - self.pair[np.minimum(n, 3)]) / share)
        out.append((grams, gain, n))
        keys = np.concatenate([np.empty(0, np.uint64), *(_unpack_keys(r[2], r[1]) for r in of[WORD])])
        once, twice, more, total, before, count = np.concatenate([np.empty((6, 0), np.int64), *(_unpack_counts(r[3], 6 * r[1]).reshape(6, r[1]) for r in of[WORD])], axis=1)
        value = np.where(before > 0, np.log2(self.alone(before)) - math.log2(self.uniform), 0.0)  # the start is never a word,
        value += np.where(total > 0, np.log2(np.where(total > 0, self.taken(once, twice, more), 1.0) / np.maximum(total, 1)), 0.0)  # the end never a context
        out.append((keys, value, np.maximum(total, count)))
        return out


def _probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bit set; a shard's keys have both in its own part."""
    wide = np.uint64(FILTER_BITS - bits)
    return keys >> (_KEY - np.uint64(FILTER_BITS)), keys >> (_KEY - np.uint64(bits)) << wide | keys & ((np.uint64(1) << wide) - np.uint64(1))


def _digest(rules: _Rules, bits: int, least: list[int]):
    """A shard's part of the bit set, and its entries that are frequent enough to be known everywhere."""

    def run(table: pa.Table) -> pa.Table:
        shard, entries = table.column("shard")[0].as_py(), rules.entries(table)
        part = np.zeros(1 << FILTER_BITS - bits, bool)
        for at in _probes(np.concatenate([k for k, _, _ in entries]), bits):
            part[(at & np.uint64(len(part) - 1)).astype(np.int64)] = True
        often = [_bin(f) >= t for (_, _, f), t in zip(entries, least, strict=True)]
        keys, values = (np.concatenate([e[i][o] for e, o in zip(entries, often, strict=True)]) for i in (0, 1))
        return _rows([(0, shard, 0, len(keys), np.packbits(part, bitorder="little").tobytes(), keys.tobytes(), values.tobytes(), None)])

    return run


def train(trusted: DataFrame, bits: int, text_col: str = "text") -> tuple[DataFrame, _Rules, list[int]]:
    """(the model's rows by shard, its rules, the bins of frequency from which entries of each kind are known everywhere). All trusted text trains.

    Blocks of text send their distinct pairs to 2**bits shards by the pairs' hashes; shards add them up and ask other shards, those of words, for what all
    of them know of their words: how many words stand before one, and how often a context's pairs occur. No task holds more than a block or a shard, and nothing but counts of counts reaches the driver.
    """
    counted = map_arrow(trusted.select(F.col(text_col).cast("binary").alias("text")), _counting(bits), _MODEL)
    pairs = keep(counted.groupBy("shard").applyInArrow(_merging(bits), _MODEL), "pairs")
    words = keep(pairs.where(F.col("kind") == ASK).groupBy("shard").applyInArrow(_words(bits), _MODEL), "words")

    def summed(frame: DataFrame, kind: int, width: int) -> np.ndarray:
        return sum((np.frombuffer(r["a"], np.int64) for r in frame.where(F.col("kind") == kind).select("a").toLocalIterator()), np.zeros(width, np.int64))

    pair, word = summed(pairs, PAIR_STATS, 6 + BINS), summed(words, WORD_STATS, 6 + BINS)
    least = []
    for most, often in zip(CACHED, (pair[6:], word[6:]), strict=True):
        above = np.cumsum(often[::-1])[::-1]  # entries of a bin and those above it
        least.append(int((above > most).sum()))
    of_pairs = F.col("kind") == STORE  # the words that a shard asks for are its pairs' own
    stored = pairs.where(F.col("kind").isin(STORE, ASK)).select("kind", F.when(of_pairs, F.col("shard")).otherwise(F.col("sender")).alias("shard"), F.when(of_pairs, F.col("sender")).otherwise(F.col("shard")).alias("sender"), "n", "a", F.when(of_pairs, F.col("b")).alias("b"), "c", "d")
    return stored.unionByName(words.where(F.col("kind").isin(REPLY, WORD))), _Rules(pair, word), least


def perplexity(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_tokens, bits) for each row: bits is log2 of the perplexity, the mean over the words and one end. A text without words has null bits.

    The model lies in shards, as many as the corpus needs. Each block of documents asks them for what the bit set doesn't rule out and the frequent entries don't answer: bigrams,
    and rarer words, with the document that has each; the shards answer with sums for each document.
    Equal rows have equal results and are returned as often as they occur.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    bits = min(FILTER_BITS - 3, max(SHARD_BITS, math.ceil(math.log2(max(1.0, chars / SHARD_CHARS)))))
    model, rules, least = train(trusted, bits, text_col)
    with _shuffles_cleaned(spark):
        parts = model.groupBy("shard").applyInArrow(_digest(rules, bits, least), _MODEL).select("shard", "a", "b", "c").toArrow()  # as large as FILTER_BITS and CACHED say
    seen, frequent = np.zeros(1 << FILTER_BITS - 3, np.uint8), [(np.empty(0, np.uint64), np.empty(0))]
    for shard, a, b, c in _lists(parts, "shard", "a", "b", "c"):
        seen[shard * len(a) : (shard + 1) * len(a)] = np.frombuffer(a, np.uint8)
        frequent.append((np.frombuffer(b, np.uint64), np.frombuffer(c, np.float64)))
    keys, values = (np.concatenate(c) for c in zip(*frequent, strict=True))
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((seen, keys[order], values[order]))
    unknown = math.log2(rules.uniform)
    kind = docs.schema[id_col].dataType.simpleString()
    ask = f"shard int, block long, n int, keys binary, owners binary, at int, id {kind}, lang string, n_tokens long, total double"
    names = [f.split()[0] for f in ask.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, cached, value = shared.value

        def maybe(keys: np.ndarray) -> np.ndarray:
            held = np.ones(len(keys), bool)
            for at in _probes(keys, bits):
                held &= (seen[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            return held

        def known(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(which keys are frequent ones, the values of all, others 0); keys in order are found faster."""
            if not len(cached):
                return np.zeros(len(keys), bool), np.zeros(len(keys))
            at = np.minimum(np.searchsorted(cached, keys), len(cached) - 1)
            found = cached[at] == keys
            return found, np.where(found, value[at], 0.0)

        for block in _blocks(batches, "text"):
            token, before, lengths = block_tokens(block.column("text").to_pylist())
            n, name = len(lengths), int.from_bytes(hashlib.blake2b(block.column("row").to_numpy().tobytes(), digest_size=8).digest(), "little", signed=True)
            owner = np.repeat(np.arange(n, dtype=np.uint32), lengths)
            own, at = np.unique(np.concatenate((token, [_START])), return_inverse=True)
            own = _named(own)
            order = np.argsort(own)
            found, worth, open_ = np.empty(len(own), bool), np.empty(len(own)), maybe(own)
            found[order], worth[order] = known(own[order])
            open_ &= ~found
            total = unknown * lengths + np.bincount(owner, worth[at[:-1]], n) + worth[at[-1]]
            if open_[at[-1]]:  # each text has the start before it
                at, whose = np.concatenate((at[:-1], np.full(n, at[-1]))), np.concatenate((owner, np.arange(n, dtype=np.uint32)))
            else:
                at, whose = at[:-1], owner
            rare = open_[at]
            asked = [(own[at[rare]], whose[rare])]
            pairs = _bigrams(token, before)
            del token, before
            held = maybe(pairs)
            pairs, own = pairs[held], owner[held]
            order = np.argsort(pairs)
            pairs, own = pairs[order], own[order]
            found, worth = known(pairs)
            total = total + np.bincount(own, worth, n)
            asked.append((pairs[~found], own[~found]))
            keys, owner = (np.concatenate(c) for c in zip(*asked, strict=True))
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            out = [(shard, name, c.stop - c.start, _pack_keys(keys[c]), _pack(owner[c]), None, None, None, None, None) for shard, c in _cut(keys, _KEY, bits)]
            out += [(k % (1 << bits), name, 0, None, None, k, i, lang, int(m), float(t)) for k, (i, lang, m, t) in enumerate(zip(block.column("id").to_pylist(), block.column("lang").to_pylist(), lengths, total, strict=True))]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), block.schema.field("id").type, pa.string(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    asked = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col, lang_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")), run, ask)

    def answer(_key, questions: pa.Table, model_: pa.Table) -> pa.Table:
        blocks, places, sums = [], [], []
        if questions.num_rows and model_.num_rows:
            keys, values = (np.concatenate(c) for c in list(zip(*rules.entries(model_), strict=True))[:2])
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            for name, n, asked_, owners in _lists(questions.filter(pa.compute.greater(questions.column("n"), 0)), "block", "n", "keys", "owners"):
                own = _unpack_keys(asked_, n)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                of = np.bincount(_unpack(owners, n, np.uint32), weights=np.where(keys[at] == own, values[at], 0.0))
                places.append(np.flatnonzero(of))
                sums.append(of[places[-1]])
                blocks.append(np.full(len(places[-1]), name, np.int64))
        base = questions.filter(pa.compute.is_valid(questions.column("at"))).select(back_names)
        more = {"block": blocks, "at": places, "total": sums}
        kinds = {f.name: f.type for f in base.schema}
        n = sum(map(len, sums))
        return pa.concat_tables([base, pa.table({c: pa.array(np.concatenate(more[c]), kinds[c]) if n and c in more else pa.nulls(n, kinds[c]) for c in back_names})])

    back = f"block long, at int, id {kind}, lang string, n_tokens long, total double"
    back_names = [f.split()[0] for f in back.split(", ")]
    answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(answer, back)
    copies = F.sum(F.col("n_tokens").isNotNull().cast("long"))
    summed = answers.groupBy("block", "at").agg(F.first("id", True).alias("id"), F.first("lang", True).alias("lang"), F.first("n_tokens", True).alias("n_tokens"), F.sum("total").alias("total"), copies.alias("copies"))
    out = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    # blocks of the same rows have one name and have each added their sums
    return out.select("id", "lang", F.col("n_tokens") - 1, F.when(F.col("n_tokens") > 1, -F.col("total") / F.col("copies") / F.col("n_tokens")).alias("bits")).toDF("id", "lang", "n_tokens", "bits")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, trains): the documents that labels trust (label 1). Four fifths train, drawn by a hash of the id; the others calibrate."""
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    return good.withColumn("trains", F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(TRAINS * (1 << 20)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", quantile: float = QUANTILE, least: int = 20) -> DataFrame:
    """(id, lang, n_tokens, bits, threshold, passes) for each row.

    The model is trained on trusted documents; all trusted documents that did not train it give each language its threshold, the
    `quantile` of their bits (from 10,000 buckets of an approximate one). A language (null is one, too) with fewer than `least` of them takes the threshold of all together; without
    any, nothing is rejected. Texts without words do not pass.
    """
    known = keep(trusted_ids(labels, id_col, label_col), "trusted-ids")
    trusted = docs.join(known.where("trains").select(F.col("id").alias("_trusted")), F.col(id_col) == F.col("_trusted"), "left_semi")
    scored = keep(perplexity(docs, trusted, id_col, text_col, lang_col), "perplexity")
    held = keep(scored.join(known.where("not trains").select(F.col("id").alias("_id")), F.col("id") == F.col("_id")).where("bits is not null"), "calibration")
    highest = lambda frame: frame.agg(F.percentile_approx("bits", quantile, 10_000).alias("own"), F.count("*").alias("n"))
    overall = highest(held).first()["own"]
    by_lang = highest(held.groupBy(F.col("lang").alias("_lang"))).where(F.col("n") >= least).select("_lang", "own")
    joined = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    passes = F.col("bits").isNotNull() & (threshold.isNull() | (F.col("bits") <= threshold))
    return joined.select("id", "lang", "n_tokens", "bits", threshold.alias("threshold"), passes.alias("passes"))
