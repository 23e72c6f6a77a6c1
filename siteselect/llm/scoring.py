"""Language-model scores by deleted interpolation, with counts joined in hash shards."""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteselect.llm.common import keep, small_batches
from siteselect.llm.minhash import WordHashes, _mix

#: About how many characters of text form a block, and how many keys a shard holds.
BLOCK_CHARS, SHARD_KEYS = 8_000_000, 1_500_000
#: Bits of a key that one hop tells apart: nobody sends to more than 2**HOP_BITS others, however many shards there are. A hop moves all keys once
#: more, so it is as wide as leaves a hundred bigrams of a block to a message.
HOP_BITS = 12
#: Classes of documents: not trained on, trained on and used to learn the mixture weights, trained on otherwise.
TEST, HELD, TRAIN = 0, 1, 2
BUCKETS, STEPS, BINS = 24, 4, 160
_START, _END = np.uint64(0x51AB1E5EED0000F1), np.uint64(0xE0D0FD0C5EED00A7)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a bigram's hash that travel; of 10**12 distinct bigrams, one in 70,000 shares its count with another.
_DROP = np.uint64(8)


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of an array of integers, compressed: high planes of small numbers all but vanish."""
    wide = values.dtype.itemsize
    return pa.compress(values.view(np.uint8).reshape(-1, wide).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, dtype: type) -> np.ndarray:
    wide = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * wide, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(wide, n).T).view(dtype).reshape(-1)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n, np.uint64), dtype=np.uint64)


def block_tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, hash of the token before it, tokens of each text): words in ASCII lower case, then one end."""
    words = WordHashes()
    split = [(t or b"").lower().split() for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split)) + 1
    ends = np.cumsum(lengths) - 1
    total = int(lengths.sum())
    inner = np.ones(total, bool)
    inner[ends] = False
    token = np.full(total, _END, np.uint64)
    token[inner] = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.uint64, total - len(split))
    before = np.empty(total, np.uint64)
    before[1:] = token[:-1]
    before[ends - lengths + 1] = _START
    return token, before, lengths


def _bigrams(token: np.ndarray, before: np.ndarray) -> np.ndarray:
    return _mix(before * _ODD + token) >> _DROP


def _pack_counts(values: np.ndarray) -> bytes:
    """Counts as 4 bytes each, or as 8 where one needs them; the first byte says which."""
    kind = np.uint64 if len(values) and int(values.max()) >> 32 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + _pack(values.astype(kind))


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    return _unpack(data[1:], n, np.uint64 if data[0] == 8 else np.uint32).astype(np.int64)


#: A message up: a sender's distinct keys of one range, and how often its training documents have each. A message down: the shards' sums for them.
_ASK = "kind int, shard int, block int, cls int, n int, keys binary, counts binary"
_REPLY = "kind int, shard int, block int, cls int, n int, counts binary, kept binary, distinct long, total long"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _messages(kind: int, parent: int, hop: int, bits: int, block: int, cls: int, keys: np.ndarray, counts: np.ndarray | None) -> list[tuple]:
    """Sorted keys within the range `parent`, cut into its 2**hop parts, which are those of the highest `bits` bits; parts without keys get no message."""
    shift = np.uint64((64 if kind == 1 else 64 - int(_DROP)) - bits)
    parts = np.arange(parent << hop, (parent + 1 << hop) + 1, dtype=np.uint64)
    at = np.searchsorted(keys >> shift, parts)
    cut = [(int(parts[i]), slice(at[i], at[i + 1])) for i in np.flatnonzero(np.diff(at)).tolist()]
    return [(kind, part, block, cls, int(c.stop - c.start), _pack_keys(keys[c]), b"" if counts is None else _pack_counts(counts[c])) for part, c in cut]


def _ask(hop: int):
    """A block's distinct unigrams (kind 1, with the start as one) and bigrams (kind 2), by range, with their counts in the block."""

    def run(table: pa.Table) -> pa.Table:
        block, cls = table.column("block")[0].as_py(), table.column("cls")[0].as_py()
        token, before, lengths = block_tokens(table.column("text").to_pylist())
        rows = []
        for kind, values in ((1, np.concatenate((token, np.full(len(lengths), _START)))), (2, _bigrams(token, before))):
            keys, counts = np.unique(values, return_counts=True)
            rows += _messages(kind, 0, hop, hop, block, cls, keys, None if cls == TEST else counts)
        return _table(rows, _ASK)

    return run


def _asked(table: pa.Table) -> list[tuple[int, int, np.ndarray, np.ndarray | None]]:
    """(block, class, keys, counts) of each message; those of documents that are not trained on have no counts."""
    columns = (table.column(f).to_pylist() for f in ("block", "cls", "n", "keys", "counts"))
    return [(b, c, _unpack_keys(k, n), _unpack_counts(x, n) if c != TEST else None) for b, c, n, k, x in zip(*columns, strict=True)]


def _summed(asks: list[tuple[int, int, np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for _, _, k, _ in asks])) if asks else np.empty(0, np.uint64)
    counts = np.zeros(len(keys), np.int64)
    for _, _, k, x in asks:
        if x is not None:
            counts[np.searchsorted(keys, k)] += x
    return keys, counts


def _pass_on(hop: int, level: int):
    """What a group of senders has in one range, added up and sent on to the parts of the range in the name of the group."""

    def run(table: pa.Table) -> pa.Table:
        kind, shard, group, cls = (table.column(f)[0].as_py() for f in ("kind", "shard", "grp", "cls"))
        keys, counts = _summed(_asked(table))
        return _table(_messages(kind, shard, hop, hop * level, group, cls, keys, None if cls == TEST else counts), _ASK)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """A shard's sums over all documents, for each sender in the order of its keys: all training counts, and for those that learn the weights the counts
    without the documents that learn. One more row (block -1) counts the shard's distinct training tokens and all of them."""
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    asks = _asked(table)
    keys, whole = _summed([a for a in asks if a[1] != TEST])
    kept = np.zeros(len(keys), np.int64)
    for _, c, k, x in asks:
        if c == TRAIN:
            kept[np.searchsorted(keys, k)] += x
    rows = []
    real = keys != _START
    if kind == 1:
        rows.append((kind, shard, -1, TRAIN, 0, None, None, int(real.sum()), int(whole[real].sum())))
        rows.append((kind, shard, -2, TRAIN, 0, None, None, 0, int(kept[real].sum())))
    # a key that no training document has is looked up behind the last
    whole, kept = np.append(whole, 0), np.append(kept, 0)
    for block, cls, asked, _ in asks:
        at = np.searchsorted(keys, asked)
        at = np.where((at < len(keys)) & (keys[np.minimum(at, max(len(keys) - 1, 0))] == asked) if len(keys) else False, at, len(keys))
        rows.append((kind, shard, block, cls, len(asked), _pack_counts(whole[at]), _pack_counts(kept[at]) if cls == HELD else None, None, None))
    return _table(rows, _REPLY)


def _in_order(replies: pa.Table, column: str) -> np.ndarray:
    """The sums that answer one sender's keys of one kind: ranges follow each other as keys do."""
    rows = sorted(zip(*(replies.column(f).to_pylist() for f in ("shard", "n", column)), strict=True), key=lambda r: r[0])
    return np.concatenate([_unpack_counts(data, n) for _, n, data in rows]) if rows else np.empty(0, np.int64)


def _pass_back(_key, asks: pa.Table, replies: pa.Table) -> pa.Table:
    """The answers to a group, dealt to its senders: the group's keys are added up again, which gives the order of the answers."""
    rows = []
    if asks.num_rows:
        kind, shard = asks.column("kind")[0].as_py(), asks.column("shard")[0].as_py()
        held = _asked(asks)
        keys, _ = _summed(held)
        whole = _in_order(replies, "counts")
        kept = _in_order(replies, "kept") if held[0][1] == HELD else None
        for block, cls, asked, _ in held:
            at = np.searchsorted(keys, asked)
            rows.append((kind, shard, block, cls, len(asked), _pack_counts(whole[at]), None if kept is None else _pack_counts(kept[at]), None, None))
    return _table(rows, _REPLY)


def _exchange(blocked: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(replies to the blocks, sums of the shards): each block's distinct keys go up to the shards that add them up, and the sums come back.

    A shard is a range of keys. With few shards a block writes to each. With more than 2**HOP_BITS, a message crosses several hops: blocks write to wide
    ranges, where the messages of a group of blocks are added up and sent on to narrower ranges in the group's name, and so on; answers take the way back.
    No hop has more than 2**HOP_BITS messages for each block, so that what is exchanged grows as the text does and not as blocks times shards; what a
    task holds is a block's keys or a shard's, at every level.
    """
    hops = max(1, math.ceil(shards / HOP_BITS))
    hop = math.ceil(shards / hops)
    to = ("kind", "shard", "cls", "grp")
    group = F.shiftright("block", hop).alias("grp")
    asks = blocked.groupBy("block").applyInArrow(_ask(hop), _ASK)
    sent = []
    for level in range(2, hops + 1):
        sent.append(keep(asks, "asks"))
        asks = sent[-1].withColumn("grp", group).groupBy(*to).applyInArrow(_pass_on(hop, level), _ASK)
    replies = keep(asks.groupBy("kind", "shard").applyInArrow(_answer, _REPLY), "replies")
    sums = replies.where("block < 0").select("block", "distinct", "total")
    replies = replies.where("block >= 0")
    for asks in reversed(sent):
        back = replies.withColumns({"grp": F.col("block"), "to": F.shiftright("shard", hop)})
        replies = keep(asks.withColumn("grp", group).groupBy(*to).cogroup(back.groupBy("kind", "to", "cls", "grp")).applyInArrow(_pass_back, _REPLY), "replies")
    return replies, sums


def _joined(docs: pa.Table, replies: pa.Table, column: str) -> tuple[np.ndarray, ...]:
    """(lengths, c(w), c(v), c(v w), starts) for each token of a block, from the shards' answers."""
    token, before, lengths = block_tokens(docs.column("text").to_pylist())
    counts = {k: _in_order(replies.filter(pa.compute.equal(replies.column("kind"), k)), column).astype(np.float64) for k in (1, 2)}
    keys = np.unique(np.concatenate((token, np.array([_START]))))
    pairs, at = np.unique(_bigrams(token, before), return_inverse=True)
    return lengths, counts[1][np.searchsorted(keys, token)], counts[1][np.searchsorted(keys, before)], counts[2][at]


def _bucket(context: np.ndarray) -> np.ndarray:
    """Context-frequency buckets: 0 for a context never seen, then one for each doubling."""
    return np.minimum(np.ceil(np.log2(context + 1)), BUCKETS - 1).astype(np.int64)


def _bin(p: np.ndarray) -> np.ndarray:
    """Probabilities in steps of a quarter bit; the last bin is for zero."""
    with np.errstate(divide="ignore"):
        bits = -np.log2(p) * STEPS
    return np.where(p > 0, np.minimum(np.round(bits), BINS - 1), BINS).astype(np.int64)


def learn_weights(histogram: np.ndarray, uniform: float, rounds: int = 200) -> np.ndarray:
    """Mixture weights (bucket; bigram, unigram, uniform) by expectation-maximisation on rows (bucket, bigram bin, unigram bin, count).

    Buckets without held-out tokens take the weights of the nearest lower one that has some.
    """
    back = np.append(np.exp2(-np.arange(BINS) / STEPS), 0.0)
    weights = np.zeros((BUCKETS, 3))
    last = np.array([0.0, 0.9, 0.1])
    for b in range(BUCKETS):
        mine = histogram[histogram[:, 0] == b]
        if len(mine):
            parts = np.stack((back[mine[:, 1]], back[mine[:, 2]], np.full(len(mine), uniform)), axis=1)
            n = mine[:, 3].astype(float)
            w = np.full(3, 1 / 3)
            for _ in range(rounds):
                share = parts * w
                new = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
                done = np.abs(new - w).max() < 1e-7
                w = new
                if done:
                    break
            # no weight vanishes: every token keeps a probability above 0
            last = (w + 1e-6) / (w + 1e-6).sum()
        weights[b] = last
    weights[0] = np.array([0.0, *(weights[0][1:] / weights[0][1:].sum())])
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base_add: float = 0.1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; null texts are empty and have one token, the end.

    Rows whose id, as text, has a CRC-32 that 10 divides are not trained on; those that leave 1 are trained on, and learn the mixture weights
    against the counts of the others (deleted interpolation). A token's probability is
    w2 c(v w) / c(v) + w1 c(w) / N + w0 / (V + 1), its weights those of the context's frequency. score is the sum of log10 over tokens.

    Counts are joined in shards: a block of documents asks for its distinct keys, packed, with its own counts of them; a shard adds up all blocks and answers
    each with the sums in the block's order (see _exchange). Blocks and shards have a bounded size whatever the corpus; nothing is collected but a few sums
    and a histogram of fixed size. A null id counts as trained on. Blocks are dealt by id and text: only rows equal in both share one. A text of any length
    is scored whole, within its block. Equal rows have equal results and count as often as they occur.
    """
    spark = docs.sparkSession
    small_batches(spark)
    code = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10, F.lit(2))
    cls = F.when(code == 0, TEST).when(code == 1, HELD).otherwise(TRAIN)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), cls.alias("cls"))
    chars = {r["cls"]: r["n"] for r in rows.groupBy("cls").agg(F.sum(F.length("text")).alias("n")).collect()}
    blocks = {c: max(1, math.ceil((chars.get(c) or 0) / BLOCK_CHARS)) for c in (TEST, HELD, TRAIN)}
    first = {TEST: 0, HELD: blocks[TEST], TRAIN: blocks[TEST] + blocks[HELD]}
    deal = lambda c: F.pmod(F.xxhash64("id", "text"), F.lit(blocks[c])) + first[c]
    block = F.when(F.col("cls") == TEST, deal(TEST)).when(F.col("cls") == HELD, deal(HELD)).otherwise(deal(TRAIN)).cast("int")
    blocked = rows.select(block.alias("block"), "cls", "id", F.col("text").cast("binary").alias("text"))
    shards = max(1, math.ceil(math.log2(max(2.0, sum(v or 0 for v in chars.values()) / 6 / SHARD_KEYS))))
    replies, totals = _exchange(blocked, shards)
    sums = {r["block"]: (r["v"] or 0, r["n"] or 0) for r in totals.groupBy("block").agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).collect()}
    (distinct, total), (_, kept_total) = sums.get(-1, (0, 0)), sums.get(-2, (0, 0))
    uniform = 1.0 / (distinct + 1)

    def histogram(_key, docs_: pa.Table, replies_: pa.Table) -> pa.Table:
        lengths, c, context, pair = _joined(docs_, replies_, "kept") if docs_.num_rows else (np.empty(0),) * 4
        with np.errstate(invalid="ignore", divide="ignore"):
            two = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
        code_ = (_bucket(context) * (BINS + 1) + _bin(two)) * (BINS + 1) + _bin(c / max(kept_total, 1))
        values, n = np.unique(code_, return_counts=True)
        return pa.table([pa.array(values, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    mine = replies.where(f"cls = {HELD}").select("kind", "shard", "block", "n", "kept")
    learnt = blocked.where(f"cls = {HELD}").groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(histogram, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    table = np.array([(r["code"] // (BINS + 1) ** 2, r["code"] // (BINS + 1) % (BINS + 1), r["code"] % (BINS + 1), r["n"]) for r in learnt], np.int64).reshape(-1, 4)
    weights = learn_weights(table, uniform)
    kind = docs.schema[id_col].dataType.simpleString()

    def final(_key, docs_: pa.Table, replies_: pa.Table) -> pa.Table:
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        if not docs_.num_rows:
            return pa.table([docs_.column("id"), *(pa.array([], k) for k in kinds)], names=names)
        lengths, c, context, pair = _joined(docs_, replies_, "counts")
        w = weights[_bucket(context)]
        p = w[:, 0] * np.where(context > 0, pair / np.maximum(context, 1), 0.0) + w[:, 1] * c / max(total, 1) + w[:, 2] * uniform
        base = np.log10((c + base_add) / (total + base_add * (distinct + 1)))
        at = np.cumsum(lengths) - lengths
        columns = (np.asarray(docs_.column("cls")) == TEST, lengths, np.add.reduceat((c > 0).astype(np.int64), at), np.full(len(lengths), total), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at))
        return pa.table([docs_.column("id"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=names)

    answers = replies.select("kind", "shard", "block", "n", "counts")
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(final, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


