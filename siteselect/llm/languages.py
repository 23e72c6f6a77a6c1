"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteselect.llm.common import keep, map_arrow

ORDER = 4
#: Characters of labelled text that are read at most, about, over all languages; documents are drawn whole by a hash of their id.
TRAIN_CHARS = 12_000_000
#: Exponents that calibration tries for the confidence.
SCALES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EDGE = "\x02"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _grams(words: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(word of each character, hashes of the n-grams that end there, of their contexts), n from 1 to order.

    A word stands between edge marks; its first mark is never predicted, its last is. An n-gram that would begin before
    the first mark has hash 0: the model does not look beyond a word.
    """
    text = "".join(_EDGE + w + _EDGE for w in words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    full, context = [], []
    before = np.full(len(codes), 1, np.uint64)
    for n in range(1, order + 1):
        h = np.zeros(len(codes), np.uint64)
        for back in range(n - 1, -1, -1):
            shifted = np.concatenate((np.zeros(back, np.uint64), codes[: len(codes) - back])) if back else codes
            h = _mix(h * _STEP + shifted + np.uint64(n))
        fits = place >= n - 1
        full.append(np.where(fits, h | np.uint64(1), 0))
        if n > 1:
            c = np.zeros(len(codes), np.uint64)
            for back in range(n - 1, 0, -1):
                c = _mix(c * _STEP + np.concatenate((np.zeros(back, np.uint64), codes[: len(codes) - back])) + np.uint64(n - 1))
            context.append(np.where(fits, c | np.uint64(1), 0))
        else:
            context.append(before)
    predicted = place > 0
    return word[predicted], [f[predicted] for f in full], [c[predicted] for c in context]


@dataclass
class Model:
    """All languages' models in shared sorted arrays: for each order the n-gram hashes with a column of log2 probabilities for each language
    (NaN: not seen there), and the context hashes with a column of log2 back-off masses. Bounded by the sample the model is trained on."""

    langs: list[str]
    order: int
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    ctx: list[np.ndarray]
    mass: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray
    scale: float = 4.0

    def bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters predicted, log2 probability by language) of each word."""
        if not self.langs or not words:
            return np.zeros(len(words)), np.zeros((len(words), len(self.langs)))
        word, full, context = _grams(words, self.order)
        total = np.zeros((len(words), len(self.langs)))
        owed = np.zeros((len(word), len(self.langs)))  # log2 of the back-off masses so far
        open_ = np.ones((len(word), len(self.langs)), bool)
        score = np.zeros((len(word), len(self.langs)))
        for n in range(self.order, 0, -1):
            at, found = _find(self.keys[n - 1], full[n - 1])
            value = np.where(found[:, None], self.logp[n - 1][at], np.nan)
            hit = open_ & ~np.isnan(value)
            score[hit] = (owed + value)[hit]
            open_ &= ~hit
            if not open_.any():
                break
            if n > 1:
                at, found = _find(self.ctx[n - 2], context[n - 1])
                owed += np.where(found[:, None], self.mass[n - 2][at], 0.0)
        score[open_] = (owed + self.floor)[open_]
        np.add.at(total, word, score)
        return np.bincount(word, minlength=len(words)), total


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


@dataclass
class _Order:
    """One language's n-grams of one length: sorted hashes, log2 probabilities, context hashes and log2 back-off masses."""

    keys: np.ndarray
    logp: np.ndarray
    ctx: np.ndarray
    mass: np.ndarray


def _counts(words: list[str], times: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, counts, contexts, shorter n-grams) of the n-grams of each length.

    The highest order counts occurrences; lower ones count the distinct characters that come before. N-grams at a word's start have none and keep their occurrences.
    """
    word, full, context = _grams(words, order)
    weight = times[word]
    found = []
    follow: np.ndarray | None = None
    for n in range(order, 0, -1):
        valid = full[n - 1] != 0
        keys, first, inverse = np.unique(full[n - 1][valid], return_index=True, return_inverse=True)
        c = np.bincount(inverse, weights=weight[valid], minlength=len(keys))
        if follow is not None:
            seen = np.unique(np.stack([follow[valid], inverse]), axis=1)
            more = np.bincount(seen[1][seen[0] >= 0], minlength=len(keys)).astype(float)
            c = np.where(more > 0, more, c)
        follow = np.full(len(valid), -1)
        follow[valid] = inverse
        found.append((keys, c, context[n - 1][valid][first], full[n - 2][valid][first] if n > 1 else keys))
    return found[::-1]


def train_one(words: list[str], times: np.ndarray, chars: int, order: int = ORDER) -> tuple[list[_Order], float]:
    """One language's interpolated Kneser-Ney model from its words' counts, and the log2 probability of a character never seen.

    One discount for each order, from its counts of one and two. The lowest order is mixed with a uniform share; chars is the number of characters known.
    """
    orders: list[_Order] = []
    floor, uniform = -20.0, 1.0 / (chars * 4)
    lower_keys, lower_p = np.zeros(0, np.uint64), np.zeros(0)
    for n, (keys, c, ctx_of, short) in enumerate(_counts(words, times, order), 1):
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        ctx, inverse = np.unique(ctx_of, return_inverse=True)
        total = np.bincount(inverse, weights=c)
        mass = d * np.bincount(inverse) / np.maximum(total, 1e-9)
        if n == 1:
            lower = np.full(len(keys), uniform)
            floor = float(np.log2(mass[0] * uniform)) if len(mass) else floor
        else:
            lower = lower_p[_find(lower_keys, short)[0]]
        lower_keys, lower_p = keys, np.maximum(c - d, 0) / total[inverse] + mass[inverse] * lower
        orders.append(_Order(keys, np.log2(lower_p).astype(np.float32), ctx, np.log2(np.minimum(mass, 1.0)).astype(np.float32)))
    return orders, floor


def assemble(parts: dict[str, tuple[list[_Order], float]], order: int = ORDER) -> Model:
    """The languages' models side by side in shared sorted arrays. Languages without a limit accept everything."""
    langs = sorted(parts)
    model = Model(langs, order, [], [], [], [], np.array([parts[lang][1] for lang in langs]), np.full(len(langs), np.inf))
    for n in range(order if langs else 0):
        own = [parts[lang][0][n] for lang in langs]
        for to_keys, to_values, keys_of, values_of, blank in ((model.keys, model.logp, "keys", "logp", np.nan), (model.ctx, model.mass, "ctx", "mass", 0.0)):
            if keys_of == "ctx" and n == 0:
                continue
            keys = np.unique(np.concatenate([getattr(o, keys_of) for o in own]))
            values = np.full((len(keys), len(langs)), blank, np.float32)
            for i, o in enumerate(own):
                values[np.searchsorted(keys, getattr(o, keys_of)), i] = getattr(o, values_of)
            to_keys.append(keys)
            to_values.append(values)
    return model


def train(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """Models from word counts by language."""
    chars = len({ch for c in counts.values() for w in c for ch in w}) + 2
    times = {lang: np.fromiter(c.values(), dtype=np.float64, count=len(c)) for lang, c in counts.items()}
    return assemble({lang: train_one(list(c), times[lang], chars, order) for lang, c in counts.items()}, order)


class _Words(dict):
    """Word to its row in the score table, for one batch after another; emptied when full. New words are scored PART at a time: scoring holds some 3 kB for each."""

    LIMIT, PART = 100_000, 4_096

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.chars = np.zeros(0)
        self.scores = np.zeros((0, len(model.langs)))

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        fresh = list({w for t in texts for w in t if w not in self})
        if len(self) + len(fresh) > self.LIMIT:
            self.clear()
            self.chars, self.scores = np.zeros(0), np.zeros((0, len(self.model.langs)))
            fresh = list({w for t in texts for w in t})
        made = [self.model.bits(fresh[at : at + self.PART]) for at in range(0, len(fresh), self.PART)]
        if made:
            self.update(zip(fresh, range(len(self.chars), len(self.chars) + len(fresh)), strict=True))
            self.chars = np.concatenate((self.chars, *(chars for chars, _ in made)))
            self.scores = np.concatenate((self.scores, *(scores for _, scores in made)))
        return [np.fromiter(map(self.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _LETTERS.findall(text.lower()) if text else []


def judge(model: Model, entropy: np.ndarray, chars: float) -> tuple[int, float, bool]:
    """(language, confidence, accepted) from the cross-entropies, bits for each character, of a text of so many characters.

    Confidence is the best language's share of 2**(-scale * entropy). A text is accepted if its cross-entropy is not above its language's limit,
    widened for short texts, whose mean scatters more.
    """
    best = int(np.argmin(entropy))
    spread = np.exp2(-model.scale * (entropy - entropy[best]))
    return best, float(1.0 / spread.sum()), bool(entropy[best] <= model.limits[best] * (1 + 2.0 / np.sqrt(max(chars, 1.0))))


def _words(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of the rows (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    return keep(map_arrow(texts, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")


def _trained(words: DataFrame, order: int) -> Model:
    """Each language's model is trained in a task of its own, which holds its sample; only finished arrays reach the driver."""

    def characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                known.update(word)
        yield pa.RecordBatch.from_arrays([pa.array(map(ord, known), pa.int32())], ["character"])

    chars = words.select("word").mapInArrow(characters, "character int").distinct().count() + 2

    def model_of(table: pa.Table) -> pa.Table:
        orders, floor = train_one(table["word"].to_pylist(), table["n"].to_numpy().astype(np.float64), chars, order)
        columns = [[table["lang"][0].as_py()] * order, list(range(order)), [floor] * order, *([getattr(o, c).tobytes() for o in orders] for c in ("keys", "logp", "ctx", "mass"))]
        kinds = (pa.string(), pa.int32(), pa.float64(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "n", "floor", "keys", "logp", "ctx", "mass"])

    made = keep(words.groupBy("lang").applyInArrow(model_of, "lang string, n int, floor double, keys binary, logp binary, ctx binary, mass binary"), "language-models")
    parts: dict[str, tuple[list[_Order], float]] = {}
    for r in made.orderBy("lang", "n").toLocalIterator():
        orders = parts.setdefault(r["lang"], ([], r["floor"]))[0]
        orders.append(_Order(*(np.frombuffer(r[c], k) for c, k in (("keys", np.uint64), ("logp", np.float32), ("ctx", np.uint64), ("mass", np.float32)))))
    return assemble(parts, order)


def _calibrate(model: Model, scored: DataFrame) -> None:
    """Limits: the 0.999 quantile of the cross-entropy of a language's own documents and a tenth more, and at least 1.75 times their median, so that
    texts with names, codes or figures among their words pass and letters without a language's order do not. A language none of whose documents has 40 letters
    or more takes the limit of all languages together. Scale: the value of SCALES under which the documents' own languages get the highest mean log confidence.

    Only sums and quantiles reach the driver.
    """
    langs = list(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {lang: i for i, lang in enumerate(langs)}
        for batch in batches:
            rows: list[tuple] = []
            for lang, chars, entropy in zip(batch.column("lang").to_pylist(), batch.column("chars").to_pylist(), batch.column("entropy").to_pylist(), strict=True):
                if not chars or lang not in index:
                    continue
                bits, own = np.array(entropy), index[lang]
                z = -np.array(SCALES)[:, None] * (bits - bits.min()) * np.log(2)
                rows.append((lang, chars, bits[own], (np.log(np.exp(z).sum(axis=1)) - z[:, own]).tolist()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "chars", "bits", "losses"])

    judged = keep(scored.mapInArrow(run, "lang string, chars double, bits double, losses array<double>"), "language-calibration")
    losses = judged.agg(*[F.sum(F.get("losses", F.lit(i))).alias(f"loss{i}") for i in range(len(SCALES))]).first()
    if losses[0] is None:
        return
    model.scale = SCALES[int(np.argmin(list(losses)))]
    quantiles = F.percentile("bits", F.lit([0.5, 0.999])).alias("q")
    long = judged.where("chars >= 40")
    limit = lambda q: max(q[1] * 1.1, q[0] * 1.75) if q else np.inf
    pooled = limit(long.agg(quantiles).first()["q"])
    own = {r["lang"]: limit(r["q"]) for r in long.groupBy("lang").agg(quantiles).collect()}  # a row for each language
    model.limits = np.array([own.get(lang, pooled) for lang in langs])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", order: int = ORDER, train_chars: int = TRAIN_CHARS) -> Model:
    """Train on the rows of `labelled` that have a text and a language.

    Each language gets an equal part of train_chars (a documented bound, so that the model may be broadcast); where its texts hold more,
    whole documents are drawn by a hash of their id. A tenth of the drawn documents calibrates and is not trained on; languages of which
    nothing would be left train on all they have, and calibrate on it.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    lengths = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n"))
    langs = lengths.count()
    if not langs:
        return train({})
    rates = lengths.select("lang", F.least(F.lit(1.0), F.lit(train_chars / langs) / F.greatest("n", F.lit(1))).alias("rate"))
    place = F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    tenth = F.pmod(F.xxhash64(F.lit("tenth"), "id"), F.lit(10))
    drawn = keep(rows.join(F.broadcast(rates), "lang").where(place < F.col("rate")).select("id", "lang", "text", (tenth == 0).alias("apart")), "language-sample")  # a short row for each language
    both = drawn.groupBy("lang").agg((F.min("apart") == F.max("apart")).alias("all"))
    dealt = drawn.join(F.broadcast(both), "lang")
    model = _trained(_words(dealt.where("all or not apart").select("lang", "text")), order)
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    _calibrate(model, score_rows(dealt.where("all or apart"), shared, "id", "text", "lang string", ["lang"]))
    return model


def score_rows(docs: DataFrame, shared, id_col: str, text_col: str, more: str = "", extra: list[str] | None = None) -> DataFrame:
    """(id, extra columns, chars, entropy array by language) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = _Words(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                chars, entropy = [], []
                for rows in words.rows(texts):
                    n = float(words.chars[rows].sum())
                    chars.append(n)
                    entropy.append((-words.scores[rows].sum(axis=0) / n).tolist() if n and len(model.langs) else [])
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(chars, pa.float64()), pa.array(entropy, pa.list_(pa.float64()))], ["id", *(extra or []), "chars", "entropy"])

    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c) for c in extra or []]]
    return map_arrow(docs.select(*columns), run, f"id {kind}, {more + ', ' if more else ''}chars double, entropy array<double>")


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted, bits) for each row, from the whole text and nothing else.

    Null texts and texts without a letter are `und`, with score 0, and not accepted; so are all texts if the model knows no language.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = score_rows(docs, shared, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [("und", 0.0, False, None) if not e or not m.langs else (lambda j, e=e: (m.langs[j[0]], j[1], j[2], e[j[0]]))(judge(m, np.array(e), c)) for c, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.bool_(), pa.float64()), strict=True))], ["id", "lang_pred", "score", "accepted", "bits"])

    return scored.mapInArrow(run, f"id {kind}, lang_pred string, score double, accepted boolean, bits double")


def held_out(id_col: str = "doc_id", by: int = 4, remainder: int = 2) -> Column:
    """Whether the CRC-32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % by == remainder, F.lit(False))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text `predict` does not accept: null texts, texts without letters and those that fit no language.

    Rows pass through with all their columns; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = _Words(m)
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                mask = []
                for rows in words.rows([words_of(t) for t in part.column(at).to_pylist()]):
                    n = float(words.chars[rows].sum())
                    mask.append(bool(n and len(m.langs) and judge(m, -words.scores[rows].sum(axis=0) / n, n)[2]))
                yield part.filter(pa.array(mask, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
