"""Spelling variants: words one edit apart, found by pivotal bigrams."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteselect.llm.common import keep, map_arrow
from siteselect.llm.divergence import pieces

MIN_LENGTH, MIN_COUNT = 5, 3
#: A word whose form has this many times its count or more is taken for a variant of it.
TIMES = 2
#: One of so many pairs of document and word is misspelled on purpose.
MISSPELLED = 97
#: One edit destroys bigrams that overlap, so that one of two disjoint ones survives; the three rarest always have two such.
_WIDTH, _PIVOTS, _PREFIX = 2, 2, 3
_HELD = 300_000
#: In Latin-1, where a character is a byte and others are "?": a-z and U+00C0 to U+00FF stand for themselves, A-Z for a-z, anything else separates.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def misspelled(prefix: int, word: bytes) -> bytes:
    """The word (Latin-1), without one character if the CRC-32 of the prefix's bytes and its own in UTF-8 says so; prefix is the former's CRC-32."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
    if h % MISSPELLED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): words repeat, once for each task and each time that it was full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            words = list(total)
            for at in range(0, len(words), 8192):
                part = words[at : at + 8192]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([total[w] for w in part], pa.int64())], ["word", "n"])
            total.clear()

        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prefix = zlib.crc32(f"{key}:".encode())
                for words in pieces(text.encode("latin-1", "replace"), _RUNS):
                    for word, n in Counter([w for w in words if len(w) >= MIN_LENGTH]).items():
                        result = misspelled(prefix, word)
                        total[result] = total.get(result, 0) + n
                if len(total) > _HELD:
                    yield from out()
        yield from out()

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "word string, n long").where(F.length("word") >= MIN_LENGTH)


def _codes(word: bytes) -> np.ndarray:
    letters = np.frombuffer(word, np.uint8).astype(np.int64)
    return letters[:-1] * 256 + letters[1:]


def _gram_ranks(words: DataFrame) -> np.ndarray:
    """For each bigram code its place by occurrences in the words, rarest first. Words have 90 characters, so there are 8,100 bigrams at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                np.add.at(counts, _codes(word.encode("latin-1")), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["gram", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for gram, n in map_arrow(words.select("word"), run, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    return counts


def pivots(places: list[int], costs: list[int], width: int = _WIDTH, count: int = _PIVOTS) -> list[int]:
    """Of grams at ascending places the `count` disjoint ones that cost least together, by dynamic programming over the last one taken."""
    best: list[list[tuple[int, tuple]]] = [[(0, ())] * (len(places) + 1)] + [[(1 << 62, ())] * (len(places) + 1) for _ in range(count)]
    before = 0
    for i, place in enumerate(places):
        while places[before] <= place - width:
            before += 1
        for k in range(1, count + 1):
            cost, chain = best[k - 1][before]
            taken = (cost + costs[i], (place, chain))
            best[k][i + 1] = min(best[k][i], taken, key=lambda c: c[0])
    chain, chosen = best[count][-1][1], []
    while chain:
        chosen.append(chain[0])
        chain = chain[1]
    return chosen[::-1]


def grams_of(word: bytes, counts: np.ndarray) -> tuple[int, list[int], list[int], list[int]]:
    """(last, prefix, pivots, codes): the order of the third rarest bigram, the places of all bigrams up to it, those of the pivots, and all bigrams' codes."""
    codes = _codes(word)
    order = counts[codes] * (1 << 16) + codes
    last = int(np.partition(order, _PREFIX - 1)[_PREFIX - 1])
    prefix = np.flatnonzero(order <= last)
    return last, prefix.tolist(), pivots(prefix.tolist(), counts[codes[prefix]].tolist()), codes.tolist()


def _indexed(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """(word, n, len, last, pivot, gram, pos): a row for each bigram of the prefix; pivot says whether it is one of the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last, prefix, chosen, codes = grams_of(word.encode("latin-1"), counts)
                rows += [(word, n, len(word), last, place in chosen, codes[place], place) for place in prefix]
            for at in range(0, len(rows), 8192):
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows[at : at + 8192], strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n", "len", "last", "pivot", "gram", "pos"])

    return map_arrow(words.select("word", "n"), run, "word string, n long, len int, last long, pivot boolean, gram int, pos int")


def links(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): pairs a < b of words (word, n) one edit apart, each once.

    Let the word whose prefix ends first in the order of rarity ask: its pivots stand in its prefix, so they come no later than the other's last prefix
    bigram, and the one that the edit leaves alone stands in the other's prefix, at its place or one beside it as the lengths differ. The distance is part of
    the join condition, so that nothing but true pairs leaves the join.
    """
    index = keep(_indexed(words, _gram_ranks(words)), "spelling-grams")
    shifts = F.array(*[F.struct(F.lit(size).alias("size"), F.lit(by).alias("by")) for size, by in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))])
    asks = index.where("pivot").select("gram", F.col("word").alias("a"), F.col("n").alias("na"), F.col("last").alias("last_a"), "len", "pos", F.explode(shifts).alias("s"))
    asks = asks.select("gram", (F.col("len") + F.col("s.size")).alias("len"), (F.col("pos") + F.col("s.by")).alias("pos"), "a", "na", "last_a")
    held = index.select("gram", "len", "pos", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("last").alias("last_b"))
    same = ["gram", "len", "pos"]
    near = (F.col("last_a") <= F.col("last_b")) & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    found = asks.join(held, [asks[c] == held[c] for c in same] + [near]).select("a", "na", "b", "nb")
    first = F.col("a") < F.col("b")
    one, other = F.struct(F.col("a").alias("w"), F.col("na").alias("n")), F.struct(F.col("b").alias("w"), F.col("nb").alias("n"))
    pairs = found.select(F.when(first, one).otherwise(other).alias("x"), F.when(first, other).otherwise(one).alias("y")).distinct()
    return pairs.select(F.col("x.w").alias("a"), F.col("x.n").alias("na"), F.col("y.w").alias("b"), F.col("y.n").alias("nb"))


def _roots(forms: DataFrame, rounds: int = 16) -> DataFrame:
    """(word, root) for words with a form: the chain of forms doubles its stride each round. Counts at least double along it, so that it ends."""
    up = keep(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(rounds):
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = keep(up.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            return up
    raise RuntimeError(f"forms still lead on after {rounds} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of at least MIN_LENGTH characters and MIN_COUNT occurrences in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; in one of MISSPELLED pairs of a document and a word, a character is left out. Two words are near if
    one edit leads from one to the other. A word's form is the near word with the largest n (of equal ones the smallest), if that is TIMES its own n or more, and its root
    is the end of its chain of forms. Null texts have no words; a null id counts as an empty one; repeated rows count as often as they stand. Words may be of any length.
    """
    counted = _occurrences(docs, id_col, text_col).groupBy("word").agg(F.sum("n").alias("n"))
    words = keep(counted.where(F.col("n") >= MIN_COUNT), "spelling-words")
    found = keep(links(words), "spelling-links")
    both = found.union(found.select("b", "nb", "a", "na")).toDF("word", "own", "near", "near_n")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    forms = words.join(best, "word", "left").withColumn("fits", -F.col("best.minus") >= TIMES * F.col("n"))
    forms = forms.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("best.near")).alias("form"), F.when(F.col("fits"), -F.col("best.minus")).alias("form_n"))
    forms = keep(forms, "spelling-forms")
    rooted = forms.join(_roots(forms.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
