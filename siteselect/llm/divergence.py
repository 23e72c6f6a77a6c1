"""How far the sources of a language differ in the terms they use, by a frequent-pattern tree of term rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteselect.llm.common import keep, map_arrow

#: Probabilities are whole numbers of this fraction.
UNIT = 1_000_000_000
MIN_DOCS, TOP_TERMS = 3, 200
#: Terms that a task holds counts of before it hands them on, and bytes of a text that it takes apart at a time.
_HELD, _PIECE = 200_000, 1 << 20
_COMBINATIONS = 1 << 20
#: Letters and all bytes beyond ASCII stand for themselves, A-Z for a-z, anything else separates.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes, table: bytes, size: int = _PIECE) -> Iterator[list[bytes]]:
    """The words of a text whose separators the table turns into spaces, some at a time."""
    text, at = text.translate(table), 0
    while at < len(text):
        end = text.find(b" ", at + size) if at + size < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; a task returns a term of a group once, or once for each time that it was full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, documents) in groups.items():
                terms = list(n)
                for at in range(0, len(terms), 8192):
                    part = terms[at : at + 8192]
                    fixed = [pa.array([v] * len(part), pa.string()) for v in (lang, source)]
                    numbers = [pa.array([held[t] for t in part], pa.int64()) for held in (n, documents)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(part, pa.binary()).view(pa.string()), *numbers], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, documents = groups.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for words in pieces(text, _LETTERS):
                    n.update(words)
                    seen.update(words)
                documents.update(seen)
                if sum(len(held[0]) for held in groups.values()) > _HELD:
                    yield from out()
        yield from out()

    blank = [F.coalesce(c, F.lit("")) for c in ("lang", "source", "text")]
    return map_arrow(docs.select(blank[0].alias("lang"), blank[1].alias("source"), blank[2].cast("binary").alias("text")), run, "lang string, source string, term string, n long, docs long")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exactly."""
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _floor_apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Tree:
    """A frequent-pattern tree of patterns that come in order: each is (items, times), its items (source, p) in source order.

    A pattern shares the nodes of its longest prefix with the one before it; because of the order no other can be shared. A node is named
    by the place of its item among all items put in, its ancestors are the items before it there, and its times those of all patterns through it.
    """

    def __init__(self) -> None:
        self.path: list[tuple] = []
        self.on_path: list[int] = []
        self.nodes: list[int] = []
        self.depths: list[int] = []
        self.times: list[int] = []
        self.items = 0

    def insert(self, items: list[tuple], times: int) -> None:
        shared = 0
        while shared < min(len(items), len(self.path)) and items[shared] == self.path[shared]:
            shared += 1
        del self.on_path[shared:]
        for depth in range(shared, len(items)):
            self.on_path.append(len(self.nodes))
            self.nodes.append(self.items + depth)
            self.depths.append(depth)
            self.times.append(0)
        for node in self.on_path:
            self.times[node] += times
        self.path, self.items = items, self.items + len(items)

    def combinations(self, most: int = _COMBINATIONS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(node's item, ancestor's item, times) of every node with each of its ancestors, about `most` at a time."""
        nodes, depths, times = (np.array(a, np.int64) for a in (self.nodes, self.depths, self.times))
        ends = np.cumsum(depths)
        start = 0
        while start < len(nodes):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            d = depths[start:end]
            node = np.repeat(nodes[start:end], d)
            nth = np.arange(len(node)) - np.repeat(np.cumsum(d) - d, d)
            yield node, node - np.repeat(d, d) + nth, np.repeat(times[start:end], d)
            start = end


def _corrections(patterns: DataFrame) -> DataFrame:
    """(lang, source, item, high, low): what a pair's sum needs beyond its two sources' own, as high * 2^32 + low; pairs repeat.

    For a node (s, p) and an ancestor (t, q), whose sources have p0 and q0 for terms they lack, a term that both have adds
    f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) to the sum of (s, t) that takes them one by one. All terms through the node add it at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            keys, values = list(sums), list(sums.values())
            for at in range(0, len(keys), 8192):
                columns = [pa.array(c, pa.string()) for c in zip(*keys[at : at + 8192], strict=True)] + [pa.array(c, pa.int64()) for c in zip(*values[at : at + 8192], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "high", "low"])
            sums.clear()

        for batch in batches:
            langs, times = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            flat = batch.column(1).flatten()
            sources, p, p0 = flat.field("source").to_pylist(), flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            names: dict[tuple[str, str], int] = {}
            tree, codes, at = Tree(), np.zeros(len(p), np.int64), 0
            for lang, size, n in zip(langs, batch.column(1).value_lengths().to_pylist(), times, strict=True):
                items = []
                for i in range(at, at + size):
                    codes[i] = code = names.setdefault((lang, sources[i]), len(names))
                    items.append((code, int(p[i])))
                tree.insert(items, n)
                at += size
            labels = list(names)
            for node, above, n in tree.combinations():
                for a, b in ((node, above), (above, node)):
                    joint = _floor_apart(p[a], p[b]) - _floor_apart(p[a], p0[b]) - _floor_apart(p0[a], p[b]) + _floor_apart(p0[a], p0[b])
                    pair, which = np.unique(codes[a] * len(labels) + codes[b], return_inverse=True)
                    parts = np.zeros((2, len(pair)), np.int64)
                    np.add.at(parts[0], which, (joint >> 32) * n)
                    np.add.at(parts[1], which, (joint & 0xFFFFFFFF) * n)
                    for k, high, low in zip(pair.tolist(), *parts.tolist(), strict=True):
                        (lang, one), (_, other) = labels[k // len(labels)], labels[k % len(labels)]
                        held = sums.setdefault((lang, one, other), [0, 0])
                        held[0] += high
                        held[1] += low
            if len(sums) > _HELD:
                yield from out()
        yield from out()

    return map_arrow(patterns.select("lang", "items", "times"), run, "lang string, source string, item string, high long, low long")


def _whole(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) for documents (lang, source, text; nulls read as '').

    Part `pair` has, for each source of a language, every other one with the sum over the language's terms of (p - q)^2 / q, rounded down, from the shares p and q
    of the terms in the two; part `term` the TOP_TERMS terms that the source has and uses more than the language does, by the same measure. Terms are maximal
    runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased; those in fewer than MIN_DOCS documents of the language are left out. Repeated
    rows are documents of their own. Sums are exact. Ranks go by value, largest first, then by item.

    A pair's sum is that of the terms neither has, plus what each source's own terms change alone, plus what the terms of both change together;
    this last part comes from the tree, where the terms of one pattern of shares are one path.
    """
    terms = keep(_counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-terms")
    rows = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("items"))
    rows = keep(rows.where(F.col("docs") >= MIN_DOCS).drop("docs"), "divergence-rows")
    each = rows.select("lang", "term", "total", F.explode("items").alias("i")).select("lang", "term", "total", "i.source", "i.n")
    occurring = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    of_group = each.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    of_lang = rows.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_words"))
    groups = occurring.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["words", "terms", "lang_words"])
    none = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("words"), F.col("terms"))).otherwise(1)
    groups = keep(groups.withColumn("p0", none), "divergence-groups")
    share, of_all = _share(F.col("n"), F.col("words"), F.col("terms")), _share(F.col("total"), F.col("lang_words"), F.col("terms"))
    items = keep(each.join(groups, ["lang", "source"]).select("lang", "source", "term", share.alias("p"), of_all.alias("q"), "p0"), "divergence-items")

    paths = items.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("items"))
    paths = keep(paths.groupBy("lang", "items").agg(F.count("*").alias("times")), "divergence-paths")
    together = _corrections(paths.repartitionByRange("lang", "items").sortWithinPartitions("lang", "items"))
    together = together.groupBy("lang", "source", "item").agg((F.sum(_whole("high")) * F.lit(1 << 32) + F.sum(_whole("low"))).cast("decimal(38,0)").alias("value"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = keep(groups.join(other, "lang").where(F.col("source") != F.col("item")).select("lang", "source", "item", "terms", "p0", "q0"), "divergence-pairs")
    shares = keep(items.groupBy("lang", "source", "p").agg(F.count("*").alias("times")), "divergence-shares")
    neither = _apart(F.col("p0"), F.col("q0"))
    base = pairs.select("lang", "source", "item", (_whole("terms") * _whole(neither)).cast("decimal(38,0)").alias("value"))
    change = lambda value: F.sum(F.col("times").cast("decimal(17,0)") * _whole(value - neither)).cast("decimal(38,0)").alias("value")
    own = pairs.join(shares, ["lang", "source"]).groupBy("lang", "source", "item").agg(change(_apart(F.col("p"), F.col("q0"))))
    theirs = pairs.join(shares.withColumnRenamed("source", "item"), ["lang", "item"]).groupBy("lang", "source", "item").agg(change(_apart(F.col("p0"), F.col("p"))))
    summed = base.unionByName(own).unionByName(theirs).unionByName(together).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    ordered = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_part = summed.withColumn("rank", F.row_number().over(ordered)).withColumn("part", F.lit("pair"))
    over = items.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    term_part = over.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= TOP_TERMS).withColumn("part", F.lit("term"))
    return pair_part.unionByName(term_part).select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
found AS (
  SELECT lang, source, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM found GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM counts GROUP BY ALL HAVING sum(docs) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
filled AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, total FROM g JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
sized AS (SELECT lang, source, count(*) AS v, sum(n) AS words, sum(total) AS lang_words FROM filled GROUP BY ALL),
shares AS (
  SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // CAST(words + v AS HUGEINT) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * CAST(total + 1 AS HUGEINT)) // CAST(lang_words + v AS HUGEINT) AS q
  FROM filled JOIN sized USING (lang, source)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
