import re
from collections import Counter
from itertools import product

import oracle

from siteselect.llm import divergence, queries

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Rows (lang, source, part, item, value, rank) for rows (lang, source, text)."""
    counts, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)
        groups.add((lang, source))
        counts.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        terms = [w for (x, w), n in docs.items() if x == lang and n >= 3]
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda n: {w: 1 + 10**9 * (n[w] + 1) // (sum(n.values()) + len(terms)) for w in terms}
        own = {s: share(Counter({w: counts[lang, s, w] for w in terms})) for s in sources}
        every = share(Counter({w: sum(counts[lang, s, w] for s in sources) for w in terms}))
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(o, sum(f(own[s][w], own[o][w]) for w in terms)) for o in sources if o != s]
            over = [(w, f(own[s][w], every[w])) for w in terms if counts[lang, s, w] and own[s][w] > every[w]]
            for part, items in (("pair", pairs), ("term", over)):
                ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1) if part == "pair" or rank <= 200]
    return sorted(out)


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "lang string, source string, text string, item string, value long, term string")
    return sorted(tuple(r) for r in divergence.audit(frame).collect())


def test_query_equals_sql(spark):
    assert oracle.compare(queries.QUERIES["op12_source_divergence"](spark, SF), divergence.ORACLE, SF) > 0


def test_nulls_empty_texts_repeated_rows_and_groups_without_terms(spark):
    rows = [("en", s, t) for s, t in product(("a", "b", "c"), ("The cat, the DOG; the Éclair", "the cat naïve naïve", "", None))]
    rows += [("en", "a", "rare word here")] * 2 + [("en", "dd", "nothing kept")] + [(None, None, "the end the end"), (None, "z", "the end"), (None, "z", "the end"), ("de", "q", None), ("de", "r", "x y")]
    rows += [("en", "b", "漢字 the\x00cat 漢字")] * 3
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:0] + [("en", "a", "x")]) == []


def test_empty_table_and_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 1000)
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).count() == 0
    rows = [("en", "a", "one two three " * 30_000), ("en", "b", "one four " * 5), ("en", "a", "two one " + "z" * 5000), ("en", "b", "one two"), ("en", "c", "four " * 9)]
    assert list(divergence.pieces(b"ab cd  ef", divergence._LETTERS, 3)) == [[b"ab"], [b"cd"], [b"ef"]] or sum(divergence.pieces(b"ab cd  ef", divergence._LETTERS, 3), []) == [b"ab", b"cd", b"ef"]
    assert found(spark, rows) == brute(rows)


def test_paths_share_nodes_and_combinations_are_met_once():
    tree = divergence.Tree()
    for items, times in [([(0, 5), (1, 2)], 4), ([(0, 5), (1, 2), (2, 9)], 1), ([(0, 5), (2, 9)], 2), ([(1, 2)], 8)]:
        tree.insert(items, times)
    assert list(zip(tree.depths, tree.times, strict=True)) == [(0, 7), (1, 5), (2, 1), (1, 2), (0, 8)]
    for most in (1, 2, 100):
        met = sorted((int(a), int(b), int(n)) for node, above, times in tree.combinations(most) for a, b, n in zip(node, above, times, strict=True))
        assert met == [(1, 0, 5), (4, 2, 1), (4, 3, 1), (6, 5, 2)]


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.lit(10**13).alias("n"), F.lit(3 * 10**13).alias("total"), F.lit(10**9).alias("terms"))
    assert row.select(divergence._share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 10**9)
