"""License scans by diagonal voting, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteselect.llm.common import keep, lower_ascii

#: A word once A-Z are in lower case, and the same stretches of a text as it stands.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_AS_IS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a rolling k-gram.
K = 2
#: Diagonals so near each other are one span; words inserted or dropped in a copy move its diagonal.
GAP = 3
#: Share of a template's k-grams that a span must hold.
COVERAGE = 0.75
#: Phrases whose every consecutive occurrence counts, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Well-known license sentences, with their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights", "cc0-1.0"),
)


def template_rows(templates: tuple[tuple[str, str], ...], first: int = 0, k: int = K) -> list[tuple[int, str, int, int, str, str]]:
    """(template, label, k-grams, offset, first word, second word) for each k-gram place of each template."""
    rows = []
    for number, (phrase, label) in enumerate(templates, first):
        words = phrase.split()
        rows += [(number, label, len(words) - k + 1, at, words[at], words[at + 1]) for at in range(len(words) - k + 1)]
    return rows


def _templates(spark: SparkSession) -> DataFrame:
    """A fixed table of a few hundred short rows, whatever the corpus."""
    rows = template_rows(PHRASES) + template_rows(TEMPLATES, len(PHRASES))
    frame = spark.createDataFrame(rows, "template int, label string, grams int, at int, word1 string, word2 string")
    return frame.withColumn("gram", F.xxhash64("word1", "word2"))


def words_of(text: Column) -> Column:
    """The words as they stand: to lower-case whole texts with A-Z alone would cost more than all the rest."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_AS_IS), F.lit(0))


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, template, label, grams, diagonal, votes, low, high, places): the k-grams of a template that stand on one diagonal of a text.

    All rolling k-grams of all texts are joined by the hash of their words in lower case, and then by the words, of which A-Z alone are in lower case, to the
    places of the templates, which are of ASCII letters: so a letter that only Unicode takes for the capital of one of theirs does not match. A place in the text less the place
    in the template is the diagonal; what stands there is counted once for each place of the template: places has a bit for each (fewer than 64).
    `row` is a hash of the text, so that rows of one id stay apart unless they are equal.
    """
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), words_of(F.col(text_col)).alias("words"))
    each = words.select("id", "row", F.posexplode("words").alias("pos", "w1"), "words").select("id", "row", "pos", "w1", F.get("words", F.col("pos") + 1).alias("w2"))
    places = F.broadcast(_templates(docs.sparkSession))  # fixed size
    met = each.where("w2 is not null").withColumn("h", F.xxhash64(F.lower("w1"), F.lower("w2"))).join(places, (F.col("h") == F.col("gram")) & (lower_ascii(F.col("w1")) == F.col("word1")) & (lower_ascii(F.col("w2")) == F.col("word2")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))
    held = met.groupBy("id", "row", "template", "label", "grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.bit_or(bit).alias("places"), F.min("pos").alias("low"), (F.max("pos") + K - 1).alias("high"))
    return held.select("id", "row", "template", "label", "grams", "diagonal", F.bit_count("places").cast("long").alias("votes"), "low", "high", "places")


def _chain(diagonals: Column, grams: Column) -> Column:
    """(n, first, last) of the longest run of a template's k-grams that stand in a text in the template's order, given the (diagonal, places) of a span.

    From one k-gram of the run to the next, both the place in the text and that in the template grow, and no more than GAP words come in or drop out. So the
    one before stands at most grams + GAP places back, and only those are looked at.
    """
    on = lambda d: F.filter(F.sequence(F.lit(0), grams - 1), lambda k: F.getbit(d["places"], k) == 1)
    places = F.array_sort(F.flatten(F.transform(diagonals, lambda d: F.transform(on(d), lambda k: F.struct((d["diagonal"] + k).alias("pos"), k.alias("at"))))))

    def step(acc: Column, x: Column) -> Column:
        before = F.filter(acc, lambda r: (r["pos"] < x["pos"]) & (r["at"] < x["at"]) & (F.abs((x["pos"] - x["at"]) - (r["pos"] - r["at"])) <= GAP))
        most = F.array_max(F.transform(before, lambda r: F.struct(r["n"].alias("n"), r["first"].alias("first"))))
        one = F.struct((F.coalesce(most["n"], F.lit(0)) + 1).alias("n"), F.coalesce(most["first"], x["pos"]).alias("first"), x["pos"].alias("pos"), x["at"].alias("at"))
        # the longest run so far stays, however far back
        top = F.array_max(acc)
        return F.concat(F.filter(acc, lambda r: (r["pos"] >= x["pos"] - grams - GAP) | (r == top)), F.array(one))

    runs = F.aggregate(places, F.expr("cast(array() as array<struct<n int, first int, pos int, at int>>)"), step)
    best = F.array_max(runs)
    return F.struct(best["n"].alias("n"), best["first"].alias("first"), (best["pos"] + K - 1).alias("last"))


def spans(voted: DataFrame) -> DataFrame:
    """(id, row, template, label, first_word, last_word, coverage): neighbouring diagonals merged, and those that hold up.

    A span holds up if COVERAGE of the template's k-grams stand in it in the template's order; a k-gram that comes again counts once.
    """
    order = W.partitionBy("id", "row", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(True))
    numbered = voted.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = numbered.groupBy("id", "row", "template", "label", "grams", "span").agg(F.bit_count(F.bit_or("places")).alias("distinct"), F.collect_list(F.struct("diagonal", "places")).alias("diagonals"))
    chained = merged.where(F.col("distinct") / F.col("grams") >= COVERAGE).withColumn("run", _chain(F.col("diagonals"), F.col("grams")))
    coverage = F.col("run.n") / F.col("grams")
    return chained.where(coverage >= COVERAGE).select("id", "row", "template", "label", F.col("run.first").cast("long").alias("first_word"), F.col("run.last").cast("long").alias("last_word"), coverage.alias("coverage"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    n_base counts the places of PHRASES, which stand on one diagonal with all their k-grams; first_word and last_word are the smallest and
    largest of their starts (null if there is none). labels are theirs and those of the spans that hold up. score is the highest coverage.
    Null and empty texts have no words and no labels (an empty string). Equal rows have equal results.
    """
    voted = keep(votes(docs, id_col, text_col), "votes")
    whole = (F.col("template") < len(PHRASES)) & (F.col("votes") == F.col("grams"))
    base = voted.where(whole).select("id", "row", F.col("label"), F.col("diagonal").alias("start"), F.lit(1.0).alias("coverage"))
    other = spans(voted.where(F.col("template") >= len(PHRASES))).select("id", "row", "label", F.lit(None).cast("int").alias("start"), "coverage")
    is_base = F.col("start").isNotNull()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = base.unionByName(other).groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(
        F.count("start").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("coverage").alias("score"),
    )
    counted = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_AS_IS)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), counted.alias("n_words"))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    return out.select("id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle() -> str:
    """The same for `documents`, in DuckDB's SQL."""
    values = ", ".join(f"({n}, '{label}', {grams}, {at}, '{a}', '{b}')" for n, label, grams, at, a, b in template_rows(PHRASES) + template_rows(TEMPLATES, len(PHRASES)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE places(template, label, grams, place, word1, word2) AS (VALUES {values}),
texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS words FROM documents),
each AS (SELECT doc_id, words, unnest(range(len(words) - 1)) AS pos FROM texts WHERE len(words) > 1),
met AS (SELECT DISTINCT e.doc_id, p.template, p.label, p.grams, p.place, e.pos FROM each e JOIN places p ON e.words[e.pos + 1] = p.word1 AND e.words[e.pos + 2] = p.word2),
whole AS (SELECT doc_id, label, pos - place AS start FROM met WHERE template < {len(PHRASES)} GROUP BY doc_id, template, label, grams, pos - place HAVING count(DISTINCT place) = grams),
enough AS (SELECT doc_id, template FROM met WHERE template >= {len(PHRASES)} GROUP BY doc_id, template, grams HAVING count(DISTINCT place) >= {COVERAGE} * grams),
marked AS (SELECT m.* FROM met m JOIN enough USING (doc_id, template)),
runs(doc_id, template, label, grams, place, pos, n) AS (
  SELECT doc_id, template, label, grams, place, pos, 1 FROM marked
  UNION
  SELECT m.doc_id, m.template, m.label, m.grams, m.place, m.pos, r.n + 1 FROM runs r JOIN marked m
    ON m.doc_id = r.doc_id AND m.template = r.template AND m.pos > r.pos AND m.place > r.place AND abs((m.pos - m.place) - (r.pos - r.place)) <= {GAP}),
found AS (
  SELECT doc_id, label, start, 1.0::DOUBLE AS coverage FROM whole
  UNION ALL
  SELECT doc_id, label, NULL, max(n)::DOUBLE / grams FROM runs GROUP BY doc_id, template, label, grams HAVING max(n)::DOUBLE / grams >= {COVERAGE}),
summed AS (SELECT doc_id, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE start IS NOT NULL), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM found GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM texts t LEFT JOIN summed s ON t.doc_id = s.doc_id"""
