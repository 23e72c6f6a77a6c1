"""Near-duplicate lines by an exact set-similarity join, with DataFrame operations only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from siteselect.llm.common import keep

#: What a text must have to hold a token.
TOKEN = r"[^ \t\r\n]"
#: Lines match at a Jaccard similarity of NUM / DEN or more; kept as integers, so that no comparison rounds.
NUM, DEN = 4, 5
#: Buckets of the token counts that order tokens by rarity, and bits of the sets of texts and lines that verification reads.
BUCKETS, FILTER_BITS = 1 << 18, 1 << 22
#: Lines of more tokens have twice as many parities; bytes of a file's dictionary of token hashes.
LONG, DICTIONARY = 96, 8 << 20
#: Slices of the prefix tokens that the pair join takes one after the other, so that its shuffle needs so much less disk at a time.
SLICES = 2


def _plain(text: Column) -> Column:
    """The lower-cased text with a blank for each tab and carriage return. Whole strings cost a fraction of what regular expressions do."""
    plain = F.lower(text)
    for mark in ("\t", "\r"):
        plain = F.replace(plain, F.lit(mark), F.lit(" "))
    return plain


def tokens(line: Column) -> Column:
    """Distinct words of a plain line."""
    return F.array_remove(F.array_distinct(F.split(line, " ")), "")


def _each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, line_no, line): plain lines; `row` is a hash of the text, so that rows of one id stay apart unless they are equal."""
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), _plain(F.col(text_col)).alias("plain"))
    return plain.select("id", "row", F.posexplode(F.split("plain", "\n")).alias("line_no", "line"))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, line_no, cls, cls2, words): each line with a token; two hashes of its token set, which name its class; and the hashes of its tokens, sorted.

    Texts are cut into tokens here alone: what orders tokens and what looks for matches reads the hashes. Repeated ones are written once, as places in a dictionary.
    """
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))
    each = _each(docs, id_col, text_col).select("id", "row", "line_no", F.sort_array(hashes).alias("words")).where(F.size("words") > 0)
    named = (F.xxhash64("words").alias("cls"), F.xxhash64(F.lit(1), F.col("words")).alias("cls2"))
    return keep(each.select("id", "row", "line_no", *named, "words"), "lines", options={"parquet.dictionary.page.size": DICTIONARY})


def _rarity(hashed: DataFrame) -> DataFrame:
    """One row with an array: for each bucket of token hashes, how many binary digits the number of lines with its tokens has, in the high bits of a long. Its size is fixed."""
    each = hashed.select(F.explode("words").alias("word"))
    counts = each.groupBy(F.col("word").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    every = hashed.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    high = F.shiftleft(F.length(F.bin(F.coalesce("n", F.lit(0)))).cast("long"), 57)
    classes = every.join(counts, "bucket", "left").select("bucket", high.alias("high"))
    return keep(classes.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "high"))), lambda x: x["high"]).alias("high")), "rarity")


def _signature(words: Column, high: Column) -> Column:
    """Token hashes as longs in one order for all lines: rare ones first (by their bucket's count), then by hash."""
    of = lambda h: F.coalesce(F.get(high, h.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0).cast("long"))
    return F.sort_array(F.transform(words, lambda h: of(h).bitwiseOR(F.shiftrightunsigned(h, 7))))


def _least_overlap(n: Column) -> Column:
    """ceil(n * NUM / DEN): what a line of n tokens must share with any match."""
    return F.floor((n * NUM + (DEN - 1)) / DEN).cast("int")


def _lines(hashed: DataFrame) -> DataFrame:
    """(id, row, line_no, cls, cls2, n, bits0, bits1, prefix): each line with its class, its number of tokens and the tokens of its prefix.

    A line and any match of it share a token among their prefixes, the n - ceil(0.8 n) + 1 rarest tokens of each. Prefix tokens
    are kept as 31 bits; two that collide only add a candidate. bits0 has 64 parities of the token hashes: a token that only one of two lines has
    changes one of them, so they bound the difference of the sets from below. Lines of more than LONG tokens have 128: bits1 has those of one half of the hashes.
    """
    ordered = hashed.withColumn("high", _rarity(hashed).scalar())
    signed = ordered.select("id", "row", "line_no", "cls", "cls2", _signature(F.col("words"), F.col("high")).alias("sig")).withColumn("n", F.size("sig"))
    prefix = F.slice("sig", F.lit(1), F.col("n") - _least_overlap(F.col("n")) + 1)
    flip = lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int")))
    none = F.lit(0).cast("long")
    half = F.aggregate("sig", none, lambda a, t: F.when(t.bitwiseAND(64) == 64, flip(a, t)).otherwise(a))
    bits = (F.aggregate("sig", none, flip).alias("bits0"), F.when(F.col("n") > LONG, half).otherwise(none).alias("bits1"))
    return signed.select("id", "row", "line_no", "cls", "cls2", "n", *bits, F.transform(prefix, lambda t: t.bitwiseAND((1 << 31) - 1).cast("int")).alias("prefix"))


def _classes(lines: DataFrame) -> DataFrame:
    """(num, cls, cls2, first, more, ord, n, bits0, bits1, prefix): a class for each token set, with its first line; num names it, ord goes with the order of the first lines."""
    place = F.struct("id", "row", "line_no")
    grouped = lines.groupBy("cls", "cls2").agg(F.min(place).alias("first"), (F.count("*") > 1).alias("more"), *[F.first(c).alias(c) for c in ("n", "bits0", "bits1", "prefix")])
    number = isinstance(lines.schema["id"].dataType, IntegralType)
    order = F.coalesce(F.col("first.id").cast("long"), F.lit(-(1 << 63))) if number else F.lit(0).cast("long")
    return keep(grouped.select(F.monotonically_increasing_id().alias("num"), "cls", "cls2", "first", "more", order.alias("ord"), "n", "bits0", "bits1", "prefix"), "classes")


def _shared(na: Column, nb: Column) -> Column:
    """What sets of these sizes share at least, if they match."""
    return F.floor(((na + nb) * NUM + (NUM + DEN - 1)) / (NUM + DEN))


def _spare(a: str, b: str) -> Column:
    """Tokens that two sets (the prefixes of their columns) may still differ by, going by sizes and parities; a match has 0 or more."""
    na, nb = _size(a), _size(b)
    every, half = (F.col(f"{a}bits{k}").bitwiseXOR(F.col(f"{b}bits{k}")) for k in (0, 1))
    differ = F.when((na > LONG) & (nb > LONG), F.bit_count(half) + F.bit_count(every.bitwiseXOR(half))).otherwise(F.bit_count(every))
    return na + nb - 2 * _shared(na, nb) - differ


def _posts(classes: DataFrame) -> DataFrame:
    """(num, ord, at, bits0, bits1, key): a row for each prefix token of each class; `at` packs its size, the token's place and whether it is done, as
    narrow rows make small shuffles. Sets of fewer than NUM tokens match their equals alone."""
    each = classes.where(F.col("n") >= NUM).select("num", "ord", "n", "done", "bits0", "bits1", F.posexplode("prefix").alias("pos", "key"))
    at = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos") * 2 + F.col("done").cast("int")
    return each.select("num", "ord", at.alias("at"), "bits0", "bits1", "key")


def _size(of: str = "") -> Column:
    return F.shiftright(f"{of}at", 32).cast("int")


def _place(of: str = "") -> Column:
    return F.shiftright(F.col(f"{of}at").bitwiseAND((1 << 32) - 1), 1).cast("int")


def _done(of: str = "") -> Column:
    return F.col(f"{of}at").bitwiseAND(1) == 1


def _short(posts: DataFrame) -> DataFrame:
    """The postings under which a class meets sets that are as long as its own or longer: it shares one of so many with each match among them."""
    return posts.where(_place() <= _size() - _shared(_size(), _size()))


def _leaders(classes: DataFrame) -> DataFrame:
    """(a, b): for each class the earlier one that is most likely to match among those that come first under one of its prefix tokens, if any may. Copies of one
    line nearly all find their first here, so that the join below need not pair them with each other."""
    posts = _short(_posts(classes.withColumn("done", F.lit(False))))
    # of equal places all columns take the same row; hashing their fixed widths spares the sorts that a least struct takes
    first = posts.groupBy("key").agg(*[F.min_by(c, "ord").alias(f"l_{c}") for c in ("num", "at", "bits0", "bits1")])
    met = posts.join(first, "key").where(F.col("l_num") != F.col("num")).withColumn("spare", _spare("", "l_"))
    best = met.where("spare >= 0").groupBy("num").agg(F.max_by("l_num", "spare").alias("a"))
    return keep(best.select("a", F.col("num").alias("b")), "leaders")


def _candidates(classes: DataFrame, done: DataFrame) -> DataFrame:
    """(a, b): pairs of classes that share a prefix token and pass the length, the positional and the parity filter, but for pairs whose later class
    is done: it has an earlier match, and needs no other. The earlier one may be done or not.

    The longer set asks with its whole prefix, the shorter one stands under the part that longer matches must share.
    """
    flagged = classes.select("num", "ord", "n", "bits0", "bits1", "prefix").join(done.select("num", F.lit(True).alias("done")), "num", "left")
    flagged = keep(flagged.withColumn("done", F.coalesce("done", F.lit(False))), "flagged")
    slices = [keep(_pairs(_posts(flagged).where(F.pmod("key", F.lit(SLICES)) == n)), "candidates") for n in range(SLICES)]
    return functools.reduce(DataFrame.union, slices).distinct()


def _pairs(posts: DataFrame) -> DataFrame:
    """(a, b): the pairs of classes among these postings."""
    a, b = posts.alias("a"), _short(posts).alias("b")
    na, nb = _size("a."), _size("b.")
    rest = F.least(na - _place("a."), nb - _place("b."))  # places count from 0
    longer = (na > nb) | ((na == nb) & (F.col("a.num") > F.col("b.num")))
    later_done = F.when(F.col("a.ord") > F.col("b.ord"), _done("a.")).when(F.col("a.ord") < F.col("b.ord"), _done("b.")).otherwise(_done("a.") & _done("b."))
    fits = (rest >= _shared(na, nb)) & (_spare("a.", "b.") >= 0)
    on = (F.col("a.key") == F.col("b.key")) & longer & (nb * DEN >= na * NUM) & ~later_done & fits
    return a.join(b, on).select(F.col("a.num").alias("a"), F.col("b.num").alias("b")).distinct()


def _bit_set(values: DataFrame) -> DataFrame:
    """One row with an array of longs: a bit set of fixed size of the column `value`."""
    slot = F.pmod(F.col("value"), F.lit(FILTER_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    words = values.groupBy(F.floor(slot / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))
    every = values.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("word"))
    filled = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    return keep(filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits")), "bit-set")


def _in(bits: Column, value: Column) -> Column:
    slot = F.pmod(value, F.lit(FILTER_BITS))
    return F.getbit(F.get(bits, F.floor(slot / 64).cast("int")), (slot % 64).cast("int")) == 1


def _later(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(num): the classes that are the later one of a pair whose token sets do have the similarity.

    Only the first lines of named classes are read out of the texts again: bit sets of fixed size keep most other texts and lines from the join.
    """
    named = pairs.select(F.col("a").alias("num")).union(pairs.select("b")).distinct()
    wanted = keep(classes.select("num", "first").join(named, "num").select("num", "first.*"), "wanted")
    texts = _bit_set(wanted.select(F.col("row").alias("value")))
    places = _bit_set(wanted.select(F.xxhash64("row", "line_no").alias("value")))
    holding = docs.withColumn("_bits", texts.scalar()).where(_in(F.col("_bits"), F.xxhash64(text_col)))
    read = _each(holding, id_col, text_col).withColumn("bits", places.scalar()).where(_in(F.col("bits"), F.xxhash64("row", "line_no"))).drop("bits")
    at = F.struct("id", "row", "line_no")
    named_at = wanted.select("num", at.alias("first"))
    sets = keep(read.select(at.alias("at"), "line").join(named_at, F.col("at").eqNullSafe(F.col("first"))).groupBy("num", "first").agg(F.min("line").alias("line")).select("num", "first", tokens(F.col("line")).alias("set")), "sets")
    left, right = sets.toDF("a", "fa", "sa"), sets.toDF("b", "fb", "sb")
    shared = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(left, "a").join(right, "b").where(shared * (NUM + DEN) >= (F.size("sa") + F.size("sb")) * NUM)
    return keep(met.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("num")).distinct(), "later")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, removed): for each text that loses lines, their numbers (from 0, sorted).

    A line is removed if an earlier one, by id, then by a hash of the text where an id is repeated, then by line number, has the same
    token set or one of Jaccard similarity 0.8 or more, whether that one itself is removed or not. Lines without a token stay and
    remove none. Rows equal in id and text count as one. Null ids come first; null texts have no lines.

    Equal sets form a class and enter the join once, however many lines there are.
    """
    docs = docs.select(id_col, text_col).where(F.col(text_col).isNotNull())
    hashed = _hashed(docs, id_col, text_col)
    classes = _classes(_lines(hashed))
    near = _later(docs, id_col, text_col, classes, _leaders(classes))
    rest = _later(docs, id_col, text_col, classes, _candidates(classes, near))
    matched = near.union(rest).distinct().withColumn("near", F.lit(True))
    # of a class without an earlier match its first line stays; of the others none
    changed = classes.select("num", "cls", "cls2", "first", "more").join(matched, "num", "left").where(F.col("more") | F.col("near"))
    earliest = changed.select("cls", "cls2", F.when(F.col("near").isNull(), F.col("first")).alias("stays"))
    place = F.struct("id", "row", "line_no")
    gone = hashed.select("cls", "cls2", "id", "row", "line_no").join(earliest, ["cls", "cls2"]).where(~place.eqNullSafe(F.col("stays")))
    return gone.groupBy("id", "row").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def _with_removals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    gone = removals(docs, id_col, text_col).select(F.col("id").alias("_line_id"), F.col("row").alias("_line_row"), F.col("removed").alias("_line_gone"))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_line_id")) & (F.xxhash64(text_col) == F.col("_line_row")), "left").drop("_line_id", "_line_row")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, removed_lines) for each row; removed_lines are comma-joined. A null text has 0 lines."""
    gone = removals(docs, id_col, text_col).select(F.col("id").alias("_line_id"), F.col("row").alias("_line_row"), "removed")
    count = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"))) + 1
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.coalesce(count, F.lit(0)).cast("long").alias("n_lines"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("_line_id")) & (F.col("row") == F.col("_line_row")), "left")
    return joined.select("id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the lines of `removals` taken out of their texts. Rows that have no line left with a token go; all others and all columns stay.

    A column chars_col, if there is one, is set to the new text's length where the text changed.
    """
    joined = _with_removals(docs, id_col, text_col)
    split, gone = F.split(text_col, "\n"), F.col("_line_gone")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone), lambda i: F.get(split, i))
    changed = joined.withColumn(text_col, F.when(gone.isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
    changed = changed.where(gone.isNull() | F.col(text_col).rlike(TOKEN))
    if chars_col and chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        changed = changed.withColumn(chars_col, F.when(gone.isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(kind)))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, i AS line_no, list_sort(list_filter(list_distinct(string_split(replace(replace(lower(parts[i + 1]), chr(9), ' '), chr(13), ' '), ' ')), lambda w: w <> '')) AS words
  FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
used AS (SELECT * FROM lines WHERE len(words) > 0),
sets AS (SELECT words, min((doc_id, line_no)) AS first, row_number() OVER () AS cls FROM used GROUP BY words),
each AS (SELECT cls, len(words) AS n, unnest(words) AS word FROM sets),
freq AS (SELECT word, count(*) AS df FROM each GROUP BY word),
ranked AS (SELECT e.cls, e.n, e.word, row_number() OVER (PARTITION BY e.cls ORDER BY f.df, e.word) AS pos FROM each e JOIN freq f USING (word)),
prefix AS (SELECT * FROM ranked WHERE pos <= n - (n * {NUM} + {DEN - 1}) // {DEN} + 1),
pairs AS (SELECT DISTINCT a.cls AS a, b.cls AS b FROM prefix a JOIN prefix b ON a.word = b.word AND a.cls <> b.cls AND least(a.n, b.n) * {DEN} >= greatest(a.n, b.n) * {NUM}),
near AS (SELECT p.a AS cls, min(y.first) AS first FROM pairs p JOIN sets x ON x.cls = p.a JOIN sets y ON y.cls = p.b
  WHERE len(list_intersect(x.words, y.words)) * {NUM + DEN} >= (len(x.words) + len(y.words)) * {NUM} GROUP BY p.a),
stays AS (SELECT s.words, least(s.first, coalesce(n.first, s.first)) AS stays FROM sets s LEFT JOIN near n USING (cls)),
gone AS (SELECT u.doc_id, u.line_no FROM used u JOIN stays s ON u.words = s.words WHERE (u.doc_id, u.line_no) <> s.stays),
summed AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS numbers FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(s.n, 0) AS n_removed, coalesce(s.numbers, '') AS removed_lines
FROM documents d LEFT JOIN summed s USING (doc_id)"""
