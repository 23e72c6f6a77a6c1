import random
import re
import zlib
from collections import Counter

import numpy as np

from siteselect.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Whether one insertion, deletion or replacement leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def words_of(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def brute(rows):
    words, out = words_of(rows), {}
    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in links.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(links[w]), words.get(form.get(w)))
    return out


def found(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame).collect()}


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in queries.QUERIES["op13_spelling_variants"](spark, SF).collect()}
    assert got == brute(rows) and any(v[0] for v in got.values())


def test_all_links_of_many_like_words_are_found(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(700)} | {"a" * k for k in range(5, 12)} | {"ab" * k for k in range(3, 8)} | {"x" * 400, "x" * 401, "y" + "x" * 400}
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = sorted((r["a"], r["b"]) for r in spelling.links(frame).collect())
    assert got == sorted((a, b) for a in words for b in words if a < b and near(a, b))


def test_chains_of_forms_ties_nulls_and_empty_tables(spark, docs):
    texts = ["palabra " * 40 + "palabre " * 20 + "palubre " * 9 + "pulubre " * 4, "Größe GRÖSSE Größen größen " * 5, None, "", "ALPHA1alpha2alphÀ×÷ " * 3, "漢字wordy漢字 " * 4, "z" * 300_000, "palabra"]
    frame = docs([*texts, *texts], ids=[*range(len(texts)), *[None] * len(texts)])
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = found(frame)
    assert got == brute(rows)
    assert got["pulubre"][:2] == ("palubre", "palabra")
    assert found(frame.where("doc_id < 0")) == {} and found(docs([None, "", "one two"])) == {}


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(10)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        costs = [rng.randint(1, 9) for _ in places]
        chosen = spelling.pivots(places, costs)
        assert chosen[1] - chosen[0] >= 2
        price = dict(zip(places, costs, strict=True))
        assert sum(price[p] for p in chosen) == min(price[a] + price[b] for a in places for b in places if b - a >= 2)


def test_prefix_has_every_bigram_up_to_the_third_rarest():
    counts = np.zeros(1 << 16, np.int64)
    word = b"aaaaab"
    last, prefix, chosen, codes = spelling.grams_of(word, counts)
    assert prefix == [0, 1, 2, 3] and len(codes) == 5 and chosen == [0, 2]
