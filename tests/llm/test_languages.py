import random
from collections import Counter, defaultdict
from math import log2

import numpy as np

from siteselect.llm import languages


def brute_bits(counts, word, order, chars):
    """Interpolated Kneser-Ney by dictionaries; a word's n-grams do not reach before its first mark."""
    edge = "\x02"
    grams = [None] + [Counter() for _ in range(order)]
    before = [None] + [defaultdict(set) for _ in range(order)]
    for w, n in counts.items():
        t = edge + w + edge
        for i in range(1, len(t)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    grams[k][t[i - k + 1 : i + 1]] += n
                    if k < order and i - k >= 0:
                        before[k][t[i - k + 1 : i + 1]].add(t[i - k])
    c = [None] + [{g: (len(before[k][g]) if k < order and before[k][g] else n) for g, n in grams[k].items()} for k in range(1, order + 1)]
    d = [None]
    for k in range(1, order + 1):
        n1, n2 = sum(v == 1 for v in c[k].values()), sum(v == 2 for v in c[k].values())
        d.append(min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (chars * 4)
        same = {x: v for x, v in c[k].items() if x[:-1] == g[:-1]}
        lower = p(g[1:])
        if not same:
            return lower
        total = sum(same.values())
        return max(c[k].get(g, 0) - d[k], 0) / total + d[k] * len(same) / total * lower

    t = edge + word + edge
    return sum(log2(p(t[max(0, i - order + 1) : i + 1])) for i in range(1, len(t)))


def test_model_equals_brute_force_kneser_ney():
    rng = random.Random(3)
    counts = {lang: {"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))): rng.randint(1, 5) for _ in range(60)} for lang, letters in (("xx", "abcde"), ("yy", "cdefg"))}
    model = languages.train(counts, order=3)
    chars = len({ch for c in counts.values() for w in c for ch in w}) + 2
    words = [*counts["xx"], *counts["yy"], "zzz", "abz", "q"]
    n, scores = model.bits(words)
    for i, w in enumerate(words):
        assert n[i] == len(w) + 1
        for j, lang in enumerate(model.langs):
            assert np.isclose(scores[i, j], brute_bits(counts[lang], w, 3, chars)), (w, lang)


def test_predict_on_held_out_texts_and_odd_rows(spark, docs):
    rng = random.Random(1)
    vocabulary = {"aa": ["the", "and", "ing", "tion", "with"], "bb": ["der", "und", "ung", "sch", "mit"]}
    langs = [rng.choice(["aa", "bb"]) for _ in range(300)]
    texts = [" ".join("".join(rng.choices(vocabulary[lang], k=2)) for _ in range(30)) for lang in langs]
    frame = docs([*texts, None, "", "123 !?", "xqzj vkwp " * 30, texts[0] * 200], langs=[*langs, None, None, None, None, None])
    model = languages.fit(frame.where("doc_id % 3 <> 0"))
    got = {r["id"]: r for r in languages.predict(frame, model).collect()}
    assert len(got) == 305
    assert all(got[i]["lang_pred"] == langs[i] and got[i]["accepted"] and 0.5 < got[i]["score"] <= 1 for i in range(300))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["accepted"] for i in (300, 301, 302))
    assert not got[303]["accepted"] and got[303]["lang_pred"] in ("aa", "bb")
    assert got[304]["lang_pred"] == langs[0]


def test_numerals_are_no_letters_and_marks_stay_in_words():
    assert languages.words_of("½ ² Ⅷ 12 _ abc") == ["abc"] and languages.words_of("हिन्दी") == ["हिन्दी"]


def test_a_language_without_long_documents_takes_the_common_limit(spark, docs):
    rng = random.Random(4)
    vocabulary = {"aa": ["the", "and", "ing", "tion", "with"], "bb": ["der", "und", "ung", "sch", "mit"]}
    text = lambda lang, n: " ".join("".join(rng.choices(vocabulary[lang], k=2)) for _ in range(n))
    langs = ["aa"] * 200 + ["bb"] * 12
    model = languages.fit(docs([text("aa", 40) if lang == "aa" else text("bb", 2) for lang in langs], langs=langs))
    assert model.langs == ["aa", "bb"] and np.isfinite(model.limits).all()


def test_without_labels_all_is_undetermined(spark, docs):
    frame = docs(["some words"], langs=[None])
    assert [r["lang_pred"] for r in languages.predict(frame, languages.fit(frame)).collect()] == ["und"]
    assert languages.predict(frame.where("doc_id < 0"), languages.fit(frame)).count() == 0


def test_new_words_are_scored_in_small_parts():
    """However many new words a batch brings, what scoring holds at a time is bounded, and each word keeps its own scores."""
    asked = []

    class Model:
        langs = ["a", "b"]

        def bits(self, words):
            asked.append(len(words))
            return np.array([len(w) for w in words], float), np.array([[int(w[1:]), -int(w[1:])] for w in words], float)

    words = languages._Words(Model())
    for low in (0, 15_000, 90_000):
        texts = [[f"w{i}" for i in range(low, low + 20_000)], [], [f"w{low}"]]
        for text, rows in zip(texts, words.rows(texts), strict=True):
            assert words.scores[rows].tolist() == [[int(w[1:]), -int(w[1:])] for w in text] and words.chars[rows].tolist() == [len(w) for w in text]
    assert max(asked) <= 4096 and sum(asked) == 55_000
