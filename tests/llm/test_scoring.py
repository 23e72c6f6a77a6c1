import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from siteselect.llm import scoring


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + ["</s>"]


def brute(texts, ids):
    """Counts, weights and scores by dictionaries; the weights' table is binned as documented."""
    code = {i: zlib.crc32(str(i).encode()) % 10 for i in ids}
    uni, pair, kept_uni, kept_pair = Counter(), Counter(), Counter(), Counter()
    for i, t in zip(ids, texts, strict=True):
        seq = tokens(t)
        for v, w in zip(["<s>", *seq[:-1]], seq, strict=True):
            if code[i] != 0:
                uni[w] += 1
                pair[v, w] += 1
                uni["<s>"] += v == "<s>"
            if code[i] > 1:
                kept_uni[w] += 1
                kept_pair[v, w] += 1
                kept_uni["<s>"] += v == "<s>"
    total = sum(n for w, n in uni.items() if w != "<s>")
    kept_total = sum(n for w, n in kept_uni.items() if w != "<s>")
    distinct = sum(n > 0 for w, n in uni.items() if w != "<s>")
    rows = Counter()
    for i, t in zip(ids, texts, strict=True):
        if code[i] == 1:
            seq = tokens(t)
            for v, w in zip(["<s>", *seq[:-1]], seq, strict=True):
                c = kept_uni[v]
                two = kept_pair[v, w] / c if c else 0.0
                rows[int(scoring._bucket(np.array([c]))[0]), int(scoring._bin(np.array([two]))[0]), int(scoring._bin(np.array([kept_uni[w] / kept_total]))[0])] += 1
    table = np.array([(*k, n) for k, n in rows.items()]).reshape(-1, 4)
    weights = scoring.learn_weights(table, 1 / (distinct + 1))
    out = {}
    for i, t in zip(ids, texts, strict=True):
        seq = tokens(t)
        score = 0.0
        for v, w in zip(["<s>", *seq[:-1]], seq, strict=True):
            c = uni[v]
            a = weights[int(scoring._bucket(np.array([c]))[0])]
            score += math.log10(a[0] * (pair[v, w] / c if c else 0) + a[1] * uni[w] / total + a[2] / (distinct + 1))
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in seq)
        out[i] = (code[i] == 0, len(seq), sum(uni[w] > 0 for w in seq), total, base, score)
    return out


@pytest.mark.parametrize(("chars", "keys", "bits"), [(3000, 300, 10), (500, 50, 2)])
def test_scores_equal_brute_force(spark, docs, monkeypatch, chars, keys, bits):
    """One hop to few shards, then three hops between about 40 blocks and 64 shards."""
    monkeypatch.setattr(scoring, "BLOCK_CHARS", chars)
    monkeypatch.setattr(scoring, "SHARD_KEYS", keys)
    monkeypatch.setattr(scoring, "HOP_BITS", bits)
    rng = random.Random(12)
    texts = []
    for _ in range(150):
        w, out = "w0", []
        for _ in range(rng.randint(0, 60)):
            w = f"w{(int(w[1:]) * 3 + rng.choice([0, 0, 1])) % 40}" if rng.random() < 0.9 else f"W{rng.randint(0, 200)}".replace("W", rng.choice("wW"))
            w = w.lower()
            out.append(w if rng.random() < 0.9 else w.upper())
        texts.append(rng.choice([" ", "\n", "\t "]).join(out))
    texts += [None, "", "é ñ unseen tokens", texts[0]]
    ids = list(range(len(texts)))
    got = {r["id"]: r for r in scoring.score(docs(texts)).collect()}
    want = brute(texts, ids)
    assert len(got) == len(texts)
    for i in ids:
        r, w = got[i], want[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert math.isclose(r["base_score"], w[4], rel_tol=1e-9) and math.isclose(r["score"], w[5], rel_tol=1e-9)
    test = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def test_no_rows_and_one_row(spark, docs):
    assert scoring.score(docs(["a"]).where("doc_id < 0")).count() == 0
    assert scoring.score(docs(["a b"])).count() == 1


def test_messages_grow_with_the_text(spark, docs, monkeypatch):
    """Twice the text is twice the blocks and twice the shards, but no block writes to more than 2**HOP_BITS ranges."""
    monkeypatch.setattr(scoring, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(scoring, "HOP_BITS", 2)
    monkeypatch.setattr(scoring, "small_batches", lambda *_: None)
    made, real = [], scoring.keep

    def counted(frame, name):
        made.append(real(frame, name))
        return made[-1]

    monkeypatch.setattr(scoring, "keep", counted)
    rng = random.Random(3)
    blocked = spark.createDataFrame([(b, scoring.TRAIN, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(300)).encode()) for b in range(48)], "block int, cls int, text binary")
    replies, sums = scoring._exchange(blocked, 6)
    assert len(made) == 5  # two tables of questions, three of answers
    assert all(m.where("block >= 0").count() <= 48 * 2 * 4 for m in made)
    assert replies.select("block").distinct().count() == 48
    assert sums.where("block = -1").selectExpr("sum(total)").first()[0] == 48 * 301


def test_counts_beyond_four_bytes():
    for values in ([], [0, 3, 2**32 - 1], [1, 2**32, 2**45]):
        x = np.array(values, np.int64)
        assert scoring._unpack_counts(scoring._pack_counts(x), len(x)).tolist() == values


def test_null_and_text_ids_repeats_and_a_very_long_text(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    rows = [("a", "x y"), ("a", "x y"), (None, "x y"), (None, None), (None, long), ("", "Ünseen \u2003 X")]
    frame = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 AS id", "2 AS cls", "3 AS block")
    got = scoring.score(frame).collect()
    assert len(got) == len(rows) and sorted(r["n_tokens"] for r in got) == [1, 3, 3, 3, 4, 300_001]
    assert len({(r["score"], r["base_score"]) for r in got if r["id"] == "a"}) == 1
    assert all(not r["held_out"] for r in got if r["id"] is None) and all(math.isfinite(r["score"]) for r in got)
