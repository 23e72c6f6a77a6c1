import hashlib
from collections import Counter

import numpy as np

from siteselect.llm import minhash


def jaccard(a, b, width=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_edits_equal_brute_force(spark, docs):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, n)) for n in (0, 1, 3, 7, 50, 400, 900, 2000)] + [None, "ünï çödé " * 40, "same text here", "same text here"]
    ids = list(range(100, 100 + 3 * len(texts), 3))
    got = {r["doc_id"]: r for r in minhash.with_edits(docs(texts, ids=ids)).collect()}
    assert sorted(got) == ids
    order = sorted(range(len(texts)), key=lambda i: -ids[i])
    for k, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        row = got[ids[i]]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert abs(row["near_edited"] - jaccard(text, changed)) < 0.16
        assert abs(row["near_next"] - jaccard(text, following)) < 0.16
    assert got[ids[-1]]["fingerprint"] == got[ids[-2]]["fingerprint"]


def test_one_row_and_no_rows(spark, docs):
    row = minhash.with_edits(docs(["abc def ghi"])).collect()
    assert len(row) == 1 and row[0]["near_next"] == 1.0
    assert minhash.with_edits(docs(["abc"]).where("doc_id < 0")).count() == 0


def test_estimate_is_unbiased_also_for_short_texts():
    words = minhash.WordHashes()
    rng = np.random.default_rng(3)
    for size in (12, 60, 1000):
        errors = []
        for _ in range(60):
            a = [f"w{i}" for i in rng.integers(0, 10**6, size)]
            cut = int(size * rng.uniform(0.1, 0.9))
            b = a[:cut] + [f"v{i}" for i in rng.integers(0, 10**6, size - cut)]
            x, y = " ".join(a), " ".join(b)
            estimate = minhash.likeness(minhash.fingerprint(x.encode(), words), minhash.fingerprint(y.encode(), words))
            errors.append(estimate - jaccard(x, y))
        assert abs(np.mean(errors)) < 0.04, (size, np.mean(errors))


def test_fingerprints_table(spark, docs):
    rows = {r["id"]: bytes(r["fingerprint"]) for r in minhash.fingerprints(docs([None, "a b c", "A b  c"])).collect()}
    assert rows[0] == b"" and rows[1] == rows[2] and len(rows[1]) == minhash.BINS * minhash.BITS // 8


def test_rows_of_one_id_follow_in_the_stated_order_and_ids_keep_their_type(spark):
    import xxhash

    texts = [f"text number {i} of some words" for i in range(40)] + ["text number 7 of some words"]
    rows = [("b", t) for t in texts] + [("a", "first of all"), (None, "none at all")]
    frame = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = minhash.with_edits(frame).collect()
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), seed=42))
    order = sorted([r for r in rows if r[0] == "b"], key=lambda r: (signed(r[1]), r[1])) + [("a", "first of all"), (None, "none at all")]
    want = Counter((i, hashlib.sha256(minhash.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
