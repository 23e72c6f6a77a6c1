import math
import random
from collections import Counter, defaultdict

from siteselect.llm import quality


def discounts(counts):
    n = [sum(v == k for v in counts) for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    raw = (1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5)
    d = [min(max(x, 0.05), k - 0.05) for k, x in enumerate(raw, 1)]
    return lambda c: d[min(c, 3) - 1]


def brute(train, texts):
    pair = Counter()
    for t in train:
        seq = (t or "").lower().split() + ["</s>"]
        pair.update(zip(["<s>", *seq[:-1]], seq, strict=True))
    before, after = Counter(w for _, w in pair), defaultdict(list)
    for (v, _), n in pair.items():
        after[v].append(n)
    d, e = discounts(pair.values()), discounts(before.values())
    kinds, words = sum(before.values()), len(before)
    uniform = sum(e(c) for c in before.values()) / kinds / (words + 1)
    out = []
    for t in texts:
        seq = (t or "").lower().split() + ["</s>"]
        total = 0.0
        for v, w in zip(["<s>", *seq[:-1]], seq, strict=True):
            low = (before[w] - e(before[w])) / kinds + uniform if w in before else uniform
            if v in after:
                c, n = pair[v, w], sum(after[v])
                total += math.log2(((c - d(c)) if c else 0) / n + sum(map(d, after[v])) / n * low)
            else:
                total += math.log2(low)
        out.append(-total / len(seq) if len(seq) > 1 else None)
    return out


def test_perplexity_equals_brute_force(spark, docs):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{min(rng.randint(0, 30), rng.randint(0, 30))}" for _ in range(rng.randint(1, 40)))
    train = [text() for _ in range(60)]
    texts = [text() for _ in range(40)] + [None, "", "never seen words", train[0], train[0].upper()]
    got = {r["id"]: r for r in quality.perplexity(docs(texts), docs(train)).collect()}
    assert len(got) == len(texts)
    for i, bits in enumerate(brute(train, texts)):
        assert (got[i]["bits"] is None) == (bits is None) and (bits is None or math.isclose(got[i]["bits"], bits, rel_tol=1e-9)), i
    again = quality.perplexity(docs(["w1 w2", "w1 w2"], ids=[7, 7]), docs(train)).collect()
    assert len(again) == 2 and all(math.isclose(r["bits"], brute(train, ["w1 w2"])[0]) for r in again)


def test_thresholds_keep_clean_texts_and_reject_junk(spark, docs):
    rng = random.Random(7)
    clean = [" ".join(f"w{min(rng.randint(0, 40), rng.randint(0, 40))}" for _ in range(60)) for _ in range(400)]
    junk = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(60)) for _ in range(150)]
    frame = docs([*clean, *junk, None], langs=["en"] * 300 + [None] * 100 + ["en"] * 151)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 400, 2)] + [(400, 0), (None, 1)], "doc_id long, quality int")
    rows = {r["id"]: r["passes"] for r in quality.classify(frame, labels).collect()}
    # quartiles of a few dozen calibration texts scatter: one clean text in fifty may fall outside
    assert len(rows) == 551 and sum(rows[i] for i in range(400)) >= 392 and not any(rows[i] for i in range(400, 551))


def test_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.classify(docs(["a b", None]), none).collect()
    assert {r["id"]: r["passes"] for r in rows} == {0: True, 1: False}
    assert quality.classify(docs(["a"]).where("doc_id < 0"), none).count() == 0


def test_all_trusted_documents_train_but_those_that_calibrate(spark):
    """About 6,000 trained at most, however many were trusted."""
    labels = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    rows = quality.trusted_ids(labels).collect()
    assert len(rows) == 10_000 and abs(sum(r["trains"] for r in rows) - 8000) < 150


def test_shards_answer_what_is_not_known_everywhere(spark, docs, monkeypatch):
    rng = random.Random(11)
    text = lambda: " ".join(f"w{min(rng.randint(0, 400), rng.randint(0, 400))}" for _ in range(rng.randint(1, 60)))
    train = [text() for _ in range(150)] + [None]
    texts = [text() for _ in range(80)] + [None, "never seen words w1", *train[:5]]
    want = brute(train, texts)
    for known, bits in (((0, 0), 6), ((20, 7), 3)):
        monkeypatch.setattr(quality, "CACHED", known)
        monkeypatch.setattr(quality, "SHARD_BITS", bits)
        got = {r["id"]: r["bits"] for r in quality.perplexity(docs(texts).repartition(5), docs(train).repartition(7)).collect()}
        assert len(got) == len(texts) and all((got[i] is None) == (b is None) and (b is None or math.isclose(got[i], b, rel_tol=1e-9)) for i, b in enumerate(want))
