import math
import random
import re

import pandas as pd

from siteselect.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), ceiling=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(ceiling * sizes[s] for s in full)
        open_weight = sum(w[s] for s in names if s not in full)
        share = {s: ceiling * sizes[s] if s in full else w[s] * rest / open_weight for s in names}
        above = {s for s in names if s not in full and share[s] > ceiling * sizes[s]}
        if not above:
            return share
        full |= above


def test_taken_words_meet_targets(spark, docs):
    rng = random.Random(2)
    sources = [rng.choice(["a", "a", "a", "B", "é", "z", None]) for _ in range(3000)]
    texts = ["w " * int(rng.lognormvariate(4, 1.2)) if rng.random() > 0.02 else rng.choice([None, "", " x"]) for _ in sources]
    frame = docs(texts, sources=sources)
    rows = mixing.mix(frame).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    by_source, taken = {}, {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or ""))
        by_source[r["source"]] = by_source.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    want = brute_targets(by_source)
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == by_source[r["source"]]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(5, 0.002 * t), (s, taken[s], t)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(frame.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}


def test_priors_tilt_rates_and_meet_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 80), "ab"[i % 2], rng.choice([0.5, 1.0, 2.0])) for i in range(1200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = mixing.mix(frame, prior_col="q", weights=(1.0, 3.0)).collect()
    q = {r[0]: r[3] for r in rows}
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) < 0.01 * mine[0]["target"]
        mean = {p: sum(r["copies"] for r in mine if q[r["doc_id"]] == p) / sum(q[r["doc_id"]] == p for r in mine) for p in (0.5, 1.0, 2.0)}
        assert mean[0.5] < mean[1.0] < mean[2.0]


def test_rates_equal_a_direct_solver(spark, docs):
    rng = random.Random(6)
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in range(500)]
    texts = ["w " * min(4000, int(rng.lognormvariate(3, 1.5))) for _ in sources]
    rows = mixing.mix(docs(texts, sources=sources)).collect()
    for s in set(sources):
        mine = [r for r in rows if r["source"] == s]
        total, target, mean = sum(r["size"] for r in mine), mine[0]["target"], sum(r["size"] for r in mine) / len(mine)
        if target >= 3 * total * (1 - 1e-12):
            assert all(r["rate"] == 3 for r in mine if r["size"])
            continue

        def rate(m, size):
            return 3 / (1 + 2 * math.exp(min(700, -m * size / mean)))

        low, high = -1e5, 1e5
        for _ in range(200):
            m = (low + high) / 2
            low, high = (m, high) if sum(r["size"] * rate(m, r["size"]) for r in mine) < target else (low, m)
        assert all(abs(r["rate"] - rate(low, r["size"])) < 1e-6 for r in mine), s
        assert len({round(r["rate"], 6) for r in mine}) > 10  # tilted by size, not one ratio


def test_no_words_no_rows_and_expand(spark, docs):
    assert mixing.mix(docs(["a"]).where("doc_id < 0")).count() == 0
    rows = mixing.mix(docs([None, ""], sources=["a", "b"])).collect()
    assert [r["target"] for r in rows] == [0.0, 0.0]
    frame = docs(["a", "b", "c"])
    copies = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "doc_id long, copies long")
    out = mixing.expand(frame, frame.selectExpr("doc_id", "source", "xxhash64(text) AS row").join(copies, "doc_id"))
    assert out.columns == frame.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 0, 2]


def test_rows_of_one_id_take_their_own_copies(spark, docs):
    frame = docs(["a", "b", "b"], ids=[1, 1, 1])
    mixed = frame.selectExpr("doc_id", "source", "xxhash64(text) AS row", "CASE WHEN text = 'a' THEN 3L ELSE 1L END AS copies")
    assert sorted(r["text"] for r in mixing.expand(frame, mixed).collect()) == ["a", "a", "a", "b", "b"]


def test_what_rounding_leaves_is_settled():
    """With a large document and a few small ones, no copy more, no copy less and no copy of one for another brings the words nearer to what the rates ask."""
    rng, far = random.Random(9), []
    for _ in range(200):
        sizes = [rng.randint(1500, 3000), *(rng.randint(20, 400) for _ in range(4)), 9, 4, 1, 1, 1]
        rates = [rng.uniform(0.3, 2.7) for _ in sizes]
        frame = pd.DataFrame({"doc_id": range(len(sizes)), "row": 0, "size": sizes, "rate": rates, "n": 1})
        got = mixing._round(frame)
        assert got["taken"].between(0, 3).all()
        off = int((got["size"] * got["taken"]).sum()) - sum(s * r for s, r in zip(sizes, rates, strict=True))
        up = [0, *(s for s, t in zip(got["size"], got["taken"], strict=True) if t < 3)]
        down = [0, *(s for s, t in zip(got["size"], got["taken"], strict=True) if t > 0)]
        assert abs(off) <= 0.5 or min(abs(off + a - b) for a in up for b in down) >= abs(off) - 1e-5
        far.append(abs(off))
    assert sorted(far)[100] < 1, sorted(far)


def test_many_equal_rows_and_null_ids(spark):
    """Equal rows are counted first and share their copies; rows without an id are dealt by their texts."""
    rows = [(None, "w " * 7, "a")] * 9001 + [(None, "w " * (1 + i % 50) + str(i), "b") for i in range(3000)] + [(5, None, None), (5, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", None):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= max(5, 0.001 * mine[0]["target"])
    assert len({r["copies"] for r in got if r["source"] == "a"}) <= 2
    assert mixing.mix(spark.createDataFrame([("k", "a b", "s")], "doc_id string, text string, source string")).first()["doc_id"] == "k"


def test_no_document_passes_a_fractional_ceiling(docs):
    got = mixing.mix(docs(["a b c", "d e", "f"] * 20, sources=["x", "y", "z"] * 20), ceiling=1.5).collect()
    assert max(r["copies"] for r in got) <= 1
