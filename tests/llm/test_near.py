import random

import corpus_pipeline
from siteselect.llm import near


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(items):
    """Ids that stay: greedy by id."""
    stay = []
    for doc, text in sorted(items):
        own = shingle_set(text)
        if not any(5 * len(own & s) >= 4 * len(own | s) for _, s in stay):
            stay.append((doc, own))
    return {doc for doc, _ in stay}


def planted(rng):
    """Texts with copies of mean shingle likeness 0.8 to 0.95, and copies just below."""
    texts = []
    for n, edits in [(100, 1), (100, 2), (100, 3), (300, 3), (300, 6), (300, 8), (1000, 10), (1000, 22), (40, 1), (24, 1)] * 3:
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(words))
        for at in rng.sample(range(n), edits):
            words[at] = f"v{rng.randrange(5000)}"
        texts.append("\n".join(words))
    return texts


def test_pipeline_stage_removes_planted_copies_of_0_8_and_more(spark, docs):
    texts = planted(random.Random(3))
    want = brute(list(enumerate(texts)))
    assert 30 <= len(want) < 45  # most copies are 0.8 or more, some are not
    kept = corpus_pipeline.near_dedup(spark, docs(texts), "")
    assert {r["doc_id"] for r in kept.collect()} == want


def test_chains_large_groups_and_odd_rows(spark, docs):
    rng = random.Random(4)
    words = [f"c{i}" for i in range(120)]
    texts = []
    for step in range(12):  # each like the one before, the ends unlike
        texts.append(" ".join(words))
        words = words[3:] + [f"d{step}{i}" for i in range(3)]
    base = [f"b{i}" for i in range(200)]
    for _ in range(60):  # copies of one text; some pairs of them reach 0.8, others do not
        copy = list(base)
        for at in rng.sample(range(200), rng.randint(1, 6)):
            copy[at] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += ["one two", "ONE two", "one two three", "word " * 50, "word " * 80]
    rng.shuffle(texts)
    frame = docs([*texts, None, ""])
    kept = near.deduplicate(frame)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.where("trim(text) <> ''").collect()} == brute(list(enumerate(texts)))
    assert kept.where("text is null or text = ''").count() == 1
    assert near.deduplicate(frame.where("doc_id < 0")).count() == 0


def test_undecided_documents_are_settled_in_groups(spark, docs, monkeypatch):
    monkeypatch.setattr(near, "LEADER_ROUNDS", 1)
    texts = planted(random.Random(6))
    assert {r["doc_id"] for r in near.deduplicate(docs(texts)).collect()} == brute(list(enumerate(texts)))


def test_a_long_chain_and_a_family_take_both_ways(spark, docs, monkeypatch):
    rng = random.Random(11)
    words = [f"c{i}" for i in range(60)]
    texts = []
    for step in range(60):  # each like the two before and after it alone, undecided for 20 rounds
        texts.append(" ".join(words))
        words = words[3:] + [f"d{step}x{i}" for i in range(3)]
    for _ in range(150):
        copy = [f"b{i}" for i in range(200)]
        for at in rng.sample(range(200), rng.randint(1, 7)):
            copy[at] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    want = brute(list(enumerate(texts)))
    assert len([i for i in want if i < 60]) == 20
    taken = []
    settled = near._settled
    monkeypatch.setattr(near, "_settled", lambda *a: taken.append(1) or settled(*a))
    assert {r["doc_id"] for r in near.deduplicate(docs(texts)).collect()} == want
    assert len(taken) == 1  # the default rounds do not suffice, one settlement does
    taken.clear()
    monkeypatch.setattr(near, "GROUP_DOCS", 3)  # rounds go on for larger groups, between settlements of the small ones
    some = [*texts[:16], *texts[60:70]]
    assert {r["doc_id"] for r in near.deduplicate(docs(some)).collect()} == brute(list(enumerate(some))) and taken


def test_repeated_and_null_ids(spark, docs):
    frame = docs(["a b c d e f", "a b c d e f", "other words stand here now", "other words stand here now"], ids=[1, 1, 1, None])
    assert sorted((r["doc_id"] or -1, r["text"]) for r in near.deduplicate(frame).collect()) == [(-1, "other words stand here now"), (1, "a b c d e f"), (1, "other words stand here now")]


def test_stage_takes_the_candidates_of_op6(spark, docs, monkeypatch):
    """Without any band, copies that op6's fingerprints link still meet, and similarity decides on them."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(1200)]
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join(["start", *base]), " ".join(f"w{rng.randrange(5000)}" for _ in range(300))]
    monkeypatch.setattr(near, "bands", lambda hashes: [])
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(texts), "").collect()} == {0, 3}
