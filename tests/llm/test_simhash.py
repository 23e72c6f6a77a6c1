import itertools

import xxhash

from siteselect.llm import simhash


def brute_fingerprint(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, distance=3):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(items)), 2):
        if (items[a][1] ^ items[b][1]).bit_count() <= distance:
            parent[find(a)] = find(b)
    low = {}
    for i, (doc, _) in enumerate(items):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return {doc: low[find(i)] for i, (doc, _) in enumerate(items)}


def test_groups_equal_brute_force(spark, docs):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \n\t", "One two", "one TWO", "a b c", base, base + " tail", base.replace("w30", "v30"), base, "Ünï code   words here", "solo"]
    texts += [f"{base} {i}" for i in range(40)] + [" ".join(f"q{i * j % 97}" for i in range(50)) for j in range(1, 20)]
    frame = docs(texts, ids=list(range(len(texts), 0, -1)))
    rows = simhash.groups(frame).collect()
    items = [(len(texts) - i, brute_fingerprint(t)) for i, t in enumerate(texts)]
    assert {r["id"]: r["fp"] & (2**64 - 1) for r in rows} == dict(items)
    assert {r["id"]: r["component"] for r in rows} == brute_components(items)


def test_links_find_every_pair_up_to_three_bits(spark):
    import random

    rng = random.Random(5)
    values = {0}
    for _ in range(40):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(4):
            values.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = [(r["a"], r["b"]) for r in simhash.links(frame).collect()]
    want = {(a, b) for a, b in itertools.permutations(signed, 2) if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert set(got) == want and len(got) == len(want)


def test_deduplicate_keeps_one_of_each_group_and_all_columns(spark, docs):
    frame = docs(["a b c d e f", "a b c d e f", "other words stand here now", None, ""])
    kept = simhash.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]
    assert simhash.deduplicate(frame.where("doc_id < 0")).count() == 0


def test_long_chain_is_one_component(spark):
    from siteselect.llm.components import connected

    frame = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["component"] for r in connected(frame).collect()} == {0}


def test_different_texts_of_one_id_both_stay(spark, docs):
    texts = ["alpha beta gamma delta epsilon", "one two three four five six", "alpha beta gamma delta epsilon"]
    kept = [r["text"] for r in simhash.deduplicate(docs(texts, ids=[1, 1, 2])).collect()]
    assert sorted(kept) == sorted(texts[:2])
