import itertools
import random
import re

from siteselect.llm import lines


def brute(docs):
    """Line numbers that go, by id; ids are unique."""
    all_lines = []
    for i, t in sorted(docs, key=lambda d: d[0]):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            words = frozenset(w for w in re.split("[ \t\r]", line.lower()) if w)
            if words:
                all_lines.append((i, k, words))
    gone = {}
    for a, b in itertools.combinations(all_lines, 2):
        if 5 * len(a[2] & b[2]) >= 4 * len(a[2] | b[2]):
            gone.setdefault(b[0], set()).add(b[1])
    return gone


def test_removals_equal_brute_force(spark, docs):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(30)] + ["the", "of"] * 10
    texts = ["\n".join(" ".join(rng.choices(pool[: rng.choice([8, 50])], k=rng.randint(0, 9))) for _ in range(rng.randint(1, 8))) for _ in range(80)]
    long = " ".join(f"x{i}" for i in range(50))
    texts += [None, "", "\n\n", long, long + " y z", long.upper(), long.replace("x7 ", "q7 ").replace("x9 ", "q9 "), " a  b c\r\n\ta b\tc", "boiler plate line here\n" * 300]
    frame = docs(texts)
    got = {r["id"]: set(r["removed"]) for r in lines.removals(frame).collect()}
    want = brute(list(enumerate(texts)))
    assert got == want
    kept = {r["doc_id"]: r for r in lines.deduplicate(frame).collect()}
    assert lines.deduplicate(frame).columns == frame.columns
    for i, t in enumerate(texts):
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, set()))
        if i in want and not re.search(lines.TOKEN, left):
            assert i not in kept
        else:
            assert kept[i]["text"] == left and (i not in want or kept[i]["n_chars"] == len(left))
    report = {r["id"]: r for r in lines.report(frame).collect()}
    assert len(report) == len(texts) and report[80]["n_lines"] == 0 and report[88]["n_removed"] == 299


def test_repeated_rows_null_ids_and_empty_table(spark, docs):
    frame = docs(["a b c d", "a b c d", "a b c d", "k l m n"], ids=[1, 1, 2, None])
    assert {r["id"]: r["removed"] for r in lines.removals(frame).collect()} == {2: [0]}
    assert lines.report(frame).count() == 4
    assert lines.removals(frame.where("doc_id < 0")).count() == 0


def test_pipeline_stage_removes_repeated_lines_of_one_and_two_tokens(spark, docs):
    import corpus_pipeline

    chinese = "这是一个很长的句子没有空格所以整行只有一个词" * 3
    texts = [f"Read more\nfirst words stand here\n{chinese}", f"read MORE\nother text is in this\n\n{chinese}", "more read", "alone", f"{chinese}\nalone again", "Alone\n\nthe end of all"]
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs(texts), "").collect()}
    assert kept == {0: texts[0], 1: "other text is in this\n", 3: "alone", 4: "alone again", 5: "\nthe end of all"}


def test_texts_are_cut_into_tokens_once_and_long_lines_match(spark, docs, monkeypatch):
    """Texts are read for their tokens, and again for the first lines that each of two verifications wants; lines about as long as LONG meet across it."""
    rng = random.Random(12)
    texts = []
    for n in range(70, 130, 4):
        words = [f"l{n}x{i}" for i in range(n)]
        texts += [" ".join(words), " ".join(words[: rng.randint(n * 3 // 4, n - 1)]), " ".join([*words, *(f"m{n}x{i}" for i in range(rng.randint(1, n // 3)))])]
    rng.shuffle(texts)
    read = []
    plain = lines._plain
    monkeypatch.setattr(lines, "_plain", lambda text: read.append(1) or plain(text))
    assert {r["id"]: set(r["removed"]) for r in lines.removals(docs(texts)).collect()} == brute(list(enumerate(texts)))
    assert len(read) == 3
