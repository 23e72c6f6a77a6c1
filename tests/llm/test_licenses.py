import re

from siteselect.llm import licenses


def brute(text):
    words = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force_and_odd_rows(spark, docs):
    texts = [None, "", "cc by", "CC-BY 4.0, cc by cc by", "All rights reserved. all RIGHTS\nreserved", "general public", "the GNU General Public License, general public license", "é cc by ñ", "x " * 3000 + "cc by " * 50, "cc by"]
    rows = {r["id"]: r for r in licenses.scan(docs(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_edited_license_is_found_across_diagonals(spark, docs):
    notice = licenses.TEMPLATES[5][0]
    cut = notice.replace("free software", "free and open software")
    texts = ["start " * 40 + cut + " end", notice, "this program is free", "the of and " * 50]
    rows = {r["id"]: r for r in licenses.scan(docs(texts)).collect()}
    assert rows[0]["labels"] == rows[1]["labels"] == "gpl,gpl-notice" and rows[0]["score"] >= 0.75
    assert rows[2]["labels"] == rows[3]["labels"] == ""
    spans = licenses.spans(licenses.votes(docs(texts)).where(f"template >= {len(licenses.PHRASES)}")).where("id = 0").collect()
    assert [(s["first_word"], s["last_word"] - s["first_word"] + 1) for s in spans] == [(40, len(cut.split()))]


def test_repeated_ids_and_empty_table(spark, docs):
    rows = licenses.scan(docs(["cc by", "none"], ids=[1, 1])).collect()
    assert sorted(r["n_base"] for r in rows) == [0, 1]
    assert licenses.scan(docs(["cc by"]).where("doc_id < 0")).count() == 0


def test_repeated_or_disordered_words_do_not_stand_in_for_missing_ones(spark, docs):
    nc, notice = "licensed under cc by nc 4 0", licenses.TEMPLATES[5][0]
    half = notice.split()
    swapped = " ".join(half[11:] + half[:11])  # all but one of its word pairs, in another order
    texts = ["Licensed under CC BY 4.0 (CC BY 4.0).", "CC BY 4.0 CC BY 4.0 CC BY 4.0", nc, "cc by " * 40 + nc, nc.replace("by nc", "by the nc"), swapped, "of the terms " * 3000 + notice]
    rows = {r["id"]: r for r in licenses.scan(docs(texts)).collect()}
    assert [(rows[i]["labels"], rows[i]["score"]) for i in range(4)] == [("cc-by", 1.0)] * 2 + [("cc-by,cc-by-nc-4.0", 1.0)] * 2
    assert rows[4]["labels"] == "cc-by,cc-by-nc-4.0" and "gpl-notice" not in rows[5]["labels"] and "gpl-notice" in rows[6]["labels"]
    spans = licenses.spans(licenses.votes(docs(texts)).where(f"template >= {len(licenses.PHRASES)}"))
    got = {(s["id"], s["label"]): (s["first_word"], s["last_word"], round(s["coverage"], 6)) for s in spans.collect()}
    assert got[2, "cc-by-nc-4.0"] == (0, 6, 1.0) and got[3, "cc-by-nc-4.0"] == (80, 86, 1.0) and got[4, "cc-by-nc-4.0"][2] == round(5 / 6, 6)
    assert {k for k in got if k[0] in (0, 1)} == set()
