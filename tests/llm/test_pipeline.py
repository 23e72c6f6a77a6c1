import random

import pytest

import corpus_pipeline
from siteselect.llm import languages, lines, mixing, packing, simhash

pytest.importorskip("public_tokenizers")


@pytest.fixture()
def corpus(docs):
    rng = random.Random(9)
    parts = {"en": ["the", "and", "ing", "tion", "with"], "de": ["der", "und", "ung", "sch", "mit"]}

    def text(lang, n=60):
        return "\n".join(" ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(12)) for _ in range(n // 12))

    langs = [rng.choice(["en", "de"]) for _ in range(120)]
    texts = [text(lang) for lang in langs]
    texts += [texts[0], texts[1] + " extra", None, "", "?!?", "xqzj vkwp jjqx " * 40, texts[2].split("\n")[0] + "\n" + text("en")]
    langs += ["en", "en", "en", "en", "en", None, "en"]
    return docs(texts, langs=langs, sources=[rng.choice(["a", "b", None]) for _ in langs])


def test_each_stage_takes_effect_and_keeps_columns(spark, corpus):
    docs, columns = corpus, corpus.columns
    docs = corpus_pipeline.language_id(spark, docs, "")
    ids = {r["doc_id"] for r in docs.collect()}
    assert docs.columns == columns and {122, 123, 124, 125}.isdisjoint(ids) and set(range(120)) <= ids
    deduped = lines.keep(corpus_pipeline.line_dedup(spark, docs, ""), "t")
    texts = {r["doc_id"]: r["text"] for r in deduped.collect()}
    assert deduped.columns == columns and 120 not in texts and len(texts[126].split("\n")) == 5 and all(texts[i] for i in range(120))
    once = lines.keep(corpus_pipeline.near_dedup(spark, deduped, ""), "t")
    components = simhash.groups(deduped).select("component").distinct().count()
    assert once.columns == columns and once.count() == components
    mixed = lines.keep(corpus_pipeline.source_mixing(spark, once, ""), "t")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(once.select("doc_id", "text", "source")).collect()}
    taken = [r["doc_id"] for r in mixed.collect()]
    assert mixed.columns == columns and all(taken.count(i) == n for i, n in copies.items())
    pieces = corpus_pipeline.sequence_packing(spark, mixed, "").collect()
    tokens = packing.tokenise(mixed, packing_path()).agg({"n": "sum"}).first()[0]
    assert sum(r["length"] for r in pieces) == tokens


def packing_path():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def test_stages_are_listed_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "source_mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and languages.ORDER == 4


def _through(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = lines.keep(stage(spark, docs, ""), name)
        assert docs.columns == columns
    return docs, corpus_pipeline.sequence_packing(spark, docs, "").collect()


def test_empty_table_goes_through_all_stages(spark, docs):
    left, pieces = _through(spark, docs(["a"]).where("doc_id < 0"))
    assert left.count() == 0 and pieces == []


def test_repeated_and_null_ids_go_through_all_stages(spark, docs):
    rng = random.Random(5)
    words = ["the", "and", "with", "from", "that", "this", "have", "were", "been", "into"]
    texts = [" ".join("".join(rng.choices(words, k=2)) for _ in range(30)) for _ in range(40)]
    left, pieces = _through(spark, docs([*texts, texts[0], None], ids=[None, None, 1, 1, *range(4, 40), 1, None]))
    kept = {r["text"] for r in left.collect()}
    assert kept <= set(texts) and {p["doc_id"] for p in pieces} == {r["doc_id"] for r in left.collect()}
