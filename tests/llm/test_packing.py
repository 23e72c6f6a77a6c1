import zlib

import numpy as np
import pytest

from siteselect.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def expected_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_hold_every_id_once(spark, docs):
    texts = ["Hello, World's end!", None, "", "don't stop here \x1c x <|endoftext|>a é İ ÇPA!!", "word " * 5000, "word " * 5000, "x" * 3000, "12 345\n\nnew\tline"]
    rows = packing.pack(docs(texts), PATH, length=64).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["id"], []).append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
    for i, t in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        whole = expected_ids(t)
        assert [r["start"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
        got = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in pieces]).tolist()
        assert got == whole and all(r["doc_tokens"] == len(whole) for r in pieces)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))


def test_repeated_rows_and_empty_table(spark, docs):
    rows = packing.pack(docs(["a b", "a b"], ids=[3, 3]), PATH).collect()
    assert sum(r["length"] for r in rows) == 2 * len(expected_ids("a b"))
    assert packing.pack(docs(["a"]).where("doc_id < 0"), PATH).count() == 0


def test_hilbert_is_a_path_of_single_steps():
    grid = np.array([(a, b) for a in range(8) for b in range(8)])
    order = grid[np.argsort(packing.hilbert(grid, bits=3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    cube = np.array([(a, b, c) for a in range(4) for b in range(4) for c in range(4)])
    keys = packing.hilbert(cube, bits=2)
    assert sorted(keys) == list(range(64))
    assert (np.abs(np.diff(cube[np.argsort(keys)], axis=0)).sum(1) == 1).all()
