"""Operator 12 against the tokenizers library: ids and decoded texts."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratagrid.llm import bpe
from stratagrid.llm import textkit as K

PARTS = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0     　abcXYZ019'.,!?é漢😀́¹²", "'s", "'re", "<|endoftext|>", "<|endof", " the", "hello world"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    t.no_padding()
    t.no_truncation()
    return t


def own(texts):
    d, o = K.text_buffers(pa.array(texts, pa.string()))
    ids, at = bpe.loaded(bpe.default_tokenizer()).encode(d, o)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(PARTS), max_size=12).map("".join)), min_size=1, max_size=6))
def test_ids_equal_the_library(library, texts):
    assert own(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_pretokens(library):
    for t in ("ab" * 30_000, "é" * 9_999, " " * 20_000 + "x", "=" * 10_001):
        assert own([t]) == [library.encode(t, add_special_tokens=False).ids]


def test_stale_entries_are_skipped(library):
    """Pairs that a neighbour's merge has taken stand in the heap still."""
    for w in ("aaaaaaa", "aaaaaaaaaaaaaa", "ababababa", "hhhhhe", "thethethe"):
        assert own([w]) == [library.encode(w, add_special_tokens=False).ids]


def test_whole_texts_of_the_table(spark, library):
    from stratagrid.llm.common import table

    rows = {r["doc_id"]: r for r in bpe.op12_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_defined_cases(spark):
    rows = [(1, None, 5, "x"), (1, "", 6, "y"), (2, "a b", 7, "z"), (2, "a b", 7, "z"), (None, "<|endoftext|>", 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    coded = bpe.encode(docs)
    assert coded.columns == ["doc_id", "n_tokens", "ids"]
    got = sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in coded.collect()), key=str)
    assert [x[1] for x in got if x[0] == 1] == [0, 0] and len([x for x in got if x[0] == 2]) == 2
    assert np.frombuffer(next(x[2] for x in got if x[0] is None), "<u4").tolist() == [50256]
    assert {(r["doc_id"], r["text"]) for r in bpe.decode(coded).collect()} == {(1, ""), (2, "a b"), (None, "<|endoftext|>")}
    assert bpe.encode(docs.where("false")).count() == 0
    half = spark.createDataFrame([(1, bytearray(np.array([bpe.loaded(bpe.default_tokenizer()).of_byte[0xC3]], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(half).collect()} == {1: "�", 2: None}
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x00"))], "doc_id long, ids binary")).collect()


def test_recent_table_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    t = bpe.Recent()
    for i in range(100):
        t.put(i, b"x")
        assert t[0] == b"x" or i < 0
    assert len(t) + len(t.older) <= 20 and t[5] is None
