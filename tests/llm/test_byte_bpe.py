"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import hashlib
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from stratalake.fixtures import table
from stratalake.llm import byte_bpe, queries


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))


@pytest.fixture(scope="module")
def codec(ranks):
    return byte_bpe.Codec(byte_bpe.build(ranks))


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def same(codec, plain, texts):
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == plain.encode_ordinary(text), repr(text[:200])
        assert codec.decode(ids.tolist()) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_any_text(codec, plain, texts):
    same(codec, plain, texts)


@settings(max_examples=300, deadline=None)
@given(st.text("a bAé'\"lst,.!?\n\t\r\x1c\x85\xa0\u3000-=_09日🎉", max_size=60))
def test_signs_spaces_and_runs(codec, plain, text):
    same(codec, plain, [text])


def test_special_strings_and_runs(codec, plain):
    runs = [c * n for c in "a -=_.\n*é0#" for n in (1, 2, 3, 5, 17, 100, 1000)]
    same(codec, plain, ["<|endoftext|>", "it's we'll 'llama", "x" * 200_000, *runs])


def test_white_space_is_complete(codec, plain):
    """Cuts stand on the characters that the pattern takes for white space, no more and no fewer."""
    odd = [chr(c) for c in range(sys.maxunicode) if unicodedata.category(chr(c))[0] in "ZC" and not 0xD800 <= c < 0xF900]
    odd = [c for c in odd if ord(c) < 0x3100 or ord(c) > 0xFFFD][:2000]
    same(codec, plain, [f"a{c}b!{c}! {c}.{c}{c}\n{c}" for c in odd])


def test_stretches_change_nothing(codec, plain, monkeypatch):
    texts = ["one two, three.  four\n\n five! " * 20, "", "six", "", "se ven " * 9]
    for size in (1, 7, 40):
        monkeypatch.setattr(byte_bpe, "STRETCH", size)
        same(codec, plain, texts)


def test_memory_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 10)
    monkeypatch.setattr(byte_bpe, "STRETCH", 100)
    texts = [f"word{i} other{i} " * 3 + "y" * 100 for i in range(50)]
    assert [codec.decode(i.tolist()) for i in codec.encode(texts)] == [t.encode() for t in texts]
    assert len(codec.memo) < 40 and max(map(len, codec.memo)) <= byte_bpe.MEMO_CHARS


def test_starts_within_split_characters(codec, ranks):
    text = "naïve 日本 🎉🏽 x"
    ids = next(codec.encode([text])).tolist()
    tokens, at, expected = codec.tokens(ids), 0, []
    for token in tokens:
        expected.append(len(text.encode()[: at + 1].decode("utf-8", "ignore")) if at and not _whole(text, at) else len(text.encode()[:at].decode()))
        at += len(token)
    starts = codec.starts(ids).tolist()
    assert starts[0] == 0 and starts == sorted(starts)
    assert len(set(starts)) < len(starts)  # some character is split
    for start, mine, whole in zip(starts, expected, _bounds(text, tokens)):
        if whole:
            assert start == mine
        assert text[start].encode()[0] & 0xC0 != 0x80


def _whole(text, at):
    return text.encode()[at] & 0xC0 != 0x80


def _bounds(text, tokens):
    at = 0
    for token in tokens:
        yield _whole(text, at)
        at += len(token)


def test_whole_table_against_tiktoken(spark, plain):
    rows = queries.QUERIES["op13_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    expected = {}
    for d in docs:
        ids = plain.encode_ordinary(d.text or "")
        packed = np.array(ids, "<u4").tobytes()
        expected[d.doc_id] = (
            len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()
        )
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == expected
    assert len(rows) == len(docs) and all(r.round_trip for r in rows)


def test_odd_documents(spark, odd_documents, plain):
    rows = byte_bpe.decode(byte_bpe.encode(odd_documents, starts="at", packed="raw"))
    assert rows.columns == [*odd_documents.columns, "token_ids", "at", "raw", "decoded"]
    for r in rows.withColumn("back", byte_bpe.text_of("decoded")).collect():
        text = r.text or ""
        assert r.token_ids == plain.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert np.frombuffer(r.raw, "<u4").tolist() == r.token_ids
        assert r.back == text and len(r.at) == len(r.token_ids)


def test_ids_outside_the_vocabulary(spark):
    rows = spark.createDataFrame([([None, -1, 10**6],), (None,), ([],)], "token_ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(rows).collect()] == [b"", b"", b""]


def test_split_character_alone(spark, ranks):
    half = ranks["é".encode()[:1]]
    rows = byte_bpe.decode(spark.createDataFrame([([half],)], "token_ids array<int>"))
    assert rows.select(byte_bpe.text_of("decoded").alias("t")).first().t == "\ufffd"


def test_empty_table(spark, no_documents):
    assert byte_bpe.report(no_documents).collect() == []
