"""Piece encoding against brute force and exact round trips."""

from __future__ import annotations

import random

import pytest

from stratalake.fixtures import table
from stratalake.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def plain_score(vocabulary, text):
    """Best sum of scores by trying every piece at every position."""
    known = {
        p: s for i, (p, s) in enumerate(zip(vocabulary.pieces, vocabulary.scores))
        if i not in vocabulary.special
    }
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 20), end):
            score = known.get(text[start:end])
            if score is None and end - start == 1:
                score = vocabulary.unknown_score
            if score is not None and (best[end] is None or best[start] + score > best[end]):
                best[end] = best[start] + score
    return best[-1]


def score_of(vocabulary, text, ids):
    total, byte = 0.0, set(vocabulary.bytes_at)
    unknown = sum(1 for c in text if c not in {p for p in vocabulary.pieces if len(p) == 1})
    for i in ids:
        if i not in byte:
            total += vocabulary.scores[i]
    return total + unknown * vocabulary.unknown_score


TEXTS = ["the", "Hello  world", "  two  marks ", "naïve 日本 🎉", "line\nbreak\r\n\ttab", "a", "zzzzqqq"]


@pytest.mark.parametrize("text", TEXTS)
def test_best_score(model, text):
    encoder = pieces.Encoder(model)
    ids = encoder.encode(text).tolist()
    marked = pieces.MARK + text.replace(" ", pieces.MARK)
    assert score_of(model, marked, ids) == plain_score(model, marked)
    assert pieces.segment(model, marked) == ids  # cutting into words changes nothing
    assert encoder.decode(encoder.encode(text)) == text


def toy(byte_pieces: bool):
    names = ["<unk>", pieces.MARK, "a", "b", "ab", "ba", "aba", pieces.MARK + "a"]
    scores = [0.0, -3.0, -2.0, -2.0, -3.0, -3.0, -4.0, -4.0]
    special, at = {0}, []
    if byte_pieces:
        at = list(range(len(names), len(names) + 256))
        names += [f"<0x{b:02X}>" for b in range(256)]
        scores += [0.0] * 256
        special |= set(at)
    return pieces.Vocabulary(names, scores, 0, at, frozenset(special))


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_toy_vocabulary_against_brute_force(byte_pieces):
    vocabulary, rng = toy(byte_pieces), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices("ab c\n", [4, 4, 2, 1, 1], k=rng.randint(1, 14)))
        ids = pieces.Encoder(vocabulary).encode(text).tolist()
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        if byte_pieces:
            assert score_of(vocabulary, marked, ids) == plain_score(vocabulary, marked)
            assert pieces.Encoder(vocabulary).decode(pieces.np.array(ids)) == text
        else:
            assert ids == pieces.segment(vocabulary, marked)


def test_equal_scores_take_the_longest_last_piece():
    vocabulary = pieces.Vocabulary(["<unk>", "x", "y", "xy"], [0, -1, -1, -2], 0, [], frozenset({0}))
    assert pieces.segment(vocabulary, "xy") == [3]


def test_memory_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 10)
    encoder = pieces.Encoder(model)
    text = " ".join(f"word{i}" for i in range(200))
    assert encoder.decode(encoder.encode(text)) == text
    assert len(encoder.memo) <= 10


def test_whole_table_round_trip(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = pieces.decode(pieces.encode(docs))
    assert rows.where("NOT round_trip OR decoded <> text").count() == 0
    assert rows.count() == docs.count()


def test_odd_documents(spark, odd_documents):
    rows = pieces.encode(odd_documents)
    assert rows.columns == [*odd_documents.columns, "piece_ids", "round_trip"]
    for r in pieces.decode(rows).collect():
        text = r.text or ""
        assert r.decoded == text.replace(pieces.MARK, " ")
        assert r.round_trip == (pieces.MARK not in text)
        assert bool(r.piece_ids) == bool(text)


def test_empty_table(spark, no_documents):
    assert pieces.encode(no_documents).collect() == []
