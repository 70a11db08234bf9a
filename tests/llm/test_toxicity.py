"""Toxicity models: held-out accuracy, counts against brute force, odd input."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stratalake.fixtures import table
from stratalake.llm import toxicity
from stratalake.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = QUERIES["op2_toxicity"](spark, d).join(table(spark, d, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    toxic = [r for r in held if r.toxic == 1]
    clean = [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.9
    assert sum(r.predicted for r in clean) / len(clean) <= 0.01
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


TRAINING = "text string, toxic int, fit boolean"


def plain_counts(rows):
    """(u, w) -> counts of (text, toxic, fit), by dictionaries of the words themselves."""
    counts = {}
    for text, toxic, fit in rows:
        words = toxicity.words_of(text)
        for key in {*zip(["", *words], words), *((None, w) for w in words)}:
            own = counts.setdefault(key, [0, 0, 0, 0])
            own[not toxic] += 1
            own[2 + (not toxic)] += bool(fit)
    return counts


def names(rows):
    words = {w for text, *_ in rows for w in toxicity.words_of(text)} | {""}
    return {toxicity.short_hash(w): w for w in words} | {toxicity.ALONE: None}


@pytest.mark.parametrize("chunk", [1, 2, 8000])
def test_pair_counts(spark, monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK_TEXTS", chunk)
    rows = [("A b a b", 1, True), ("b a", 0, False), ("", 0, False), (None, 1, True), ("a b", 1, False), ("b a b", 0, True)]
    found, word = {}, names(rows)
    for r in toxicity.pair_counts(spark.createDataFrame(rows, TRAINING).coalesce(1)).collect():
        own = found.setdefault((word[r.u], word[r.w]), [0, 0, 0, 0])
        for i, c in enumerate(toxicity.COUNTS):
            own[i] += r[c]
    assert found == plain_counts(rows)


def plain_ratios(counts, discount):
    """Every expression's log ratio, straight from the formulas; ``counts`` has (toxic, ordinary)."""
    alone = {w: n for (u, w), n in counts.items() if u is None}
    pairs = {k: n for k, n in counts.items() if k[0] is not None}
    types = Counter(w for _, w in pairs)

    def mass(groups):
        shares = []
        for c in (0, 1):
            own = [n[c] for n in groups.values()]
            shares.append(1 - sum(max(n - discount, 0) for n in own) / sum(own))
        return min(0.95, max(shares))

    b1, b2 = mass(alone), mass(pairs)
    z = [sum(max(n[c] - discount, 0) for n in alone.values()) for c in (0, 1)]

    def p1(w, c):
        return (1 - b1) * max(alone[w][c] - discount, 0) / max(z[c], 1e-9) + b1 * types[w] / len(pairs)

    def p2(u, w, c):
        own = max(pairs[u, w][c] - discount, 0) / max(alone[u][c], 1)
        return (1 - b2) * own + b2 * p1(w, c)

    found = {(None, w): math.log(p1(w, 0) / p1(w, 1)) for w in alone}
    found |= {(u, w): math.log(p2(u, w, 0) / p2(u, w, 1)) for u, w in pairs if u != ""}
    return found


def made_rows(vocabulary, n=400, seed=3):
    rng, words = random.Random(seed), vocabulary[:60]
    rows = []
    for i in range(n):
        own = rng.choices(words, weights=range(60, 0, -1), k=rng.randint(1, 30))
        if i % 4 == 0:
            own += rng.choices(["zax", "zex", words[3]], k=3)
        rows.append((" ".join(own), int(i % 4 == 0), i % 5 == 0))
    return rows


@pytest.mark.parametrize("whole", [True, False])
def test_ratios_against_a_plain_model(spark, vocabulary, whole):
    """The table has the plain model's ratio for each expression above the discount; those it
    lacks have the ratio of their backoff in the plain model too."""
    rows = made_rows(vocabulary)
    model = toxicity.Model(spark.createDataFrame(rows, TRAINING))
    counts = {
        k: (n[0], n[1]) if whole else (n[0] - n[2], n[1] - n[3]) for k, n in plain_counts(rows).items()
    }
    counts = {k: n for k, n in counts.items() if sum(n)}
    tables = model.ratios(model.discounts, whole).collect()
    found = {r.key: r for r in tables}
    assert len(found) == len(tables) > 100
    for i, discount in enumerate(model.discounts):
        plain = plain_ratios(counts, discount)
        for (u, w), ratio in plain.items():
            h = toxicity.short_hash(w)
            key = h if u is None else int(toxicity.pair_key(np.int64(toxicity.short_hash(u)), np.int64(h)))
            if key in found:
                assert found[key][f"r{i}"] == pytest.approx(ratio, abs=1e-9)
            else:
                assert ratio == pytest.approx(0.0 if u is None else plain[None, w], abs=1e-9)


def plain_line(text, ratios):
    words, last, line = toxicity.words_of(text), {}, []
    for i, w in enumerate(words):
        ratio = ratios.get((words[i - 1], w) if i else None, ratios.get((None, w), 0.0))
        line.append(0.0 if i - last.get(w, -99) < toxicity.STRETCHES[0] else ratio)
        last[w] = i
    return line


@pytest.mark.parametrize("part_rows", [7, 4_000_000])
def test_evidence_against_a_plain_model(spark, vocabulary, monkeypatch, part_rows):
    monkeypatch.setattr(toxicity, "PART_ROWS", part_rows)
    rows = made_rows(vocabulary)
    if part_rows < 100:
        rows = rows[:40]
    model = toxicity.Model(spark.createDataFrame(rows, TRAINING))
    plain = plain_ratios({k: n[:2] for k, n in plain_counts(rows).items()}, 3.0)
    texts = [r[0] for r in rows] + [None, "", "unseen words", " ".join(vocabulary[:60] * 4), vocabulary[3] + " zax zax"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    scored = toxicity.evidence(docs, model.ratios([3.0], True), "e").collect()
    assert [r.text for r in scored] == texts
    for r in scored:
        line = plain_line(r.text, plain)
        expected = [0.0] * toxicity.FEATURES
        if line:
            mean = lambda k: max(sum(line[i : i + k]) / k for i in range(len(line) - k + 1))
            peaks = [mean(min(s, len(line))) for s in toxicity.STRETCHES]
            top = sorted(line, reverse=True)[: toxicity.TOP]
            expected = [sum(line) / len(line), *peaks, top[0], sum(top) / len(top), len(str(len(line))) - 1]
        assert r.e == pytest.approx(expected, abs=1e-5)


@pytest.fixture(scope="module")
def labelled_corpus(spark, vocabulary):
    """Texts whose toxic class uses four words of its own; one long text with one insult."""
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(1200):
        words = rng.choices(vocabulary, k=rng.randint(5, 60))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zax", "zex", "zix", "zox"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs.append((5000, " ".join(rng.choices(vocabulary, k=5000)) + " zax zex zox"))
    docs.append((5001, " ".join(rng.choices(vocabulary, k=5000))))
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_own_words_and_long_texts(spark, labelled_corpus):
    docs, labels = labelled_corpus
    rows = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    right = sum(rows[i].predicted == (i % 6 == 0) for i in range(1200))
    assert right >= 1190
    assert rows[5000].score > 0.5 > rows[5001].score


def test_held_out_labels_are_not_read(spark, labelled_corpus):
    docs, labels = labelled_corpus
    turned = labels.selectExpr(
        "doc_id", "quality",
        "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic",
    )
    a = {r.doc_id: r.score for r in toxicity.report(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.report(docs, turned).collect()}
    assert a == pytest.approx(b)


def test_odd_documents(spark, labelled_corpus, odd_documents):
    docs, labels = labelled_corpus
    scored = toxicity.score(odd_documents, docs, labels, "toxic_score").collect()
    assert len(scored) == odd_documents.count()
    none = {r.toxic_score for r in scored if not (r.text or "").strip()}
    assert len(none) == 1 and none.pop() < 0.5
    clean = toxicity.clean_documents(odd_documents, docs, labels)
    assert clean.columns == odd_documents.columns and clean.count() == odd_documents.count()


def test_without_labels_or_documents(spark, labelled_corpus, no_documents, no_labels):
    docs, labels = labelled_corpus
    assert {r.score for r in toxicity.report(docs, no_labels).collect()} == {0.0}
    one_class = labels.where("toxic = 0")
    assert {r.score for r in toxicity.report(docs, one_class).collect()} == {0.0}
    assert toxicity.report(no_documents, labels).collect() == []


def test_contradicting_labels_go_by_majority(spark):
    from stratalake.llm.common import one_label

    rows = [(1, 0, 1), (1, 0, 0), (2, 0, 1), (2, 0, 0), (2, 0, 0), (3, 0, None), (None, 0, 1)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    assert sorted(map(tuple, one_label(labels, "toxic").collect())) == [(1, 1), (2, 0)]


def test_labels_too_many_to_broadcast_are_joined(spark, labelled_corpus, monkeypatch):
    docs, labels = labelled_corpus
    small = sorted(map(tuple, toxicity.labelled(docs, labels).collect()))
    monkeypatch.setattr(toxicity, "LABEL_ROWS", -1)
    assert sorted(map(tuple, toxicity.labelled(docs, labels).collect())) == small


def test_pairs_that_tell_the_classes_apart(spark):
    """Neither word alone does."""
    rows = []
    for i in range(200):
        rows.append((f"red fox k{i} blue sky" if i % 2 else f"red sky k{i} blue fox", i % 2, False))
    table = toxicity.Model(spark.createDataFrame(rows, TRAINING)).ratios([3.0], True)
    found, word = {}, ["red", "blue", "fox", "sky"]
    keys = spark.createDataFrame(
        [(u, w, toxicity.short_hash(u), toxicity.short_hash(w)) for u in word for w in word],
        "a string, b string, u bigint, w bigint",
    )
    for r in keys.withColumn("key", toxicity.pair_key_column("u", "w")).join(table, "key").collect():
        found[r.a, r.b] = r.r0 > 0
    assert found == {
        ("red", "fox"): True, ("blue", "sky"): True, ("red", "sky"): False, ("blue", "fox"): False,
    }
    assert table.where("abs(r0) < 1e-9").count() == 4  # the four words alone


def test_rows_of_the_fit_are_bounded(spark, labelled_corpus, monkeypatch):
    docs, labels = labelled_corpus
    rows = toxicity.labelled(docs, labels)
    assert rows.where("fit").count() > 150
    monkeypatch.setattr(toxicity, "FIT_ROWS", 50)
    assert 20 < toxicity.labelled(docs, labels).where("fit").count() < 90
    assert toxicity.labelled(docs, labels).count() == rows.count()


def test_rows_of_the_curve_are_counted_too(spark, vocabulary):
    """Words that only toxic texts of the curve's fold have are known to the scores."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(1500):
        words = rng.choices(vocabulary, k=30)
        toxic = i % 5 == 0
        if toxic:
            words += ["zax", "zex"]
            if zlib.crc32(str(i).encode()) % toxicity.FOLDS == toxicity.FIT_FOLD:
                words += ["qux", "quz"]
            rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs.append((9000, "qux quz " + " ".join(rng.choices(vocabulary, k=4))))
    scored = toxicity.report(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )
    assert scored.where("doc_id = 9000").first().score > 0.5
