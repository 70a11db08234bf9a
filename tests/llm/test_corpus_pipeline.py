"""The pipeline stage by stage on planted documents."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from stratalake.fixtures import table
from stratalake.scratch import written

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_duplicates", "decontamination", "encoding"
    ]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory, vocabulary):
    """Clean prose with copies, near copies, shared passages, test items and insults in it."""
    rng = random.Random(4)

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    def lines(n):
        return "\n".join(prose(rng.randint(8, 15)) for _ in range(n))

    docs, labels = [], []
    for i in range(600):
        words = prose(60).split()
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["zax", "zex", "zix"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    clean = {1000 + i: lines(12) for i in range(30)}
    docs += list(clean.items())
    passage = prose(60)
    shared = {1100: lines(5), 1101: lines(6)}
    docs += [(d, f"{t}\n{passage}\n{prose(9)}") for d, t in shared.items()]
    docs.append((1200, clean[1003]))  # exact copy
    single = prose(4000)
    near = single.split()
    near[200] = "changed"
    docs += [(1300, single), (1301, " ".join(near))]
    items = [(i, prose(25)) for i in range(5)]
    docs.append((1400, f"{lines(3)}\n{prose(5)} {items[2][1]} {prose(5)}"))
    docs.append((1500, f"zax {prose(8)} zix zex {prose(8)} zex zax"))
    d = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{d}/labels.parquet"
    )
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(
        f"{d}/benchmark.parquet"
    )
    return d, dict(docs), clean, passage


def test_planted_cases(spark, planted):
    d, docs, clean, passage = planted
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    toxic = {i for i in range(0, 600, 5)}
    assert len(toxic & rows.keys()) <= 3 and 1500 not in rows
    assert {i for i in range(600) if i % 5} <= rows.keys()
    assert clean.keys() <= rows.keys()
    assert all(rows[i].text == clean[i] for i in clean)
    assert passage in rows[1100].text and passage not in rows[1101].text
    assert 1200 not in rows
    assert 1300 in rows and 1301 not in rows
    assert 1400 not in rows
    assert all(r.round_trip and r.n_chars == len(r.text) for r in rows.values())


def test_recall_of_edited_copies_over_all_stages(spark, planted, tmp_path, vocabulary):
    """Copies of which a word in a thousand is changed, in one line or in lines: either the line
    dedup takes nearly all of them or the fingerprints find them. No scrap of one stays."""
    rng = random.Random(12)
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary, k=2000)
        edited = list(words)
        for at in rng.sample(range(2000), 2):
            edited[at] = "edited"
        step = 2000 if i % 2 else 25
        for k, own in enumerate((words, edited)):
            text = "\n".join(" ".join(own[j : j + step]) for j in range(0, 2000, step))
            docs.append((10_000 + 2 * i + k, text, "en", "s", len(text)))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{planted[0]}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    theirs = table(spark, planted[0], "documents").where("doc_id < 600")
    theirs.unionByName(spark.createDataFrame(docs, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    first = [10_000 + 2 * i for i in range(60)]
    assert sum(d in rows for d in first) >= 54  # the model of short texts takes a few long ones
    assert sum(d + 1 in rows for d in first if d in rows) <= 6


def test_run_is_the_stages_one_after_the_other(spark, planted):
    d = planted[0]
    docs = table(spark, d, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = written(stage(spark, docs, d), name)
        if name != "encoding":
            assert docs.columns == before
    assert docs.columns == [*before, "piece_ids", "round_trip"]
    got = corpus_pipeline.run(spark, d).select(docs.columns)
    assert got.exceptAll(docs).count() == docs.exceptAll(got).count() == 0


def test_odd_documents_pass_every_stage(spark, planted, odd_documents):
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = written(stage(spark, docs, planted[0]), f"odd-{name}")
        assert docs.columns[: len(columns)] == columns
    assert docs.where("doc_id = 5").count() == 1


def test_empty_documents_pass_every_stage(spark, planted, no_documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, planted[0]).count() == 0
