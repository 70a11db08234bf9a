"""Line dedup against brute force."""

from __future__ import annotations

import random

import pytest

from stratalake.fixtures import table
from stratalake.llm import linededup

DOCS = "doc_id bigint, text string"


def plain(rows, min_words=20, rare_words=5, rare_docs=16):
    """Texts without the lines of any run that an earlier text has: of min_words words or more,
    or of rare_words or more if at most rare_docs texts have it."""
    lines = {d: [s.strip() for s in t.encode().split(b"\n")] for d, t in rows}
    spans, holders = {}, {}
    for d, mine in lines.items():
        words = [len(s.split()) for s in mine]
        spoken = [i for i, n in enumerate(words) if n]
        for k, i in enumerate(spoken):
            for j in spoken[k:]:
                size = sum(words[i : j + 1])
                if size >= rare_words:
                    run = tuple(mine[i : j + 1])
                    spans.setdefault(d, []).append((i, j + 1, run, size))
                    holders.setdefault(run, set()).add(d)
                if size - words[j] >= min_words:
                    break  # longer ones are unions of these
    out = {}
    for d, text in rows:
        gone = set()
        for i, j, run, size in spans.get(d, []):
            if min(holders[run]) < d and (size >= min_words or len(holders[run]) <= rare_docs):
                gone.update(range(i, j))
        out[d] = "\n".join(s for i, s in enumerate(text.split("\n")) if i not in gone)
    return out


def result(docs, **options):
    return {r.doc_id: r.text for r in linededup.dedup_lines(docs, **options).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_blocks_against_brute_force(spark, vocabulary, seed):
    rng = random.Random(seed)
    passages = [
        [" ".join(rng.choices(vocabulary, k=rng.randint(1, 12))) for _ in range(rng.randint(1, 8))]
        for _ in range(12)
    ]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.5:
                passage = rng.choice(passages)
                cut = rng.randint(0, len(passage) - 1)
                lines += passage[cut:] if rng.random() < 0.5 else passage
            if rng.random() < 0.2:
                lines.append("")
            lines.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 15))))
        rows.append((d, "\n".join(lines)))
    for options in ({"min_words": 12}, {"min_words": 12, "rare_docs": 2}, {"min_words": 9, "rare_words": 1}):
        got = result(spark.createDataFrame(rows, DOCS), **options)
        assert got == plain(rows, **options)
    assert any(got[d] != t for d, t in rows)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table_against_brute_force(spark, sf):
    docs = table(spark, f"/root/testdata/sf{sf}", "documents").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got, want = result(docs), plain(rows)
    assert {d: t for d, t in got.items() if want[d] != t} == {}
    assert linededup.dedup_lines(docs, rare_docs=0).where("text = ''").count() <= sum(t == "" for t in got.values())


LINE = "twelve words that no more than two of all these documents share"


def test_a_rare_line_goes_and_a_frequent_one_stays(spark):
    often = "a line of eight words in many documents"
    rows = [(i, f"own start {i}\n{often}\nown end {i}") for i in range(40)]
    rows[7] = (7, f"{LINE}\nmore of seven\n{often}")
    rows[30] = (30, f"thirty\n{often}\nthen\n  {LINE} \nmore of seven\nthirty ends")
    got = result(spark.createDataFrame(rows, DOCS))
    assert got.pop(30) == f"thirty\n{often}\nthen\nthirty ends"  # with the short line beside it
    assert got == {d: t for d, t in rows if d != 30}


def test_rarity_is_counted_in_documents(spark):
    """A line that one text repeats, or that only its copies have, is as rare as its documents."""
    rows = [(0, "\n".join([LINE] * 50)), (1, f"{LINE}\nmine")]
    assert result(spark.createDataFrame(rows, DOCS))[1] == "mine"
    many = [(i, f"{LINE}\nmine {i}") for i in range(linededup.RARE_DOCS + 1)]
    assert result(spark.createDataFrame(many, DOCS)) == dict(many)
    few = many[:-1]
    assert result(spark.createDataFrame(few, DOCS)) == {d: f"mine {d}" if d else t for d, t in few}


def test_what_is_left_of_a_copy_can_be_dropped(spark):
    a = "\n".join(f"{LONG} {i} {LONG}" for i in range(10))
    rows = [(1, a), (2, f"{a}\nedited"), (3, a), (4, f"{LONG} 3 {LONG}\n" + "x" * 300), (5, "short"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, DOCS)
    assert result(docs, least_left=0.2) == {1: a, 4: "x" * 300, 5: "short", 6: None, 7: ""}
    assert set(result(docs)) == {1, 2, 3, 4, 5, 6, 7}


LONG = "one two three four five six seven eight nine ten"


def test_a_text_is_edited_once(spark, capsys):
    """The filter on what is left uses the edit that the text comes from, in one worker per task."""
    docs = spark.createDataFrame([(1, "a b c d e")], DOCS)
    linededup.dedup_lines(docs, least_left=0.2).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython [edited(") == 1


def test_copies_moved_and_repeated_passages(spark):
    a, b = f"{LONG} A {LONG}", f"{LONG} B {LONG}"
    rows = [
        (1, f"head\n{a}\nmiddle\n{b}\ntail"),
        (2, f"{b}\nown words\n{a}"),  # moved
        (3, f"{a}\n{a}\nrest"),  # repeated
        (4, f"head\n{a}\nmiddle\n{b}\ntail"),  # a copy
        (0, f"  {b}  \nfirst holder"),
    ]
    got = result(spark.createDataFrame(rows, DOCS))
    assert got == {
        0: rows[4][1],
        1: "head\nmiddle\ntail".replace("head\nmiddle\ntail", f"head\n{a}\nmiddle\ntail"),
        2: "own words",
        3: "rest",
        4: "",
    }


def test_without_moved_only_the_alignment_is_deleted(spark):
    a, b = f"{LONG} A {LONG}", f"{LONG} B {LONG}"
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{a}")]
    got = result(spark.createDataFrame(rows, DOCS), moved=False)
    assert got[2] in (a, b)


def test_patience():
    assert linededup.increasing([(0, 5), (1, 1), (2, 2), (3, 9), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    # unique anchors first, repeated pairs only between them
    pairs = [(0, 0), (1, 3), (2, 1), (2, 4), (3, 5)]
    assert sorted(linededup.patience(pairs)) == [(0, 0), (1, 3), (2, 4), (3, 5)]


def test_short_common_lines_stay(spark):
    rows = [(1, "Released under a license.\nmine"), (2, "Released under a license.\nyours")]
    assert result(spark.createDataFrame(rows, DOCS)) == dict(rows)


def test_odd_documents(spark, odd_documents):
    got = linededup.dedup_lines(odd_documents, deleted="gone")
    assert got.columns == [*odd_documents.columns, "gone"]
    assert got.count() == odd_documents.count()
    before = sorted((str(r.doc_id), str(r.text)) for r in odd_documents.collect())
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == before


def test_rows_of_one_id_are_not_compared(spark):
    rows = [(1, f"{LONG} {LONG}"), (1, f"{LONG} {LONG}\nmore"), (None, f"{LONG} {LONG}")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted(
        [("1", rows[0][1]), ("1", rows[1][1]), ("None", "")]
    )


def test_n_chars_follows_the_text(spark):
    docs = spark.createDataFrame(
        [(1, f"{LONG} {LONG}\né", 7), (2, f"{LONG} {LONG}\nü", 7)], f"{DOCS}, n_chars bigint"
    )
    got = {r.doc_id: (r.text, r.n_chars) for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: (f"{LONG} {LONG}\né", 7), 2: ("ü", 1)}


def test_empty_table(spark, no_documents):
    assert linededup.dedup_lines(no_documents).collect() == []
