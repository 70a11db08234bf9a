"""Quality rules: counts against brute force, fences, native plans."""

from __future__ import annotations

import random
import re

import numpy as np

from stratalake.fixtures import table
from stratalake.llm import quality_rules
from stratalake.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [s for s in text.split("\n") if WORD.search(s)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(again),
        n < 20 or 100 * len(again) > 30 * n,
    )


def check(docs):
    got = quality_rules.judge(docs)
    texts = sorted(((r.doc_id, plain(r.text)) for r in docs.collect()), key=str)
    rows = sorted(((r[0], tuple(r)[1:7]) for r in got.collect()), key=str)
    assert rows == texts
    assert got.where("base_failed AND kept").count() == 0
    return got


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = check(table(spark, d, "documents"))
    rows = got.join(table(spark, d, "labels"), "doc_id").where("NOT base_failed")
    good = rows.where("quality = 1")
    assert good.where("kept").count() / good.count() > 0.97
    bad = rows.where("quality = 0")
    assert bad.where("kept").count() / bad.count() < 0.3


def test_odd_documents(spark, odd_documents):
    check(odd_documents)


def test_repeats_over_window_ends(spark):
    texts = [
        "a b c d e f g h a b c d e f g h",
        "a " * 8,
        "a " * 9,
        "x a b c d e f g h y a b c d e f g h z a b c d e f g h i",
        "a b c d e f g h i j a b c d e f g h i j k",
    ]
    check(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)],
                                "doc_id bigint, text string, lang string, source string"))


def test_empty_table(spark, no_documents):
    assert quality_rules.judge(no_documents).collect() == []


def marked(words, n):
    return " ".join(f"{w}##||" for w in words.split()[:n])


def test_fences_adapt_to_the_group(spark):
    """Symbols that are usual in one source are an exception in another."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    rows = []
    for i in range(300):
        own = f"{words} {i} x{i} y{i} z{i}"
        rows.append((i, f"{own} {marked(words, 8 + i % 4)}", "en", "tables"))
        rows.append((1000 + i, own, "en", "prose"))
    rows.append((5000, f"{words} a b c d {marked(words, 9)}", "en", "prose"))
    rows.append((5001, f"{words} a b c d {marked(words, 9)}", "en", "tables"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert not kept[5000] and kept[5001]
    assert all(kept[i] and kept[1000 + i] for i in range(300))


def test_small_groups_use_merged_sketches(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    rows = [(i, f"{words} {i} x y z{i}", "en", f"s{i % 40}") for i in range(400)]
    rows.append((900, f"{words} a b c d" + " ####" * 20, "en", "lone"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert not kept[900] and sum(kept.values()) == 400


def groups_of(rows):
    """(lang, source) -> measures of the texts that pass the base rules."""
    found = {}
    for doc_id, text, lang, source in rows:
        n, chars, symbols, dup, again, failed = plain(text)
        lines = [s for s in (text or "").split("\n") if WORD.search(s)]
        if not failed:
            own = (chars / n, symbols / max(chars, 1), dup / max(len(lines), 1), again / n)
            found.setdefault((lang, source), []).append((doc_id, own))
    return found


def limits(groups):
    """The fences by exact quantiles: (lang, source) -> per measure (low, high)."""
    names = (*quality_rules.QUANTILES, "mid")

    def quantiles(values):
        values = np.sort(values)
        above = values[values > 0]
        at = lambda v, r: v[max(0, int(np.ceil(r * len(v))) - 1)]
        found = {q: at(values, r) for q, r in quality_rules.QUANTILES.items()}
        return found | {"mid": at(above, 0.5) if len(above) else 0.0, "n": len(values), "m": len(above)}

    def mixed(own, above):
        weight = lambda n: n / (n + quality_rules.PRIOR)
        share = {q: weight(own["m"] if q == "mid" else own["n"]) for q in names}
        return {q: share[q] * own[q] + (1 - share[q]) * above[q] for q in names}

    out = {}
    for i, m in enumerate(quality_rules.MEASURES):
        values = {g: np.array([v[i] for _, v in rows]) for g, rows in groups.items()}
        whole = quantiles(np.concatenate(list(values.values())))
        langs = {
            lang: mixed(quantiles(np.concatenate([v for g, v in values.items() if g[0] == lang])), whole)
            for lang in {g[0] for g in values}
        }
        for g, v in values.items():
            q = mixed(quantiles(v), langs[g[0]])
            spread = quality_rules.FENCE * (q["q75"] - q["q25"])
            if m == quality_rules.WORD_LENGTH:
                fence = q["q25"] - spread, q["q75"] + spread
            else:
                fence = -1.0, q["q90"] + spread + quality_rules.SHARES[m] * q["mid"]
            out.setdefault(g, []).append(fence)
    return out


def test_verdicts_against_exact_quantiles(spark):
    """``kept`` equals that of exact quantiles, but for texts within the sketches' error of a
    fence; every limit takes many values, and every measure rejects a text by itself."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    groups = groups_of([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
    fences = limits(groups)
    wrong, near, alone = 0, 0, [0, 0, 0, 0]
    for g, rows in groups.items():
        for doc_id, own in rows:
            beyond = [not low <= v <= high for v, (low, high) in zip(own, fences[g])]
            edge = any(
                abs(v - f) < 0.03 * (abs(f) + 0.05) for v, pair in zip(own, fences[g]) for f in pair
            )
            if sum(beyond) == 1:
                alone[beyond.index(True)] += 1
            if kept[doc_id] == any(beyond):
                wrong += not edge
                near += edge
    assert wrong == 0 and near < 20
    assert all(alone), alone
    for i in range(4):
        assert len({round(f[i][1], 4) for f in fences.values()}) >= 40


def test_each_measure_rejects_a_text_of_its_own(spark):
    """In a group whose texts repeat a little, one that repeats more goes, and so on."""
    rng = random.Random(6)
    words = [f"{a}{b}{c}{d}" for a in "bdfg" for b in "aeiou" for c in "lmnr" for d in "aeiou"]

    def text(symbols=0, again=0, dup=0, long=""):
        own = [w + long for w in rng.sample(words, 360)]
        if again:
            own[180 : 180 + again] = own[:again]
        own[5] += "#" * symbols
        lines = [" ".join(own[i : i + 6]) for i in range(0, 360, 6)]
        for i in range(dup):
            lines[10 + 3 * i] = lines[0]
        return "\n".join(lines)

    rows = [
        (i, text(symbols=i % 3, again=9 if i % 20 == 0 else 0, dup=i % 7 == 0), "en", "s") for i in range(400)
    ]
    rows += [(900, text(symbols=60)), (901, text(again=45)), (902, text(dup=8)), (903, text(long="andlonger"))]
    rows = [(*r, "en", "s") if len(r) == 2 else r for r in rows]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    judged = {r.doc_id: r for r in got.collect()}
    assert [judged[i].base_failed for i in range(900, 904)] == [False] * 4
    assert [judged[i].kept for i in range(900, 904)] == [False] * 4
    assert all(judged[i].kept for i in range(400))


def test_no_python_in_the_plan(spark, capsys):
    QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.001").explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_groups_too_many_to_broadcast_are_joined(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    small = sorted(map(tuple, quality_rules.judge(docs).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", -1)
    assert sorted(map(tuple, quality_rules.judge(docs).collect())) == small
