"""Hard negatives against brute force and DuckDB."""

from __future__ import annotations

import itertools
import math
import random

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalake.llm import hard_negatives as hn
from stratalake.llm.oracles import ORACLES
from stratalake.llm.queries import QUERIES

ROWS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, first=5, low=80, high=100, scale=256):
    kept = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None or not all(x is not None and math.isfinite(x) for x in vector):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(scale * float(np.float32(x))) for x in vector]))
    out = []
    anchors = {i: min(r[1:] for r in kept if r[0] == i) for i in {r[0] for r in kept} if i % 100 == 0}
    for i, (label, vector) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), j, lab) for j, lab, v in kept if j != i)
        for p, pos, _ in [s for s in scored if s[2] == label][:first]:
            inside = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p][:first]
            out += [(i, pos, k, n, -p, -s) for k, (s, n, _) in enumerate(inside, 1)]
    return sorted(out)


def collected(rows):
    return sorted(
        (r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)
        for r in rows.collect()
    )


def made(seed, n=900, dims=6, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels)
        rows.append((i, [c * 0.5 + rng.gauss(0, 0.4) for c in centres[rng.randrange(labels)]], label))
    return rows


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_whole_table_matches_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    with compare.duck(d) as con:
        result = QUERIES["op12_hard_negatives"](spark, d)
        assert compare.difference(result, con, ORACLES["op12_hard_negatives"]) is None


@pytest.mark.parametrize("block, group, tile", [(512, 256, 256), (7, 3, 4), (64, 2, 1)])
def test_sizes_of_blocks_change_nothing(spark, monkeypatch, block, group, tile):
    for name, value in (("BLOCK_ROWS", block), ("GROUP", group), ("ZONES_PER_TILE", tile), ("PICKED_BYTES", 500)):
        monkeypatch.setattr(hn, name, value)
    rows = made(block)
    assert collected(hn.report(spark.createDataFrame(rows, ROWS))) == brute(rows)


def test_only_blocks_within_bounds_are_read(spark, monkeypatch):
    """Clusters far apart: most pairs of anchors and blocks are ruled out by the zone maps."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", 16)
    rng = random.Random(4)
    centres = [[rng.choice((-1, 1)) for _ in range(8)] for _ in range(20)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 20]], i // 20 % 3) for i in range(3000)]
    df = spark.createDataFrame(rows, ROWS)
    index = hn.build_index(hn.vectors(df), F.col("row_id") % 100 == 0)
    own = index.anchors.withColumns({"lows": F.array("floor"), "highs": F.array(F.lit(int(hn.MOST)))})
    groups, tiles = hn._groups(own, index.shape).collect(), index.all_tiles.collect()
    chosen = hn._chooser(index.shape, True)
    picked = 0
    for g, t in itertools.product(groups, tiles):
        row = g.asDict() | {"zones": [z.asDict() for z in t.zones]}
        batch = hn.pa.RecordBatch.from_pylist([{k: bytes(v) if isinstance(v, bytearray) else v for k, v in row.items()}])
        for out in chosen([batch]):
            picked += sum(len(x) // 8 for x in out["ids"].to_pylist())
    blocks = index.blocks.count()
    assert 0 < picked < 30 * blocks / 3 / 4
    assert collected(hn.report(df)) == brute(rows)


def test_bounds_hold_and_are_reached():
    rng = np.random.default_rng(1)
    rows, anchors = rng.integers(-99, 99, (50, 7)), rng.integers(-99, 99, (9, 7))
    below, above = hn.bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = anchors @ rows.T
    assert (below[:, 0] <= scores.min(axis=1)).all() and (above[:, 0] >= scores.max(axis=1)).all()
    below, above = hn.bounds(anchors, rows[:1], rows[:1])
    assert (below[:, 0] == scores[:, 0]).all() and (above[:, 0] == scores[:, 0]).all()


@pytest.mark.parametrize("dims, bits", [(1, 3), (2, 1), (2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_differ_in_one_place_by_one(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)), np.uint8)
    keys = hn.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    path = cells[np.argsort(np.array(keys, object), kind="stable")].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_exact_scores_of_large_components():
    a = np.array([[2**30, -(2**30)], [3, 4]])
    assert hn.inner(a, a).tolist() == [[2**61, -(2**30)], [-(2**30), 25]]
    with pytest.raises(OverflowError):
        hn.inner(np.array([[2**40]]), np.array([[2**40]]))


def test_large_components_in_a_table(spark):
    rows = [(i, [x * 2.0**14 for x in v], label) for i, v, label in made(9, n=300)]
    assert collected(hn.report(spark.createDataFrame(rows, ROWS))) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(2, n=400, dims=3) + [
        (None, [1.0, 1.0, 1.0], 1), (1001, None, 1), (1002, [1.0, 1.0, 1.0], None), (1003, [None, 1.0, 1.0], 1),
        (1004, [nan, 1.0, 1.0], 1), (1005, [inf, 1.0, 1.0], 1), (1006, [-inf, 1.0, 1.0], 1),
        (1100, [0.5, 0.5], 1), (1101, [], 2), (1200, [], 0), (1300, [-1.0, -1.0, -1.0], 7), (-100, [0.3, 0.2, 0.1], 1),
    ]
    df = spark.createDataFrame(rows, ROWS)
    names = ("row_id", "block_id", "rank", "score", "vector", "curve", "is_anchor", "anchor_id")
    assert collected(hn.report(df.withColumns({n: F.lit("x") for n in names}))) == brute(rows)


def test_ties_and_one_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 32)
    rows = [(i, [0.5, 0.5, 0.0], 1 + i % 2) for i in range(700)] + made(3, n=0)
    assert collected(hn.report(spark.createDataFrame(rows, ROWS))) == brute(rows)


def test_repeated_rows(spark):
    rows = made(5, n=300)
    rows += rows[:150] + [(100, [9.0] * 6, 0)]
    assert collected(hn.report(spark.createDataFrame(rows, ROWS))) == brute(rows)


def test_other_windows(spark):
    rows = made(6, n=300)
    df = spark.createDataFrame(rows, ROWS)
    moved = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    index = hn.build_index(hn.vectors(moved), F.col("row_id") % 100 == 0, positives=3)
    assert collected(hn.mine(index, negatives=3, low=50, high=90)) == brute(rows, 3, 50, 90)


def test_empty_and_lonely(spark):
    assert hn.report(spark.createDataFrame([], ROWS)).collect() == []
    assert hn.report(spark.createDataFrame([(100, [1.0, 2.0], 1)], ROWS)).collect() == []
