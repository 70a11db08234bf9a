"""SimHash groups against brute force."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from stratalake.fixtures import table
from stratalake.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """doc_id -> smallest doc_id reachable over links of at most 3 bits."""
    prints = np.array([f for _, f in rows], np.uint64)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= 3):
            label[root(int(j))] = root(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((d, f, least.get(root(i))) for i, (d, f) in enumerate(rows) if d is not None)


def found(frame):
    rows = frame.collect()
    return sorted((r[0], int(r[1], 16), r[2]) for r in rows if r[0] is not None)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert found(simhash.components(docs)) == plain_components(rows)


def test_odd_documents(spark, odd_documents):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in odd_documents.collect()]
    result = simhash.components(odd_documents)
    assert result.columns == ["doc_id", "fingerprint", "component_id"]
    assert found(result) == plain_components(rows)


def test_empty_table(spark, no_documents):
    assert simhash.components(no_documents).collect() == []
    assert simhash.one_per_group(no_documents).collect() == []


def chained(n, seed):
    """Families around random centres and chains of small steps."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = list(centres)
    for c in centres[: n // 3]:
        at = c
        for _ in range(rng.integers(1, 6)):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                at = at ^ np.uint64(1 << int(b))
            out.append(at)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("options", [{}, {"shard_rows": 50}, {"shard_rows": 50, "cell_rows": 30}])
def test_links_lose_no_group(spark, options):
    points = chained(600, 3)
    prints = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    edges = simhash.links(prints, sample=300, **options)
    roots = dict(map(tuple, simhash.stars(edges).collect()))
    groups = {}
    for p in points.view(np.int64).tolist():
        groups.setdefault(roots.get(p, p), []).append(p)
    want = {}
    for doc, _, component in plain_components(list(zip(range(len(points)), points.tolist()))):
        want.setdefault(component, []).append(int(points.view(np.int64)[doc]))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_triangle_bounds_keep_every_near_pair():
    points = chained(400, 9)
    for mask in simhash.masks():
        tree = simhash.fit_tree(points, mask, 1, 16)
        assert tree.leaves > 8
        homes, guests = {}, {}
        for leaf, at, home in simhash.route(tree, points):
            for i, h in zip(at.tolist(), home.tolist()):
                guests.setdefault(i, set()).add(leaf)
                if h:
                    assert i not in homes
                    homes[i] = leaf
        assert len(homes) == len(points)
        for i in range(len(points)):
            close = np.bitwise_count((points[i] ^ points) & np.uint64(mask)) <= 1
            assert all(homes[i] in guests[int(j)] for j in np.flatnonzero(close))


def test_one_document_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (9, "other text of its own")]
    rows += [(7, None), (8, ""), (None, "alone without any id"), (None, "alone without any id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(
        map(str, [(2, "a b c d e f g"), (9, "other text of its own"), (7, None),
                  (None, "alone without any id")])
    )


def test_star_rounds_join_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    assert {tuple(r) for r in simhash.stars(edges).collect()} == {(i, 0) for i in range(1, 301)}
