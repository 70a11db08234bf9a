"""SimHash near-duplicates: exact Hamming search with vantage-point trees.

Fingerprints: text is lower-cased (A-Z only), cut at ASCII white space into words and
these into shingles; a bit is set if more than half of the shingles' XXH64 have it.

Two fingerprints that differ in at most ``radius`` bits differ in at most
``radius // PARTS`` bits of one of their ``PARTS`` parts. So there is one vantage-point
tree per part, over the Hamming distance of that part, which has a much smaller search
ball than the whole fingerprint. A tree is fitted on a bounded sample of fingerprints
(``SAMPLE``) and only says where to cut; every fingerprint is then

* at home in one shard, reached by comparing its distance to each vantage with the radius;
* a guest of every other shard that the triangle bounds cannot rule out.

Within a shard the same cuts go on until few fingerprints are left, which are compared
directly over all bits. Shards over ``cell_rows`` rows are cut into a grid of cells, so
no group is taken whole by one task. A shard reports links to one root per group found
there; linked groups are then joined by large-star/small-star rounds, each of which is
written to the shared folder.

Defined results: null and wordless texts have fingerprint zero and link like others;
component_id is the smallest doc_id of the group and null only if no member has one;
rows that repeat a doc_id and text are one document; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stratalake.llm.common import free_name
from stratalake.scratch import written

SHINGLE = 3
RADIUS = 3
SEED = 42
PARTS = 2
SAMPLE = 65_536
SHARD_ROWS = 8_192
CELL_ROWS = 200_000
LEAF = 256
CHUNK = 65_536


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, n)
    starts, ends = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        spans = zip(starts[i : i + CHUNK], ends[i : i + CHUNK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    over = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    @F.arrow_udf("bigint")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            raw = texts.cast(pa.binary())
            values = np.array([fingerprint(t.as_py(), shingle) for t in raw], np.uint64)
            yield pa.array(values.view(np.int64))

    return of


@dataclass
class Tree:
    """Cuts of the space: inside if the masked distance to ``vantage`` is at most ``radius``.

    Children of node i are inside[i] and outside[i]; a negative child c is leaf -c - 1.
    """

    mask: int
    slack: int
    vantage: list[int]
    radius: list[int]
    inside: list[int]
    outside: list[int]
    leaves: int


def _distance(points: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int16)


def _best_cut(points, mask, slack, rng, tries=6):
    """(vantage, radius) with the fewest comparisons left, or None if no cut saves any."""
    best, cut = 0.95 * len(points) ** 2, None
    picks = points[rng.integers(0, len(points), min(tries, len(points)))]
    for vantage in np.unique(picks):
        count = np.bincount(_distance(points, int(vantage), mask), minlength=65)
        below = np.cumsum(count)
        middle = int(np.searchsorted(below, len(points) / 2))
        for radius in range(max(0, middle - 3), min(63, middle + 3) + 1):
            home_in = int(below[radius])
            home_out = len(points) - home_in
            guest_in = int(below[min(64, radius + slack)])
            guest_out = len(points) - (int(below[radius - slack]) if radius >= slack else 0)
            cost = home_in * guest_in + home_out * guest_out
            if home_in and home_out and cost < best:
                best, cut = cost, (int(vantage), radius)
    return cut


def fit_tree(sample: np.ndarray, mask: int, slack: int, leaf: int, seed: int = 0) -> Tree:
    rng = np.random.default_rng(seed)
    tree = Tree(mask, slack, [], [], [], [], 0)
    todo = [(sample, None, None)]
    while todo:
        points, parent, side = todo.pop()
        cut = _best_cut(points, mask, slack, rng) if len(points) > leaf else None
        if cut is None:
            node = -tree.leaves - 1
            tree.leaves += 1
        else:
            node = len(tree.vantage)
            tree.vantage.append(cut[0])
            tree.radius.append(cut[1])
            tree.inside.append(0)
            tree.outside.append(0)
            near = _distance(points, cut[0], mask) <= cut[1]
            todo.append((points[near], node, "inside"))
            todo.append((points[~near], node, "outside"))
        if parent is not None:
            getattr(tree, side)[parent] = node
    return tree


def route(tree: Tree, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, positions of points there, whether each is at home)."""
    todo = [(0 if tree.vantage else -1, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if node < 0:
            yield -node - 1, at, home
            continue
        d = _distance(points[at], tree.vantage[node], tree.mask)
        near = d <= tree.radius[node]
        into = d <= tree.radius[node] + tree.slack
        out = d > tree.radius[node] - tree.slack
        todo.append((tree.inside[node], at[into], (home & near)[into]))
        todo.append((tree.outside[node], at[out], (home & ~near)[out]))


def link(home: np.ndarray, guests: np.ndarray, radius: int, mask: int, slack: int):
    """(fingerprint, root) pairs that connect all home-guest pairs within ``radius``.

    ``guests`` holds the home points too. Cuts as in the trees until few are left.
    """
    rng = np.random.default_rng(1)
    todo = [(home, guests)]
    while todo:
        a, b = todo.pop()
        if not len(a) or len(b) < 2:
            continue
        cut = _best_cut(a, mask, slack, rng, 3) if len(a) > LEAF else None
        if cut is None:
            yield from _compare(a, b, radius)
            continue
        da, db = _distance(a, cut[0], mask), _distance(b, cut[0], mask)
        todo.append((a[da <= cut[1]], b[db <= cut[1] + slack]))
        todo.append((a[da > cut[1]], b[db > cut[1] - slack]))


def _compare(home: np.ndarray, guests: np.ndarray, radius: int):
    """All pairs compared over all bits; groups are kept as labels, never as pairs."""
    label = np.arange(len(guests))
    rows = max(1, (1 << 20) // len(guests))
    touched = False
    for i in range(0, len(home), rows):
        close = np.bitwise_count(home[i : i + rows, None] ^ guests[None, :]) <= radius
        for row in np.flatnonzero(close.sum(axis=1) > 1):
            touched = True
            found = np.unique(label[close[row]])
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
    if touched:
        other = np.flatnonzero(label != np.arange(len(guests)))
        yield guests[other], guests[label[other]]


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def masks(parts: int = PARTS) -> list[int]:
    width = 64 // parts
    return [((1 << width) - 1) << (width * i) for i in range(parts)]


def links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS,
          cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(a, b): fingerprints of column ``fp`` (distinct) whose groups are all links' groups."""
    spark = prints.sparkSession
    total = prints.count()
    share = min(1.0, sample / max(1, total))
    order = F.pmod(F.xxhash64("fp"), F.lit(1 << 20))
    picked = prints.where(order < F.lit(int(share * (1 << 20)) + 1)).select("fp").limit(2 * sample)
    points = np.sort(np.array([r[0] for r in picked.collect()], np.int64)).view(np.uint64)
    leaf = max(8, int(shard_rows * len(points) / max(1, total)))
    slack = radius // PARTS
    trees = [fit_tree(points, m, slack, leaf, i) for i, m in enumerate(masks())]
    offsets = np.cumsum([0, *(t.leaves for t in trees)]).tolist()
    shared = spark.sparkContext.broadcast(trees)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for tree, base in zip(shared.value, offsets):
                found = list(route(tree, fps.view(np.uint64)))
                if found:
                    at = np.concatenate([f[1] for f in found])
                    shards = [np.full(len(f[1]), base + f[0], np.int32) for f in found]
                    yield _batch(
                        shard=np.concatenate(shards),
                        fp=fps[at],
                        home=np.concatenate([f[2] for f in found]),
                    )

    placed = written(
        prints.select("fp").mapInArrow(spread, "shard int, fp bigint, home boolean"), "placed"
    )
    large = (
        placed.groupBy("shard").count().where(F.col("count") > cell_rows)
        .select("shard", F.ceil(F.col("count") / cell_rows).cast("int").alias("cuts"))
        .collect()
    )  # at most one row per leaf of a tree fitted on ``sample`` points
    cuts = {r["shard"]: r["cuts"] for r in large}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Home chunk i meets guest chunk j in cell (i, j)."""
        for batch in batches:
            shards, fps, homes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            k = np.array([cuts.get(int(s), 1) for s in shards], np.int64)
            mine = (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(
                np.int64
            ) % k
            for role in ("guest", "home"):
                at = np.arange(len(fps)) if role == "guest" else np.flatnonzero(homes)
                for step in range(int(k[at].max()) if len(at) else 0):
                    sel = at[k[at] > step]
                    i, j = (np.full(len(sel), step), mine[sel])
                    if role == "home":
                        i, j = j, i
                    yield _batch(
                        shard=shards[sel].astype(np.int32),
                        cell=(i * k[sel] + j).astype(np.int64),
                        fp=fps[sel],
                        home=np.full(len(sel), role == "home"),
                    )

    def join(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        tree = next(i for i in range(len(trees)) if shard < offsets[i + 1])
        fps = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        own = np.unique(fps[home])
        found = list(link(own, np.unique(fps), radius, masks()[tree], slack))
        a = np.concatenate([f[0] for f in found] or [np.array([], np.uint64)])
        b = np.concatenate([f[1] for f in found] or [np.array([], np.uint64)])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    celled = placed.mapInArrow(cells, "shard int, cell bigint, fp bigint, home boolean")
    # a fixed number: the work of a shard is far larger than its bytes suggest
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    celled = celled.repartition(tasks, "shard", "cell")
    return celled.groupBy("shard", "cell").applyInArrow(join, "a bigint, b bigint").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not the smallest of its group."""
    pair = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now = written(pair.distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least)
            .distinct()
        )
        now = written(small, "small-star")
        last, mark = mark, _mark(now)
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(F.shiftright(F.xxhash64("u", "v"), 40)),
            F.bit_xor(F.xxhash64("v", "u")),
        ).first()
    )


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
           **options) -> tuple[DataFrame, DataFrame]:
    """(rows, reps): per row doc_id, text_hash, fp; per fp the first document of its group.

    The first document is the smallest (doc_id is null, doc_id, text_hash) as column ``rep``.
    """
    text = F.col("text").cast("string")
    rows = written(
        docs.select(
            F.col("doc_id"),
            F.xxhash64(text).alias("text_hash"),
            _fingerprints(shingle)(text).alias("fp"),
        ),
        "fingerprints",
    )
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    prints = written(rows.groupBy("fp").agg(F.min(key).alias("rep")), "prints")
    star = written(stars(links(prints, radius, **options)), "stars")
    grouped = prints.join(star, prints["fp"] == star["node"], "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    grouped = written(grouped, "grouped")
    linked = (
        grouped.join(star.select("root").distinct(), "root", "left_semi")
        .groupBy("root")
        .agg(F.min("rep").alias("first"))
    )
    reps = grouped.join(linked, "root", "left").select("fp", F.coalesce("first", "rep").alias("rep"))
    return rows, reps


def components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``."""
    rows, reps = groups(docs, **options)
    return rows.join(reps, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("rep.doc_id").alias("component_id"),
    )


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The first document of each group, with the columns of ``docs``."""
    rows, reps = groups(docs, **options)
    text_hash, first_id, first_hash = (
        free_name(docs, n) for n in ("text_hash", "first_id", "first_hash")
    )
    firsts = written(
        reps.select(
            F.col("rep.doc_id").alias(first_id), F.col("rep.text_hash").alias(first_hash)
        ).distinct(),
        "firsts",
    )
    hashed = docs.withColumn(text_hash, F.xxhash64(F.col("text").cast("string")))
    kept = hashed.join(
        firsts,
        F.col("doc_id").eqNullSafe(F.col(first_id)) & (F.col(text_hash) == F.col(first_hash)),
        "left_semi",
    )
    if not rows.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", text_hash])
    return kept.drop(text_hash)
