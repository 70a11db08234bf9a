"""Hard negatives from blocks in Hilbert order with per-dimension zone maps.

Rows are sorted by label and by their place on a Hilbert curve through all dimensions, and
written as Parquet blocks of ``BLOCK_ROWS`` rows of one label. Beside its rows each block has
the least and greatest value of every dimension. Interval arithmetic turns these into bounds
of the inner product of an anchor with any row of the block; only the zone maps are read for
that. A block is read for an anchor if one of the anchor's windows meets its bounds:

* positives: the block the anchor lies in gives its first scores while it is packed, and the
  last of them is the floor of the anchor's window over the blocks of its label;
* negatives: one window per positive, from a share of its score up to another, over the blocks
  of the other labels.

Anchors travel in groups, zone maps in tiles; both meet by an equality join on the tile. What
goes on to the blocks is the part of a group that needs the block. Scores are exact integers.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take
no part; shorter vectors count as if filled up with zeros, empty ones score 0; a row with the
anchor's own id is never its positive or negative; other repeated rows count as often as they
occur, and of an anchor's own copies the least (label, vector) is the anchor; ties go to the
smaller id; anchors without positives, positives with an empty window and empty tables have no
rows; other columns are ignored. Scores beyond 64-bit integers raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from stratalake.scratch import written

BLOCK_ROWS = 512
GROUP = 256
ZONES_PER_TILE = 256
PICKED_BYTES = 1 << 23
BITS = 2
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

BLOCKS = """label int, n int, ids binary, vectors binary, least binary, most binary,
    anchor_at binary, floors array<bigint>"""
GROUPS = """label int, ids binary, vectors binary, lows binary, highs binary,
    windows int"""
PICKED = """block_id bigint, ids binary, vectors binary, lows binary, highs binary, windows int"""
HITS = "anchor_id bigint, window int, row_id bigint, score bigint"


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``."""
    greatest = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (a, b)]
    limit = a.shape[1] * greatest[0] * greatest[1]
    if limit < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if limit <= MOST:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError(f"inner products up to {limit} do not fit 64 bits")


def bounds(a: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with any vector between two others."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return inner(up, least) + inner(down, most), inner(up, most) + inner(down, least)


def hilbert_keys(levels: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve, as sortable bytes; ``levels`` are (rows, dimensions).

    Axes are transposed to the curve's index by Skilling's exchange and inversion of bits.
    """
    x = np.ascontiguousarray(levels.T.astype(np.uint32))
    dims = len(x)
    if not dims or not x.shape[1]:
        return [b""] * x.shape[1]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = np.uint32(bit - 1)
        for axis in x:
            swapped = (x[0] ^ axis) & low
            inverted = (axis & bit) != 0
            swapped[inverted] = 0
            axis ^= swapped
            x[0] ^= np.where(inverted, low, swapped)
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0).astype(np.uint32)
        bit >>= 1
    x ^= turn
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def vectors(rows: DataFrame, key: str = "vec_id", label: str = "label",
            vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(row_id, label, vector) of the rows that take part; components are floor(scale * x)."""
    whole = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    return rows.where(
        F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & whole
    ).select(
        F.col(key).cast("long").alias("row_id"),
        F.col(label).cast("int").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"),
    )


@dataclass
class Shape:
    """Dimensions, the type that holds all components, and each dimension's middle and spread."""

    dims: int
    kind: str
    middle: np.ndarray
    spread: np.ndarray

    def levels(self, matrix: np.ndarray) -> np.ndarray:
        """Two bits per component, by quarters of a normal distribution; widest dimension first."""
        z = (matrix - self.middle) / np.where(self.spread > 0, self.spread, 1)
        cut = (z > -0.6745).astype(np.uint8) + (z > 0) + (z > 0.6745)
        return cut[:, np.argsort(-self.spread, kind="stable")]


def shape_of(rows: DataFrame) -> Shape:
    """A row per dimension comes to the driver."""
    found = (
        rows.select(F.posexplode("vector").alias("dim", "x"))
        .groupBy("dim")
        .agg(
            F.avg("x").alias("middle"), F.stddev_pop("x").alias("spread"),
            F.max("x").alias("most"), F.min("x").alias("least"),
        )
        .orderBy("dim")
        .collect()
    )
    furthest = max([0, *(max(r.most, -r.least) for r in found)])
    kind = next((t for t in ("<i2", "<i4", "<i8") if furthest <= np.iinfo(t).max), "<i8")
    return Shape(
        len(found), kind,
        np.array([r.middle for r in found], float), np.array([r.spread for r in found], float),
    )


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of equal length; missing components are 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return values.reshape(len(lists), dims)
    matrix = np.zeros((len(lists), dims), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    matrix[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return matrix


def _unpacked(raw: bytes, kind: str, columns: int) -> np.ndarray:
    flat = np.frombuffer(raw, kind)
    return flat.reshape(-1, columns) if columns else flat.reshape(0, 0)


def _batch(columns: dict[str, list], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in ddl.replace("\n", " ").split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[name], kinds[kind]) for name, kind in fields], [name for name, _ in fields]
    )


def _block(label: int, ids: np.ndarray, matrix: np.ndarray, flags: np.ndarray, shape: Shape,
           positives: int) -> dict:
    """A row of the block table, with the floors of the anchors that lie in it."""
    order = np.argsort(ids, kind="stable")
    ids, matrix, flags = ids[order], matrix[order], flags[order]
    at = np.flatnonzero(flags).astype(np.int32)
    floors: list[int | None] = []
    if len(at):
        scores = inner(matrix[at], matrix)
        for row, a in zip(scores, at):
            others = np.sort(row[ids != ids[a]])
            floors.append(int(others[-positives]) if len(others) >= positives else None)
    kind = shape.kind
    return {
        "label": int(label), "n": len(ids), "ids": ids.astype("<i8").tobytes(),
        "vectors": matrix.astype(kind).tobytes(),
        "least": matrix.min(axis=0).astype(kind).tobytes(),
        "most": matrix.max(axis=0).astype(kind).tobytes(),
        "anchor_at": at.astype("<i4").tobytes(), "floors": floors,
    }


def _packer(shape: Shape, positives: int, size: int):
    """Sorted rows to blocks of one label."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, held = None, []

        def emit(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            ids, matrix, flags = (np.concatenate(x) for x in zip(*held))
            cuts = range(0, len(ids) - least + 1, size)
            blocks = [
                _block(label, ids[i : i + size], matrix[i : i + size], flags[i : i + size], shape, positives)
                for i in cuts
            ]
            held = [(x[len(blocks) * size :] for x in (ids, matrix, flags))]
            held = [tuple(h) for h in held]
            for b in blocks:
                yield _batch({k: [v] for k, v in b.items()}, BLOCKS)

        for batch in batches:
            ids = batch["row_id"].to_numpy(zero_copy_only=False)
            labels = batch["label"].to_numpy(zero_copy_only=False)
            flags = batch["is_anchor"].to_numpy(zero_copy_only=False)
            matrix = _matrix(batch["vector"], shape.dims)
            edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                if labels[start] != label:
                    yield from emit(1)
                    label, held = labels[start], []
                held.append((ids[start:end], matrix[start:end], flags[start:end]))
                yield from emit(size)  # whole blocks only
        yield from emit(1)

    return packed


@dataclass
class Index:
    """Written blocks, their zone maps in tiles per label and over all, and the anchors in them."""

    blocks: DataFrame
    label_tiles: DataFrame
    all_tiles: DataFrame
    tiles: int
    anchors: DataFrame
    shape: Shape
    positives: int


def build_index(rows: DataFrame, is_anchor: Column, positives: int = 5) -> Index:
    """Blocks of the rows that ``vectors`` gives; ``is_anchor`` is over row_id and label."""
    shape = shape_of(rows)

    @F.arrow_udf("binary")
    def curve(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            levels = shape.levels(_matrix(lists, shape.dims))
            yield pa.array(hilbert_keys(levels, BITS), pa.binary())

    keyed = rows.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))).withColumn("curve", curve("vector"))
    ordered = keyed.repartitionByRange("label", "curve", "row_id").sortWithinPartitions(
        "label", "curve", "row_id"
    )
    packer = _packer(shape, positives, BLOCK_ROWS)
    blocks = written(
        ordered.select("row_id", "label", "vector", "is_anchor")
        .mapInArrow(packer, BLOCKS)
        .withColumn("block_id", F.monotonically_increasing_id()),
        "blocks",
    )
    anchors = written(_anchors(blocks, shape), "anchors")
    per_label = blocks.groupBy("label").agg(F.ceil(F.count("*") / ZONES_PER_TILE).alias("tiles"))
    tiles = 1 + blocks.count() // ZONES_PER_TILE
    return Index(
        blocks,
        _tiles(blocks.join(per_label, "label"), ["label", "tiles"], F.col("tiles")),
        _tiles(blocks, [], F.lit(tiles)),
        tiles, anchors, shape, positives,
    )


def _tiles(blocks: DataFrame, by: list[str], tiles: Column) -> DataFrame:
    """(by, tile, zones): about ``ZONES_PER_TILE`` zone maps a row."""
    zones = F.collect_list(F.struct("block_id", "label", "least", "most")).alias("zones")
    tile = F.pmod(F.xxhash64("block_id"), tiles).alias("tile")
    return written(blocks.groupBy(*by, tile).agg(zones), "tiles")


def _anchors(blocks: DataFrame, shape: Shape) -> DataFrame:
    """(anchor_id, label, vector, floor, block_id)"""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.frombuffer(r["anchor_at"], "<i4")
                ids = np.frombuffer(r["ids"], "<i8")[at]
                matrix = np.frombuffer(r["vectors"], shape.kind).reshape(r["n"], shape.dims)[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids), pa.array([r["label"]] * len(at), pa.int32()),
                        pa.array([v.tobytes() for v in matrix], pa.binary()),
                        pa.array(r["floors"], pa.int64()), pa.array([r["block_id"]] * len(at), pa.int64()),
                    ],
                    ["anchor_id", "label", "vector", "floor", "block_id"],
                )

    rows = blocks.where(F.length("anchor_at") > 0).mapInArrow(
        taken, "anchor_id bigint, label int, vector binary, floor bigint, block_id bigint"
    )
    copy = F.min(F.struct("label", "vector", "floor", "block_id")).alias("c")
    return rows.groupBy("anchor_id").agg(copy).select("anchor_id", "c.*")


def _groups(anchors: DataFrame, shape: Shape) -> DataFrame:
    """Anchors of one label in rows of up to ``GROUP``, near ones together; no two have an id."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def group() -> pa.RecordBatch:
            windows = max(len(h["lows"]) for h in held)
            edge = lambda name, fill: np.array(
                [[*h[name], *[fill] * (windows - len(h[name]))] for h in held], "<i8"
            ).tobytes()
            return _batch({
                "label": [held[0]["label"]], "windows": [windows],
                "ids": [np.array([h["anchor_id"] for h in held], "<i8").tobytes()],
                "vectors": [b"".join(h["vector"] for h in held)],
                "lows": [edge("lows", MOST)], "highs": [edge("highs", LEAST)],  # missing: empty
            }, GROUPS)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == GROUP or held[0]["label"] != row["label"]):
                    yield group()
                    held = []
                held.append(row)
        if held:
            yield group()

    return (
        anchors.repartitionByRange("label", "block_id", "anchor_id")
        .sortWithinPartitions("label", "block_id", "anchor_id")
        .select("anchor_id", "label", "vector", "lows", "highs")
        .mapInArrow(grouped, GROUPS)
    )


def _chooser(shape: Shape, same_label: bool):
    """Groups beside tiles: for each block the anchors with a window that meets its bounds."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                matrix = np.frombuffer(r["vectors"], shape.kind).reshape(len(ids), shape.dims)
                lows, highs = (_unpacked(r[x], "<i8", r["windows"]) for x in ("lows", "highs"))
                zones = r["zones"]
                least, most = (
                    np.frombuffer(b"".join(z[x] for z in zones), shape.kind).reshape(len(zones), shape.dims)
                    for x in ("least", "most")
                )
                below, above = bounds(matrix, least, most)
                meets = np.zeros(below.shape, bool)
                for low, high in zip(lows.T, highs.T):
                    meets |= (above >= low[:, None]) & (below <= high[:, None])
                meets &= (np.array([z["label"] for z in zones]) == r["label"]) == same_label
                names = [f.split()[0] for f in PICKED.split(",")]
                out, size = {n: [] for n in names}, 0
                for zone, who in zip(zones, meets.T):
                    if not who.any():
                        continue
                    out["block_id"].append(zone["block_id"])
                    out["windows"].append(r["windows"])
                    for name, part in (("ids", ids), ("vectors", matrix), ("lows", lows), ("highs", highs)):
                        out[name].append(part[who].tobytes())
                        size += len(out[name][-1])
                    if size > PICKED_BYTES:
                        yield _batch(out, PICKED)
                        out, size = {n: [] for n in names}, 0
                yield _batch(out, PICKED)

    return chosen


def _scorer(shape: Shape, first: int):
    """Blocks beside anchors: the first rows of each window within the block."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                anchors, ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["row_ids"], "<i8")
                mine = np.frombuffer(r["vectors"], shape.kind).reshape(len(anchors), shape.dims)
                rows = np.frombuffer(r["row_vectors"], shape.kind).reshape(len(ids), shape.dims)
                scores = inner(mine, rows)
                other = anchors[:, None] != ids
                lows, highs = (_unpacked(r[x], "<i8", r["windows"]) for x in ("lows", "highs"))
                for window, (low, high) in enumerate(zip(lows.T, highs.T)):
                    inside = (scores >= low[:, None]) & (scores <= high[:, None]) & other
                    a, b = np.nonzero(inside)
                    if not len(a):
                        continue
                    order = np.lexsort((ids[b], ~scores[a, b], a))  # ~: descending without overflow
                    a, b = a[order], b[order]
                    head = np.flatnonzero(np.diff(a, prepend=-1))
                    rank = np.arange(len(a)) - np.repeat(head, np.diff([*head, len(a)]))
                    a, b = a[rank < first], b[rank < first]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchors[a]), pa.array(np.full(len(a), window, np.int32)),
                            pa.array(ids[b]), pa.array(scores[a, b]),
                        ],
                        ["anchor_id", "window", "row_id", "score"],
                    )

    return scored


def first_in_windows(index: Index, anchors: DataFrame, same_label: bool, first: int) -> DataFrame:
    """(anchor_id, window, row_id, score, rank): the first rows of each anchor's windows.

    ``anchors`` are (anchor_id, label, vector, block_id, lows, highs); the rows searched are
    those of the anchor's label or those of all others.
    """
    groups = written(_groups(anchors, index.shape), "groups")
    if same_label:
        tiles, on = index.label_tiles, ["label", "tile"]
        spread = groups.join(tiles.select("label", "tiles").distinct(), "label")
    else:
        tiles, on = index.all_tiles, ["tile"]
        spread = groups.withColumn("tiles", F.lit(index.tiles).cast("long"))
    spread = spread.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    picked = (
        spread.drop("tiles")
        .join(tiles.select(*on, "zones"), on)
        .mapInArrow(_chooser(index.shape, same_label), PICKED)
    )
    blocks = index.blocks.select(
        "block_id", F.col("ids").alias("row_ids"), F.col("vectors").alias("row_vectors")
    )
    hits = picked.join(blocks, "block_id").drop("block_id").mapInArrow(_scorer(index.shape, first), HITS)
    place = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "row_id")
    return hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= first)


def _percent(score: Column, percent: int) -> Column:
    """The greatest integer of at most so many hundredths of a score, without floats."""
    part = score * percent
    return ((part - F.pmod(part, F.lit(100))).cast("decimal(20,0)") / 100).cast("long")


def mine(index: Index, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Negatives have between ``low`` and ``high`` percent of the positive's score.
    """
    own = index.anchors.withColumns({
        "lows": F.array(F.coalesce("floor", F.lit(int(LEAST)))), "highs": F.array(F.lit(int(MOST))),
    })
    positives = first_in_windows(index, own, True, index.positives)
    listed = written(
        positives.select(
            "anchor_id", "rank", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"),
            (-_percent(F.col("score"), -low)).alias("low"), _percent(F.col("score"), high).alias("high"),
        ),
        "positives",
    )
    wanted = (
        listed.where("low <= high")
        .groupBy("anchor_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
        .selectExpr("anchor_id", "w.low AS lows", "w.high AS highs", "w.rank AS ranks")
    )
    anchors = index.anchors.drop("floor").join(wanted.drop("ranks"), "anchor_id")
    found = first_in_windows(index, anchors, False, negatives)
    return (
        found.join(wanted.select("anchor_id", "ranks"), "anchor_id")
        .withColumn("positive_rank", F.col("ranks")[F.col("window")])
        .join(
            listed.select("anchor_id", F.col("rank").alias("positive_rank"), "positive_id", "positive_score"),
            ["anchor_id", "positive_rank"],
        )
        .select(
            "anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )


def report(rows: DataFrame) -> DataFrame:
    """Negatives of every hundredth row; the labels of every seventh are moved on by one."""
    moved = rows.withColumn(
        "label",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")),
    )
    index = build_index(vectors(moved), F.col("row_id") % 100 == 0)
    return mine(index)
