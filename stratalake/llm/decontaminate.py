"""Benchmark decontamination: word windows of test items found by Wu-Manber search.

Text is lower-cased (A-Z only) and cut into words; a window is ``window`` consecutive
words of an item, or the whole item if it is shorter. All windows of one length form
one Wu-Manber table: the shift of a block of two words says how far the search can jump,
the bucket of a window's last block lists the windows to compare word by word.

The tables are broadcast in parts of at most ``part_rows`` windows. Each part reads the
documents once and adds its hits to those found before, so the number of test items is
not limited, and documents are never shuffled.

Defined results: a null or wordless text has no words and no hit; null or wordless items
have no window; items that share an id count once; an item without id is shown as "null";
repeated documents are searched each; other columns are passed through.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalake.llm.common import free_name
from stratalake.scratch import written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
BLOCK = 2
PART_ROWS = 200_000
HITS = "struct<n_words:bigint,spans:array<struct<start:int,stop:int>>,items:array<string>>"
_HITS = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text; bytes.lower() changes A-Z and nothing else."""
    return WORD.findall(text.lower()) if text else []


def windows_of(words: list[bytes], size: int) -> set[bytes]:
    """Windows, their words joined by a space (which no word contains)."""
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class WuManber:
    """Search for word sequences of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], length: int):
        self.length = length
        self.block = min(BLOCK, length)
        self.longest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], set[str]]]]
        self.buckets = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                block = words[end - self.block : end]
                self.shift[block] = min(length - end, self.shift.get(block, self.longest))
            self.buckets[words[-self.block :]].append((words, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of every occurrence, starts ascending."""
        length, block, shift, longest = self.length, self.block, self.shift, self.longest
        end, n = length, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            step = shift.get(key, longest)
            if step:
                end += step
                continue
            start = end - length
            for pattern, items in self.buckets[key]:
                if words[start] == pattern[0] and tuple(words[start:end]) == pattern:
                    yield start, items
            end += 1


def build_tables(rows: Iterable[tuple[bytes, str]]) -> list[WuManber]:
    """One table per window length."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(dict)
    for window, item in rows:
        words = tuple(window.split(b" "))
        by_length[len(words)].setdefault(words, set()).add(item)
    return [WuManber(p, n) for n, p in sorted(by_length.items())]


def search(tables: list[WuManber], text: bytes | None, before: dict | None) -> dict:
    """Word spans (disjoint, ascending) and items of one text, with those of ``before``."""
    words = words_of(text)
    spans, items = [], set()
    if before:
        spans = [(s["start"], s["stop"]) for s in before["spans"]]
        items.update(before["items"])
    for table in tables:
        for start, found in table.find(words):
            stop = start + table.length
            if spans and spans[-1][0] <= start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(stop, spans[-1][1]))
            else:
                spans.append((start, stop))
            items |= found
    spans.sort()
    merged: list[tuple[int, int]] = []
    for start, stop in spans:
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((start, stop))
    return {
        "n_words": len(words),
        "spans": [{"start": a, "stop": b} for a, b in merged],
        "items": sorted(items),
    }


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window binary, item_id string): the distinct windows of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = [
                (w, item)
                for item, text in zip(batch.column(0).to_pylist(), texts)
                for w in windows_of(words_of(text), window)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.binary()),
                    pa.array([r[1] for r in rows], pa.string()),
                ],
                ["window", "item_id"],
            )

    ids = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    rows = items.select(ids.alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "window binary, item_id string").distinct()


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    hits: str = "hits",
    window: int = WINDOW,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``docs`` with a column ``hits``: n_words, hit word spans and the items found."""
    spark = docs.sparkSession
    windows = written(item_windows(items, window), "benchmark-windows")
    parts = max(1, math.ceil(windows.count() / part_rows))
    part_of = F.pmod(F.xxhash64("window", "item_id"), F.lit(parts))
    before = free_name(docs, "hits_before")
    found = docs.withColumn(hits, F.lit(None).cast(HITS))
    for part in range(parts):
        rows = windows.where(part_of == part).collect()  # part_rows of them, about
        shared = spark.sparkContext.broadcast([(bytes(r[0]), r[1]) for r in rows])
        found = found.withColumnRenamed(hits, before)
        found = found.withColumn(hits, _searcher(shared)(F.col("text"), F.col(before)))
        found = found.drop(before)
        if parts > 1:
            found = written(found, f"hits-{part}")
    return found


def _searcher(shared):
    tables: list[WuManber] = []

    @F.arrow_udf(HITS)
    def searched(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        if not tables:
            tables.extend(build_tables(shared.value))
        for texts, before in parts:
            raw = texts.cast(pa.binary()).to_pylist()
            old = before.to_pylist() if before.null_count < len(before) else [None] * len(raw)
            yield pa.array([search(tables, t, b) for t, b in zip(raw, old)], _HITS)

    return searched



def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    rows = find_hits(docs.select("doc_id", "text"), items, **options)
    n_hit = F.aggregate(
        "hits.spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"])
    )
    joined = F.array_join(F.array_sort("hits.items"), ",")
    return rows.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents without any window of a test item, with the columns of ``docs``."""
    hits = free_name(docs, "hits")
    found = find_hits(docs, items, hits=hits, **options)
    return found.where(F.size(F.col(hits)["spans"]) == 0).drop(hits)
