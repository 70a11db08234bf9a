"""Line dedup: blocks of lines that an earlier document has are deleted from the later one.

A *run* is a sequence of consecutive lines that starts and ends with words. Two kinds stand
for rare lines:

* the shortest runs, starting or ending at a given line, of ``MIN_WORDS`` words or more: so many
  words do not recur by chance, so none of them is left out for being frequent;
* runs of ``RARE_WORDS`` words or more, but fewer than that, mostly single lines, if at most
  ``RARE_DOCS`` documents have them, counted over all documents.

Every common block of ``MIN_WORDS`` words or more is a union of common runs; a shorter one
is deleted if it has a rare line, with the common lines beside it that belong to a rare run.

1. Each run hash is given its first holder, the earliest document with that run. Runs that
   only one document has go no further, nor do short ones that are frequent.
2. A later document is paired with the first holders of its runs, not with all holders:
   as many pairs at most as it has lines, however many copies there are.
3. Each pair is aligned by patience: runs that occur once on both sides, the longest
   increasing chain of them, then the rest between the chain's gaps in the same way. The
   lines of the aligned runs are deleted from the later document. What is left of the
   common runs (moved or repeated passages) is aligned again; as every round can only add
   to the lines of common runs, whatever is left after ``ROUNDS`` rounds is taken at once.

The earliest copy of a block is always kept. Order is by doc_id; rows without doc_id come last.

Defined results: lines are compared without surrounding white space; null texts stay null;
a text that is deleted in full becomes empty; n_chars, if there, follows the text where it
changed; rows that share a doc_id are never compared with each other, nor are rows without
doc_id; other columns are passed through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stratalake.llm.common import free_name

MIN_WORDS = 20
RARE_WORDS = 5
RARE_DOCS = 16
ROUNDS = 6
LAST = (1 << 63) - 1  # order of rows without doc_id


def runs_of(
    text: bytes | None, min_words: int = MIN_WORDS, rare_words: int = RARE_WORDS
) -> list[tuple[int, int, int, int]]:
    """(hash, first line, lines, kind) of the shortest runs that start or end at each line, and
    of shorter ones. The kind is 0 for long runs, 1 for short ones and 2 if a text has a short
    one again."""
    if not text:
        return []
    lines = [line.strip() for line in text.split(b"\n")]
    words = np.fromiter((len(line.split()) for line in lines), np.int64, len(lines))
    total = np.concatenate([[0], np.cumsum(words)])
    if total[-1] < min(min_words, rare_words):
        return []
    n = len(lines)
    # end of the run from i: first j with total[j] - total[i] >= min_words
    ends = np.searchsorted(total, total[:-1] + min_words, "left")
    # start of the run up to j: last i with total[j] - total[i] >= min_words
    starts = np.searchsorted(total, total[1:] - min_words, "right") - 1
    spans = {(i, int(j)) for i, j in enumerate(ends) if j <= n and words[i]}
    spans |= {(int(i), j + 1) for j, i in enumerate(starts) if i >= 0 and words[j]}
    digest = xxhash.xxh3_64_intdigest
    whole = b"".join(digest(line).to_bytes(8, "little") for line in lines)
    hashed = lambda i, j: digest(whole[8 * i : 8 * j]) - (1 << 63)
    found = [(hashed(i, j), i, j - i, 0) for i, j in sorted(spans)]
    seen: set[int] = set()
    for i, j in _short_spans(words, total, min_words, rare_words):
        h = hashed(i, j)
        found.append((h, i, j - i, 2 if h in seen else 1))
        seen.add(h)
    return found


def _short_spans(
    words: np.ndarray, total: np.ndarray, min_words: int, rare_words: int
) -> Iterator[tuple[int, int]]:
    """Runs with at least ``rare_words`` but fewer than ``min_words`` words."""
    spoken = np.flatnonzero(words).tolist()
    sums = total.tolist()
    for k, i in enumerate(spoken):
        for j in spoken[k:]:
            size = sums[j + 1] - sums[i]
            if size >= min_words:
                break
            if size >= rare_words:
                yield i, j + 1


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain that increases on both sides; ``pairs`` ascend on the first."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tails, b)
        if i == len(tails):
            tails.append(b)
            at.append(k)
        else:
            tails[i], at[i] = b, k
        back.append(at[i - 1] if i else -1)
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def patience(common: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Aligned (later line, earlier line) pairs out of all ``common`` pairs of equal runs.

    Anchors are pairs whose lines occur in no other pair; between two anchors the rest is
    aligned in the same way. Where nothing is unique, the longest increasing chain decides.
    """
    aligned: list[tuple[int, int]] = []
    todo = [sorted(common)]
    while todo:
        pairs = todo.pop()
        if not pairs:
            continue
        left: dict[int, int] = {}
        right: dict[int, int] = {}
        for a, b in pairs:
            left[a] = left.get(a, 0) + 1
            right[b] = right.get(b, 0) + 1
        unique = [p for p in pairs if left[p[0]] == 1 and right[p[1]] == 1]
        if not unique:
            aligned += increasing([(a, b) for a, b in _first_of_each(pairs)])
            continue
        chain = increasing(unique)
        aligned += chain
        if len(chain) == len(pairs):
            continue
        gaps: list[list[tuple[int, int]]] = [[] for _ in range(len(chain) + 1)]
        lefts, rights = [a for a, _ in chain], [b for _, b in chain]
        for a, b in pairs:
            gap = bisect_left(lefts, a)
            if gap == bisect_left(rights, b) and (gap == len(chain) or lefts[gap] != a):
                gaps[gap].append((a, b))
        todo += [g for g in gaps if g]
    return aligned


def _first_of_each(pairs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    seen = -1
    for a, b in pairs:
        if a != seen:
            seen = a
            yield a, b


def lines_to_delete(shared: Iterable[tuple[int, int, int, int]], moved: bool = True) -> set[int]:
    """Lines of one document, given (holder, line, lines, holder's line) of its common runs.

    Without ``moved`` only what the first alignment with each holder finds is deleted.
    """
    by_holder: dict[int, dict[tuple[int, int], int]] = {}
    for holder, line, count, there in shared:
        pairs = by_holder.setdefault(holder, {})
        pairs[line, there] = max(count, pairs.get((line, there), 0))
    deleted: set[int] = set()
    for _, runs in sorted(by_holder.items()):
        rest = list(runs)
        for round_ in range(ROUNDS if moved else 1):
            last = moved and round_ == ROUNDS - 1
            for pair in rest if last else patience(rest):
                deleted.update(range(pair[0], pair[0] + runs[pair]))
            rest = [p for p in rest if not deleted.issuperset(range(p[0], p[0] + runs[p]))]
            if not rest:
                break
    return deleted


def without(text: str, lines: set[int]) -> str:
    return "\n".join(s for i, s in enumerate(text.split("\n")) if i not in lines)


def common_runs(
    docs: DataFrame, min_words: int = MIN_WORDS, rare_words: int = RARE_WORDS,
    rare_docs: int = RARE_DOCS,
) -> DataFrame:
    """(doc, text_hash, shared): per later document its runs that an earlier one has."""

    @F.arrow_udf("array<struct<h:bigint,line:int,lines:int,kind:tinyint>>")
    def cut(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, kinds = ("h", "line", "lines", "kind"), (np.int64, np.int32, np.int32, np.int8)
        for texts in parts:
            found = [runs_of(t.as_py(), min_words, rare_words) for t in texts.cast(pa.binary())]
            flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 4)
            columns = [pa.array(flat[:, i].astype(k)) for i, k in enumerate(kinds)]
            values = pa.StructArray.from_arrays(columns, names)
            offsets = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            yield pa.ListArray.from_arrays(offsets, values)

    text = F.col("text").cast("string")
    runs = docs.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("doc"),
        F.xxhash64(text).alias("text_hash"),
        F.explode(cut(text)).alias("run"),
    ).select("doc", "text_hash", "run.*")
    first = (
        runs.groupBy("h")
        .agg(
            F.min(F.struct("doc", "line")).alias("first"),
            F.max("doc").alias("last"),
            F.max("kind").alias("kind"),
            F.count_if(F.col("kind") == 1).alias("docs"),
        )
        .where((F.col("last") > F.col("first.doc")) & ((F.col("kind") == 0) | (F.col("docs") <= rare_docs)))
        .select("h", F.col("first.doc").alias("holder"), F.col("first.line").alias("there"))
    )
    return (
        runs.join(first, "h")
        .where("doc > holder")
        .groupBy("doc", "text_hash")
        .agg(F.collect_set(F.struct("holder", "line", "lines", "there")).alias("shared"))
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, moved: bool = True,
                deleted: str | None = None, rare_words: int = RARE_WORDS,
                rare_docs: int = RARE_DOCS, least_left: float = 0.0) -> DataFrame:
    """``docs`` without the blocks that earlier documents have.

    ``deleted`` names an extra column with the numbers of the deleted lines. Without
    ``moved``, blocks that stand in another order than in the earlier document stay. A document
    that keeps less than ``least_left`` of its characters is dropped: what is left of a copy
    with a few edits is no document.
    """
    doc, text_hash, shared, edit = (
        free_name(docs, n) for n in ("order_id", "text_hash", "shared", "edit")
    )

    @F.arrow_udf("struct<text:string,lines:array<int>>")
    def edited(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("text", pa.string()), ("lines", pa.list_(pa.int32()))])
        for texts, common in parts:
            rows = []
            for text, runs in zip(texts, common):
                old, runs = text.as_py(), runs.as_py()
                if old is None or not runs:
                    rows.append({"text": None, "lines": []})
                    continue
                lines = lines_to_delete(
                    ((r["holder"], r["line"], r["lines"], r["there"]) for r in runs), moved
                )
                rows.append({"text": without(old, lines), "lines": sorted(lines)})
            yield pa.array(rows, kind)

    found = common_runs(docs, min_words, rare_words, rare_docs).select(
        F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("shared").alias(shared)
    )
    text = F.col("text").cast("string")
    rows = (
        docs.withColumn(doc, F.coalesce("doc_id", F.lit(LAST)))
        .withColumn(text_hash, F.xxhash64(text))
        .join(found, [doc, text_hash], "left")
    )
    # the text of a document without common runs does not go through Python
    given = F.when(F.col(shared).isNotNull(), text)
    # not called deterministic, else the filter below gets an evaluation of its own: texts edited
    # twice, by two workers per task
    rows = rows.withColumn(edit, edited.asNondeterministic()(given, F.col(shared)))
    new = {"text": F.coalesce(F.col(edit)["text"], text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(
            F.col(edit)["text"].isNotNull(), F.char_length(F.col(edit)["text"]).cast("long")
        ).otherwise(F.col("n_chars"))
    if deleted:
        new[deleted] = F.coalesce(F.col(edit)["lines"], F.array().cast("array<int>"))
    if least_left:
        left = F.char_length(F.col(edit)["text"]) >= least_left * F.char_length(text)
        rows = rows.where(F.col(edit)["text"].isNull() | left)
    return rows.withColumns(new).select(*docs.columns, *([deleted] if deleted else []))
