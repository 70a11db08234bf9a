"""Toxicity: class-conditional Kneser-Ney models compared word by word.

Words and word pairs of all labelled training texts are counted per class (toxic and
ordinary). Both models share what lies below the counts: a word's backoff probability is
its number of distinct left neighbours over both classes, and the mass given to backoff is
the same for both. So an expression that neither class has seen says nothing, and a rare
one says little. With counts n, a discount D and backoff masses b,

    P_c(w)     = (1 - b1) max(n_c(w) - D, 0) / Z_c + b1 N(.w) / N(..)
    P_c(w | u) = (1 - b2) max(n_c(u w) - D, 0) / n_c(u) + b2 P_c(w)

n counts the texts that have an expression, not its repetitions within one. No expression is
left out: one that both classes have D times at most has the ratio of its backoff, which is 1
for a word and the word's own for a pair, so the table of ratios needs only the others. Words
are known by 48 bits of their XXH64; among ten million fewer than one pair is equal.

A text's evidence is the log-likelihood ratio of its words, each given the word before:
the mean over the text, the highest mean of ``STRETCHES`` words, the highest word and the mean
of the three highest, and the length's order of magnitude; a word that comes again within the longest stretch is
no new evidence. A logistic curve turns this into a score. The curve and the discount, one of
``DISCOUNTS``, are fitted on about ``FIT_ROWS`` labelled training rows of fold ``FIT_FOLD``
at most, whose evidence comes from counts without them; the counts behind the scores are those
of all labelled training rows. Both come from one shuffle, which says of each count how much
of it is the fit's; as a pair of hashes is most of it, the counts travel as packed blocks.

The table of ratios grows with the corpus. It is broadcast as sorted arrays of at most
``PART_ROWS`` rows; a task holds one of them at a time and passes each of its batches by all.

Defined results: null, empty and wordless texts have no evidence and get the score of none;
contradicting labels go by majority, ties to toxic; without labels of both classes every
score is 0; repeated rows are scored each; other columns are passed through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from stratalake.llm.common import fold, free_name, kept, one_label
from stratalake.scratch import written

WORD = re.compile(r"\w+")
FOLDS = 5
FIT_FOLD = 1
FIT_ROWS = 20_000
DISCOUNTS = (2.0, 3.0, 4.0)
STRETCHES = (24, 6)
TOP = 3
FEATURES = 4 + len(STRETCHES)
RIDGE = 1.0
PART_ROWS = 4_000_000
LABEL_ROWS = 8_000_000  # labels are broadcast up to here, else joined by shuffle
CHUNK_TEXTS = 8_000  # texts and words that a task counts at once
CHUNK_WORDS = 300_000
SCORED_WORDS = 80_000  # words that a task scores at once
COMPACT_ROWS = 1_000_000  # rows that a gathering task adds before it sums them
PARTS_PER_TASK = 4
SALTS = 8
MEMO = 60_000  # hashes of words that a task keeps
HASH = (1 << 48) - 1
ALONE = -1  # the left neighbour of a word on its own
CLASSES = ("t", "o")  # toxic, ordinary
COUNTS = ("t", "o", "ft", "fo")  # texts of the classes, and those of them that are in the fit


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def short_hash(word: str) -> int:
    """48 bits of XXH64."""
    return xxhash.xxh64_intdigest(word, seed=42) & HASH


EMPTY = short_hash("")  # the left neighbour of a text's first word


def pair_key(u, w):
    """One number for a pair of words; numbers below 2**48 are words on their own."""
    return (u << 16) ^ w


def pair_key_column(u: str, w: str) -> Column:
    return F.shiftleft(u, 16).bitwiseXOR(F.col(w))


class Hasher:
    """Texts as hashes of their words."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, left neighbour) of all texts one after another, and the texts' lengths."""
        words = [words_of(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = set(chain.from_iterable(words)) - self.memo.keys()
        self.memo.update((w, short_hash(w)) for w in new)
        sizes = np.array(list(map(len, words)), np.int64)
        flat = chain.from_iterable(words)
        w = np.fromiter(map(self.memo.__getitem__, flat), np.int64, int(sizes.sum()))
        u = np.empty_like(w)
        u[1:] = w[:-1]
        u[(np.cumsum(sizes) - sizes)[sizes > 0]] = EMPTY
        return w, u, sizes


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, fit) of the training rows; fold 0 is never among them. ``fit`` marks the
    rows of the curve."""
    marks = written(one_label(labels.where(fold("doc_id", FOLDS) != 0), "toxic"), "labels")
    in_fold = fold("doc_id", FOLDS) == FIT_FOLD
    sizes = marks.agg(F.count("*").alias("all"), F.count_if(in_fold).alias("fold")).first()
    share = min(1.0, FIT_ROWS / max(1, sizes["fold"]))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))
    marks = marks.withColumn("fit", in_fold & place)
    if sizes["all"] <= LABEL_ROWS:
        marks = F.broadcast(marks)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(marks, "doc_id").select("text", "toxic", "fit")


def _counted(words: tuple[np.ndarray, ...], toxic: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, ...]:
    """(w, u, n) of some texts: n has the four counts of a pair, or a word alone, 16 bits each."""
    w, u, sizes = words
    text = np.repeat(np.arange(len(sizes)), sizes)
    w, u, text = np.tile(w, 2), np.concatenate([u, np.full_like(u, ALONE)]), np.tile(text, 2)
    key = pair_key(w, u)
    order = np.argsort(key, kind="stable")  # texts stay in order within a key
    w, u, text, key = w[order], u[order], text[order], key[order]
    new_key = np.diff(key, prepend=~key[:1]) != 0
    once = new_key | (np.diff(text, prepend=-1) != 0)
    w, u, text, new_key = w[once], u[once], text[once], new_key[once]
    one = np.where(toxic, 1, 1 << 16).astype(np.int64)
    one += np.where(fit, one << 32, 0)
    first = np.flatnonzero(new_key)
    n = np.add.reduceat(one[text], first) if len(first) else np.array([], np.int64)
    return w[first], u[first], n


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: what hardly varies compresses to nothing."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def packed(w: np.ndarray, u: np.ndarray, n: np.ndarray) -> bytes:
    """Rows in the order of the words, about seven bytes each."""
    raw = _planes(np.diff(w, prepend=0)) + _planes(u) + _planes(n)
    return pa.compress(raw, codec="zstd", asbytes=True) + len(raw).to_bytes(8, "little")


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int.from_bytes(block[-8:], "little")
    raw = np.frombuffer(pa.decompress(block[:-8], size, codec="zstd"), np.uint8)
    planes = np.ascontiguousarray(raw.reshape(3, 8, -1).transpose(0, 2, 1)).view("<i8")[..., 0]
    return np.cumsum(planes[0]), planes[1], planes[2]


def blocks(rows: DataFrame) -> DataFrame:
    """(part, block): partial counts of (text, toxic, fit), split by word; the pairs of a word
    are split by their left neighbour, so that hot words come in ``SALTS`` parts.

    Counted per text, since a word that one text repeats is no evidence about others. The
    first word of a text has the left neighbour ""; u is ``ALONE`` for the word on its own.
    """
    parts = PARTS_PER_TASK * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = kept("toxicity", Hasher)
        for batch in batches:
            toxic = np.array(batch["toxic"].to_pylist(), bool)
            fit = np.array(batch["fit"].to_pylist(), bool)
            for start, end in _chunks(batch["text"], CHUNK_WORDS):
                words = hasher(batch["text"][start:end].to_pylist())
                w, u, n = _counted(words, toxic[start:end], fit[start:end])
                part = (w * SALTS + u % SALTS) % parts
                order = np.lexsort((u, w, part))
                w, u, n, part = w[order], u[order], n[order], part[order]
                edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
                spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[edges[:-1]].astype(np.int32)),
                        pa.array([packed(w[i:j], u[i:j], n[i:j]) for i, j in spans], pa.binary()),
                    ],
                    ["part", "block"],
                )

    return rows.select("text", "toxic", "fit").mapInArrow(count, "part int, block binary")


def _chunks(texts: pa.Array, words: int) -> Iterator[tuple[int, int]]:
    """Texts of a batch in stretches of so many words, about."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False) // 6
    start, held = 0, 0
    for end, size in enumerate(sizes.tolist(), 1):
        held += size
        if end == len(texts) or held > words or end - start >= CHUNK_TEXTS:
            yield start, end
            start, held = end, 0


def _summed(w: np.ndarray, u: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows in the order of (w, u), equal ones added up."""
    order = np.lexsort((u, w))
    w, u, counts = w[order], u[order], counts[order]
    first = np.flatnonzero((np.diff(w, prepend=~w[:1]) != 0) | (np.diff(u, prepend=~u[:1]) != 0))
    return w[first], u[first], np.add.reduceat(counts, first, axis=0)


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """(w, u, counts) of all blocks of a task; held compact, as in any aggregation."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        for block in batch["block"]:
            w, u, n = unpacked(block.as_py())
            counts = np.stack([n >> 16 * i & 0xFFFF for i in range(len(COUNTS))], axis=1).astype(np.int32)
            held.append((w, u, counts))
            size += len(w)
            if size > COMPACT_ROWS:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = 0
    return _summed(*map(np.concatenate, zip(*held))) if held else None


def pair_counts(rows: DataFrame) -> DataFrame:
    """(w, u, t, o, ft, fo): in how many texts of each class a pair u w occurs, and in how many
    of those that are in the fit."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _gathered(batches)) is not None:
            w, u, counts = found
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (w, u, *counts.T)], ["w", "u", *COUNTS])

    return _dealt(rows).mapInArrow(merged, "w bigint, u bigint, t bigint, o bigint, ft bigint, fo bigint")


def _dealt(rows: DataFrame) -> DataFrame:
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks(rows).repartition(tasks, "part")


TABLE = ["types", "ftypes", *COUNTS, *(f"p{c}" for c in COUNTS)]


def _table(rows: DataFrame, least: float) -> DataFrame:
    """Rows (w, u null) of words, partly summed: distinct left neighbours, the counts of the
    word alone, and the sums over its pairs; and a row (w, u) for each pair that one class has
    more than ``least`` times, with its counts as those sums."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _gathered(batches)) is None:
            return
        w, u, counts = found
        pair = u != ALONE
        rest = counts[:, 0] + counts[:, 1] > counts[:, 2] + counts[:, 3]
        columns = [pair, pair & rest, *(counts * ~pair[:, None]).T, *(counts * pair[:, None]).T]
        first = np.flatnonzero(np.diff(w, prepend=~w[:1]) != 0)
        sums = [np.add.reduceat(c.astype(np.int64), first) for c in columns]
        entry = np.flatnonzero(pair & (counts[:, :2].max(axis=1) > least))
        none = np.zeros(len(entry), np.int64)
        own = [none] * (2 + len(COUNTS)) + list(counts[entry].astype(np.int64).T)
        names = ["w", "u", *TABLE]
        number = pa.int64()
        yield pa.RecordBatch.from_arrays(
            [pa.array(w[first]), pa.nulls(len(first), number), *map(pa.array, sums)], names
        )
        yield pa.RecordBatch.from_arrays([pa.array(w[entry]), pa.array(u[entry]), *map(pa.array, own)], names)

    return _dealt(rows).mapInArrow(merged, ", ".join(f"{c} bigint" for c in ("w", "u", *TABLE)))


class Model:
    """Counts of all training rows, and with them those without the rows of the fit.

    ``pairs`` (w, u, counts) has the pairs that one class has more than ``least`` times,
    ``words`` (w, counts, types) all words; ``sums`` are over both.
    """

    def __init__(self, rows: DataFrame, discounts: Sequence[float] = DISCOUNTS):
        self.discounts = tuple(discounts)
        table = written(_table(rows, min(self.discounts)), "expressions")
        counts = [f"p{c}" for c in COUNTS]
        self.pairs = table.where("u IS NOT NULL").select("w", "u", *counts)
        self.words = written(
            table.where("u IS NULL").groupBy("w").agg(*[F.sum(c).alias(c) for c in TABLE]), "words"
        )
        self.sums = self.words.agg(
            *[F.sum(c).alias(c) for c in TABLE], *self._above("")
        ).first().asDict() | self.pairs.agg(*self._above("p")).first().asDict()

    def _above(self, prefix: str) -> list[Column]:
        """Sums of what is above each discount, for each class, of all and of the rest."""
        return [
            F.sum(F.greatest(self._n(f"{prefix}{c}", whole) - d, F.lit(0.0))).alias(f"{prefix}{c}{d}{whole}")
            for c in CLASSES
            for d in self.discounts
            for whole in (True, False)
        ]

    @staticmethod
    def _n(name: str, whole: bool) -> Column:
        """A count of all rows, or of those that are not in the fit."""
        if whole:
            return F.col(name)
        return F.col(name) - F.col(f"{name[:-1]}f{name[-1]}")

    def _total(self, name: str, whole: bool) -> float:
        s = self.sums
        return float((s[name] or 0) - (0 if whole else s[f"{name[:-1]}f{name[-1]}"] or 0))

    def has_both(self, whole: bool) -> bool:
        return all(self._total(c, whole) > 0 for c in CLASSES)

    def masses(self, discount: float, whole: bool) -> tuple[float, float]:
        """(b1, b2): the larger share that the discount takes from either class."""

        def taken(prefix: str) -> float:
            shares = [
                1 - (self.sums[f"{prefix}{c}{discount}{whole}"] or 0.0) / max(self._total(prefix + c, whole), 1.0)
                for c in CLASSES
            ]
            return min(0.95, max(shares))

        return taken(""), taken("p")

    def ratios(self, discounts: Sequence[float], whole: bool) -> DataFrame:
        """(key, r0, r1, ...): log ratios by each discount of the expressions that have one;
        of words under their hash, of pairs under ``pair_key``."""
        types = F.col("types") if whole else F.col("ftypes")
        all_types = max(1.0, float((self.sums["types" if whole else "ftypes"]) or 0))
        own = {c: self._n(c, whole) for c in CLASSES}
        low = min(discounts)

        def above(n: Column, d: float) -> Column:
            return F.greatest(n - F.lit(d), F.lit(0.0))

        def p1(c: str, d: float) -> Column:
            b1, _ = self.masses(d, whole)
            z = max(self.sums[f"{c}{d}{whole}"] or 0.0, 1e-9)
            return (1 - b1) * above(own[c], d) / z + b1 * types / all_types

        known = self.words.select(
            "w", *[own[c].alias(c) for c in CLASSES],
            *[p1(c, d).alias(f"{c}{i}") for c in CLASSES for i, d in enumerate(discounts)],
        )
        of_word = [
            F.when(F.greatest("t", "o") > d, F.log(F.col(f"t{i}") / F.col(f"o{i}"))).otherwise(0.0)
            for i, d in enumerate(discounts)
        ]
        names = [f"r{i}" for i in range(len(discounts))]
        single = known.where(F.greatest("t", "o") > low).select(
            F.col("w").alias("key"), *[r.alias(n) for r, n in zip(of_word, names)]
        )
        entries = self.pairs.select("w", "u", *[self._n(f"p{c}", whole).alias(f"p{c}") for c in CLASSES])
        entries = entries.where(F.greatest("pt", "po") > low)
        left = known.select(F.col("w").alias("u"), F.col("t").alias("ut"), F.col("o").alias("uo"))

        def p2(c: str, i: int, d: float) -> Column:
            _, b2 = self.masses(d, whole)
            own = above(F.col(f"p{c}"), d) / F.greatest(F.col(f"u{c}"), F.lit(1))
            return (1 - b2) * own + b2 * F.col(f"{c}{i}")

        of_pair = [
            F.when(F.greatest("pt", "po") > d, F.log(p2("t", i, d) / p2("o", i, d))).otherwise(of_word[i])
            for i, d in enumerate(discounts)
        ]
        double = (
            entries.join(known, "w")
            .join(left, "u")  # and without the pairs at the start of a text
            .select(pair_key_column("u", "w").alias("key"), *[r.alias(n) for r, n in zip(of_pair, names)])
        )
        return written(single.unionByName(double), "ratios")


def _parts(table: DataFrame) -> list[Broadcast]:
    """The table of ratios as sorted arrays of at most about ``PART_ROWS`` rows."""
    spark = table.sparkSession
    parts = max(1, math.ceil(table.count() / PART_ROWS))
    shared = []
    for part in range(parts):
        rows = table.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).toArrow()
        key = rows["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        ratios = [rows[n].to_numpy().astype(np.float32)[order] for n in rows.column_names[1:]]
        shared.append(spark.sparkContext.broadcast((key[order], np.array(ratios))))
    return shared


def looked_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` that the table has, and their ratios by each discount."""
    known, ratios = table
    if not len(known) or not len(keys):
        return np.array([], np.int64), np.empty((len(ratios), 0), np.float32)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    found = np.flatnonzero(known[at] == keys)
    return found, ratios[:, at[found]]


def word_ratios(w: np.ndarray, u: np.ndarray, tables: Iterator, discounts: int) -> np.ndarray:
    """Log ratio of every word given its left neighbour, by each discount."""
    distinct, place = np.unique(w, return_inverse=True)
    single = np.zeros((discounts, len(distinct)), np.float32)
    line, has_pair = np.zeros((discounts, len(w)), np.float32), np.zeros(len(w), bool)
    keys = pair_key(u, w)
    for table in tables:
        found, ratios = looked_up(distinct, table)
        single[:, found] = ratios
        found, ratios = looked_up(keys, table)
        line[:, found], has_pair[found] = ratios, True
    return np.where(has_pair, line, single[:, place])


def repeated(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words that the same text has among the ``STRETCHES[0]`` words before."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(w, kind="stable")
    near = np.diff(order, prepend=-STRETCHES[0]) < STRETCHES[0]
    near &= (np.diff(w[order], prepend=-2) == 0) & (np.diff(text[order], prepend=-1) == 0)
    again = np.zeros(len(w), bool)
    again[order] = near
    return again


def features(line: np.ndarray) -> list[float]:
    """Evidence of one text from its words' ratios."""
    n = len(line)
    if not n:
        return [0.0] * FEATURES
    total = np.concatenate([[0.0], np.cumsum(line, dtype=np.float64)])
    peaks = [float((total[k:] - total[:-k]).max() / k) for k in (min(s, n) for s in STRETCHES)]
    top = np.sort(np.partition(line, n - TOP)[-TOP:] if n > TOP else line)[::-1]
    return [float(total[-1] / n), *peaks, float(top[0]), float(top.mean()), float(int(math.log10(n)))]


def evidence(docs: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """``docs`` with an array of the features by each discount that the table has."""
    parts, discounts = _parts(table), len(table.columns) - 1

    def tables() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in parts:
            yield part.value
            if len(parts) > 1:
                part.__dict__.pop("_value", None)  # one at a time

    @F.arrow_udf("array<double>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = kept("toxicity", Hasher)
        for texts in batches:
            rows = []
            for start, end in _chunks(texts, SCORED_WORDS):
                w, u, sizes = hasher(texts[start:end].to_pylist())
                lines = word_ratios(w, u, tables(), discounts)
                lines[:, repeated(w, sizes)] = 0
                own = [
                    list(chain.from_iterable(features(line[stop - size : stop]) for line in lines))
                    for stop, size in zip(np.cumsum(sizes).tolist(), sizes.tolist())
                ]
                rows.append(pa.array(own, pa.list_(pa.float64())))
            yield pa.concat_arrays(rows) if rows else pa.array([], pa.list_(pa.float64()))

    return docs.withColumn(name, found(F.col("text").cast("string")))


def fit_curve(points: np.ndarray, labels: np.ndarray, ridge: float = RIDGE) -> list[float]:
    """Weights (bias, one per feature) of a logistic curve, by Newton's method; the ridge is
    on features of unit spread."""
    middle, spread = points.mean(axis=0), np.maximum(points.std(axis=0), 1e-9)
    x = np.column_stack([np.ones(len(points)), (points - middle) / spread])
    w, pull = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * points.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - labels) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / spread
    return [float(w[0] - weights @ middle), *weights.tolist()]


def log_loss(weights: Sequence[float], points: np.ndarray, labels: np.ndarray) -> float:
    z = np.clip(weights[0] + points @ np.array(weights[1:]), -30, 30)
    return float(np.mean(np.log1p(np.exp(np.where(labels == 1, -z, z)))))


def choose(points: np.ndarray, labels: np.ndarray, discounts: int, halves: int = 4) -> int:
    """The discount whose curve does best on rows it was not fitted on."""
    part = np.arange(len(labels)) % halves
    losses = []
    for i in range(discounts):
        x = points[:, i * FEATURES : (i + 1) * FEATURES]
        losses.append(
            sum(log_loss(fit_curve(x[part != h], labels[part != h]), x[part == h], labels[part == h]) for h in range(halves))
        )
    return int(np.argmin(losses))


def _curve(rows: DataFrame, model: Model) -> tuple[float, list[float]]:
    """(discount, weights), fitted on rows that the counts behind their own evidence leave out."""
    middle = model.discounts[len(model.discounts) // 2]
    default = middle, [-3.0, 1.0, 1.0, 0.5, 0.0, 0.0, 0.0]
    if not model.has_both(whole=False):
        return default
    table = model.ratios(model.discounts, whole=False)
    fit = evidence(rows.where("fit"), table, "evidence").select("evidence", "toxic")
    found = sorted((r.evidence, r.toxic) for r in fit.collect())  # FIT_ROWS of them, about
    labels = np.array([t for _, t in found])
    if len(set(labels.tolist())) < 2 or len(labels) < 2 * FEATURES:
        return default
    order = np.random.default_rng(5).permutation(len(found))
    points, labels = np.array([e for e, _ in found])[order], labels[order]
    best = choose(points, labels, len(model.discounts))
    return model.discounts[best], fit_curve(points[:, best * FEATURES : (best + 1) * FEATURES], labels)


def score(docs: DataFrame, training: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, learned from the labelled rows of ``training``."""
    rows = labelled(training, labels)
    model = Model(rows)
    if not model.has_both(whole=True):
        return docs.withColumn(name, F.lit(0.0))
    discount, (bias, *weights) = _curve(rows, model)
    part = free_name(docs, "evidence")
    scored = evidence(docs, model.ratios([discount], whole=True), part)
    z = F.lit(bias)
    for i, weight in enumerate(weights):
        z = z + F.lit(weight) * F.col(part)[i]
    return scored.withColumn(name, 1 / (1 + F.exp(-z))).drop(part)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = docs.select("doc_id", "text")
    scored = score(docs, docs, labels)
    return scored.select(
        "doc_id",
        (fold("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def clean_documents(docs: DataFrame, training: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not predicted toxic, with the columns of ``docs``."""
    name = free_name(docs, "score")
    return score(docs, training, labels, name).where(F.col(name) < 0.5).drop(name)
