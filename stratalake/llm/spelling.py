"""Spelling variants: words one edit apart, by composition of finite-state machines.

The vocabulary's minimised acceptor is composed with a transducer that allows one inserted,
deleted or replaced code point, and with the acceptor again; what the composition accepts are
the near pairs. Before the edit both sides are in the same state, after it they are in two
states whose right languages are intersected. The edit is made at the first place where two
words differ, so each pair is accepted once. Words are numbered by the acceptor in sorted
order; pairs inside a state are found once, however many prefixes lead to it.

The composition is enumerated per initial state. The words with the first ``EDGE`` code points
in common are one partition; where more than ``LIMIT`` words share them, the state is replaced
by its successors, one code point further, until none is larger. What is left of a replaced
state, including the first ``EDGE``, are its transitions that make the edit there: behind them
both sides must be equal, so these pairs meet by equality of what stands before and behind the
edit, at most a word for each letter of the alphabet and one without.

A word's form is its near word of largest count (ties: the smaller word) if that is at least
``ratio`` times as frequent; the root is where the forms lead.

Defined results: null texts have no words, a null document id counts as empty text in the
choice of deletions; repeated documents count again; words without near words have none, no
form and are their own root; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratalake.scratch import written

EDGE = 3
LIMIT = 1 << 12
WORDS_PER_TASK = 1 << 14
RATIO = 10
RUN = r"[A-Za-z\u00C0-\u00FF]"
FOUND = "word string, n_near bigint, best struct<minus_n:bigint,word:string>"
TURN = (1 << 64) - 1


class State:
    """A state of the acceptor; once frozen it knows the words and near pairs behind it."""

    __slots__ = ("arcs", "final", "count", "lengths", "pairs", "total")

    def __init__(self):
        self.arcs: dict[str, tuple[State, int]] = {}  # the number of words before the arc's
        self.final = False

    def freeze(self, shared: dict) -> None:
        """Number the words; ``lengths`` has a bit for each of their lengths, modulo 64."""
        self.count, self.lengths = int(self.final), int(self.final)
        for symbol, (target, _) in self.arcs.items():
            self.arcs[symbol] = target, self.count
            self.count += target.count
            self.lengths |= (target.lengths << 1 | target.lengths >> 63) & TURN
        self.pairs = list(self._edits(shared))
        self.total = len(self.pairs) + sum(t.total for t, _ in self.arcs.values())

    def _edits(self, shared: dict) -> Iterator[tuple[int, int]]:
        """Numbers of the words that differ by an edit of the first symbol behind this state."""
        arcs = list(self.arcs.items())
        for k, (symbol, (target, before)) in enumerate(arcs):
            for _, (other, at) in arcs[k + 1 :]:
                for i, j in _common(target, other, shared):
                    yield before + i, at + j
            if target.final and self.final:
                yield before, 0
            for after, (longer, inside) in target.arcs.items():
                if after != symbol and after in self.arcs:
                    shorter, at = self.arcs[after]
                    for i, j in _common(longer, shorter, shared):
                        yield before + inside + i, at + j


def _common(s: State, t: State, shared: dict) -> list[tuple[int, int]]:
    """Numbers in both states of the words that both accept."""
    if not s.lengths & t.lengths:
        return []
    known = shared.get((s, t))
    if known is None:
        known, stack = [], [(s, t, 0, 0)]
        while stack:
            a, b, i, j = stack.pop()
            if a is b:
                known += [(i + k, j + k) for k in range(a.count)]
                continue
            if a.final and b.final:
                known.append((i, j))
            for symbol, (target, before) in a.arcs.items():
                if symbol in b.arcs:
                    other, at = b.arcs[symbol]
                    if target.lengths & other.lengths:
                        stack.append((target, other, i + before, j + at))
        shared[s, t] = known
    return known


def acceptor(words: list[str]) -> State:
    """The minimal acceptor of sorted, distinct words, built word by word."""
    register: dict[tuple, State] = {}
    shared: dict[tuple[State, State], list] = {}
    path, last = [State()], ""

    def settle(depth: int) -> None:
        """Freeze the states of the last word beyond ``depth``, or use equal ones."""
        while len(path) > depth + 1:
            state = path.pop()
            key = (state.final, *((c, id(t)) for c, (t, _) in state.arcs.items()))
            if key in register:
                state = register[key]
            else:
                state.freeze(shared)
                register[key] = state
            path[-1].arcs[last[len(path) - 1]] = state, 0

    for word in words:
        depth = 0
        while depth < min(len(word), len(last)) and word[depth] == last[depth]:
            depth += 1
        settle(depth)
        path += [State() for _ in word[depth:]]
        path[-1].final = True
        last = word
    settle(0)
    path[0].freeze(shared)
    return path[0]


def near_pairs(root: State) -> Iterator[tuple[int, int]]:
    """Numbers of all accepted words that are one edit apart, each pair once."""
    stack = [(root, 0)]
    while stack:
        state, first = stack.pop()
        for i, j in state.pairs:
            yield first + i, first + j
        stack += [(t, first + before) for t, before in state.arcs.values() if t.total]


def _composed(rows: list[tuple[str, int]], depth: int) -> pa.RecordBatch:
    """Near words of one partition's sorted (word, n), all with the same ``depth`` symbols."""
    counts: dict[int, int] = {}
    best: dict[int, tuple[int, int]] = {}
    for pair in near_pairs(acceptor([word[depth:] for word, _ in rows])):
        for mine, other in (pair, pair[::-1]):
            counts[mine] = counts.get(mine, 0) + 1
            rank = (-rows[other][1], other)
            if mine not in best or rank < best[mine]:
                best[mine] = rank
    mine = list(counts)
    structs = pa.StructArray.from_arrays(
        [
            pa.array([best[i][0] for i in mine], pa.int64()),
            pa.array([rows[best[i][1]][0] for i in mine], pa.string()),
        ],
        ["minus_n", "word"],
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][0] for i in mine], pa.string()),
            pa.array([counts[i] for i in mine], pa.int64()),
            structs,
        ],
        ["word", "n_near", "best"],
    )


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by partition and word."""
    prefix, held = None, []
    for batch in batches:
        for start, word, n in zip(*(batch[c].to_pylist() for c in ("prefix", "word", "n"))):
            if start != prefix:
                if len(held) > 1:
                    yield _composed(held, len(prefix))
                prefix, held = start, []
            held.append((word, n))
    if len(held) > 1:
        yield _composed(held, len(prefix))


def _partitions(words: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(prefix, word, n) with at most ``LIMIT`` words a prefix, and the words split at each depth."""
    whole, split = [], []
    rest, depth = words, EDGE
    while True:
        rest = rest.withColumn("prefix", F.substring("word", 1, depth))
        sizes = rest.groupBy("prefix").agg(F.count("*").alias("size")).where(F.col("size") > LIMIT)
        hot = written(sizes.select("prefix"), "hot_prefixes")
        if hot.isEmpty():
            return _union([*whole, rest]).select("prefix", "word", "n"), split
        whole.append(rest.join(hot, "prefix", "left_anti"))
        rest = rest.join(hot, "prefix", "left_semi").select("word", "n")
        split.append(rest.withColumn("depth", F.lit(depth)))
        depth += 1


def _union(parts: list[DataFrame]) -> DataFrame:
    first, *others = parts
    for other in others:
        first = first.unionByName(other)
    return first


def _split_pairs(words: DataFrame) -> DataFrame:
    """Near words by edits at the place ``depth`` of (word, n, depth)."""
    d, word = F.col("depth"), F.col("word")
    before = F.substring(word, F.lit(1), d)
    symbol = F.substring(word, d + 1, F.lit(1))
    behind = lambda skipped: F.substring(word, d + 1 + skipped, F.length(word))

    def row(skipped: int) -> Column:
        key = F.concat(before, F.lit("\x00"), behind(skipped))
        return F.struct(key.alias("key"), F.lit(bool(skipped)).alias("gap"), symbol.alias("symbol"))

    met = (
        words.where(F.length("word") >= d)
        .select("word", "n", F.explode(F.array(row(0), row(1))).alias("r"))
        .where("r.symbol <> '' OR NOT r.gap")
        .groupBy("r.key")
        .agg(F.collect_list(F.struct("word", "n", "r.gap", "r.symbol")).alias("g"))
        .where(F.size("g") > 1)
    )
    near = F.filter(
        "g",
        lambda o: (F.col("u.gap") | o["gap"]) & (F.col("u.symbol") != o["symbol"]),
    )
    rows = met.select("g", F.explode("g").alias("u")).select("u.word", near.alias("near"))
    return rows.where(F.size("near") > 0).select(
        "word",
        F.size("near").cast("long").alias("n_near"),
        F.array_min(F.transform("near", lambda o: F.struct((-o["n"]).alias("minus_n"), o["word"].alias("word")))).alias("best"),
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): ``words`` are distinct (word, n), best has -n and the word."""
    words = written(words, "vocabulary")
    tasks = 1 + words.count() // WORDS_PER_TASK
    partitions, split = _partitions(words)
    edges = words.withColumn("depth", F.explode(F.array(*map(F.lit, range(EDGE)))))
    composed = (
        partitions.repartition(tasks, "prefix")
        .sortWithinPartitions("prefix", "word")
        .mapInArrow(_compose, FOUND)
    )
    found = composed.unionByName(_split_pairs(_union([edges, *split])))
    none = F.lit(None).cast("struct<minus_n:bigint,word:string>")
    return (
        words.withColumns({"n_near": F.lit(0).cast("long"), "best": none})
        .unionByName(found.withColumn("n", F.lit(None).cast("long")))
        .groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each round doubles the steps made along the forms."""
    steps = forms.select("word", F.col("form").alias("root"))
    while True:
        steps = written(steps, "roots")
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = steps.join(onward, "root", "left")
        if further.where("beyond IS NOT NULL").isEmpty():
            return steps
        steps = further.select("word", F.coalesce("beyond", "root").alias("root"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n)."""
    is_form = -F.col("best.minus_n") >= ratio * F.col("n")
    rows = written(
        near_words(words).select(
            "word", "n", "n_near",
            F.when(is_form, F.col("best.word")).alias("form"),
            F.when(is_form, -F.col("best.minus_n")).alias("form_n"),
        ),
        "forms",
    )
    followed = roots(rows.where("form IS NOT NULL"))
    return rows.join(followed, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def word_counts(docs: DataFrame, least_chars: int = 7, least_n: int = 2, spoil: int = 31) -> DataFrame:
    """(word, n) over whole texts; about one run in ``spoil`` loses a code point, by its crc32."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_chars},}}"), F.lit(0))
    runs = docs.select("doc_id", F.explode(found).alias("run")).select(
        F.translate("run", upper, upper.lower()).alias("run"),
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"),
    )
    place = F.col("h") % F.length("run")
    shorter = F.overlay("run", F.lit(""), (place + 1).cast("int"), F.lit(1))
    return (
        runs.withColumn("h", F.crc32(F.concat("id", "run").cast("binary")))
        .select(F.when(F.col("h") % spoil == 0, shorter).otherwise(F.col("run")).alias("word"))
        .where(F.length("word") >= least_chars)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_n)
    )


def report(docs: DataFrame) -> DataFrame:
    return variants(word_counts(docs))
