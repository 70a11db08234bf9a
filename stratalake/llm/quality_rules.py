"""Quality rules with thresholds that adapt to language and source.

Word, symbol, line and repetition counts of a text are array and string functions; no row
leaves the JVM. For each (lang, source) two KLL quantile sketches of each measure are kept,
of all values and of those above zero; the sketches of a language are merged into one for the
language, those into one for all. A quantile of a language with n values is
n / (n + PRIOR) parts its own and for the rest that of all, and a quantile of a group is mixed
with its language's in the same way, so small groups lean on larger ones without a switch.
A text is rejected if a measure lies beyond

    word length:    the quartiles, by more than FENCE interquartile ranges
    other shares:   q90 + FENCE x interquartile range + RARE x median of the values above zero

of its group. Where most texts lack a trait, the quantiles are zero, and the last term says
how strong the trait is in the texts that have it: it lets ordinary exceptions pass.
The thresholds are a small table joined with the
counts, by broadcast up to ``BROADCAST_GROUPS`` groups, else by shuffle.

Two windows are taken as equal if their 64-bit hashes are.

Defined results: null and empty texts have no words and fail the base rules; null lang
and source are groups of their own; rows of base-failed texts do not shape thresholds;
repeated rows count each; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratalake.scratch import written

# The contract's base rules.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

FENCE = 4.0
PRIOR = 50
SKETCH_K = 400
BROADCAST_GROUPS = 100_000

WORD_LENGTH = "word_length"
# share -> RARE, how many medians of the values above zero an exception may have
SHARES = {"symbol_share": 0.1, "dup_line_share": 4.0, "repeat_share": 4.5}
MEASURES = (WORD_LENGTH, *SHARES)
QUANTILES = {"q25": 0.25, "q75": 0.75, "q90": 0.9}
REPORT = [
    "doc_id",
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
]
_SPACE = r"[\x20\x09-\x0D]+"


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.array_remove(F.split("text", _SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (
            F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))
        ).alias("n_symbols"),
    )
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > WINDOW, hashes).alias("hashes"),
    )
    # Only texts in which some window recurs go on to the sort.
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.array_sort(
        F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    rows = rows.withColumn("placed", F.when(some, placed)).drop("hashes")
    same = lambda x, j: (
        F.coalesce(F.get("placed", j - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("placed", j + 1)["h"] == x["h"], F.lit(False))
    )
    again = F.array_sort(F.transform(F.filter("placed", same), lambda x: x["i"]))
    rows = rows.withColumn("again", F.when(F.col("placed").isNotNull(), again)).drop("placed")
    covered = F.aggregate(
        F.transform(
            "again",
            lambda p, k: F.least(
                F.lit(WINDOW), F.coalesce(F.get("again", k + 1) - p, F.lit(WINDOW))
            ),
        ),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return rows.withColumn(
        "n_repeat_words", F.when(F.col("again").isNotNull(), covered).otherwise(0).cast("long")
    ).drop("again")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def measures(rows: DataFrame) -> DataFrame:
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.withColumns(
        {
            "word_length": part("word_chars", "n_words"),
            "symbol_share": part("n_symbols", "word_chars"),
            "dup_line_share": part("n_dup_lines", "n_lines"),
            "repeat_share": part("n_repeat_words", "n_words"),
        }
    )


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, n, and per measure a mergeable sketch of all values, of those above zero
    (``_some``), and their number."""
    own = {m: F.col(m).cast("double") for m in MEASURES}
    return rows.groupBy("lang", "source").agg(
        F.count("*").alias("n"),
        *(F.kll_sketch_agg_double(v, SKETCH_K).alias(m) for m, v in own.items()),
        *(F.kll_sketch_agg_double(F.when(v > 0, v), SKETCH_K).alias(f"{m}_some") for m, v in own.items()),
        *(F.count_if(v > 0).alias(f"{m}_n") for m, v in own.items()),
    )


def _merged(table: DataFrame, *keys: str) -> DataFrame:
    return table.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *(F.kll_merge_agg_double(f"{m}{s}", SKETCH_K).alias(f"{m}{s}") for m in MEASURES for s in ("", "_some")),
        *(F.sum(f"{m}_n").alias(f"{m}_n") for m in MEASURES),
    )


def _quantiles(table: DataFrame) -> DataFrame:
    """The table's quantiles in place of its sketches, ``mid`` being that of the values above
    zero, and the number of values behind each."""

    def of(m: str, name: str) -> Column:
        if name == "mid":
            found = F.kll_sketch_get_quantile_double(f"{m}_some", F.lit(0.5))
            return F.when(F.col(f"{m}_n") > 0, found).otherwise(0.0).cast("double")
        return F.kll_sketch_get_quantile_double(m, F.lit(QUANTILES[name])).cast("double")

    keys = [c for c in ("lang", "source") if c in table.columns]
    values = [of(m, q).alias(f"{m}_{q}") for m in MEASURES for q in (*QUANTILES, "mid")]
    return table.select(*keys, "n", *[f"{m}_n" for m in MEASURES], *values)


def _mixed(rows: DataFrame, above: dict[str, Column]) -> DataFrame:
    """Quantiles drawn towards those of the larger group they belong to."""
    new = {}
    for m in MEASURES:
        for q in (*QUANTILES, "mid"):
            name = f"{m}_{q}"
            n = F.col(f"{m}_n") if q == "mid" else F.col("n")
            share = n / (n + F.lit(float(PRIOR)))
            new[name] = share * F.col(name) + (1 - share) * above[name]
    return rows.withColumns(new)


def thresholds(own: DataFrame) -> DataFrame:
    """lang, source and the fences that hold there, from the group's sketches ``own``."""
    by_lang = _merged(own, "lang")
    of_all = _quantiles(_merged(by_lang)).first().asDict()  # one row of numbers
    of_lang = _mixed(_quantiles(by_lang), {k: F.lit(v).cast("double") for k, v in of_all.items()})
    names = [c for c in of_lang.columns if c != "lang"]
    of_lang = of_lang.select(F.col("lang").alias("of_lang"), *[F.col(c).alias(f"{c}_above") for c in names])
    rows = _quantiles(own).join(of_lang, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    rows = _mixed(rows, {c: F.col(f"{c}_above") for c in names})
    q = lambda m, name: F.col(f"{m}_{name}")
    spread = {m: FENCE * (q(m, "q75") - q(m, "q25")) for m in MEASURES}
    return rows.select(
        "lang",
        "source",
        (q(WORD_LENGTH, "q25") - spread[WORD_LENGTH]).alias(f"{WORD_LENGTH}_low"),
        (q(WORD_LENGTH, "q75") + spread[WORD_LENGTH]).alias(f"{WORD_LENGTH}_high"),
        *((q(m, "q90") + spread[m] + rare * q(m, "mid")).alias(f"{m}_high") for m, rare in SHARES.items()),
    )


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    rows = written(counts(docs), "counts")
    rows = measures(rows.withColumn("base_failed", base_failed()))
    own = written(sketches(rows.where(~F.col("base_failed"))), "sketches")
    if own.isEmpty():
        return rows.select(*REPORT, F.lit(False).alias("kept"))  # every row failed the base rules
    fences = thresholds(own).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    if own.count() <= BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    here = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(
        F.col("of_source")
    )
    outside = F.coalesce(F.col(WORD_LENGTH) < F.col(f"{WORD_LENGTH}_low"), F.lit(False))
    for m in MEASURES:
        outside = outside | F.coalesce(F.col(m) > F.col(f"{m}_high"), F.lit(False))
    return rows.join(fences, here, "left").select(
        *REPORT, (~F.col("base_failed") & ~outside).alias("kept")
    )
