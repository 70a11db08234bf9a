"""Secret scan: candidates of secrets judged by a random forest; no row leaves the JVM.

Candidates are runs of ``MIN_CHARS`` or more letters, digits and ``+/_-=`` with a digit in them,
taken with the words before and after. Each is described by its length, its transitions
between kinds of characters, the share of its letters that belong to words of the corpus
(dictionary coverage), signs of a path around it, and its neighbouring words. A random
forest fitted on labelled findings tells secrets from false positives; it is compiled to
a column expression.

Where no labelled findings are given, ``seed_labels`` marks the clear cases: a candidate that
a credential word is assigned to, without a placeholder word near, is a secret; numbers
only, and candidates without any credential word within reach, are not. All others are
left to the forest, which is fitted on ``FIT_ROWS`` labelled findings at most, chosen by hash.

The dictionary covers all documents: every letter run of a candidate is looked up among
the words of the corpus and counts if at least ``DICTIONARY_TEXTS`` texts have it. The words
are counted before the shuffle, and only those that some candidate has.

Defined results: null and empty texts have no candidates; repeated rows give their findings
each; equal candidates in one text are findings of their own, numbered in text order; with
findings of one label only, every score is that label; extra columns play no part.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from stratalake.llm import forest
from stratalake.scratch import written

MIN_CHARS = 16
DICTIONARY_TEXTS = 20
FIT_ROWS = 20_000
TREES, DEPTH = 16, 5
BROADCAST_RUNS = 1_000_000

# Words that name credentials, and words that name examples.
CREDENTIALS = "key|token|secret|passw|pwd|auth|credential|bearer|apikey|private"
PLACEHOLDERS = "example|sample|dummy|test|placeholder|changeme|your|xxxx|fake"

_KIND = r"A-Za-z0-9+/_\-"
CANDIDATE = rf"(?<![{_KIND}])(?=[A-Za-z+/_\-]*[0-9])[{_KIND}]{{{MIN_CHARS},}}={{0,2}}"
NEAR = 80  # characters of context before and after

FEATURES = [
    "length",
    "transitions",
    "digit_share",
    "upper_share",
    "hex",
    "distinct_share",
    "coverage",
    "path_like",
    "path_test",
    "quoted",
    "assigned",
    "credential_before",
    "credential_after",
    "placeholder_near",
]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, position, candidate, before and after of every candidate."""
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"),
        F.col("text").cast("string").alias("text"),
    ).where(F.col("text").rlike(CANDIDATE))
    rows = rows.select(
        "doc_id",
        "path",
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
        F.split("text", CANDIDATE, -1).alias("rest"),
    )
    one = F.transform(
        "found",
        lambda c, i: F.struct(
            c.alias("candidate"),
            F.lower(F.right(F.get("rest", i), F.lit(NEAR))).alias("before"),
            F.lower(F.left(F.get("rest", i + 1), F.lit(NEAR))).alias("after"),
        ),
    )
    rows = rows.select("doc_id", "path", F.posexplode(one).alias("position", "one"))
    return rows.select("doc_id", "path", "position", "one.*")


def known_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(run): the letter runs that at least ``DICTIONARY_TEXTS`` texts have as a word."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = docs.select(F.explode(F.array_distinct(F.split(text, r"[^\p{L}]+"))).alias("run"))
    if runs.count() <= BROADCAST_RUNS:
        words = words.join(F.broadcast(runs), "run", "left_semi")
    counts = words.groupBy("run").agg(F.count("*").alias("n"))
    return runs.join(counts.where(F.col("n") >= DICTIONARY_TEXTS), "run", "left_semi")


def coverage(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(candidate, coverage): share of its characters in words of the dictionary."""
    runs = F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0)))
    by_run = found.select("candidate").distinct().select("candidate", runs.alias("run"))
    by_run = written(by_run, "runs")
    known = written(known_runs(docs, by_run.select("run").distinct()), "known-runs")
    return (
        by_run.join(known, "run")
        .groupBy("candidate")
        .agg(F.sum(F.char_length("run")).alias("letters"))
        .select("candidate", (F.col("letters") / F.char_length("candidate")).alias("coverage"))
    )


def _share(text: Column, pattern: str) -> Column:
    left = F.char_length(F.regexp_replace(text, pattern, ""))
    return 1 - left / F.greatest(F.char_length(text), F.lit(1))


def describe(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``FEATURES`` as doubles."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    kinds = c
    for kind, one in (("[0-9]+", "9"), ("[a-z]+", "a"), ("[A-Z]+", "A")):
        kinds = F.regexp_replace(kinds, kind, one)
    word_before = F.regexp_extract(before, r"(\S+)[\s=:\"'(<]*$", 1)
    word_after = F.regexp_extract(after, r"^\S*\s+(\S+)", 1)
    value = {
        "length": F.char_length(c),
        "transitions": (F.char_length(kinds) - 1) / F.char_length(c),
        "digit_share": _share(c, "[0-9]+"),
        "upper_share": _share(c, "[A-Z]+"),
        "hex": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & c.rlike("[A-Fa-f]"),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / F.char_length(c),
        "coverage": F.coalesce("coverage", F.lit(0.0)),
        "path_like": c.contains("/") | before.rlike(r"[/\\.]$") | after.rlike(r"^[/\\]"),
        "path_test": F.lower("path").rlike("test|example|sample|fixture|mock"),
        "quoted": before.rlike("[\"']$") & after.rlike("^[\"']"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$"),
        "credential_before": word_before.rlike(CREDENTIALS),
        "credential_after": word_after.rlike(CREDENTIALS),
        "placeholder_near": before.rlike(PLACEHOLDERS) | after.rlike(PLACEHOLDERS),
    }
    rows = found.join(coverage(docs, found), "candidate", "left")
    return rows.withColumns({k: v.cast("double") for k, v in value.items()})


def seed_labels(rows: DataFrame) -> DataFrame:
    """``rows`` with label 1 or 0 where the case is clear, else null."""
    named = (F.col("credential_before") == 1) & (F.col("assigned") == 1)
    near = F.concat_ws(" ", "before", "after").rlike(CREDENTIALS)
    secret = named & (F.col("placeholder_near") == 0) & (F.col("digit_share") < 1)
    return rows.withColumn(
        "label", F.when(secret, 1).when((F.col("digit_share") == 1) | ~near, 0)
    )


def fit(rows: DataFrame) -> Column:
    """Score column from findings with features and a 0/1 ``label``."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return F.lit(float(next(iter(counts), 0)))
    data = VectorAssembler(inputCols=FEATURES, outputCol="inputs").transform(rows)
    model = RandomForestClassifier(
        featuresCol="inputs", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11,
        featureSubsetStrategy="sqrt",
    ).fit(data)
    votes = [forest.vote(t) for t in forest.read_trees(model, FEATURES)]
    return sum(votes[1:], votes[0]) / len(votes)


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All candidates of ``docs`` with features, score and is_secret.

    ``labelled``: findings as ``candidates`` returns them with a 0/1 ``label``.
    """
    rows = written(describe(docs, written(candidates(docs), "candidates")), "findings")
    train = seed_labels(rows) if labelled is None else describe(docs, labelled)
    train = train.where(F.col("label").isNotNull()).select(
        *FEATURES, "label", F.xxhash64("doc_id", "candidate", "position").alias("pick")
    )
    train = written(train.orderBy("pick").limit(FIT_ROWS).drop("pick"), "training")
    return rows.withColumn("score", fit(train)).withColumn("is_secret", F.col("score") >= 0.5)


def report(docs: DataFrame) -> DataFrame:
    """One row per finding; the candidate is shown by its hash and first characters only."""
    return scan(docs).select(
        "doc_id",
        F.col("position").cast("long").alias("position"),
        F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"),
        F.concat(F.left("candidate", F.lit(4)), F.lit("...")).alias("shown"),
        F.char_length("candidate").cast("long").alias("n_chars"),
        "coverage",
        "score",
        "is_secret",
    )
