"""Quality classifier: a sparse rule ensemble over text statistics.

A small random forest is fitted on the statistics of labelled training rows. Each path
from a root to a node is a rule, a conjunction of comparisons; a lasso-penalised logistic
regression over all rules keeps few of them. The kept rules with their weights are compiled
into one column expression, so texts are scored without leaving the JVM.

Forest and weights are fitted on at most ``FIT_ROWS`` labelled rows, chosen by a hash of
their id; statistics and scores cover all documents. Labels, language, source and id
are no inputs.

Defined results: null and empty texts have all statistics zero; contradicting labels go by
majority, ties to good; with labels of one class only, every score is that class, without
any label 0.5; repeated rows are scored each; other columns are passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from stratalake.llm import forest
from stratalake.llm.common import fold, free_name, one_label
from stratalake.scratch import written

FOLDS, HELD_OUT = 4, 2
FIT_ROWS = 20_000
TREES, DEPTH = 24, 4
LASSO = 0.001
GOOD = 0.7

STATISTICS = [
    "n_words",
    "word_length",
    "distinct_share",
    "repeat_share",
    "upper_share",
    "digit_share",
    "symbol_share",
    "bar_share",
    "bang_share",
    "stop_share",
    "comma_share",
    "words_per_line",
    "equal_line_share",
]


def _without(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _count(text: Column, mark: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))


def statistics(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with ``STATISTICS`` as doubles, their names after ``prefix``."""
    words, lines = free_name(docs, f"{prefix}words"), free_name(docs, f"{prefix}lines")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns(
        {
            words: F.array_remove(F.split(text, r"\s+"), ""),
            lines: F.array_remove(F.split(text, "\n"), ""),
        }
    )
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.char_length(F.array_join(words, "")), F.lit(1)).cast("double")
    w = F.col(words)
    repeats = F.size(F.filter(
        F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: a == b),
        lambda same: same,
    ))
    value = {
        "n_words": F.size(words),
        "word_length": F.when(F.size(words) > 0, chars / n).otherwise(0.0),
        "distinct_share": F.size(F.array_distinct(words)) / n,
        "repeat_share": repeats / n,
        "upper_share": _without(text, r"\p{Lu}+") / chars,
        "digit_share": _without(text, "[0-9]+") / chars,
        "symbol_share": _without(text, "[#*$%&<>{}~^=_]+") / chars,
        "bar_share": _count(text, "|") / n,
        "bang_share": _count(text, "!") / n,
        "stop_share": _count(text, ".") / n,
        "comma_share": _count(text, ",") / n,
        "words_per_line": F.size(words) / F.greatest(F.size(lines), F.lit(1)),
        "equal_line_share": (F.size(lines) - F.size(F.array_distinct(lines)))
        / F.greatest(F.size(lines), F.lit(1)),
    }
    named = {prefix + k: v.cast("double") for k, v in value.items()}
    return rows.select(*docs.columns, *(v.alias(k) for k, v in named.items()))


@dataclass
class Ensemble:
    """score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: list[tuple[float, tuple[forest.Test, ...]]]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for weight, tests in self.rules:
            total = total + F.lit(weight) * forest.rule(tests)
        return 1 / (1 + F.exp(-total))


def fit(rows: DataFrame, label: str, prefix: str = "") -> Ensemble:
    """Rules and weights from ``rows`` with statistics and a 0/1 ``label``."""
    names = [prefix + s for s in STATISTICS]
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if len(counts) < 2:
        return Ensemble({(): 0.0, (0,): -30.0, (1,): 30.0}[tuple(counts)], [])
    data = VectorAssembler(inputCols=names, outputCol="inputs").transform(rows)
    model = RandomForestClassifier(
        featuresCol="inputs", labelCol=label, numTrees=TREES, maxDepth=DEPTH, seed=7,
        featureSubsetStrategy="sqrt", minInstancesPerNode=max(1, sum(counts.values()) // 1000),
    ).fit(data)
    trees = forest.read_trees(model, names)
    found = sorted({p for t in trees for p in forest.paths(t)}, key=str)
    held = F.array(*(forest.rule(p) for p in found)).alias("held")
    held = written(rows.select(label, held), "rules")
    lasso = LogisticRegression(
        featuresCol="inputs", labelCol=label, elasticNetParam=1.0, regParam=LASSO, maxIter=60,
        standardization=False,
    ).fit(held.select(label, array_to_vector("held").alias("inputs")))
    kept = [(float(w), p) for w, p in zip(lasso.coefficients.toArray(), found) if w]
    return Ensemble(float(lasso.intercept), kept)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """(text, quality) of at most ``limit`` labelled rows that are not held out."""
    marks = written(one_label(labels.where(fold("doc_id", FOLDS) != HELD_OUT), "quality"), "labels")
    count = marks.count()
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    marks = marks.where(pick < int((1 << 30) * min(1.0, limit / max(1, count))))
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(marks), "doc_id").select("text", "quality")  # limit rows, about


def learn(docs: DataFrame, labels: DataFrame, prefix: str = "") -> Ensemble:
    rows = written(statistics(training_rows(docs, labels), prefix).drop("text"), "statistics")
    return fit(rows, "quality", prefix)


def score(docs: DataFrame, ensemble: Ensemble, name: str = "score", prefix: str = "") -> DataFrame:
    """``docs`` with the score from 0 to 1."""
    return statistics(docs, prefix).withColumn(name, ensemble.score()).select(*docs.columns, name)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = docs.select("doc_id", "text")
    scored = score(docs, learn(docs, labels))
    return scored.select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )
