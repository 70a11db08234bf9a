from __future__ import annotations

import random

import pytest

from stratalake.llm.common import ship_package

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(autouse=True, scope="session")
def _shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def vocabulary():
    """Invented words, the same in every run."""
    rng = random.Random(5)
    return ["".join(rng.choices("abdeilmnorstu", k=rng.randint(2, 9))) for _ in range(3000)]


def odd_texts() -> list[str | None]:
    """Texts that break careless code."""
    return [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "one",
        "\n\n\n",
        "naïve café 日本語 🎉   é",
        "a\x00b \x1f tail",
        "word " * 30_000,
        "x" * 200_000,
        "same line\n" * 500,
        "▁ marks ▁▁",
    ]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Odd texts, repeated rows, rows without id, and columns named like inner ones."""
    rows = [(i, t, None, "s", 0) for i, t in enumerate(odd_texts())]
    rows += [(3, "one", "en", "s", 3), (None, "no id here", "en", None, 10), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    extra = {n: docs["lang"] for n in (
        "text_hash", "fp", "rep", "shared", "order_id", "score", "hits", "words", "lines", "first_id",
        "evidence", "encoded", "host", "layout", "result",
    )}
    return docs.withColumns(extra)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)
