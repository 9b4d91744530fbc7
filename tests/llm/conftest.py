import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text[, source]) as documents, with extra columns whose names clash with inner ones."""

    def make(rows, clash=False):
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(data, SCHEMA)
        if clash:
            for name in ("node", "key", "digest", "host", "label", "count", "salt", "score", "row"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here at all please"), (None, None),
        (6, long_text), (7, long_text), (8, "é漢🙂 ▁ x\r\ny\x0bz"), (9, "a" * 5000), (10, None),
    ]


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
