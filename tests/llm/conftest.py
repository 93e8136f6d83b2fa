from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for columns of their own.
CLASHES = ("rules", "lines", "hits", "repeats", "licence", "language", "kept", "score", "log_weight", "sample_key", "_doc", "_spans", "_own", "_held", "_items", "_gone", "_text", "_id", "k", "bits", "node", "gram", "kind")


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "délta", "eins", "zwei", "the", "of", "über", "x1"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    shared, line = prose(60), "All rights reserved by nobody in particular"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, prose(40)), (7, shared), (6, shared), (8, prose(10) + "\n" + shared), (9, "x" * 300_000), (10, prose(30_000)), (None, shared), (11, "a b c d"), (12, "a b c d"), (13, "word " * 500), (14, "1234 5678 !!"), (15, "a\0b c \U0001f600 é")]
    rows += [(20 + i, f"{prose(25)}\n  {line.upper() if i % 2 else line} \n{prose(5)}") for i in range(12)]
    rows += [(40, prose(50)), (40, None)]
    rows[-1] = rows[-2]
    return [(i, t, rng.choice(["en", "de", None]), "s", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(texts, SCHEMA).repartition(3)
    return df.select("*", *(F.lit("mine").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
