import random

import pytest
from pyspark.sql import types as T

#: Columns of documents, and two more whose names the operators use themselves.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHING = T.StructType([*SCHEMA, T.StructField("kept", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.StringType()), T.StructField("words", T.StringType())])


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("ba", "lo", "ti", "ne", "su", "ra", "mi", "ko")) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, repeated ids."""
    rng = random.Random(3)
    long = sentence(rng, 30_000)
    base = sentence(rng, 60)
    return [
        (1, "Hello world, hello.", "en", "a", 1),
        (2, None, "en", None, None),
        (3, "", None, "a", 0),
        (4, "   \t\n ", "en", "a", 4),
        (5, long, "fr", "b", len(long)),
        (6, base, "fr", "b", 5),
        (7, base, "fr", "b", 5),
        (7, base, "fr", "b", 5),
        (8, base.replace(" ", "  \n"), "fr", "b", 5),
        (None, base, "de", "c", None),
        (None, "no id here", None, None, None),
        (9, base + " " + sentence(rng, 1), "fr", "b", 5),
        (10, "Árbol ÑANDÚ 日本語 😀 don't <|endoftext|> x", "es", "c", 9),
        (10, "another text under the same id", "en", "c", 9),
        (11, "a", "en", "c", 1),
        (12, "...!!! ### 123", "en", "c", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows as a table with clashing extra columns."""
    return spark.createDataFrame([(*r, None, 7, "x", 3, "y", None) for r in odd_rows], CLASHING)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
