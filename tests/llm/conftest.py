import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for columns of their own.
CLASHES = ("row", "ID", "size", "head", "full", "class", "keys", "tokens", "P", "tree", "text_key", "count", "k", "clean", "kept_id", "copies", "of", "first", "url_key", "node", "start")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)) + "."


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, source), with columns of clashing names."""

    def make(rows):
        df = spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)
        return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])

    return make


@pytest.fixture(scope="session")
def nasty(docs_of):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    a, b, long = prose(1, 120), prose(2, 90), prose(3, 60_000)
    near = a.split()
    near[60] = "changed"
    rows = [
        (1, a, "s"), (2, a, "s"), (2, a, "s"), (None, a, None), (3, " ".join(near), "s"), (4, b, None), (5, b + " And more.", "t"),
        (6, None, "s"), (None, None, None), (7, "", "t"), (8, "", "t"), (9, "  \n ", "t"), (10, "One.", "t"), (11, "one", "t"), (12, long, "t"), (12, long, "t"), (13, long + " End.", "u"),
    ]
    return docs_of(rows)


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])
