import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WORDS = "sun moon star cloud rain river stone tree leaf bird fish wind snow fire sand hill road gate lamp door".split()
# Names that the operators use inside.
CLASHING = ("id", "row", "doc", "part", "fp", "key", "root", "rank", "size", "words", "queue", "n", "label", "digest")


def prose(seed: int, n: int) -> str:
    """Words in an order that hardly repeats."""
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


def edge_rows() -> list[tuple]:
    """(doc_id, text, source): nulls, empty and long texts, ties, repeated rows."""
    a, b = prose(1, 60), prose(2, 80)
    rows = [
        (1, a, "x"),
        (2, a, "y"),
        (2, a, "y"),
        (3, a + " sun", "x"),
        (4, b, None),
        (5, None, "x"),
        (6, "", "x"),
        (7, " \t\n ", "z"),
        (8, "sun", "x"),
        (9, "sun moon", None),
        (None, b, "y"),
        (None, None, None),
        (10, "\n".join([b, prose(3, 30), "tail"]), "x"),
        (11, "\n".join([prose(4, 12), b]), "y"),
        (12, "\n".join(prose(i, 15) for i in range(10, 400)), "x"),
        (13, "é" * 5000 + " ☃ \U0001f600 " + prose(5, 20), "z"),
        (14, "word" * 20_000, "z"),
        (15, prose(6, 40) + " same same same", "x"),
        (15, prose(7, 40), "x"),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(edge_rows(), "doc_id long, text string, source string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit(name))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)
