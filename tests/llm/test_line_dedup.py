"""Repeated line runs against a search for every run in all earlier text."""

import random
import re

import pytest
from conftest import prose
from plain_llm import as_rows
from pyspark.sql import functions as F

from bitloom.llm import line_dedup


def plain(rows, min_words):
    """(id, text left, dropped) for (id, text) rows in corpus order."""
    texts = [(t or "").split("\n") if t is not None else [] for _, t in rows]
    count = lambda lines: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines)
    out = []
    for d, lines in enumerate(texts):
        gone = set()
        for a in range(len(lines)):
            for e in range(d + 1):
                for b in range(a if e == d else len(texts[e])):
                    n = 0
                    while a + n < len(lines) and b + n < len(texts[e]) and lines[a + n] == texts[e][b + n]:
                        n += 1
                    if n and count(lines[a : a + n]) >= min_words:
                        gone.update(range(a, a + n))
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((rows[d][0], None if rows[d][1] is None else left, tuple(sorted(gone))))
    return out


def got(df, min_words=50):
    result = line_dedup.dedup_lines(df, min_words=min_words).select("doc.doc_id", "text", "dropped").collect()
    return sorted(((r[0], r[1], tuple(r[2])) for r in result), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_random_lines(spark, seed):
    rnd = random.Random(seed)
    pool = [prose(i, n) for i, n in enumerate([1, 1, 2, 3, 5, 8, 13])] + ["", " "]
    rows = []
    for i in range(25):
        lines = [rnd.choice(pool) for _ in range(rnd.randrange(1, 14))]
        if rows and rnd.random() < 0.5:
            old = rnd.choice(rows)[1].split("\n")
            at = rnd.randrange(len(old))
            lines[2:2] = old[at : at + rnd.randrange(1, 8)]
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df, 10) == sorted(plain(rows, 10), key=repr)


def test_edge_rows(docs):
    result = line_dedup.dedup_lines(docs).select("doc.*", F.col("text").alias("left"), "n_lines", "dropped")
    rows = {}
    for r in result.collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, rows.values())) == docs.count()
    # The same line again and again: the first row of it keeps it, others lose it.
    assert rows[1][0]["left"] == rows[1][0]["text"]
    assert [r["left"] for r in rows[2]] == ["", ""]
    assert rows[5][0]["left"] is None and rows[5][0]["n_lines"] == 0
    assert rows[6][0]["left"] == "" and rows[6][0]["n_lines"] == 1 and rows[6][0]["dropped"] == []
    assert rows[7][0]["left"] == " \t\n "
    assert rows[10][0]["dropped"] == [0] and rows[10][0]["left"].endswith("\ntail")
    assert rows[11][0]["dropped"] == [1]
    # A null id comes last, so its copy goes.
    assert sorted((r["left"] for r in rows[None]), key=repr) == ["", None]


def test_run_longer_than_any_power_of_two_of_lines(spark):
    lines = [prose(i, 2) for i in range(300)]
    rows = [(1, "\n".join(["start", *lines, "end"])), (2, "\n".join(["other", *lines[5:290], "more"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == [(1, rows[0][1], ()), (2, "other\nmore", tuple(range(1, 286)))]


def test_empty(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


def test_native(spark, docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pieces_are_found_with_three_sorts(spark):
    lines = spark.createDataFrame([(0, n, n, 30) for n in range(4)], "row long, n int, g long, words int")
    pieces = line_dedup._pieces(lines, 50)
    assert sorted(map(tuple, pieces.collect())) == [(0, 0, 0, 2), (0, 0, 1, 2), (0, 0, 2, 2)]
    plan = pieces._jdf.queryExecution().sparkPlan().toString() + pieces._jdf.queryExecution().executedPlan().toString()
    final = plan.partition("Initial Plan")[0]
    # Every sort of a task holds pages of its own: there were ten in one task.
    assert "Union" not in final and len(re.findall(r"\bSort \[", final)) <= 3, final
