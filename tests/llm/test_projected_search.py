"""Projected search against a comparison with every vector."""

import numpy as np
import pytest
from plain_llm import as_rows
from pyspark.sql import functions as F

from bitloom.llm import projected_search as s

SCHEMA = "vec_id long, embedding array<double>"


def unit(v):
    if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
        return None
    x = np.array(v, float)
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def plain(rows, k=5, every=50):
    """{(query's place, query_id): [(score, vec_id)]} by looking at all rows."""
    units = [None if i is None else unit(v) for i, v in rows]
    out = []
    for q, (i, _) in enumerate(rows):
        if units[q] is None or i % every:
            continue
        near = [(-round(float((units[q] * units[c]).sum()), 10), rows[c][0]) for c in range(len(rows)) if c != q and units[c] is not None and len(units[c]) == len(units[q])]
        out += [(i, rank, j, -score) for rank, (score, j) in enumerate(sorted(near)[:k], 1)]
    return sorted(out, key=repr)


def found(df, every=50, **how):
    rows = s.nearest(df, F.col("vec_id") % every == 0, **how).collect()
    return sorted(((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 10)) for r in rows), key=repr)


def recall(got, want):
    near = {}
    for i, _, j, _ in want:
        near.setdefault(i, set()).add(j)
    return sum(j in near[i] for i, _, j, _ in got) / len(want)


def test_chi_square():
    assert s.chi_square_below(0, 8) == 0
    # Published values of the 95 % quantile.
    for degrees, value in [(2, 5.991), (8, 15.507), (10, 18.307)]:
        assert abs(s.chi_square_quantile(0.95, degrees) - value) < 1e-3


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [
        (0, v), (50, v), (50, v), (100, w), (4, v), (6, None), (150, None), (7, []), (8, [0.0, 0.0, 0.0]), (200, [0.0, -0.0, 0.0]),
        (10, [1.0, nan, 2.0]), (11, [1.0, inf, 2.0]), (12, [1.0, None, 3.0]), (250, [1.0, 2.0]), (13, [2.0, 1.0]), (300, [5.0]),
        (None, v), (15, [1e200, 2e200, 3.3e200]), (16, [1e-200, 2e-200, 3.4e-200]), (350, [-1.0, -2.0, -3.0]), (17, [0.0, 1.0, 0.0]),
        (18, [3.0, 1.0, 0.5]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("id", "vec", "cid", "ids", "dim", "cell", "part", "block", "score", "own", "best", "far"):
        df = df.withColumn(name, F.lit(name))
    assert found(df, confidence=1 - 1e-12) == plain(rows)
    assert s.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert found(spark.createDataFrame([(50, v)], SCHEMA)) == []
    assert found(spark.createDataFrame([(51, v), (52, w)], SCHEMA)) == []


def test_float_column_with_other_names(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(6).astype(np.float32)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "i int, v array<float>, rank int")
    got = s.nearest(df, F.col("i") % 50 == 0, "i", "v", confidence=1 - 1e-12)
    assert sorted(((*r[:3], round(r[3], 10)) for r in got.collect()), key=repr) == plain(rows)


def test_a_large_group_of_copies(spark):
    rng = np.random.default_rng(2)
    one = [float(x) for x in rng.standard_normal(8)]
    rows = [(i, one if i % 3 else [float(x) for x in rng.standard_normal(8)]) for i in range(1500)]
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(4), confidence=1 - 1e-12)
    assert got == plain(rows)


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_recall_with_many_cells(spark, monkeypatch, kind):
    for name, value in [("CELL_ROWS", 64), ("PART_ROWS", 50), ("BLOCK", 16), ("STEP", 16)]:
        monkeypatch.setattr(s, name, value)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64))
    if kind == "clustered":
        x = x * 0.3 + rng.standard_normal((100, 64))[rng.integers(0, 100, 4000)]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    want = plain(rows)
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert len(got) == len(want) and recall(got, want) >= 0.93
    scores = {(i, j): c for i, _, j, c in want}
    assert all(scores.get((i, j), c) == c for i, _, j, c in got)


def test_given_vectors(spark):
    """The registered query, on the vectors of a given table."""
    from bitloom.llm.queries import QUERIES

    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = plain([(r["vec_id"], list(r["embedding"])) for r in df.collect()])
    got = as_rows(QUERIES["op11_projected_search"](spark, "/root/testdata/sf0.01"))
    assert recall(got, want) >= 0.9 and len(got) == len(want)
