"""Vector links against a comparison of all pairs."""

import numpy as np
import pytest
from plain_llm import as_rows, union_find

from bitloom.llm import vector_dedup


def clustered(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    rows = []
    for i in range(n):
        v = centres[i % len(centres)] + rng.standard_normal(dim) * 0.2
        rows.append((i, [float(x) for x in v], int(i % len(centres)) % 3))
    return rows


def plain(rows, threshold=0.93):
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float)
        x = x / np.abs(x).max()
        return x / np.sqrt((x * x).sum())

    units = [unit(v) for _, v, _ in rows]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None and rows[i][2] == rows[j][2]:
                if (a * b).sum() >= threshold:
                    pairs.append((i, j))
    root = union_find(len(rows), pairs)
    links, least = [0] * len(rows), {}
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    return sorted(((d, links[i], least.get(root[i]), d == least.get(root[i])) for i, (d, _, _) in enumerate(rows)), key=repr)


SCHEMA = "vec_id long, embedding array<double>, label int"


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, w, 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [], 0),
        (8, [0.0, 0.0, 0.0], 0), (9, [0.0, -0.0, 0.0], 0), (10, [1.0, nan, 2.0], 0), (11, [1.0, inf, 2.0], 0),
        (12, [1.0, None, 3.0], 0), (13, [1.0, 2.0], 0), (14, [2.0, 4.0], 0), (None, v, 0), (None, [9.0, -1.0, 0.0], 0),
        (15, [1e200, 2e200, 3e200], 0), (16, [1e-200, 2e-200, 3e-200], 0), (17, [-1.0, -2.0, -3.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert as_rows(vector_dedup.near_vectors(df)) == plain(rows)
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0
    none = spark.createDataFrame([r for r in rows if r[0] in (5, 6, 8)], SCHEMA)
    assert as_rows(vector_dedup.near_vectors(none)) == [(5, 0, 5, True), (6, 0, 6, True), (8, 0, 8, True)]


def test_float_and_string_columns_with_clashing_names(spark):
    rows = [(r[0], r[1], str(r[2]), 1, 2) for r in clustered(48)]
    df = spark.createDataFrame(rows, "id long, vec array<float>, n string, cid int, label int")
    want = plain([(a, [float(np.float32(x)) for x in b], c) for a, b, c, _, _ in rows])
    assert as_rows(vector_dedup.near_vectors(df, "id", "vec", "n")) == want


@pytest.mark.parametrize("block", [7, 1024])
def test_one_leaf_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = clustered(200)
    assert as_rows(vector_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_deep_trees_miss_few_links(spark):
    rows = clustered(1600, 32)
    want = {r[0]: r[1] for r in plain(rows)}
    got = {r[0]: r[1] for r in as_rows(vector_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA), leaf_rows=64))}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.98 * sum(want.values()) > 1000


def test_trees_deeper_than_the_sample_supports():
    units = vector_dedup._units([v for _, v, _ in clustered(4000, 32)])
    forest = vector_dedup.Forest(units[:200], len(units), 3, 32, 0.03)
    for _, idx, leaf in forest.leaves(units):
        assert set(idx) == set(range(len(units)))
        assert np.bincount(np.unique(leaf, return_inverse=True)[1]).max() < 1000
