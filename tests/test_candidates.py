"""Candidate pairs of sketches and the stored vector index, against all pairs."""

import os
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import candidates, sketch, vector_index
from bitloom.sources.files import new_folder


def groups_of_sets(seed=0, groups=30, size=6):
    """Sets of words around common cores, from nearly equal to hardly alike, with exact copies."""
    rng = np.random.default_rng(seed)
    sets = {}
    for g in range(groups):
        core = [f"g{g}w{i}" for i in range(40 + 10 * (g % 9))]
        for j in range(size):
            kept = [w for w in core if rng.random() > 0.03 * j]
            sets[len(sets)] = kept + [f"g{g}s{j}x{i}" for i in range(2 * j)]
        sets[len(sets)] = list(core)
        sets[len(sets)] = list(core)
    return sets


def built(spark, sets, p=10):
    rows = spark.createDataFrame([(i, w) for i, words in sets.items() for w in words], "k long, w string")
    return sketch.build(rows, F.col("k"), F.col("w"), p)


def bits_of(sketches):
    out = {}
    for r in sketches.rows.collect():
        out.setdefault(r["set_id"], set()).update((r["bin"], i) for i in range(63) if r["word"] >> i & 1)
    return out


@pytest.mark.parametrize("measure,least", [("jaccard", 0.8), ("jaccard", 0.5), ("cosine", 0.9)])
def test_pairs_above_against_all_pairs(spark, measure, least):
    sketches = built(spark, groups_of_sets())
    sets, classes = bits_of(sketches), {}
    for i, s in sets.items():
        classes.setdefault(frozenset(s), []).append(i)
    want = {}
    for (s, i), (t, j) in combinations(classes.items(), 2):
        shared = len(s & t)
        score = shared / len(s | t) if measure == "jaccard" else shared / (len(s) * len(t)) ** 0.5
        if score >= least:
            a, b = sorted([(min(i), len(i)), (min(j), len(j))])
            want[a[0], b[0]] = (a[1], b[1], shared, pytest.approx(score))
    got = {(r["set_a"], r["set_b"]): tuple(r)[2:] for r in candidates.pairs_above(sketches, least, measure).collect()}
    assert len(want) > 60 and all(k in want and want[k] == v for k, v in got.items())
    # The stated chance of a miss is one in a million; the contract asks for 0.9.
    assert len(got) == len(want)
    groups = {r["set_id"]: r["group_id"] for r in candidates.equal_groups(sketches).collect()}
    assert groups == {i: min(ids) for ids in classes.values() for i in ids}


def test_unlike_sets_hardly_meet(spark):
    """Candidates are a small share of all pairs, and copies are one row however many."""
    sets = {i: [f"{i}:{j}" for j in range(60)] for i in range(300)} | {1000 + i: ["same", "words", "here"] for i in range(400)}
    sketches = built(spark, sets)
    rows = candidates.band_rows(0.8)
    keyed = candidates.bit_sets(sketches).where("set_id < 1000").select("set_id", F.explode(candidates.band_keys(F.col("bits"), rows)).alias("key"))
    met = keyed.groupBy("key").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
    assert met < 0.01 * 300 * 299 / 2
    assert candidates.pairs_above(sketches, 0.8).isEmpty()
    groups = candidates.equal_groups(sketches).groupBy("group_id").count().where("count > 1").collect()
    assert [tuple(r) for r in groups] == [(1000, 400)]


def test_bit_sets_of_rows(spark):
    """Sets of one row, of several, without tokens or without an id: as from registers; one row is not shuffled by tokens."""
    rows = [(i, [f"w{j * i % 97}" for j in range(i % 50)]) for i in range(200)]
    rows += [(7, ["x", "é"]), (None, ["a", None]), (None, ["b"]), (500, None), (501, []), (502, [None])]
    df = spark.createDataFrame(rows, "k long, w array<string>").repartition(3)
    for p in (10, 4, 18):
        sketches = sketch.build(df.select("k", F.explode("w").alias("t")), F.col("k"), F.col("t"), p)
        want = {r["set_id"]: r["bits"] for r in candidates.bit_sets(sketches).collect()}
        got = candidates.bit_sets_of_rows(df, F.col("k"), F.col("w"), p).collect()
        assert {r["set_id"]: r["bits"] for r in got} == want and len(got) == len(want)


def test_documents_that_are_not_alike_hardly_meet(spark):
    """Sets with a third of their words in common, as prose has, share a band in one of 100 pairs at most."""
    rng = np.random.default_rng(2)
    common = [f"c{i}" for i in range(100)]
    sets = {i: common + [f"{i}:{j}" for j in range(int(rng.integers(90, 110)))] for i in range(300)}
    bits = candidates.bit_sets(built(spark, sets))
    keyed = bits.select("set_id", F.explode(candidates.band_keys(F.col("bits"), candidates.band_rows(0.8))).alias("key"))
    a, b = (keyed.select(F.col("set_id").alias(c), "key") for c in "ab")
    assert a.join(b, "key").where("a < b").select("a", "b").distinct().count() < 0.01 * 300 * 299 / 2


def test_bands():
    assert candidates.band_rows(1.0) == 64
    for least in (0.3, 0.5, 0.8, 0.95):
        rows = candidates.band_rows(least)
        assert (1 - least**rows) ** candidates.BANDS <= candidates.MISS or rows == 1
        assert (1 - least ** (rows + 1)) ** candidates.BANDS > candidates.MISS
    for bad in (0, -1, 1.1):
        with pytest.raises(ValueError):
            candidates.band_rows(bad)


def test_empty_sketches(spark):
    none = built(spark, {0: ["a"]}).rows.limit(0)
    assert candidates.pairs_above(sketch.Sketches(none), 0.8).isEmpty()
    with pytest.raises(ValueError):
        candidates.pairs_above(sketch.Sketches(none), 0.8, "dice")


def clustered(spark, n=6000, dim=32, around=60, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((around, dim)) * 2
    x = (centres[rng.integers(0, around, n)] + rng.standard_normal((n, dim)) * 0.6).astype(np.float32)
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<float>").repartition(8), x


def exact(x, i, k):
    away = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1))
    return np.lexsort((np.arange(len(x)), away))[:k], away


def test_index_recall_and_pairs(spark):
    """Ids divisible by 100 against all rows: recall of 0.9 or more, a fifth of the pairs at most."""
    corpus, x = clustered(spark)
    path = new_folder(spark, "index")
    index = vector_index.build(corpus, path)
    queries = corpus.where("id % 100 = 0")
    got = vector_index.nearest(index, queries, 10).collect()
    found = {(r["query_id"], r["id"]) for r in got}
    want = {(i, int(j)) for i in range(0, len(x), 100) for j in exact(x, i, 10)[0]}
    assert len(found & want) >= 0.9 * len(want) and len(got) == len(want)
    for r in got[:50]:
        assert r["score"] == pytest.approx(exact(x, r["query_id"], 1)[1][r["id"]], abs=2e-6)
    assert vector_index.pairs_compared(index, queries) < 0.2 * 60 * len(x)
    # As many probes as there are cells give the exact answer.
    again = vector_index.load(spark, path)
    assert again.probes == index.probes and np.allclose(again.centres, index.centres)
    every = vector_index.nearest(again, queries, 10, probes=len(again.centres)).collect()
    assert {(r["query_id"], r["id"]) for r in every} == want


def test_index_reads_only_the_cells_asked_for(spark):
    corpus, x = clustered(spark, 2000)
    index = vector_index.build(corpus, new_folder(spark, "index"))
    one = vector_index.nearest(index, corpus.where("id = 100"), 5, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert one.count() == 5
    files = [d for d in os.listdir(f"{index.path}/rows") if d.startswith("cell=")]
    assert len(files) > 20


def test_index_grows_and_holds_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ROWS", 50)
    monkeypatch.setattr(vector_index, "BLOCK", 3)
    corpus, x = clustered(spark, 1500)
    index = vector_index.build(corpus.where("id < 1000"), new_folder(spark, "index"))
    vector_index.add(index, corpus.where("id >= 1000"))
    got = vector_index.nearest(index, corpus.where("id % 100 = 0"), 4, probes=len(index.centres)).collect()
    assert {(r["query_id"], r["rank"]): r["id"] for r in got} == {(i, r + 1): int(j) for i in range(0, 1500, 100) for r, j in enumerate(exact(x, i, 4)[0])}
    assert vector_index.nearest(index, corpus.limit(0), 4).isEmpty()


def test_index_of_few_or_no_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None)], "id long, vec array<float>")
    index = vector_index.build(rows, new_folder(spark, "index"))
    assert [(r["id"], r["rank"]) for r in vector_index.nearest(index, rows.where("id = 1"), 5).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_given_vectors_recall(spark):
    from bitloom.plans import load_all
    from bitloom.plans.registry import REGISTRY

    load_all()
    folder = "/root/testdata/sf0.1"
    got = {(r["query_id"], r["id"]) for r in REGISTRY["knn_approx"].build(spark, folder).collect()}
    want = {(r["query_id"], r["id"]) for r in REGISTRY["knn_vectors_l2"].build(spark, folder).collect()}
    assert len(got & want) >= 0.9 * len(want)
