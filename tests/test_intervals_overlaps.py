"""Commit intervals, as-of joins and set overlaps at many commits and sets."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitloom.operators import probability, skew, versions

VERSIONS = "k string, c long, gone boolean"


def made(seed, keys=30, commits=200, rows=800):
    rng = random.Random(seed)
    return sorted({(f"k{rng.randint(1, keys)}", rng.randint(1, commits)): rng.random() < 0.2 for _ in range(rows)}.items())


def status_at(own, c, gone, commit):
    later = [x for x in own if c < x <= commit]
    return "tail" if later else "deleted" if gone else "head"


def test_matrix_of_asked_commits(spark):
    rows = [(k, c, gone) for (k, c), gone in made(1)]
    by_key = {}
    for k, c, _ in rows:
        by_key.setdefault(k, []).append(c)
    df = spark.createDataFrame(rows, VERSIONS).repartition(4)
    asked = [0, 1, 17, 17, 100, 150, 999]
    want = {(k, c, at): status_at(by_key[k], c, gone, at) for k, c, gone in rows for at in set(asked) if at >= c}
    got = versions.commit_matrix(df, "k", "c", "gone", asked).collect()
    assert {(r["k"], r["c"], r["commit"]): r["status"] for r in got} == want and len(got) == len(want)
    table = spark.createDataFrame([(a,) for a in [*asked, None]], "day long")
    again = versions.commit_matrix(df, "k", "c", "gone", table).collect()
    assert {(r["k"], r["c"], r["commit"]): r["status"] for r in again} == want
    assert versions.commit_matrix(df, "k", "c", "gone", []).isEmpty()
    assert versions.commit_matrix(df.limit(0), "k", "c", "gone").isEmpty()


def test_matrix_over_a_hundred_thousand_commits(spark):
    """Three asked commits out of 100,000: three rows at most for each version, and one key has them all."""
    n = 100_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("c"), (F.col("id") % 1000 == 999).alias("gone"))
    got = versions.commit_matrix(df, "k", "c", "gone", [10, 50_999, n - 1])
    by = {(r["commit"], r["status"]): r["count"] for r in got.groupBy("commit", "status").count().collect()}
    assert by == {(10, "head"): 1, (10, "tail"): 10, (50_999, "deleted"): 1, (50_999, "tail"): 50_999, (n - 1, "deleted"): 1, (n - 1, "tail"): n - 1}
    intervals = versions.commit_intervals(df, "k", "c", "gone")
    assert intervals.count() == 2 * n - 1


@pytest.mark.parametrize("partitions", [1, 7])
def test_status_as_of(spark, partitions):
    rows = [(k, c, gone) for (k, c), gone in made(2)]
    rng = random.Random(3)
    asks = [(f"k{rng.randint(1, 40)}", rng.randint(-5, 210), i) for i in range(500)]
    asks += asks[:20]
    df = spark.createDataFrame(rows, VERSIONS).repartition(partitions)
    wanted = spark.createDataFrame(asks, "k string, at long, n int").repartition(partitions)
    got = versions.status_as_of(df, wanted, "k", "c", "gone", "at")
    want = []
    for k, at, i in asks:
        own = [(c, gone) for key, c, gone in rows if key == k and c <= at]
        c, gone = max(own) if own else (None, None)
        want.append((k, at, i, c, None if c is None else "deleted" if gone else "head"))
    assert Counter(map(tuple, got.select("k", "at", "n", "c", "status").collect())) == Counter(want)


def test_last_known_over_many_ranges(spark):
    rows = [(k, i, i if (i * 7 + k) % 5 == 0 else None) for k in range(3) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int, v int").withColumn("b", F.expr("i div 7"))
    got = {(r["k"], r["i"]): r["last"] for r in skew.last_known(df, ["k"], "b", ["i"], "v", "last").collect()}
    last = {}
    for k, i, v in sorted(rows):
        last[k] = v if v is not None else last.get(k)
        assert got[k, i] == last[k]


def plain_overlaps(rows, weighted):
    sets, weight = {}, Counter()
    for s, e, w in rows:
        sets.setdefault(s, set()).add(e)
        weight[e] += w
    return {(i, j): sum(weight[e] if weighted else 1 for e in sets[i] & sets[j]) for i in sets for j in sets}


@pytest.mark.parametrize("block", [2, 256])
@pytest.mark.parametrize("weighted", [False, True])
def test_overlaps_in_any_blocks(spark, monkeypatch, block, weighted):
    monkeypatch.setattr(probability, "BLOCK", block)
    rng = random.Random(6)
    rows = [(f"s{rng.randint(0, 25)}", rng.choice([f"e{rng.randint(0, 60)}", "everywhere", None]), rng.randint(1, 4)) for _ in range(900)]
    rows += [(f"s{i}", "everywhere", 1) for i in range(26)] + [("alone", "only", 2)]
    df = spark.createDataFrame(rows, "item_set string, element string, w long").repartition(3)
    weight = F.col("w") if weighted else None
    want = plain_overlaps(rows, weighted)
    got = probability.overlaps(df, weight).collect()
    assert {(r["i"], r["j"]): r["w"] for r in got} == want and len(got) == len(want)
    pairs = spark.createDataFrame([("s1", "s2"), ("s2", "s1"), ("s3", "alone"), ("s3", "s3"), ("s1", "s2")], "i string, j string")
    some = {(r["i"], r["j"]): r["w"] for r in probability.overlaps(df, weight, pairs).collect()}
    cells = [("s1", "s2"), ("s2", "s1"), ("s3", "alone"), *((s, s) for s in ("s1", "s2", "s3", "alone"))]
    assert some == {c: want[c] for c in cells}


def test_an_element_in_a_hundred_thousand_sets(spark):
    """Asked cells only: nothing is made of the sets that were not asked for."""
    own = spark.range(100_000).select(F.col("id").alias("item_set"), F.explode(F.array(F.lit(-1), F.expr("id div 2"), F.col("id") + 10**6)).alias("element"))
    pairs = spark.createDataFrame([(0, 1), (1, 0), (2, 99_999), (50, 51)], "i long, j long")
    cells = probability.overlaps(own, pairs=pairs)
    got = {(r["i"], r["j"]): r["w"] for r in cells.collect()}
    assert got[0, 1] == got[1, 0] == got[50, 51] == 2 and got[2, 99_999] == 1 and got[0, 0] == 3 and len(got) == 10
    p = {(r["i"], r["j"]): r["p"] for r in probability.conditional(cells).collect()}
    assert p[0, 1] == pytest.approx(2 / 3) and p[2, 99_999] == pytest.approx(1 / 3) and p[50, 50] == 1


def test_commit_matrix_in_blocks_is_not_shuffled_when_laid_out(spark, monkeypatch):
    """Blocks of any size give the same rows, and no shuffle comes after the row of a version becomes many."""
    rows = [(k, c, (k + c) % 5 == 0) for k in range(12) for c in range(40) if (k * 7 + c * 3) % 4 == 0]
    df = spark.createDataFrame(rows, "k long, c long, gone boolean")
    want = sorted(map(tuple, versions.commit_matrix(df, "k", "c", "gone").collect()))
    assert len(want) > 1000
    for block in (1, 3, 40):
        monkeypatch.setattr(versions, "BLOCK", block)
        got = versions.commit_matrix(df, "k", "c", "gone")
        assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and not any(w in plan.split("Generate")[0] for w in ("Join", "Aggregate", "Repartition"))
