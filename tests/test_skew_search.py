import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import hashing
from bitloom.operators import search, skew


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key."""
    rng = random.Random(5)
    rows = [(("hot" if i % 3 == 0 else f"k{rng.randrange(40)}"), i, rng.choice("abcd")) for i in range(3000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, v string").withColumn("b", F.floor(F.col("t") / 50)), rows


def sequences(rows):
    by_key = defaultdict(list)
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        by_key[k].append((t, v))
    return by_key


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_splits_hot_keys_without_changing_the_join(spark, hot, how):
    df, _ = hot
    dims = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40, 2)], "k string, d int")
    got = skew.lookup(df, dims, ["k"], how, hot_rows=500, salts=7).select("k", "t", "v", "d")
    want = df.join(dims, "k", how).select("k", "t", "v", "d")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_following_across_buckets(hot):
    df, rows = hot
    got = {(r["k"], r["t"]): r["next_v"] for r in skew.following(df, ["k"], "b", ["t"], ["v"]).collect()}
    want = {}
    for k, seq in sequences(rows).items():
        for i, (t, _) in enumerate(seq):
            want[k, t] = seq[i + 1][1] if i + 1 < len(seq) else None
    assert got == want


def test_positions(hot):
    df, rows = hot
    got = {(r["k"], r["t"]): r["pos"] for r in skew.positions(df, ["k"], "b", [F.col("t")]).collect()}
    assert got == {(k, t): i for k, seq in sequences(rows).items() for i, (t, _) in enumerate(seq)}


@pytest.mark.parametrize("n, bucket_rows", [(1, 4), (3, 4), (4, 4), (11, 64), (5, 4096)])
def test_ngrams_of_long_keys(hot, n, bucket_rows):
    df, rows = hot
    got = {(r["k"], r["pos"]): "".join(r["items"]) for r in search.ngrams(df, "k", "t", "v", n, bucket_rows).collect()}
    want = {}
    for k, seq in sequences(rows).items():
        values = [v for _, v in seq]
        for i in range(len(values) - n + 1):
            want[k, i] = "".join(values[i : i + n])
    assert got == want


def test_ngrams_longer_than_input(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "k string, t int, v string")
    assert search.ngrams(df, "k", "t", "v", 3).isEmpty()


def test_ngrams_keep_missing_values_and_any_order(spark):
    rows = [("a", "2024-01-03", "z"), ("a", "2024-01-01", None), ("a", "2024-01-02", "y"), ("a", "2024-01-04", None)]
    df = spark.createDataFrame(rows, "k string, t string, v string")
    got = {r["pos"]: r["items"] for r in search.ngrams(df, "k", "t", "v", 2).collect()}
    assert got == {0: [None, "y"], 1: ["y", "z"], 2: ["z", None]}


def test_rank_goes_by_the_whole_score(spark):
    corpus = spark.createDataFrame([(1, [1.0 + 2e-9]), (2, [1.0 + 1e-9])], "id long, vec array<double>")
    queries = spark.createDataFrame([(0, [1.0])], "id long, vec array<double>")
    got = search.nearest(corpus, queries, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 1] and [r["score"] for r in got] == [0.0, 0.0]


def test_word_filter_goes_by_whole_words_in_any_script(spark):
    rows = [("the end",), ("The end",), ("éthe",), ("XtheY",), ("a,the.b",), (None,), ("the2",)]
    got = search.word_filter(spark.createDataFrame(rows, "t string"), "t", "the").collect()
    assert {r["t"] for r in got} == {"the end", "The end", "a,the.b"}


def vectors(spark, n, seed, dim=8):
    rng = np.random.default_rng(seed)
    m = np.round(rng.normal(size=(n, dim)), 3)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, vec array<double>")
    return df, m


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("block_numbers", [search.BLOCK_NUMBERS, 64])
def test_nearest_in_any_blocks_against_brute_force(spark, metric, block_numbers):
    corpus, x = vectors(spark, 200, 1)
    queries, q = vectors(spark, 10, 2)
    got = search.nearest(corpus, queries, 5, metric, block_numbers=block_numbers).collect()
    found = {(r["query_id"], r["rank"]): r["id"] for r in got}
    for i, v in enumerate(q):
        if metric == "l2":
            s = np.sqrt(((x - v) ** 2).sum(1))
        elif metric == "ip":
            s = 1 - x @ v
        else:
            s = 1 - (x @ v) / np.sqrt((x**2).sum(1) * (v**2).sum())
        best = sorted(range(len(x)), key=lambda j: (s[j], j))[:5]
        assert [found[i, r] for r in range(1, 6)] == best


def test_nearest_k_larger_than_corpus_and_no_queries(spark):
    corpus, _ = vectors(spark, 4, 1)
    queries, _ = vectors(spark, 2, 2)
    assert search.nearest(corpus, queries, 10).count() == 8
    assert search.nearest(corpus, queries.limit(0), 10).isEmpty()
    with pytest.raises(ValueError):
        search.nearest(corpus, queries, 1, "hamming")


def test_weighted_sample(spark):
    terms = [("term1", 10), ("term2", 20), ("term3", 30), ("term4", 25), ("term5", 15), ("never", 0)]
    df = spark.createDataFrame(terms, "term string, tf long")
    rows = search.weighted_sample(df, "term", "tf", 4000, seed=1).collect()
    assert sorted(r["draw"] for r in rows) == list(range(4000))
    counts = Counter(r["term"] for r in rows)
    assert "never" not in counts
    for term, tf in terms[:-1]:
        assert abs(counts[term] / 4000 - tf / 100) < 0.04
    again = search.weighted_sample(df.repartition(3), "term", "tf", 4000, seed=1).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_sample_keys(spark):
    keys = spark.range(50).select(F.col("id").alias("k"))
    rows = search.sample_keys(keys, "k", 2000, seed=2).collect()
    assert len(rows) == 2000 and {r["key"] for r in rows} == set(range(50))


def test_samples_follow_the_line_of_hashes(spark):
    """Each draw takes the item at its point of the line, as a walk over the whole line finds it."""
    rng = np.random.default_rng(0)
    weights = {f"t{i}": int(w) for i, w in enumerate(rng.integers(0, 50, 3000))} | {"heavy": 40_000}
    df = spark.createDataFrame(list(weights.items()), "term string, tf long").repartition(5)
    hashed = df.where("tf > 0").select("term", "tf", hashing.token_hash(F.col("term")).alias("h")).collect()
    line = [t for _, t, w in sorted((r["h"], r["term"], r["tf"]) for r in hashed) for _ in range(w)]
    points = {r["draw"]: r["h"] % len(line) for r in search.draws(spark, 500, 4).collect()}
    got = {r["draw"]: r["term"] for r in search.weighted_sample(df, "term", "tf", 500, seed=4).collect()}
    assert got == {d: line[at] for d, at in points.items()}
    assert 0.2 < sum(t == "heavy" for t in got.values()) / 500 < 0.5
    assert search.weighted_sample(df.limit(0), "term", "tf", 5).isEmpty()


def test_sampled_keys_that_repeat_or_are_missing(spark):
    keys = spark.createDataFrame([("a",)] * 700 + [("b",)] * 200 + [(None,)] * 100, "k string")
    rows = [r["key"] for r in search.sample_keys(keys, "k", 3000, seed=5).collect()]
    counts = Counter(rows)
    assert len(rows) == 3000 and all(abs(counts[k] / 3000 - p) < 0.04 for k, p in (("a", 0.7), ("b", 0.2), (None, 0.1)))
