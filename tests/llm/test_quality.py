"""Importance resampling: models against plain counting, and accuracy on held-out labels."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from plain_llm import as_rows
from pyspark.sql import functions as F

from bitloom.llm import quality
from bitloom.sources.tables import read_table

M = (1 << 64) - 1


def mixed(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M
    return x ^ x >> 31


def plain_grams(text):
    """Buckets of words, of pairs and of each word's byte runs."""
    words = (text or "").encode().split()
    hashes = [xxhash.xxh64_intdigest(w) for w in words]
    cut = lambda x: mixed(x & M) % quality.BUCKETS
    grams = []
    for w in words:
        w = b"\x01" + w.lower().strip(quality._MARKS) + b"\x02"
        grams.append([cut(int.from_bytes(w[i : i + 5], "big")) for i in range(len(w) - 4)])
    return [cut(h) for h in hashes], [cut(a * 3 + b) for a, b in zip(hashes, hashes[1:])], grams


TEXTS = ["a b a b c", None, "", "The the THE end.", "x " * 40 + "odd words here", "é ☃ %%% !!", "one", "word" * 3000]


def test_counts_and_worst_parts():
    batch = quality._Batch(pa.array(TEXTS, pa.string()))
    chosen = np.array([i % 2 == 0 for i in range(len(TEXTS))])
    for pick in (None, chosen):
        got = batch.counts(pick)
        for model in range(3):
            want = Counter()
            for i, t in enumerate(TEXTS):
                if pick is None or pick[i]:
                    own = plain_grams(t)[model]
                    want.update(own if model < 2 else [g for w in own for g in w])
            assert {b: got[model][b] for b in np.flatnonzero(got[model])} == dict(want)
    ratios = np.random.default_rng(0).standard_normal((3, quality.BUCKETS))
    flow, letters = batch.worst(ratios)
    for i, t in enumerate(TEXTS):
        words, pairs, grams = plain_grams(t)
        values = [ratios[0][w] + (ratios[1][pairs[j]] if j < len(pairs) else 0) for j, w in enumerate(words)]
        n = max(1, len(values) - quality.WINDOW + 1)
        assert math.isclose(flow[i], min((sum(values[j : j + quality.WINDOW]) for j in range(n)), default=0) if values else 0, abs_tol=1e-6)
        assert math.isclose(letters[i], min((sum(ratios[2][g] for g in w) for w in grams), default=0), abs_tol=1e-6)


def planted(seed=0, n=600):
    rnd = random.Random(seed)
    pool = [f"{a}{b}" for a in ("sun", "mo", "sta", "ri", "lea") for b in ("ny", "on", "rs", "ver", "ves", "der")]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(pool) for _ in range(rnd.randrange(5, 80))]
        kind = i % 10
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words[rnd.randrange(len(words))] = "vilebad" + rnd.choice(["ness", "ly", "est"])
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(kind != 0), int(kind == 1)))
    return docs, labels


def test_planted_texts(spark):
    docs, labels = planted(n=3000)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    drawn = quality.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r[0] for r in drawn.select("doc.doc_id").collect()}
    # Labelled or not, bad texts go and good ones stay.
    assert not [i for i, _ in docs if i % 10 < 2 and i in kept]
    assert len([i for i, _ in docs if i % 10 >= 2 and i in kept]) >= 0.98 * 2400


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, folder):
    """Fitted on the labels of two thirds, measured on the others."""
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    known = labels.where("doc_id % 3 <> 0")
    kept = {r[0] for r in quality.resample(docs, known).select("doc.doc_id").collect()}
    held = labels.where("doc_id % 3 = 0").collect()
    good = [r["doc_id"] in kept for r in held if r["quality"] == 1 and not r["toxic"]]
    junk = [r["doc_id"] in kept for r in held if r["quality"] == 0]
    assert np.mean(good) >= 0.97 and np.mean(junk) <= 0.2


def plain_draw(spark, docs, labels, temperature):
    """The ids drawn, by plain counting; only Spark's hash is Spark's own."""
    hashes = spark.createDataFrame(docs, "doc_id long, text string").select(
        "doc_id",
        F.xxhash64(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(2)).alias("noise"),
        F.xxhash64("doc_id", F.lit(1)).alias("fold"),
    )
    noise, fold = {}, {}
    for r in hashes.collect():
        noise[r["doc_id"]], fold[r["doc_id"]] = r["noise"], r["fold"]
    good = {i for i, quality_, toxic in labels if quality_ and not toxic}
    flat = lambda own: (own[0], own[1], [g for w in own[2] for g in w])
    grams = [plain_grams(t) for _, t in docs]
    raw, target = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
    for (i, _), own in zip(docs, grams):
        for model, buckets in enumerate(flat(own)):
            raw[model].update(buckets)
            if i in good and fold[i] % 4 > 0:
                target[model].update(buckets)
    ratios = []
    for r, t in zip(raw, target):
        scale = sum(t.values()) / max(sum(r.values()), 1)
        ratios.append({b: round(math.log((t[b] + 1) / (n * scale + 1)) * quality.GRAIN) / quality.GRAIN for b, n in r.items()})
    worst = []
    for words, pairs, letters in grams:
        values = [ratios[0][w] + (ratios[1][pairs[j]] if j < len(pairs) else 0) for j, w in enumerate(words)]
        n = max(1, len(values) - quality.WINDOW + 1)
        flow = min(sum(values[j : j + quality.WINDOW]) for j in range(n)) if values else 0
        worst.append((flow, min((sum(ratios[2][g] for g in w) for w in letters), default=0)))
    held = [w for (i, _), w in zip(docs, worst) if i in good and fold[i] % 4 == 0]
    cuts = [np.percentile([w[part] for w in held], [quality.LOSS * 100, 50]) for part in (0, 1)]
    weights = [min((w[p] - cuts[p][0]) / (cuts[p][1] - cuts[p][0]) if cuts[p][1] > cuts[p][0] else 1.0 for p in (0, 1)) for w in worst]
    draws = {}
    for (i, _), weight in zip(docs, weights):
        share = (noise[i] % (1 << 52) + 0.5) / (1 << 52)
        draws[i] = weight - temperature * math.log(-math.log(share))
    return set(sorted(draws, key=lambda i: -draws[i])[: sum(w >= 0 for w in weights)])


@pytest.mark.parametrize("temperature", [quality.TEMPERATURE, 1.0])
def test_drawn_ids_by_brute_force_in_any_partitions(spark, temperature):
    docs, labels = planted(5, 400)
    docs.append((400, None))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_draw(spark, docs, labels, temperature)
    assert 0 < len(want) < len(docs)
    for parts in (1, 7):
        drawn = quality.resample(df.repartition(parts), known, temperature=temperature).select("doc.doc_id").collect()
        assert len(drawn) == len(want) and {r[0] for r in drawn} == want


def test_edge_rows(spark, docs, empty):
    rows = [(1, 1, 0), (2, None, 0), (3, 0, 1), (None, 1, 0), (3, 1, 0), (4, 1, None), (77, 1, 0), (10, 1, 0), (11, 1, 0), (12, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    drawn = quality.resample(docs, labels)
    assert drawn.select("doc.*").columns == docs.columns
    assert set(as_rows(drawn, "doc.doc_id", "doc.text")) <= set(as_rows(docs, "doc_id", "text"))
    # Without labels nothing can be told apart, and every row stays.
    everything = quality.resample(docs, labels.limit(0))
    assert as_rows(everything, "doc.doc_id", "doc.text") == as_rows(docs, "doc_id", "text")
    assert quality.resample(empty, labels).count() == 0


def test_gumbel_top_k_is_a_weighted_draw_of_k(spark):
    docs, labels = planted(1, 300)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    cold = quality.resample(df, labels).agg(F.count("*"), F.min("log_weight")).first()
    warm = quality.resample(df, labels, temperature=100.0).agg(F.count("*"), F.min("log_weight")).first()
    assert cold[0] == warm[0]  # the number drawn stays
    assert warm[1] < 0 <= cold[1] + 0.2  # and heat lets light texts in


def test_sums_reach_the_driver_as_columns(spark):
    # Nearly every bucket of each model, without the session's Arrow setting.
    word = F.hex(F.xxhash64("id", F.col("x")))
    words = spark.range(4000).select("id", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("x")).withColumn("w", word)
    docs = words.groupBy(F.col("id").alias("doc_id")).agg(F.array_join(F.collect_list("w"), " ").alias("text"))
    labelled = spark.createDataFrame([(1, True, True)], "id long, good boolean, fit boolean")
    arrow = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    tracemalloc.start()
    try:
        ratios = quality.log_ratios(docs, labelled, "doc_id", "text")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", arrow)
    assert np.count_nonzero(ratios) > 200_000
    assert peak < 60_000_000
