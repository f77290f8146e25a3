"""Shards against a search over every capacity."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from bitloom.llm import sharding


def greedy(sizes, capacity):
    cuts, used = [], 0
    for s in sizes:
        if not cuts or used + s > capacity:
            cuts.append(0)
            used = 0
        used += s
        cuts[-1] += s
    return cuts


@pytest.mark.parametrize("cells", [16, 4096])
@pytest.mark.parametrize("seed", range(2))
def test_smallest_capacity(spark, monkeypatch, seed, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    rnd = random.Random(seed)
    sizes = [rnd.choice([1, 2, 7, 100, 5000 if seed % 2 else 90]) for _ in range(rnd.randrange(1, 400))]
    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append((at,))
    df = spark.createDataFrame(ends, "end long")
    for shards in (1, 7):
        best = max(sizes)
        while len(greedy(sizes, best)) > shards:
            best += 1
        capacity, cuts = sharding.smallest_capacity(df, at, max(sizes), shards)
        assert capacity == best and cuts[-1] == at and len(cuts) <= shards
        assert max(b - a for a, b in zip([0, *cuts], cuts)) <= best and {c for c in cuts} <= {e for (e,) in ends}


def test_edge_rows(docs):
    rows = sharding.minimax_shards(docs, shards=4).collect()
    source = docs.collect()
    key = lambda d, s, c: (d is None, d or 0, s, c)
    want = [key(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in source]
    assert sorted(key(r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(want)
    by_text = {}
    for r in rows:
        by_text.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for k, s in by_text.items() if k != (1, 0))  # null and empty are two groups
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for r in source:
        first, size = groups.get(r["text"], (None, 0))
        d = r["doc_id"]
        first = d if first is None else first if d is None else min(first, d)
        groups[r["text"]] = (first, size + len((r["text"] or "").encode()) + 1)
    order = [s for _, s in sorted(groups.values(), key=lambda g: (g[0] is None, g[0] or 0))]
    best = max(order)
    while len(greedy(order, best)) > 4:
        best += 1
    used = {}
    for r in rows:
        used[r["shard"]] = used.get(r["shard"], 0) + r["size"]
    assert max(used.values()) == best


def test_empty(empty):
    assert sharding.minimax_shards(empty).count() == 0


def test_native(docs):
    plan = sharding.minimax_shards(docs).agg(F.max("slot"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
