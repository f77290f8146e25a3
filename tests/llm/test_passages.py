"""Benchmark items and license notices against a look at every window."""

from collections import Counter

import pytest
from conftest import prose
from plain_llm import as_rows
from pyspark.sql import functions as F

from bitloom.llm import decontaminate, license_scan
from bitloom.llm.common import bare


def words(text):
    return [w for w in (bare(x) for x in (text or "").encode().split()) if w]


def runs(own, k=5):
    return [tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))] if own else []


def plain_leaks(docs, items, similarity=0.8):
    found = {}
    for d, text in docs:
        own = words(text)
        for item, wanted in items:
            want = Counter(runs(words(wanted)))
            n = len(words(wanted))
            if not n or n < 5 and len(own) != n:
                continue  # fewer words than a shingle match only as a whole text
            for at in range(max(1, len(own) - n + 1)):
                window = Counter(runs(own[at : at + n]))
                both = (window & want).total()
                s = both / (window.total() + want.total() - both)
                if s >= similarity and s > found.get((d, text, item), (0,))[0]:
                    found[d, text, item] = (s, at, min(n, len(own)))
    return sorted(((k[0], k[2], *v) for k, v in found.items()), key=repr)


ITEMS = [(i, prose(100 + i, n)) for i, n in enumerate([3, 5, 6, 9, 15, 40, 60, 200])] + [
    (50, ""), (51, None), (None, prose(120, 30)), (52, prose(105, 40)), (53, "sun sun sun sun sun sun sun sun sun"),
]


def planted():
    rows = []
    for i, (item, text) in enumerate(ITEMS):
        text = text or ""
        rows.append((i, prose(200 + i, 70) + " " + text.upper().replace(" ", ",  ") + "\n" + prose(300 + i, 50)))
        rows.append((100 + i, text))
        # One word other, a word left out at either end, and half of it.
        w = text.split()
        if len(w) > 10:
            rows.append((200 + i, prose(400 + i, 30) + " " + " ".join([*w[: len(w) // 2], "other", *w[len(w) // 2 + 1 :]]) + " end"))
            rows.append((300 + i, " ".join(w[1:]) + " " + prose(500 + i, 20)))
            rows.append((400 + i, " ".join(w[: len(w) // 2])))
    return rows + [(7, None), (8, ""), (None, ITEMS[6][1]), (9, "sun " * 50), (9, "sun " * 50)]


def test_leaks(spark, docs):
    rows = planted() + [(r["doc_id"], r["text"]) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("words", F.lit(1)).withColumn("item", F.lit(2))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n", F.lit(0))
    got = as_rows(decontaminate.leaks(df, items).drop("digest"))
    want = plain_leaks(sorted(set(rows), key=repr), ITEMS)
    # Equal and nearly equal passages: none is missed, none made up.
    assert got == want and len(want) > 15


def test_decontaminated(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    gone = {t for t in {t for _, t in rows} if plain_leaks([(0, t)], ITEMS)}
    left = decontaminate.decontaminate(df, items)
    assert left.columns == df.columns
    assert as_rows(left, "doc_id", "text") == sorted((r for r in rows if r[1] not in gone), key=repr)
    assert decontaminate.decontaminate(df, items.limit(0)).count() == len(rows)
    assert decontaminate.leaks(df.limit(0), items).count() == 0


def test_blocks_cover_the_radius(spark):
    import random

    rnd = random.Random(2)
    for _ in range(20):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        signed = [x - (1 << 64) if x >> 63 else x for x in (a, b)]
        df = decontaminate._blocks(spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "i int, fp long"))
        assert df.groupBy("block", "value").count().where("count = 2").count() > 0


def plain_notices(docs, texts, containment=0.8):
    found = set()
    for d, text in docs:
        own = runs(words(text))
        for name, notice in texts:
            want = set(runs(words(notice)))
            if want and len(want & set(own)) / len(want) >= containment:
                found.add((d, name))
    return sorted(found, key=repr)


@pytest.mark.parametrize("own", [True, False])
def test_notices(spark, docs, own):
    names = sorted(license_scan.NOTICES.items())
    if own:
        names += [("short", "sun moon"), ("none", "..."), ("empty", ""), ("long", prose(7, 90)), (None, "gate lamp door hill road"), ("null", None)]
    rows = []
    for i, (_, text) in enumerate(names):
        text = text or ""
        w = text.split()
        rows += [(i, prose(600 + i, 40 + i) + "\n" + text.lower() + ".\n" + prose(700 + i, 30)), (50 + i, text), (100 + i, " ".join(w[: len(w) // 2]))]
        rows.append((150 + i, prose(i, 5) + " " + " ".join([*w[:-1], "changed"]) + " " + prose(800 + i, 9)))
    rows += [(200, None), (None, names[0][1]), (201, ""), (202, " ".join(t or "" for _, t in names))]
    rows += [(300 + i, r["text"]) for i, r in enumerate(docs.collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("license", F.lit(0)).withColumn("window", F.lit(0))
    texts = spark.createDataFrame(names, "license string, text string") if own else None
    got = license_scan.license_notices(df, texts)
    assert as_rows(got, "doc_id", "license") == plain_notices(rows, names)
    assert got.where("containment < 0.8 OR containment > 1").count() == 0
    assert license_scan.license_notices(df.limit(0), texts).count() == 0
    if own:
        assert license_scan.license_notices(df, texts.limit(0)).count() == 0
