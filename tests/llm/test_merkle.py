"""The manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from plain_llm import as_rows
from pyspark.sql import functions as F

from bitloom.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    text = ""
    for value in (row[c] for c in COLUMNS):
        text += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return sha(text)


def tree(nodes):
    """The top, and for each node its proof as runs of (place, whole run)."""
    steps = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a - a % 8 : a - a % 8 + 8]
            steps[i].append((a % 8, run))
            at[i] = a // 8
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], steps


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, within = [], {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        top, within[g] = tree([leaf_of(r) for r in groups[g]])
        tops.append(top)
    root, beyond = tree(tops)
    out = []
    for i, g in enumerate(order):
        for row, steps in zip(groups[g], within[g]):
            steps = steps + beyond[i]
            others = "".join(d for at, run in steps for j, d in enumerate(run) if j != at)
            now = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None:
                now["text"] = row["text"].translate(str.maketrans(UPPER, LOWER))
            node = leaf_of(now)
            for at, run in steps:
                node = sha("".join([*run[:at], node, *run[at + 1 :]]))
            out.append((row["doc_id"], leaf_of(row), tops[i], root, sha(others), node, node == root))
    return sorted(out, key=repr)


def query(df):
    from bitloom.llm.queries import merkle_rows

    return merkle_rows(df)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    assert as_rows(query(df.repartition(parts))) == plain(rows)


def row(i, text="Some Text", lang="en", source="s"):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": None if text is None else len(text)}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513, 4097])
def test_sizes(spark, n):
    check(spark, [row(i * 7 + 1, f"Text {i}") for i in range(n)])


def test_groups_nulls_ties_and_long_texts(spark):
    rows = [row(i, f"Words {i}", lang) for i, lang in enumerate(["en", "de", "é", "", None, "zz", "a", "B", "ab", "x"] * 90)]
    rows += [row(None), row(None, None), row(5, "other"), row(5, "other"), row(5), row(6, None, None, None), row(7, "")]
    rows += [row(3, "A" * 300_000), row(12, "ÄÖÜ Abc ☃ \U0001f600"), row(9, "LONG " * 50_000, "solo")]
    check(spark, rows, 7)


def test_tops_of_many_groups(spark):
    check(spark, [row(i, "X", f"g{i % 600}") for i in range(700)])


def test_empty_table_and_clashing_names(spark):
    rows = [row(i) for i in range(20)]
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    for name in ("id", "grp", "pos", "part", "block", "leaf", "changed", "n", "root", "way", "digest", "of"):
        df = df.withColumn(name, F.lit(name))
    assert as_rows(query(df)) == plain(rows)
    assert query(df.limit(0)).count() == 0


def test_proofs_fold_to_the_root(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    for r in merkle.manifest(df, ["doc_id"], with_proof=True).collect():
        assert merkle.fold(r["leaf"], r["proof"]) == r["root"] and r["verified"]
        assert sha(merkle.siblings(r["proof"])) == r["proof_sha256"]
        assert merkle.fold(sha("forged"), r["proof"]) != r["root"]
