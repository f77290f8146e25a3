"""Phrases against plain counting of every piece."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from conftest import prose
from plain_llm import as_rows
from pyspark.sql import functions as F

from bitloom.llm import collocations as c

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
        yield re.findall("[^ \t]+", piece)


def phrases(rows):
    """Counts by (lang, words) and words by lang."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, n


def plain(rows, least=10, share=50, top=2000):
    f, n = phrases(rows)
    by_lang = {}
    common = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    for (lang, words), a in common.items():
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        within = [b for (other, longer), b in common.items() if other == lang and len(words) == 2 and len(longer) == 3 and words in (longer[:2], longer[1:])]
        if not any(100 * b >= share * a for b in within):
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def made(seed, n):
    """Texts of few words with marks, line ends, tabs and odd letters."""
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "York", "École", "école", "x y", " ", "ß", "a", "1.5", "night"]
    gaps = [" "] * 14 + [". ", ", ", "\n", "\t", "  ", "\r\n", "\x0b", "!", " ;:"]
    texts = []
    for _ in range(n):
        parts = [rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 40))]
        texts.append("".join(parts))
    return texts


def test_against_plain_counting(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", None, "und", "en"]), t) for t in made(1, 400)]
    rows += [("fr", prose(i, 50)) for i in range(40)] + [("fr", prose(1, 50))] * 30
    rows += [(None, None), ("en", None), ("en", ""), ("de", " .,; \n"), ("en", "night"), ("x", "one two")]
    rows += [("long", "high sea " * 30_000), ("long", "word" * 30_000), ("long", prose(3, 40_000))]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for name in ("phrase", "n", "a", "f", "chunk", "rank", "part", "doc_id"):
        df = df.withColumn(name, F.lit(name))
    assert as_rows(c.collocations(df)) == plain(rows)
    assert as_rows(c.collocations(df, least=20, share=30, top=7)) == plain(rows, 20, 30, 7)
    assert c.collocations(df.limit(0)).count() == 0


@pytest.mark.parametrize("every,slice_bytes,most_words", [(1, 1000, 512), (3, 64, 7), (8, 40, 512), (10**9, 100, 3), (10**9, 10**6, 512)])
def test_every_cut_counts_each_phrase_once(monkeypatch, every, slice_bytes, most_words):
    """Wherever chunks and segments end, each occurrence is counted once."""
    monkeypatch.setattr(c, "EVERY", every)
    monkeypatch.setattr(c, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(c, "MOST_WORDS", most_words)
    texts = made(every, 60) + [prose(2, 400), "", None, "a b", "z" * 300 + " a b c", "one " * 300, "k" * 500]
    langs = ["en" if i % 3 else "de" for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts, pa.string())], ["lang", "text"])
    chunks = Counter()
    for out in c._parse(iter([batch])):
        chunks.update(zip(*(out.column(i).to_pylist() for i in range(3))))
    names = list(chunks)
    columns = [pa.array([k[0] for k in names]), pa.array([k[1] for k in names]), pa.array([k[2] for k in names]), pa.array(list(chunks.values()))]
    parsed = pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "last", "n"])
    want, _ = phrases(zip(langs, texts))
    for k in (1, 2, 3):
        got = Counter()
        for out in c._count(k, None)(iter([parsed])):
            for lang, phrase, f in zip(*(out.column(i).to_pylist() for i in range(3))):
                got[lang, tuple(phrase.split(" "))] += f
        assert got == {key: a for key, a in want.items() if len(key[1]) == k}


def test_equal_passages_share_chunks(spark):
    """Copies of a passage at other places of a text have the same chunks but for the ends."""
    passage = prose(9, 300)
    df = spark.createDataFrame([("en", f"{prose(i, 7)} {passage} {prose(i + 50, 5)}") for i in range(20)], "lang string, text string")
    chunks = c.dictionary(df)
    assert chunks.agg(F.max("n")).first()[0] == 20
    assert chunks.count() < 20 * 8 + 60


def test_products_beyond_64_bits(spark):
    big = 4 * 10**12
    cand = spark.createDataFrame([("en", "a b", big - 1), ("en", "a b c", big - 7)], "lang string, phrase string, a long")
    parts = spark.createDataFrame([("en", w, big + i) for i, w in enumerate(["a", "b", "c", "b c", "a b"])], "lang string, phrase string, f long")
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in c._scored(cand, parts).collect()}
    assert got["a b"] == (big, big + 1, 1_000_000 * (big - 1) ** 2 // (big * (big + 1)))
    a, cuts = big - 7, [(big, big + 3), (big + 4, big + 2)]
    score, k = min((1_000_000 * a * a // (x * y), i) for i, (x, y) in enumerate(cuts))
    assert got["a b c"] == (*cuts[k], score)
