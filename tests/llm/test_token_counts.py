"""Token counts and packed windows against the tokenizer itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain_llm import as_rows
from pyspark.sql import functions as F

from bitloom.llm import packing, token_counts


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))


ODD = [
    "Hello, World!! it's WE'LL they'Re 'sam' o'clock, don't.",
    "a<|endoftext|>B <|EndOfText|> <|startoftext|>.,",
    "é H̱ İstanbul ΣΑΣ ﬁ ½ ² ß ẞ Ǆ ́x KK",
    "tab\tline\x0bform\x0cfeed\rnbsp\xa0em  \x1c \x85 end",
    "3.14 1,000 a1b2 x.y. ... ?! (a) [b] {c} word., word.) it).",
    "漢字 ひらがな 한국어 \U0001f600‍\U0001f525 ﻿",
    "WORD. Word, word; word: word! ÀÉÎ Àé. é. ÿ, ª º µ.",
    "",
    " ",
    "x" * 3000,
]
PIECES = st.sampled_from([*"aAzZ.,;:!?)('sSt<|>0 9\t\n\r éÈßİΣ̱́‍漢😀", "'s", "'LL", "<|endoftext|>", " the ", "The."])


def counted(texts):
    encoder = token_counts.pieces_of(None)
    array = pa.array(texts, pa.string())
    return [x.tolist() for x in token_counts.token_ids(array, encoder)], token_counts.token_lengths(array, encoder).tolist()


def test_odd_texts(tokenizer):
    ids, lengths = counted(ODD)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]
    assert ids == want and lengths == [len(w) for w in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=20).map("".join), min_size=1, max_size=5))
def test_any_text(tokenizer, texts):
    ids, lengths = counted(texts)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids == want and lengths == [len(w) for w in want]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_unicode(tokenizer, text):
    assert counted([text])[0] == [tokenizer.encode(text, add_special_tokens=False).ids]


def test_memory_is_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    encoder = token_counts.pieces_of(None)
    for text in ODD:
        assert token_counts.token_ids(pa.array([text]), encoder)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) < 60


def test_counts_of_edge_rows(docs, tokenizer):
    want = []
    for r in docs.collect():
        text = r["text"] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(text.encode()), n, n > 2048))
    assert as_rows(token_counts.token_counts(docs)) == sorted(want, key=repr)


def test_other_vocabulary(docs, tokenizer):
    import public_tokenizers

    path = public_tokenizers.path(token_counts.VOCABULARY)
    assert as_rows(token_counts.token_counts(docs, limit=5, path=path)) == [
        (*r[:3], r[2] > 5) for r in as_rows(token_counts.token_counts(docs))
    ]


def check_pieces(pieces, docs, tokenizer, window):
    """Exact cover of every document and of every window; the windows' ids by queue."""
    texts = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (1,))
        for r in docs.collect()
    )
    by_window = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        by_window.setdefault(p["sequence_id"], []).append(p)
    total = sum(len(t[3]) for t in texts)
    assert sorted(by_window) == list(range(-(-total // window)))
    for w, own in by_window.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or w == max(by_window) and at == total - w * window
    # Pieces of one document are put together again; repeated rows make as many documents.
    found = []
    groups = {}
    for p in pieces:
        groups.setdefault((p["doc_id"] is None, p["doc_id"] or 0, p["source"] or "", p["doc_tokens"]), []).append(p)
    for (null, d, source, n), own in groups.items():
        want = [t for t in texts if t[:3] == (null, d, source) and len(t[3]) == n]
        assert sum(p["length"] for p in own) == n * len(want)
        for start in {p["start"] for p in own}:
            for p in own:
                if p["start"] == start:
                    ids = tuple(np.frombuffer(p["ids"], "<u4").tolist())
                    assert any(t[3][start : start + p["length"]] == ids for t in want)
        found += want
    assert sorted(found) == texts


@pytest.mark.parametrize("window", [7, 64, 2048])
def test_packed_edge_rows(docs, tokenizer, window):
    pieces = packing.pack(docs, window=window)
    assert set(pieces.columns) == {"doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"}
    check_pieces(pieces.collect(), docs, tokenizer, window)


def test_mixture_is_held_in_every_window(spark, tokenizer):
    rows = [(i, f"word{i} sun moon rain " * (5 + i % 7), "abc"[min(i % 10, 2)]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    pieces = packing.pack(df, window=256).collect()
    totals, windows = {}, {}
    for p in pieces:
        totals[p["source"]] = totals.get(p["source"], 0) + p["length"]
        own = windows.setdefault(p["sequence_id"], {})
        own[p["source"]] = own.get(p["source"], 0) + p["length"]
    whole = sum(totals.values())
    served = dict.fromkeys(totals, 0)
    for w in sorted(windows)[:-1]:
        for s in totals:
            served[s] += windows[w].get(s, 0)
            # What is owed or lent never grows: it carries over exactly.
            assert abs(served[s] - (w + 1) * 256 * totals[s] / whole) <= 1.5


def test_target_shares(spark, tokenizer):
    rows = [(i, "sun moon rain " * 50, "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(df, shares={"a": 3, "b": 1}, window=128).collect()
    check_pieces(pieces, df, tokenizer, 128)
    first = {}
    for p in pieces:
        if p["sequence_id"] < 10:
            first[p["source"]] = first.get(p["source"], 0) + p["length"]
    assert first == {"a": 960, "b": 320}
    # Queue a ends first; b goes on alone, and a source without a share comes last.
    alone = packing.pack(df, shares={"a": 1}, window=128).collect()
    check_pieces(alone, df, tokenizer, 128)
    assert min(p["sequence_id"] for p in alone if p["source"] == "b") >= max(p["sequence_id"] for p in alone if p["source"] == "a")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=6), st.integers(1, 50), st.data())
def test_quotas(totals, window, data):
    shares = data.draw(st.none() | st.lists(st.integers(0, 9), min_size=len(totals), max_size=len(totals)))
    mixture = packing.Mixture(totals, shares, window)
    last = [0] * len(totals)
    for w in range(-(-sum(totals) // window) + 1):
        now = mixture.before(w)
        assert sum(now) == min(w * window, sum(totals))
        assert all(a <= b <= t for a, b, t in zip(last, now, totals))
        last = now
    assert last == totals
    for q, n in enumerate(totals):
        at = 0
        for start, length, _, _ in mixture.cuts(q, 0, n):
            assert start == at
            at += length
        assert at == n


def test_empty(empty):
    assert token_counts.token_counts(empty).count() == 0
    assert packing.pack(empty).count() == 0


def test_digest_columns(docs):
    row = packing.pack(docs).withColumn("crc", F.crc32("ids")).first()
    assert row["crc"] == zlib.crc32(row["ids"])
