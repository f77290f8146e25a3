"""Personal data: plain patterns against plain regular expressions, disguises against planted ones."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain_llm import as_rows

from bitloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out)


PARTS = st.sampled_from([*"0123459.@+-() ab_%\n", "1.2.3.4", "999", "x@y.z", "4111 1111 1111 1111", "+1 (017) 555-7713", "٣", "é", "00255"])


@settings(max_examples=1000, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join))
def test_plain(text):
    assert sorted(pii.plain(text)) == brute(text)
    # Base spans stay, whatever the method adds.
    assert {s[:3] for s in pii.spans(text) if not s[3]} == set(brute(text))


@pytest.mark.parametrize(
    "before, find, after, kind",
    [
        ("write to ", "john.doe [at] example (dot) com", " now", "email"),
        ("", "john at example dot co dot uk", "", "email"),
        ("Ä ", "jоhn@exаmple.cоm", ".", "email"),
        ("x ", "user＠host．org", " y", "email"),
        ("x ", "us​er@ho­st.org", " y", "email"),
        ("call ", "plus one two one two five five five zero one two three four", "!", "phone"),
        ("call ", "＋1 (017) 555–7713", " ok", "phone"),
        ("ip ", "one nine two dot one six eight dot one point one", ".", "ip"),
        ("ip ", "10[.]0[.]0[.]1", ".", "ip"),
        ("card ", "٤111 1111 1111 1111", ".", "card"),
        ("card ", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", ".", "card"),
    ],
)
def test_disguises(before, find, after, kind):
    text = before + find + after
    assert (kind, len(before), len(before) + len(find), True) in pii.spans(text)


@pytest.mark.parametrize("text", ["look at the dot com boom", "one two three four", "un deux (at) home", "see point one at dawn", "Привет мир", "Ωμέγα (dot)", "a + b"])
def test_ordinary_prose_is_left_alone(text):
    assert pii.spans(text) == []


def test_planted_disguises_in_long_text(docs):
    rnd = random.Random(1)
    text = "\n".join(r["text"] or "" for r in docs.collect())
    places, out = [], []
    for i, part in enumerate(text.split(" ")):
        out.append(part)
        if i % 500 == 250:
            mail = f"user{i}{rnd.choice([' at ', ' [at] ', '(at)'])}site{i}{rnd.choice([' dot ', ' [dot] '])}org"
            mail = mail.replace(" at ", " (at) ") if " dot " not in mail else mail
            start = len(" ".join(out)) + 1
            out.append(mail)
            places.append((start, start + len(mail)))
    found = {s[1:3] for s in pii.spans(" ".join(out)) if s[0] == "email"}
    assert places and set(places) <= found


def test_long_runs_of_zeros():
    """More digits than Python turns into a number, in plain and in disguised text."""
    zeros = "0" * 5000
    for text in (f"1.2.3.{zeros}", f"{zeros}.{zeros}1.2.{zeros}255", f"1.2.3.{zeros}256", f"1.2.3.{'9' * 5000}"):
        fits = not text.endswith(("256", "9"))
        assert pii.plain(text) == ([("ip", 0, len(text))] if fits else [])
        assert [s[:3] for s in pii.spans(f"one dot two {text} \u0430 at b dot org") if s[0] == "ip" and s[1] == 12] == ([("ip", 12, 12 + len(text))] if fits else [])


def test_edge_rows(spark, docs, empty):
    rows = pii.personal_data(docs).collect()
    assert len(rows) == docs.count() and all(r["spans"] == [] for r in rows)
    assert pii.personal_data(empty).count() == 0
    one = spark.createDataFrame([(1, "a@b.c 1.2.3.4"), (1, "a@b.c 1.2.3.4"), (None, None)], "doc_id long, text string")
    got = as_rows(pii.personal_data(one))
    want = [tuple(s) for s in (("email", 0, 5, False), ("ip", 6, 13, False))]
    assert [(d, [tuple(s) for s in x]) for d, x in got] == [(1, want), (1, want), (None, [])]


def test_digest(spark, tmp_path):
    from bitloom.llm.queries import QUERIES

    text = "1.2.3.4 a@b.c +1 (017) 555-7713, 4111 1111 1111 1111"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in QUERIES["op5_personal_data"](spark, str(tmp_path)).collect()}
    joined = "ip:0:7,email:8:13,phone:14:31,card:33:52"
    assert rows[1]["spans"] == joined and rows[1]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert [rows[1][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert rows[2]["spans"] == "" and rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
