"""Near copies against a comparison of all pairs."""

import random

import pytest
import xxhash
from conftest import prose
from plain_llm import as_rows, union_find

from bitloom.llm import simhash_dedup
from bitloom.llm.components import components


def plain_print(text, k=3):
    words, word = [], b""
    for c in (text or "").encode():
        if c == 0x20 or 9 <= c <= 13:
            words += [word] if word else []
            word = b""
        else:
            word += bytes([c + 32 if 65 <= c <= 90 else c])
    words += [word] if word else []
    runs = [words[i : i + k] for i in range(len(words) - k + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    return union_find(len(prints), pairs)


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "Ä b C d É f", "a  b\tc\x0bd e a b c", "x" * 9999])
@pytest.mark.parametrize("k", [3, 5])
def test_fingerprint(text, k):
    assert simhash_dedup.fingerprint(text, k) & (1 << 64) - 1 == plain_print(text, k)


def test_edge_rows(docs):
    got = as_rows(simhash_dedup.near_copies(docs))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [plain_print(t) for _, t in rows]
    root = plain_components(prints)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    want = [(d, f"{p:016x}", least.get(root[i])) for i, ((d, _), p) in enumerate(zip(rows, prints))]
    assert got == sorted(want, key=repr)


def alike(a, b, k=5):
    def runs(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}

    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b)


def check_one_of_each(rows, kept):
    """Rows that go are near copies of other rows; rows without copies stay, and one of equal texts."""
    gone = list(rows)
    for r in kept:
        gone.remove(r)
    for i, r in enumerate(gone):
        others = kept + gone[:i] + gone[i + 1 :]
        assert any(alike(s[1], r[1]) >= 0.8 for s in others), r
    texts = [t for _, t in kept]
    assert len({tuple((t or "").encode().lower().split()) for t in texts}) == len(texts)  # one of equal texts
    return gone


def test_one_of_each(docs):
    kept = simhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_one_of_each(rows, [(r["doc_id"], r["text"]) for r in kept.collect()])


def test_planted_near_copies(spark):
    rnd = random.Random(8)
    vocabulary = [f"{w}{n}" for n in range(40) for w in prose(3, 100).split()]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(150 + i)) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:30]):
        for c in range(40 if i == 0 else 3):
            w = t.split()
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(["other", "word", "Sun,", "moon."])
            rows.append((1000 + 50 * i + c, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = [tuple(r) for r in simhash_dedup.one_of_each(df, tables=8).collect()]
    gone = check_one_of_each(rows, kept)
    assert {r for r in rows if r[0] < 1000} <= set(kept)
    near = [r for r in rows if r[0] >= 1000 and alike(r[1], texts[(r[0] - 1000) // 50]) >= 0.8]
    assert len(near) > 60 and len([r for r in near if r in gone]) >= 0.9 * len(near)


def test_empty(empty):
    assert simhash_dedup.near_copies(empty).count() == 0
    assert simhash_dedup.one_of_each(empty).count() == 0


@pytest.mark.parametrize("joined", [1, 4, 32])
def test_links_of_crowded_and_sparse_keys(spark, monkeypatch, joined):
    """Fingerprints in tight balls, chains across halves and far ones, at any split point."""
    monkeypatch.setattr(simhash_dedup, "JOINED", joined)
    rnd = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        base = rnd.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rnd.randrange(7)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    x = rnd.getrandbits(64)
    for _ in range(40):
        x ^= 1 << rnd.randrange(32) | 1 << 32 + rnd.randrange(32)
        prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash_dedup.links(spark.createDataFrame([(0, p) for p in signed], "t int, fp long")).select("a", "b").collect()
    place = {p: i for i, p in enumerate(signed)}
    got = union_find(len(prints), [(place[a], place[b]) for a, b in edges])
    want = plain_components(prints)
    assert got == want
    # Every link is a true one.
    assert all((prints[place[a]] ^ prints[place[b]]).bit_count() <= 2 for a, b in edges)


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 150)]
    pairs += [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(180)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    nodes = sorted({n for a, b in pairs if a != b for n in (a, b)})
    place = {n: i for i, n in enumerate(nodes)}
    root = union_find(len(nodes), [(place[a], place[b]) for a, b in pairs if a != b])
    assert got == {n: nodes[root[place[n]]] for n in nodes}


@pytest.mark.parametrize("tables", [2, 8, simhash_dedup.TABLES])
def test_copies_behind_a_row_of_the_same_words(spark, tables):
    """Copies go also where the first row of the same words, or of none, is not alike to them."""
    a = prose(1, 60).split()
    texts = [" ".join(a), " ".join(a[::-1]), " ".join(a[::-1]), "", "### ###", "### ###"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kept = simhash_dedup.one_of_each(df, tables=tables).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 1, 3, 4]


def plain_groups(texts):
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j]) >= 0.8]
    return union_find(len(texts), pairs)


def test_chains_through_rows_that_go(spark):
    """A group is a chain of alike pairs, whether or not its inner rows stay."""
    words, texts = [f"w{i}" for i in range(200)], []
    for step in range(12):
        words[step * 15 : step * 15 + 2] = [f"other{step}", f"more{step}"]
        texts += [" ".join(words)] * 2
    assert alike(texts[0], texts[-1]) < 0.5 and set(plain_groups(texts)) == {0}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert [r["doc_id"] for r in simhash_dedup.one_of_each(df, tables=20).collect()] == [0]


def edited_apart(rnd, words, n, edits):
    """Copies with other edits each: alike to the words, hardly to each other."""
    out = []
    for c in range(n):
        w = list(words)
        for at in rnd.sample(range(0, len(w), 5), edits):
            w[at] = f"edit{c}at{at}"
        out.append(" ".join(w))
    return out


def test_crowded_group_whose_first_row_is_not_alike(spark):
    """More near copies than are joined at once, each edited apart, behind a row that only resembles them."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts = edited_apart(rnd, words, 1, 14) + edited_apart(rnd, words, 80, 4) + [" ".join(words)]
    assert max(alike(texts[0], t) for t in texts[1:]) < 0.8
    want = plain_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kept = {r["doc_id"] for r in simhash_dedup.one_of_each(df, tables=20).collect()}
    assert kept == {want.index(r) for r in set(want)}


def test_every_alike_pair_of_a_key_is_met(spark):
    """One key of rows in several groups and alone, more than any round asks: groups are those of all pairs."""
    rnd = random.Random(6)
    texts = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(100)]
        texts += edited_apart(rnd, words, 12, 2) + [" ".join(words)]
    texts += [" ".join(f"alone{i}at{j}" for j in range(90 + i)) for i in range(30)]
    rnd.shuffle(texts)
    rows = [(i, t, len(set(zip(*(t.split()[j:] for j in range(5)))))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row long, text string, size int")
    members = df.selectExpr(
        "0 as t", "0L as key", "row", "size", f"{len(rows)}L as n", f"struct(0L as row, {rows[0][2]} as size) as first",
        "cast(row * 37 % 101 as double) / 101 as place",
    )
    edges = simhash_dedup._linked(members, df.select("row", "text"), 5, 0.8).collect()
    assert union_find(len(texts), [tuple(r) for r in edges]) == plain_groups(texts)
    assert all(alike(texts[a], texts[b]) >= 0.8 for a, b in edges)


def test_planted_near_copies_by_default(spark):
    """What the pipeline runs finds at least 0.9 of pairs that are only just alike."""
    rnd = random.Random(9)
    texts = []
    for i in range(150):
        words = [f"d{i}w{j}" for j in range(150)]
        edited = list(words)
        for at in rnd.sample(range(0, 150, 5), 3):
            edited[at] = f"d{i}other{at}"
        texts += [" ".join(words), " ".join(edited)]
    near = [i for i in range(150) if 0.8 <= alike(texts[2 * i], texts[2 * i + 1]) < 0.85]
    assert len(near) > 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in simhash_dedup.one_of_each(df).collect()}
    assert kept.issuperset(range(0, 300, 2))
    assert len([i for i in near if 2 * i + 1 not in kept]) >= 0.9 * len(near)


def test_linked_fingerprints_are_candidates(spark, monkeypatch):
    """Near copies whose fingerprints are two bits apart at most go without any MinHash band; what only looks alike stays."""
    monkeypatch.setattr(simhash_dedup, "_keyed_rows", lambda left, shared: left.selectExpr("row", "size", "0 t", "0L key").limit(0))
    rnd, texts = random.Random(11), []
    for i in range(60):
        words = [f"d{i}w{j}" for j in range(1500)]
        edited = list(words)
        edited[rnd.randrange(1500)] = "other"
        texts += [" ".join(words), " ".join(edited)]
    prints = [plain_print(t) for t in texts]
    close = [i for i in range(0, 120, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 2]
    assert len(close) > 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in simhash_dedup.one_of_each(df).collect()}
    assert kept == set(range(120)) - {i + 1 for i in close}
