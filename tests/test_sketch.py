import random
import string

import pytest
from pyspark.sql import functions as F
from plain_sets import coordinates, estimate, h63, registers

from bitloom.functions import hashing
from bitloom.functions.estimate import bias_points
from bitloom.operators import similarity as sim
from bitloom.operators import sketch

A = [f"string{i}" for i in range(0, 11)]
B = [f"string{i}" for i in range(3, 12)]
C = [f"string{i}" for i in range(5, 12)]


def tokens_of(spark, sets):
    rows = [(name, t) for name, items in sets.items() for t in items]
    return spark.createDataFrame(rows, "s string, t string")


def build(spark, sets, p=10):
    return sketch.build(tokens_of(spark, sets), F.col("s"), F.col("t"), p)


def collected(sketches):
    out = {}
    for r in sketches.rows.collect():
        out.setdefault(r["set_id"], {})[r["bin"]] = r["word"]
    return out


def pairs_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "set_a string, set_b string")


@pytest.mark.parametrize("p", [4, 10, 18])
def test_build_matches_plain_python(spark, p):
    got = collected(build(spark, {"A": A, "B": B}, p))
    assert got == {"A": registers(A, p), "B": registers(B, p)}


def test_hash_seed_and_non_ascii(spark):
    words = ["masha", "über", "日本", ""]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = df.select("t", hashing.token_hash(F.col("t")), hashing.token_hash(F.col("t"), 7)).collect()
    assert [tuple(r) for r in got] == [(w, h63(w), h63(w, 7)) for w in words]


@pytest.mark.parametrize("p", [4, 10, 18])
def test_low_bits_all_zero(spark, p):
    h = 5 << (64 - p)
    row = spark.range(1).select(
        hashing.bin_of(F.lit(h), p).alias("b"), hashing.word_of(F.lit(h), p).alias("w")
    ).first()
    assert (row["b"], row["w"]) == coordinates(h, p)
    assert row["w"] == 1 << (64 - p)


@pytest.mark.parametrize("p", [3, 19, "10", True])
def test_precision_out_of_range(spark, p):
    with pytest.raises(ValueError):
        build(spark, {"A": A}, p)


def test_precisions_must_match(spark):
    with pytest.raises(ValueError):
        sketch.concat(build(spark, {"A": A}, 10), build(spark, {"B": B}, 11))


def test_repeats_and_missing_tokens_change_nothing(spark):
    once, thrice = build(spark, {"A": A}), build(spark, {"A": A + A + [None] + A})
    assert collected(once) == collected(thrice)


@pytest.mark.parametrize("p", [4, 7, 10, 14, 18])
def test_estimate_matches_plain_python(spark, p):
    points = bias_points(p)
    sets = {str(n): [f"{n}-{i}" for i in range(n)] for n in (1, 10, 100, 3000, 20000)}
    got = {r["set_id"]: r["card"] for r in sketch.cards(build(spark, sets, p)).collect()}
    assert got == {k: estimate(registers(v, p), p, points) for k, v in sets.items()}


@pytest.mark.parametrize("p", [10, 12])
def test_accuracy(spark, p):
    rng = random.Random(3)
    sets = {
        str(n): ["".join(rng.choices(string.ascii_letters + string.digits, k=7)) for _ in range(n)]
        for n in (10, 15, 20, 100, 130, 5000)
    }
    for r in sketch.cards(build(spark, sets, p)).collect():
        n = int(r["set_id"])
        assert abs(r["card"] - n) <= max(4 * 1.04 / (1 << p) ** 0.5 * n, 3)


def test_empty_set_is_listed_and_estimated(spark):
    registry = spark.createDataFrame([("A",), ("Z",)], "set_id string")
    sketches = build(spark, {"A": A})
    flags = {r["set_id"]: r["is_empty"] for r in sketch.empty_sets(sketches, registry).collect()}
    assert flags == {"A": False, "Z": True}
    cards = {r["set_id"]: r["card"] for r in sketch.cards(sketches, registry).collect()}
    assert cards == {"A": estimate(registers(A), 10, bias_points(10)), "Z": estimate({}, 10, bias_points(10))}


def test_known_overlap(spark):
    sketches = build(spark, {"A": A, "B": B, "C": C})
    pairs = pairs_of(spark, ("A", "B"), ("A", "C"), ("B", "C"))
    rows = {(r["set_a"], r["set_b"]): r for r in sim.pair_cards(sketches, pairs).collect()}
    points, regs = bias_points(10), {"A": registers(A), "B": registers(B), "C": registers(C)}
    exact = {("A", "B"): (8, 12), ("A", "C"): (6, 12), ("B", "C"): (7, 9)}
    for (x, y), row in rows.items():
        a, b = regs[x], regs[y]
        both = {k: a[k] & b[k] for k in a.keys() & b.keys() if a[k] & b[k]}
        either = {k: a.get(k, 0) | b.get(k, 0) for k in a.keys() | b.keys()}
        assert row["card_intersect"] == estimate(both, 10, points)
        assert row["card_union"] == estimate(either, 10, points)
        assert abs(row["card_intersect"] - exact[x, y][0]) <= 1
        assert abs(row["card_union"] - exact[x, y][1]) <= 1


def test_binary_operations(spark):
    ra, rb = registers(A), registers(B)
    sketches, pairs = build(spark, {"A": A, "B": B}), pairs_of(spark, ("A", "B"))
    want = {
        "union": lambda x, y: x | y,
        "intersect": lambda x, y: x & y,
        "xor": lambda x, y: x ^ y,
        "comp": lambda x, y: x & ~y,
        "comp_rev": lambda x, y: y & ~x,
    }
    for op, f in want.items():
        words = {b: f(ra.get(b, 0), rb.get(b, 0)) for b in ra.keys() | rb.keys()}
        got = {r["bin"]: r["word"] for r in sim.apply_op(sketches, pairs, op).collect()}
        assert got == {b: w for b, w in words.items() if w}


def test_union_of_parts_is_the_whole(spark):
    whole = collected(build(spark, {"x": A + B + C}))
    parts = build(spark, {"A": A, "B": B, "C": C})
    assert collected(sketch.union_all(parts, F.lit("x"))) == whole


def test_intersect_all_needs_every_member(spark):
    parts = build(spark, {"A": A, "B": B, "C": C})
    members = spark.createDataFrame([("g", "A"), ("g", "B"), ("g", "C")], "group string, set_id string")
    got = collected(sketch.intersect_all(parts, members))["g"]
    ra, rb, rc = registers(A), registers(B), registers(C)
    assert got == {b: ra[b] & rb[b] & rc[b] for b in ra.keys() & rb.keys() & rc.keys() if ra[b] & rb[b] & rc[b]}


def test_laws(spark):
    assert all(r["holds"] for r in sim.set_laws(build(spark, {"A": A, "B": B, "C": C}), "A", "B", "C").collect())


@pytest.mark.parametrize("p", [4, 10])
def test_dump_and_restore(spark, p):
    sketches = build(spark, {"A": A, "B": B}, p)
    dense = sketch.dump_dense(sketches)
    assert all(len(r["words"]) == 1 << p for r in dense.collect())
    assert collected(sketch.restore(dense, p)) == collected(sketches)
    assert collected(sketch.restore(sketch.dump_sparse(sketches), p)) == collected(sketches)
    into = build(spark, {"A": C}, p)
    assert collected(sketch.restore(dense, p, into))["A"] == registers(A + C, p)


def test_thin_drops_exactly_n_bits(spark):
    sketches = build(spark, {"A": A, "B": B})
    before = {r["set_id"]: r["n_bits"] for r in sketch.meta(sketches).collect()}
    thinned = sketch.thin(sketches, 4, seed=1)
    after = {r["set_id"]: r["n_bits"] for r in sketch.meta(thinned).collect()}
    assert after == {k: n - 4 for k, n in before.items()}
    for set_id, regs in collected(thinned).items():
        full = collected(sketches)[set_id]
        assert all(w & ~full[b] == 0 for b, w in regs.items())


def test_content_id_follows_content(spark):
    ids = {r["set_id"]: r["sha1"] for r in sketch.meta(build(spark, {"A": A, "A2": A[::-1], "B": B})).collect()}
    assert ids["A"] == ids["A2"] != ids["B"]


@pytest.mark.parametrize("block", [2, 4, 256])
def test_all_pairs_any_block_size(spark, block):
    ids = spark.range(23).selectExpr("concat('s', id) AS set_id")
    got = sorted(tuple(r) for r in sim.all_pairs(ids, block).collect())
    names = sorted(f"s{i}" for i in range(23))
    assert got == sorted((a, b) for i, a in enumerate(names) for b in names[i + 1 :])


@pytest.mark.parametrize("block", [4, 256])
def test_shared_bits_any_block_size(spark, block):
    rng = random.Random(1)
    sets = {f"s{i}": [f"t{rng.randrange(60)}" for _ in range(25)] for i in range(12)}
    regs = {k: registers(v, 6) for k, v in sets.items()}
    want = {}
    for a in sets:
        for b in sets:
            n = sum((regs[a][x] & regs[b].get(x, 0)).bit_count() for x in regs[a])
            if a < b and n:
                want[a, b] = n
    got = {(r["set_a"], r["set_b"]): r["shared"] for r in sim.shared_bits(build(spark, sets, 6), block).collect()}
    assert got == want


def test_bit_indices(spark):
    df = spark.createDataFrame([(170,), (85,), (1,)], "w bigint")
    got = [r[0] for r in df.select(hashing.bit_indices(F.col("w"))).collect()]
    assert got == [[1, 3, 5, 7], [1, 3, 5, 7], [1]]
    low = [r[0] for r in df.select(hashing.set_bits(F.col("w"))).collect()]
    assert low == [[1, 3, 5, 7], [0, 2, 4, 6], [0]]


def test_empty_side_cosine_and_equal(spark):
    sketches = build(spark, {"A": A, "A2": A})
    pairs = pairs_of(spark, ("A", "A2"), ("A", "Z"), ("Y", "Z"))
    cards = sim.pair_cards(sketches, pairs).select("set_a", "set_b", sim.cosine().alias("c"))
    got = {(r["set_a"], r["set_b"]): r["c"] for r in cards.collect()}
    assert got == {("A", "A2"): pytest.approx(1.0), ("A", "Z"): 0.0}
    same = {(r["set_a"], r["set_b"]): r["is_equal"] for r in sim.equal_pairs(sketches, pairs).collect()}
    assert same == {("A", "A2"): True, ("A", "Z"): False, ("Y", "Z"): True}
