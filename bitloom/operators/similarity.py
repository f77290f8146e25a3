"""Operations on pairs of sketches: algebra, change, similarity, laws.

Every operation takes the pairs it should work on as a table ``(set_a, set_b)``
and lines up both register sets with one union-tagged aggregate, so the work
grows with the pairs asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import estimate
from bitloom.operators.sketch import Sketches, cards, filled, meet, pow_sum, union_all

PAIR = ["set_a", "set_b"]

# Register arithmetic of each binary operation; 0 stands for an empty register.
WORD_OPS = {
    "union": lambda a, b: a.bitwiseOR(b),
    "intersect": lambda a, b: a.bitwiseAND(b),
    "xor": lambda a, b: a.bitwiseXOR(b),
    "comp": lambda a, b: a.bitwiseAND(F.bitwise_not(b)),
    "comp_rev": lambda a, b: b.bitwiseAND(F.bitwise_not(a)),
}


def all_pairs(ids: DataFrame, block: int = 256) -> DataFrame:
    """Each unordered pair of distinct set ids once, as ``(set_a, set_b)``, set_a < set_b.

    Ids fall into hash blocks of about ``block``; each pair of blocks meets in an
    equi-join on the block pair, so no task holds more than two blocks and the
    output, n(n-1)/2 rows, is the only thing that grows with n squared.
    """
    ids = ids.select("set_id").distinct()
    blocks = max(1, -(-ids.count() // block))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    keyed = (
        ids.withColumn("mine", F.pmod(F.xxhash64("set_id"), F.lit(blocks)))
        .select("set_id", "mine", other.alias("other"))
        .select("set_id", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    )
    a = keyed.select("lo", "hi", F.col("mine").alias("mine_a"), F.col("set_id").alias("set_a"))
    b = keyed.select("lo", "hi", F.col("mine").alias("mine_b"), F.col("set_id").alias("set_b"))
    once = (F.col("lo") == F.col("hi")) | (F.col("mine_a") != F.col("mine_b"))
    return a.join(b, ["lo", "hi"]).where((F.col("set_a") < F.col("set_b")) & once).select(*PAIR)


def align(sketches: Sketches, pairs: DataFrame) -> DataFrame:
    """``(set_a, set_b, bin, word_a, word_b)`` for every register either side has."""
    sides = pairs.select(*PAIR).distinct().select(
        *PAIR,
        F.inline(
            F.array(
                F.struct(F.col("set_a").alias("set_id"), F.lit(True).alias("left")),
                F.struct(F.col("set_b").alias("set_id"), F.lit(False).alias("left")),
            )
        ),
    )
    word, left = F.col("word"), F.col("left")
    return (
        meet(sides, sketches)
        .groupBy(*PAIR, "bin")
        .agg(
            F.bit_or(F.when(left, word).otherwise(F.lit(0))).alias("word_a"),
            F.bit_or(F.when(left, F.lit(0)).otherwise(word)).alias("word_b"),
        )
    )


def apply_op(sketches: Sketches, pairs: DataFrame, op: str) -> DataFrame:
    """Register-wise result ``(set_a, set_b, bin, word)`` of one binary operation."""
    word = WORD_OPS[op](F.col("word_a"), F.col("word_b"))
    return align(sketches, pairs).select(*PAIR, "bin", word.alias("word")).where("word <> 0")


def as_sketches(result: DataFrame, set_id: Column, p: int) -> Sketches:
    """Name the result sketch of each pair."""
    return Sketches(result.select(set_id.alias("set_id"), "bin", "word"), p)


def change_parts(sketches: Sketches, pairs: DataFrame) -> DataFrame:
    """Deleted, retained and added registers, with set_a as old and set_b as new.

    One alignment feeds all three parts: ``(set_a, set_b, part, bin, word)``.
    """
    a, b = F.col("word_a"), F.col("word_b")
    parts = F.array(
        *(
            F.struct(F.lit(part).alias("part"), WORD_OPS[op](a, b).alias("word"))
            for part, op in (("deleted", "comp"), ("retained", "intersect"), ("added", "comp_rev"))
        )
    )
    return align(sketches, pairs).select(*PAIR, "bin", F.inline(parts)).where("word <> 0")


def word_views(names: Sequence[str] | None = None) -> dict[str, Column]:
    """Both sides and their combinations as register words, all or the named ones."""
    a, b = F.col("word_a"), F.col("word_b")
    views = {"a": lambda: a, "b": lambda: b} | {n: lambda op=op: op(a, b) for n, op in WORD_OPS.items()}
    return {n: views[n]() for n in (names or views)}


def pair_cards(sketches: Sketches, pairs: DataFrame, views: Sequence[str] | None = None) -> DataFrame:
    """Estimates ``card_*`` and bit counts ``bits_*`` of the views, one row per pair."""
    return cards_of_aligned(align(sketches, pairs), sketches.p, PAIR, views)


def cards_of_aligned(aligned: DataFrame, p: int, by: list[str], views: Sequence[str] | None = None) -> DataFrame:
    """The same from rows that already carry ``word_a`` and ``word_b``."""
    words = word_views(views)
    sums = []
    for name, word in words.items():
        sums += [
            pow_sum(word).alias(f"s_{name}"),
            filled(word).alias(f"n_{name}"),
            F.sum(F.bit_count(word)).alias(f"bits_{name}"),
        ]
    return aligned.groupBy(*by).agg(*sums).select(
        *by,
        *(estimate.cardinality(f"s_{n}", f"n_{n}", p).alias(f"card_{n}") for n in words),
        *(f"bits_{n}" for n in words),
    )


def jaccard_pct() -> Column:
    """round(100 * intersection / union) over the columns of ``pair_cards``."""
    return F.bround(F.col("card_intersect") / F.col("card_union") * 100).cast("bigint")


def cosine() -> Column:
    """Shared bits over the geometric mean of the bit counts; 0 if a side is empty."""
    norm = F.sqrt(F.col("bits_a").cast("double") * F.col("bits_b"))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.col("bits_intersect") / norm)


def conditional(sketches: Sketches, pairs: DataFrame) -> DataFrame:
    """P(A), P(B), P(A given B), P(B given A) from the estimates of each pair.

    The universe is the union of all sets; its estimate is a one-row scalar.
    """
    sketches = sketches.once()
    everything = union_all(sketches, F.lit("U"))
    universe = cards(everything).select("card").scalar()

    def share(part, whole):
        return F.round(F.try_divide(part.cast("double"), whole), 6)

    a, b, ab, u = (F.col(c) for c in ("card_a", "card_b", "card_ab", "card_u"))
    return (
        pair_cards(sketches, pairs, ("a", "b", "intersect"))
        .select(*PAIR, "card_a", "card_b", F.col("card_intersect").alias("card_ab"), universe.alias("card_u"))
        .select(
            "*",
            share(a, u).alias("p_a"),
            share(b, u).alias("p_b"),
            share(ab, b).alias("p_a_given_b"),
            share(ab, a).alias("p_b_given_a"),
        )
    )


def equal_pairs(sketches: Sketches, pairs: DataFrame) -> DataFrame:
    """Whether both sketches of a pair have the same registers."""
    same = F.bool_and(F.col("word_a") == F.col("word_b"))
    found = align(sketches, pairs).groupBy(*PAIR).agg(same.alias("same"))
    return (
        pairs.select(*PAIR).distinct().join(found, PAIR, "left")
        .select(*PAIR, F.coalesce("same", F.lit(True)).alias("is_equal"))
    )


def shared_bits(sketches: Sketches, set_block: int = 256) -> DataFrame:
    """Number of shared bits for every pair of sets with at least one, set_a < set_b.

    This is the product of the set-by-bit matrix with its own transpose, computed
    block by block: each task holds two blocks of ``set_block`` packed sketches,
    so neither the number of sets nor one large set can overfill it.
    """
    p, sketches = sketches.p, sketches.once()
    block = max(4, min(set_block, (1 << 18) >> p))
    packed = sketches.rows.groupBy("set_id").agg(
        F.sort_array(F.collect_list(F.struct("bin", "word"))).alias("registers")
    ).select("set_id", "registers.bin", "registers.word")
    blocks = max(1, -(-sketches.rows.select("set_id").distinct().count() // block))
    keyed = packed.withColumn("mine", F.pmod(F.xxhash64("set_id"), F.lit(blocks)).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    keyed = keyed.select(
        "set_id", "bin", "word", "mine",
        F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
    )

    def block_product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key
        pdf = pdf.sort_values("set_id", kind="stable").reset_index(drop=True)
        words = np.zeros((len(pdf), 1 << p), dtype=np.int64)
        for i, (bins, values) in enumerate(zip(pdf["bin"], pdf["word"])):
            words[i, np.asarray(bins)] = np.asarray(values, dtype=np.int64)
        ids, mine = pdf["set_id"].to_numpy(), pdf["mine"].to_numpy()
        out = []
        for i in range(len(pdf) - 1):
            shared = np.bitwise_count(words[i + 1 :] & words[i]).sum(axis=1, dtype=np.int64)
            wanted = shared > 0
            if lo != hi:
                wanted &= mine[i + 1 :] != mine[i]
            out.append(pd.DataFrame({"set_a": ids[i], "set_b": ids[i + 1 :][wanted], "shared": shared[wanted]}))
        if not out:
            return pd.DataFrame({"set_a": [], "set_b": [], "shared": np.array([], dtype=np.int64)})
        return pd.concat(out, ignore_index=True)

    id_type = sketches.rows.schema["set_id"].dataType.simpleString()
    return keyed.groupBy("lo", "hi").applyInPandas(
        block_product, f"set_a {id_type}, set_b {id_type}, shared bigint"
    )


def contract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product over the shared index: rows ``(i, k, a)`` and ``(j, k, b)`` to ``(i, j, value)``.

    Both sides are summed to one entry per cell first, so a frequent ``k`` meets
    at most one row per ``i`` and per ``j``.
    """
    left = a.groupBy("i", "k").agg(F.sum("a").alias("a"))
    right = b.groupBy("j", "k").agg(F.sum("b").alias("b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def contract_diagonal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Only the cells of ``contract`` with i = j, without computing the others."""
    left = a.groupBy("i", "k").agg(F.sum("a").alias("a"))
    right = b.groupBy(F.col("j").alias("i"), "k").agg(F.sum("b").alias("b"))
    return left.join(right, ["i", "k"]).groupBy("i").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def set_laws(sketches: Sketches, a: str, b: str, c: str) -> DataFrame:
    """Ten identities of set algebra, compared register by register: ``(law, holds)``."""
    word = F.col("word")
    named = {"wa": a, "wb": b, "wc": c}
    per_bin = (
        sketches.rows.where(F.col("set_id").isin(a, b, c))
        .groupBy("bin")
        .agg(
            *(
                F.bit_or(F.when(F.col("set_id") == set_id, word).otherwise(F.lit(0))).alias(name)
                for name, set_id in named.items()
            )
        )
    )
    wa, wb, wc, zero = F.col("wa"), F.col("wb"), F.col("wc"), F.lit(0).cast("bigint")
    either, both = WORD_OPS["union"], WORD_OPS["intersect"]
    everything = either(either(wa, wb), wc)
    laws = {
        "union commutes": (either(wa, wb), either(wb, wa)),
        "intersection commutes": (both(wa, wb), both(wb, wa)),
        "union associates": (either(either(wa, wb), wc), either(wa, either(wb, wc))),
        "intersection associates": (both(both(wa, wb), wc), both(wa, both(wb, wc))),
        "intersection distributes": (both(either(wa, wb), wc), either(both(wa, wc), both(wb, wc))),
        "union distributes": (either(both(wa, wb), wc), both(either(wa, wc), either(wb, wc))),
        "union with empty": (either(wa, zero), wa),
        "intersection with universe": (both(wa, everything), wa),
        "union idempotent": (either(wa, wa), wa),
        "intersection idempotent": (both(wa, wa), wa),
    }
    held = per_bin.agg(*(F.bool_and(x == y).alias(law) for law, (x, y) in laws.items()))
    return held.select(
        F.inline(F.array(*(F.struct(F.lit(law).alias("law"), F.col(law).alias("holds")) for law in laws)))
    )


def intersect_estimate(tokens: DataFrame, set_id: Column, token: Column, pairs: DataFrame, lg_k: int = 12) -> DataFrame:
    """Theta-sketch estimates of the real intersection and difference sizes.

    Stands beside the register AND, which over-states the intersection once
    registers saturate.
    """
    thetas = tokens.select(set_id.alias("set_id"), token.alias("token")).groupBy("set_id").agg(
        F.theta_sketch_agg("token", lg_k).alias("theta")
    )
    a = thetas.select(F.col("set_id").alias("set_a"), F.col("theta").alias("ta"))
    b = thetas.select(F.col("set_id").alias("set_b"), F.col("theta").alias("tb"))
    count = F.theta_sketch_estimate
    return pairs.join(a, "set_a").join(b, "set_b").select(
        *PAIR,
        count(F.theta_intersection("ta", "tb")).alias("n_intersect"),
        count(F.theta_difference("ta", "tb")).alias("n_comp"),
        count(F.theta_union("ta", "tb", lg_k)).alias("n_union"),
    )


def intersect_exact(tokens: DataFrame, set_id: Column, token: Column, pairs: DataFrame) -> DataFrame:
    """Real sizes of the intersection, the difference and the union of each pair's token sets.

    The sets of a token are counted as one pattern, so only distinct patterns meet
    the pairs, however many tokens have them.
    """
    rows = tokens.select(set_id.alias("set_id"), token.alias("token")).distinct()
    patterns = rows.groupBy("token").agg(F.array_sort(F.collect_set("set_id")).alias("sets"))
    patterns = patterns.groupBy("sets").agg(F.count("*").alias("n"))
    # One row for each pattern and set, and so few however many tokens there are.
    held = patterns.select("sets", "n", F.explode("sets").alias("set_id"))
    sizes = held.groupBy("set_id").agg(F.sum("n").alias("size"))
    met = pairs.join(held.withColumnRenamed("set_id", "set_a"), "set_a").where(F.array_contains("sets", F.col("set_b")))
    met = met.groupBy(*PAIR).agg(F.sum("n").alias("n_intersect"))
    a, b = (sizes.select(F.col("set_id").alias(c), F.col("size").alias(f"size_{c}")) for c in PAIR)
    joined = pairs.join(met, PAIR, "left").join(a, "set_a").join(b, "set_b").na.fill(0, ["n_intersect"])
    return joined.select(
        *PAIR,
        "n_intersect",
        (F.col("size_set_a") - F.col("n_intersect")).alias("n_comp"),
        (F.col("size_set_a") + F.col("size_set_b") - F.col("n_intersect")).alias("n_union"),
    )
