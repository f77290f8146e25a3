"""Entities: a sketch with a gradient and the operation that made it.

Entity rows are ``(sha1, card, n_bits, grad, op, args)``. ``sha1`` is the content
id of the registers, ``args`` the ids of the operands, so lineage is a table and
walking it is a join. A change goes from an old sketch (``set_a``) to a new one
(``set_b``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import estimate
from bitloom.operators import similarity as sim
from bitloom.operators import sketch
from bitloom.operators.sketch import Sketches, content_id, filled, pow_sum

# Which registers, which operands and which share of which side each operation takes.
OPERATIONS = {
    "union": ("union", None),
    "intersect": ("intersect", None),
    "xor": ("xor", None),
    "comp": ("comp", ("comp", "a")),
    "deleted": ("comp", ("comp", "a")),
    "retained": ("intersect", ("intersect", "union")),
    "added": ("comp_rev", ("comp_rev", "b")),
    "advance": ("b", ("a", "b")),
}

# Fixed values. Back-propagation of one step: how operand number ``pos`` takes up the gradient.
BACKPROP = {
    ("union", 0): "add",
    ("union", 1): "add",
    ("intersect", 0): "add",
    ("intersect", 1): "add",
    ("xor", 0): "add",
    ("xor", 1): "add",
    ("comp", 0): "add",
    ("added", 1): "multiply",
    ("deleted", 0): "multiply",
    ("retained", 0): "multiply",
    ("retained", 1): "multiply",
    ("advance", 0): "multiply",
    ("advance", 1): "multiply",
    ("advance", 2): "multiply",
}


def build(sketches: Sketches, prefix: str = "b") -> DataFrame:
    """Terminal entities: gradient 0 and no operation."""
    return sketch.meta(sketches).select(
        "set_id",
        "sha1",
        "card",
        "n_bits",
        F.lit(0.0).alias("grad"),
        F.lit(None).cast("string").alias("op"),
        F.array().cast("array<string>").alias("args"),
        F.lit(prefix).alias("prefix"),
    )


def with_dataset(entities: DataFrame, datasets: DataFrame, key: list[str]) -> DataFrame:
    """Entities with their ``registers``, an array of (bin, word) of at most 2^p entries.

    An entity without any register has an empty array.
    """
    joined = entities.join(datasets.select(*key, "registers"), key, "left")
    none = F.array().cast(datasets.schema["registers"].dataType)
    return joined.withColumn("registers", F.coalesce("registers", none))


def copy(entities: DataFrame) -> DataFrame:
    """The same entities once more: id, dataset, gradient and operation are kept."""
    return entities.select("*")


def negate(entities: DataFrame) -> DataFrame:
    """The same entities with the gradient's sign turned."""
    return entities.withColumn("grad", -F.col("grad"))


def combine(sketches: Sketches, pairs: DataFrame, *ops: str, strict: bool = False) -> DataFrame:
    """Result entities of the named operations on each pair, one row per pair and operation.

    All of them come out of one alignment and one aggregate. Registers are listed
    for the results alone: the operands' ids are made once per set and joined to
    the pairs, so ``sketches`` are best kept (``once``). With ``strict`` a complement by an empty sketch fails the job;
    otherwise a share of an empty side is null.
    """
    needed, made = {"a", "b"}, set()
    for op in ops:
        part, share = OPERATIONS[op]
        needed |= {part, *(share or ())}
        made |= {part} | ({"comp", "intersect", "comp_rev"} if op == "advance" else set())
    made -= {"a", "b"}
    words = sim.word_views(sorted(needed | made))
    sums = []
    for name, word in words.items():
        sums += [
            pow_sum(word).alias(f"s_{name}"),
            filled(word).alias(f"n_{name}"),
            F.sum(F.bit_count(word)).alias(f"bits_{name}"),
        ]
        if name in made:
            sums.append(F.collect_list(F.when(word != 0, F.struct("bin", word.alias("word")))).alias(f"regs_{name}"))
    per_pair = sim.align(sketches, pairs).groupBy(*sim.PAIR).agg(*sums)
    measured = per_pair.select(
        *sim.PAIR,
        *(estimate.cardinality(f"s_{n}", f"n_{n}", sketches.p).alias(f"card_{n}") for n in words),
        *(F.col(f"bits_{n}") for n in words),
        *(content_id(F.col(f"regs_{n}")).alias(f"id_{n}") for n in sorted(made)),
    )
    rows = F.inline(F.array(*(_result(op, strict) for op in ops)))
    return _with_operands(measured, sketches).select(*sim.PAIR, rows)


def _with_operands(measured: DataFrame, sketches: Sketches) -> DataFrame:
    """Add ``id_a`` and ``id_b``, the content ids of each pair's sets; a set without registers has the empty one."""
    ids = sketch.meta(sketches)
    empty = content_id(F.array().cast("array<struct<bin:int,word:bigint>>"))
    for side in "ab":
        key = f"set_{side}"
        named = ids.select(F.col("set_id").alias(key), F.col("sha1").alias(f"id_{side}"))
        # The pairs' rows are short, and adaptive execution splits a set that is in very many of them.
        measured = measured.join(named, key, "left").withColumn(f"id_{side}", F.coalesce(f"id_{side}", empty))
    return measured


def _result(op: str, strict: bool) -> Column:
    part, share = OPERATIONS[op]
    grad = F.lit(0.0)
    if share:
        over, under = share
        grad = F.when(F.col(f"bits_{under}") != 0, F.col(f"card_{over}").cast("double") / F.col(f"card_{under}"))
    if strict and op == "comp":
        error = F.raise_error(F.lit("complement by an empty sketch")).cast("double")
        grad = F.when(F.col("bits_b") == 0, error).otherwise(grad)
    args = ["id_a", "id_b"] if op != "advance" else ["id_comp", "id_intersect", "id_comp_rev"]
    return F.struct(
        F.col(f"id_{part}").alias("sha1"),
        F.col(f"card_{part}").alias("card"),
        F.col(f"bits_{part}").alias("n_bits"),
        grad.alias("grad"),
        F.lit(op).alias("op"),
        F.array(*args).alias("args"),
    )


def diff(sketches: Sketches, pairs: DataFrame) -> DataFrame:
    """Deleted, retained and added entities of each change."""
    return combine(sketches, pairs, "deleted", "retained", "added")


def lineage(entities: DataFrame) -> DataFrame:
    """One row per operand: ``(sha1, op, grad, pos, arg)``."""
    return entities.where("op IS NOT NULL").select("sha1", "op", "grad", F.posexplode("args").alias("pos", "arg"))


def backprop(entities: DataFrame, results: DataFrame) -> DataFrame:
    """Gradients of ``entities`` after one step back from ``results``.

    Additions are summed and multipliers multiplied per operand before the join,
    so an entity used by very many results meets one row. New gradient =
    (old + sum) * product. An ``advance`` passes only to operands that have an
    operation themselves.
    """
    edges = lineage(results)
    mode = F.lit(None).cast("string")
    for (op, pos), how in BACKPROP.items():
        mode = F.when((F.col("op") == op) & (F.col("pos") == pos), how).otherwise(mode)
    moved = edges.select("arg", "grad", (F.col("op") == "advance").alias("to_derived"), mode.alias("mode"))
    moved = moved.where("mode IS NOT NULL")

    def product(keep: Column) -> Column:
        return F.product(F.when(keep, F.col("grad")).otherwise(F.lit(1.0)))

    multiplies = F.col("mode") == "multiply"

    updates = moved.groupBy(F.col("arg").alias("sha1")).agg(
        F.sum(F.when(F.col("mode") == "add", F.col("grad")).otherwise(F.lit(0.0))).alias("plus"),
        product(multiplies).alias("times_derived"),
        product(multiplies & ~F.col("to_derived")).alias("times_terminal"),
    )
    times = F.when(F.col("op").isNull(), F.col("times_terminal")).otherwise(F.col("times_derived"))
    new_grad = (F.col("grad") + F.coalesce("plus", F.lit(0.0))) * F.coalesce(times, F.lit(1.0))
    joined = entities.join(updates, "sha1", "left")
    return joined.select(*(new_grad.alias("grad") if c == "grad" else F.col(c) for c in entities.columns))


def equal(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Whether the entities of the same key have the same content and gradient."""
    r = right.select(key, F.col("sha1").alias("sha1_r"), F.col("grad").alias("grad_r"))
    same = F.col("sha1").eqNullSafe(F.col("sha1_r")) & F.col("grad").eqNullSafe(F.col("grad_r"))
    return left.join(r, key).select(key, same.alias("is_equal"))


def change_series(daily: DataFrame, p: int, first_day: Column, last_day: Column) -> DataFrame:
    """Day-over-day change per key from registers ``(key, day DATE, bin, word)``.

    Each register is sent once to its own day as the new state and once to the
    next day as the old one; a day without events counts as an empty sketch. No
    self-join and no ordering, just one aggregate by (key, day, bin).
    """
    sides = F.inline(
        F.array(
            F.struct(F.col("day").alias("to_day"), F.lit(True).alias("is_new")),
            F.struct(F.date_add("day", 1).alias("to_day"), F.lit(False).alias("is_new")),
        )
    )
    word, is_new = F.col("word"), F.col("is_new")
    aligned = (
        daily.select("key", "bin", "word", sides)
        .where((F.col("to_day") > first_day) & (F.col("to_day") <= last_day))
        .groupBy("key", F.col("to_day").alias("day"), "bin")
        .agg(
            F.bit_or(F.when(is_new, F.lit(0)).otherwise(word)).alias("word_a"),
            F.bit_or(F.when(is_new, word).otherwise(F.lit(0))).alias("word_b"),
        )
    )
    views = ("a", "b", "comp", "intersect", "comp_rev", "union")
    cards = sim.cards_of_aligned(aligned, p, ["key", "day"], views)

    def share(over: str, under: str) -> Column:
        return F.when(F.col(f"bits_{under}") != 0, F.col(f"card_{over}").cast("double") / F.col(f"card_{under}"))

    return cards.select(
        "key",
        "day",
        F.col("card_comp").alias("n_deleted"),
        F.col("card_intersect").alias("n_retained"),
        F.col("card_comp_rev").alias("n_added"),
        share("comp", "a").alias("grad_deleted"),
        share("intersect", "union").alias("grad_retained"),
        share("comp_rev", "b").alias("grad_added"),
        share("a", "b").alias("grad_advance"),
    )
