"""Conditional, joint and Markov tables over sets, in long form.

The number of sets is the matrix dimension and stays small; the elements may be
many. Elements are first counted by which sets hold them, so pairs of sets are
formed once per distinct combination and never per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.operators import similarity, skew
from bitloom.session import checkpointed


# Sets of one pattern that meet in a task.
BLOCK = 256


def _patterns(seen: DataFrame, element_weight: Column) -> DataFrame:
    """(item_set, pattern, n, w): the sets of each pattern, with the weight of all its elements.

    Elements held by the same sets are one pattern. It is known by a 128-bit
    fingerprint of its sets that combines on the map side, and named by its least
    element; no list of sets is made.
    """
    prints = [F.bit_xor(F.xxhash64("item_set", F.lit(i))).alias(f"_x{i}") for i in range(2)]
    elements = seen.groupBy("element").agg(*prints, F.count("*").alias("n"), element_weight.alias("w"))
    patterns = elements.groupBy("_x0", "_x1", "n").agg(F.min("element").alias("element"), F.sum("w").alias("w"))
    named = patterns.select("element", "n", F.col("w").alias("weight"))
    return seen.join(named, "element").select("item_set", F.col("element").alias("pattern"), "n", F.col("weight").alias("w"))


def _together(held: DataFrame) -> DataFrame:
    """(i, j, w) for every ordered pair of sets of a pattern; a pattern of many sets meets block by block."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = held.withColumn("mine", F.pmod(F.xxhash64("item_set"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    a = dealt.select("pattern", "lo", "hi", "w", F.col("item_set").alias("i"), F.col("mine").alias("mine_i"))
    b = dealt.select("pattern", "lo", "hi", F.col("item_set").alias("j"), F.col("mine").alias("mine_j"))
    once = (F.col("lo") == F.col("hi")) | (F.col("mine_i") != F.col("mine_j"))
    return a.join(b, ["pattern", "lo", "hi"]).where(once).select("i", "j", "w")


def overlaps(members: DataFrame, weight: Column | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Weight of the elements two sets share: ``(i, j, w)`` for all i, j, also 0.

    ``members`` has ``(item_set, element)``, repeats allowed; an element weighs 1, or
    the sum of ``weight`` over its rows. With ``pairs`` (i, j) only these cells are
    worked out, and the sets' own (i, i): then an element may be in any number of sets.
    """
    row_weight = F.lit(1).cast("bigint") if weight is None else weight
    # A struct, so that a missing element is one like others.
    rows = members.select("item_set", F.struct("element").alias("element"), row_weight.alias("w"))
    # Repeats fold per (set, element) on the map side, so an element meets one row per set.
    seen = checkpointed(rows.groupBy("item_set", "element").agg(F.sum("w").alias("w")))
    element_weight = F.max(F.lit(1).cast("bigint")) if weight is None else F.sum("w")
    if pairs is not None:
        return _asked_overlaps(seen, element_weight, pairs)
    sets = seen.select(F.col("item_set").alias("set_id")).distinct()
    grid = similarity.all_pairs(sets).select(F.col("set_a").alias("i"), F.col("set_b").alias("j"))
    grid = grid.unionAll(grid.select("j", "i")).unionAll(sets.select("set_id", "set_id")).withColumn("w", F.lit(0).cast("bigint"))
    return _together(_patterns(seen, element_weight)).unionByName(grid).groupBy("i", "j").agg(F.sum("w").alias("w"))


def _asked_overlaps(seen: DataFrame, element_weight: Column, pairs: DataFrame) -> DataFrame:
    asked = pairs.select("i", "j").distinct()
    own = asked.select("i").union(asked.select("j")).distinct().toDF("i")
    asked = asked.unionByName(own.withColumn("j", F.col("i"))).distinct()
    weights = seen.groupBy("element").agg(element_weight.alias("w"))
    # The elements of the asked sets only; each (set, element) is one row.
    mine = skew.lookup(skew.semi(seen, own.toDF("item_set"), ["item_set"]).select("item_set", "element"), weights, ["element"])
    mine = checkpointed(mine)
    left = asked.join(mine.select(F.col("item_set").alias("i"), "element", "w"), "i")
    met = left.join(mine.select(F.col("item_set").alias("j"), "element"), ["j", "element"])
    found = met.groupBy("i", "j").agg(F.sum("w").alias("w"))
    return asked.join(found, ["i", "j"], "left").select("i", "j", F.coalesce("w", F.lit(0).cast("bigint")).alias("w"))


def _with_sizes(cells: DataFrame) -> DataFrame:
    # Few cells out of many elements; what made them runs once.
    cells = checkpointed(cells)
    sizes = cells.where("i = j")
    return cells.join(sizes.select("i", F.col("w").alias("size_i")), "i").join(
        sizes.select("j", F.col("w").alias("size_j")), "j"
    )


def conditional(cells: DataFrame) -> DataFrame:
    """1 on the diagonal, else shared over the size of the later set: symmetric."""
    size = F.when(F.col("i") < F.col("j"), F.col("size_j")).otherwise(F.col("size_i"))
    p = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("w").cast("double") / size)
    return _with_sizes(cells).select("i", "j", p.alias("p"))


def conditional_weighted(cells: DataFrame) -> DataFrame:
    """Shared weight over the weight of j, 1 on the diagonal: not symmetric."""
    p = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("w").cast("double") / F.col("size_j"))
    return _with_sizes(cells).select("i", "j", p.alias("p"))


def joint(c: DataFrame) -> DataFrame:
    """J[a, b] = C[a, first] times the product of C[b, i] over all later i."""
    c = checkpointed(c)
    first = c.agg(F.min("j").alias("m")).scalar()
    marked = c.withColumn("first", first)
    start = marked.where("j = first").select(F.col("i").alias("a"), F.col("p").alias("p_first"))
    rest = marked.where("j <> first").groupBy(F.col("i").alias("b")).agg(F.product("p").alias("p_rest"))
    grid = c.select(F.col("i").alias("a"), F.col("j").alias("b"))
    return grid.join(start, "a").join(rest, "b").select("a", "b", (F.col("p_first") * F.col("p_rest")).alias("p"))


def posterior(j: DataFrame, evidence: str) -> DataFrame:
    """P(a | evidence): one column of the joint table, scaled to 1."""
    column = checkpointed(j.where(F.col("b") == evidence))
    total = column.agg(F.sum("p").alias("t")).scalar()
    return column.select("a", F.try_divide(F.col("p"), total).alias("p"))


def transitions(events: DataFrame, key: str, bucket: str, order: list[str], state: str) -> DataFrame:
    """Counts of (state, next state) per key sequence: ``(i, j, n)``; long sequences are split."""
    paired = skew.following(events, [key], bucket, order, [state])
    moved = paired.where(F.col(f"next_{state}").isNotNull())
    return moved.groupBy(F.col(state).alias("i"), F.col(f"next_{state}").alias("j")).agg(F.count("*").alias("n"))


def transition_matrix(counts: DataFrame) -> DataFrame:
    """Row-normalised transition probabilities ``(i, j, p)``."""
    rows = counts.groupBy("i").agg(F.sum("n").alias("total"))
    return counts.join(rows, "i").select("i", "j", (F.col("n").cast("double") / F.col("total")).alias("p"))


def chain_joint(counts: DataFrame) -> DataFrame:
    """P(a, b, c) = P(a) P(b | a) P(c | b) from transition counts."""
    counts = checkpointed(counts)
    total = counts.agg(F.sum("n").alias("t")).scalar()
    start = counts.groupBy(F.col("i").alias("a")).agg(F.sum("n").alias("n_a"))
    start = start.select("a", (F.col("n_a").cast("double") / total).alias("p_a"))
    t = transition_matrix(counts)
    step1 = t.select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("p").alias("p_b"))
    step2 = t.select(F.col("i").alias("b"), F.col("j").alias("c"), F.col("p").alias("p_c"))
    p = F.col("p_a") * F.col("p_b") * F.col("p_c")
    return start.join(step1, "a").join(step2, "b").select("a", "b", "c", p.alias("p"))


def row_stochastic(c: DataFrame) -> DataFrame:
    """Off-diagonals kept, the diagonal set so that each row sums to 1.

    ``feasible`` is false for rows whose off-diagonals already exceed 1.
    """
    c = checkpointed(c)
    off = F.sum(F.when(F.col("i") != F.col("j"), F.col("p")).otherwise(F.lit(0.0)))
    rest = c.groupBy("i").agg((F.lit(1.0) - off).alias("rest"))
    p = F.when(F.col("i") == F.col("j"), F.col("rest")).otherwise(F.col("p"))
    return c.join(rest, "i").select("i", "j", p.alias("p"), (F.col("rest") >= 0).alias("feasible"))


def project(matrix: DataFrame, steps: int) -> DataFrame:
    """State after ``steps`` steps from a uniform start: ``(state, p)``."""
    matrix = checkpointed(matrix)
    states = matrix.select("i").union(matrix.select("j")).distinct()
    n = states.agg(F.count("*").alias("n")).scalar()
    state = states.select("i", (F.lit(1.0) / n).alias("v"))
    for _ in range(steps):
        moved = matrix.join(state, "i").groupBy("j").agg(F.sum(F.col("p") * F.col("v")).alias("v"))
        state = moved.select(F.col("j").alias("i"), "v")
    return state.select(F.col("i").alias("state"), F.col("v").alias("p"))


def state_elements(projected: DataFrame, elements: DataFrame) -> DataFrame:
    """Projected probabilities by pool element; ``elements`` maps ``state`` to ``element``."""
    return projected.join(elements, "state").select("element", "p")
