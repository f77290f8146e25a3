"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import stored


def _least(directed: DataFrame) -> DataFrame:
    """(u, v, m): each arc with the least node among ``u`` and all that it points to."""
    least = directed.groupBy("u").agg(F.min("v").alias("m"))
    return directed.join(least, "u").withColumn("m", F.least("u", "m"))


def _large(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    return _least(both).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to the least of them."""
    down = _least(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    moved = down.select(F.explode(F.array("u", "v")).alias("b"), F.col("m").alias("a"))
    return moved.where("a < b").select("a", "b").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's least node.

    Rounds go on until the edges stay the same, about log2 of the longest chain;
    each round is written to shared storage, so that a lost executor repeats one
    round only. The work is linear in the edges in each round. Loops (a = b) are
    left out. ``most_rounds`` guards against an endless loop and raises.
    """
    forward = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    current, before = stored(forward.distinct(), "edges"), None
    for _ in range(most_rounds):
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == before or state[0] == 0:
            return current.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(
                current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        before = tuple(state)
        current = stored(_small(_large(current)), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
