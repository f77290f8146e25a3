"""Sketch tables: building, merging, estimating, identifying, dumping.

A sketch table has one row per non-empty register: ``(set_id, bin, word)``. All
aggregates below are Spark's own ``bit_or`` / ``bit_and``, which combine on the
map side, so one set holding most of the data still shuffles at most 2^p rows
per map task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import estimate, hashing
from bitloom.session import checkpointed


@dataclass(frozen=True)
class Sketches:
    """Rows ``(set_id, bin, word)`` of one precision; empty registers are absent."""

    rows: DataFrame
    p: int = hashing.DEFAULT_P

    def __post_init__(self):
        hashing.check_p(self.p)

    def same_p(self, other: Sketches) -> None:
        if self.p != other.p:
            raise ValueError(f"precisions differ: {self.p} and {other.p}")

    def once(self) -> Sketches:
        """The same registers, computed now and kept, for use by several branches.

        Registers are few beside the tokens behind them.
        """
        return self.with_rows(checkpointed(self.rows))

    def with_rows(self, rows: DataFrame) -> Sketches:
        return Sketches(rows.select("set_id", "bin", "word"), self.p)


def build(tokens: DataFrame, set_id: Column, token: Column, p: int = 10, seed: int = 0) -> Sketches:
    """One sketch per set id from a table with one token per row.

    Repeated tokens change nothing, so no de-duplication shuffle is needed.
    """
    hashing.check_p(p)
    hashed = tokens.where(token.isNotNull()).select(
        set_id.alias("set_id"), hashing.token_hash(token, seed).alias("h")
    )
    return from_hashes(hashed, p)


def from_hashes(hashed: DataFrame, p: int = 10) -> Sketches:
    """One sketch per set id from rows ``(set_id, h)``."""
    registers = hashed.select(
        "set_id",
        hashing.bin_of(F.col("h"), p).alias("bin"),
        hashing.word_of(F.col("h"), p).alias("word"),
    )
    return Sketches(registers.groupBy("set_id", "bin").agg(F.bit_or("word").alias("word")), p)


def concat(*parts: Sketches) -> Sketches:
    """All rows of several sketch tables of one precision."""
    first, *rest = parts
    rows = first.rows.select("set_id", "bin", "word")
    for part in rest:
        first.same_p(part)
        rows = rows.unionByName(part.rows.select("set_id", "bin", "word"))
    return Sketches(rows, first.p)


def copy(sketches: Sketches, new_id: Column) -> Sketches:
    """The same registers under new set ids."""
    return sketches.with_rows(sketches.rows.withColumn("set_id", new_id))


def meet(wanted: DataFrame, sketches: Sketches, on: str = "set_id", chunks: int = 16) -> DataFrame:
    """Registers of the sets named in ``wanted``, beside its columns.

    The join key is the set and a slice of its registers, so one set wanted by
    very many rows is spread over as many tasks as there are slices.
    """
    sliced = sketches.rows.withColumnRenamed("set_id", on).withColumn("_slice", F.col("bin") % chunks)
    asked = wanted.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return asked.join(sliced, [on, "_slice"]).drop("_slice")


def union_all(sketches: Sketches, group: Column) -> Sketches:
    """Union of all sketches that share a group value."""
    rows = sketches.rows.select(group.alias("set_id"), "bin", "word")
    return sketches.with_rows(rows.groupBy("set_id", "bin").agg(F.bit_or("word").alias("word")))


def intersect_all(sketches: Sketches, members: DataFrame) -> Sketches:
    """Register-wise AND of all member sketches of each group.

    ``members`` has ``(group, set_id)``. A register missing in any member is 0,
    so only registers present in every member can survive. Register AND is not a
    sketch of the set intersection once registers fill up; see
    ``similarity.intersect_estimate`` for an estimate of that.
    """
    sizes = members.groupBy("group").agg(F.count_distinct("set_id").alias("n_sets"))
    anded = (
        meet(members.distinct(), sketches)
        .groupBy("group", "bin")
        .agg(F.bit_and("word").alias("word"), F.count("*").alias("n"))
        .join(sizes, "group")
        .where((F.col("n") == F.col("n_sets")) & (F.col("word") != 0))
    )
    return sketches.with_rows(anded.withColumnRenamed("group", "set_id"))


def pow_sum(word: Column) -> Column:
    """Aggregate: sum of 2^-rank over the non-empty registers."""
    weight = F.pow(F.lit(2.0), -hashing.top_bit(word))
    return F.sum(F.when(word != 0, weight).otherwise(F.lit(0.0)))


def filled(word: Column) -> Column:
    """Aggregate: number of non-empty registers."""
    return F.count_if(word != 0)


def max_ranks(sketches: Sketches) -> DataFrame:
    """Highest rank seen in each register."""
    return sketches.rows.select("set_id", "bin", hashing.top_bit(F.col("word")).alias("max_rank"))


def raw_estimates(sketches: Sketches) -> DataFrame:
    """Uncorrected estimate per set."""
    word = F.col("word")
    raw = estimate.raw_estimate(F.col("s"), F.col("n"), sketches.p)
    return (
        sketches.rows.groupBy("set_id")
        .agg(pow_sum(word).alias("s"), filled(word).alias("n"))
        .select("set_id", raw.alias("raw"))
    )


def content_id(bin_words: Column) -> Column:
    """SHA-1 over the sorted non-empty registers (an array of bin, word)."""
    parts = F.transform(
        F.array_sort(bin_words), lambda r: F.concat_ws(":", r["bin"].cast("string"), r["word"].cast("string"))
    )
    return F.sha1(F.array_join(parts, ","))


def meta(sketches: Sketches, registry: DataFrame | None = None) -> DataFrame:
    """One row per set: ``sha1, card, n_bits``.

    A register list is at most 2^p entries long, so collecting it per set is
    bounded. ``registry`` (column ``set_id``) adds the sets that have no register.
    """
    word = F.col("word")
    rows = sketches.rows
    if registry is not None:
        rows = registry.select("set_id").distinct().join(rows, "set_id", "left")
        rows = rows.withColumn("word", F.coalesce("word", F.lit(0)))
    listed = F.collect_list(F.when(word != 0, F.struct("bin", "word")))
    return (
        rows.groupBy("set_id")
        .agg(
            pow_sum(word).alias("s"),
            filled(word).alias("n"),
            F.sum(F.bit_count(word)).alias("n_bits"),
            listed.alias("registers"),
        )
        .select(
            "set_id",
            F.lit(sketches.p).alias("p"),
            content_id(F.col("registers")).alias("sha1"),
            estimate.cardinality("s", "n", sketches.p).alias("card"),
            "n_bits",
        )
    )


def cards(sketches: Sketches, registry: DataFrame | None = None) -> DataFrame:
    """Estimated cardinality per set."""
    return meta(sketches, registry).select("set_id", "card")


def empty_sets(sketches: Sketches, registry: DataFrame) -> DataFrame:
    """Every registered set with a flag telling whether no register is set."""
    found = sketches.rows.select("set_id").distinct().withColumn("found", F.lit(True))
    return (
        registry.select("set_id").distinct()
        .join(found, "set_id", "left")
        .select("set_id", F.col("found").isNull().alias("is_empty"))
    )


def dump_sparse(sketches: Sketches) -> DataFrame:
    """Per set, the non-empty registers as an array of ``(bin, word)`` in bin order."""
    return sketches.rows.groupBy("set_id").agg(
        F.array_sort(F.collect_list(F.struct("bin", "word"))).alias("registers")
    )


def dump_dense(sketches: Sketches) -> DataFrame:
    """Per set, all 2^p registers in bin order, 0 where empty.

    Each register brings the zeros of the gap before it, so the array is put
    together in one pass over the non-empty registers.
    """
    zero = F.lit(0).cast("bigint")
    listed = dump_sparse(sketches)

    def with_gap(register, i):
        before = F.coalesce(F.get(F.col("registers"), i - 1)["bin"], F.lit(-1))
        return F.concat(F.array_repeat(zero, register["bin"] - before - 1), F.array(register["word"]))

    last = F.element_at("registers", -1)["bin"]
    tail = F.array_repeat(zero, F.lit((1 << sketches.p) - 1) - last)
    return listed.select("set_id", F.concat(F.flatten(F.transform("registers", with_gap)), tail).alias("words"))


def restore(dumps: DataFrame, p: int, into: Sketches | None = None) -> Sketches:
    """Rebuild sketches from sparse or dense dumps; ORs into ``into`` if given."""
    if "registers" in dumps.columns:
        rows = dumps.select("set_id", F.inline("registers"))
    else:
        rows = dumps.select("set_id", F.posexplode("words").alias("bin", "word"))
    back = Sketches(rows.where("word <> 0"), p)
    return union_all(concat(into, back), F.col("set_id")) if into is not None else back


def thin(sketches: Sketches, n_bits: int, seed: int = 0) -> Sketches:
    """Drop exactly ``n_bits`` of each set's bits, picked by a seeded hash.

    A set has at most 63 * 2^p bits, so ordering them per set is bounded.
    """
    bits = sketches.rows.select("set_id", "bin", F.explode(hashing.set_bits(F.col("word"))).alias("bit"))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "bin", "bit"))
    order = Window.partitionBy("set_id").orderBy(draw, "bin", "bit")
    kept = bits.withColumn("pos", F.row_number().over(order)).where(F.col("pos") > n_bits)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    return sketches.with_rows(kept.groupBy("set_id", "bin").agg(F.bit_or(one).alias("word")))
