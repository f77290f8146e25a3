"""Pairs of like sketches by candidates, not by looking at all pairs.

A sketch is a set of bits, each register and position one element. MinHash bands
over these elements bring like sketches together in an equality join, and only pairs
that share a band are compared, exactly. The bands are chosen so that a pair at the
threshold is missed with a probability of at most ``MISS``; nothing below it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import hashing
from bitloom.operators import sketch
from bitloom.operators.sketch import Sketches
from bitloom.sources.stores import stored

BANDS = 128
MISS = 1e-6
SEED = 17
# Elements that are hashed at once.
_STEP = 1024


def band_rows(least: float, bands: int = BANDS, miss: float = MISS) -> int:
    """The most MinHash values per band with which a pair of Jaccard ``least`` is missed rarely enough."""
    if not 0 < least <= 1:
        raise ValueError(f"the threshold must be in (0, 1], got {least}")
    rows = 1
    while rows < 64 and (1 - least ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def bit_sets(sketches: Sketches) -> DataFrame:
    """(set_id, bits): each sketch as its sorted elements, at most 2^p times the width of a register."""
    elements = F.transform(hashing.set_bits(F.col("word")), lambda at: F.col("bin") * 64 + at)
    rows = sketches.rows.select("set_id", elements.alias("bits"))
    return rows.groupBy("set_id").agg(F.sort_array(F.flatten(F.collect_list("bits"))).alias("bits"))


def _row_bits(tokens: Column, p: int) -> Column:
    """The sorted elements of the tokens of each row; the tokens of many rows at once are hashed once each."""

    @F.arrow_udf("array<int>")
    def bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            held = lists.flatten()
            there = held.is_valid().to_numpy(zero_copy_only=False)
            held, row = held.drop_null().dictionary_encode(), row[there]
            hashes = map(hashing.hash_of, held.dictionary.cast(pa.binary()).to_pylist())
            h = np.fromiter(hashes, np.int64, len(held.dictionary))
            low = h & ((1 << (hashing.HASH_BITS + 1 - p)) - 1)
            at = np.where(low == 0, hashing.HASH_BITS + 1 - p, np.bitwise_count((low & -low) - 1))
            element = (h >> (hashing.HASH_BITS - p)) * 64 + at
            found = np.sort(row.astype(np.int64) << 32 | element[held.indices.to_numpy()])
            found = found[np.diff(found, prepend=-1) != 0]
            ends = np.cumsum(np.bincount(found >> 32, minlength=len(lists)))
            yield pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), (found & 0xFFFFFFFF).astype(np.int32))

    # Else a test of the result would be moved below it, and the tokens hashed twice.
    return bits.asNondeterministic()(tokens)


def bit_sets_of_rows(rows: DataFrame, set_id: Column, tokens: Column, p: int = hashing.DEFAULT_P) -> DataFrame:
    """``bit_sets`` of a table with the tokens of one row in an array, for sets that are mostly one row.

    A set of one row is made in place, so neither its tokens nor its registers are
    shuffled; sets of several rows, found by their ids alone, are built from registers.
    """
    rows = rows.select(set_id.alias("set_id"), tokens.alias("tokens"))
    several = rows.groupBy("set_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("set_id").alias("again"))
    several = stored(several, "sketch-several")
    same = F.col("set_id").eqNullSafe(F.col("again"))
    alone = rows.join(several, same, "left_anti").select("set_id", _row_bits(F.col("tokens"), p).alias("bits"))
    shared = rows.join(several, same, "left_semi").select("set_id", F.explode("tokens").alias("token"))
    return alone.where(F.size("bits") > 0).unionByName(bit_sets(sketch.build(shared, F.col("set_id"), F.col("token"), p)))


def _content(bits: DataFrame, *more: str) -> DataFrame:
    return bits.select("set_id", F.sha1(F.concat_ws(",", "bits")).alias("content"), *more)


def equal_groups(sketches: Sketches) -> DataFrame:
    """(set_id, group_id): the least set whose registers are the same, for every set that has any."""
    return equal_groups_of_bits(bit_sets(sketches))


def equal_groups_of_bits(bits: DataFrame) -> DataFrame:
    """``equal_groups`` of the rows of ``bit_sets``, which are made once: a digest stands for the bits."""
    named = stored(_content(bits), "sketch-contents")
    least = named.groupBy("content").agg(F.min("set_id").alias("group_id"))
    return named.join(least, "content").select("set_id", "group_id")


def _spread(x: np.ndarray) -> np.ndarray:
    # The published constants of the splitmix64 finaliser.
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(bits: Column, rows: int, bands: int = BANDS) -> Column:
    """A key for each band: its ``rows`` MinHash values in one number."""
    rng = np.random.default_rng(SEED)
    # Elements are mixed once; an odd factor and a shift give each value another order of them.
    factors = rng.integers(0, 2**32, (bands * rows, 1), dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 2**32, (bands * rows, 1), dtype=np.uint32)

    def of_one(elements) -> np.ndarray:
        elements = (_spread(np.asarray(elements, np.int64).astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(elements), _STEP):
            hashed = factors * elements[at : at + _STEP]
            hashed += shifts
            least = np.minimum(least, hashed.min(axis=1))
        key = np.arange(bands, dtype=np.uint64)
        for values in least.reshape(bands, rows).T.astype(np.uint64):
            key = _spread(key * np.uint64(0x9E3779B97F4A7C15) + values)
        return key.view(np.int64)

    @F.pandas_udf("array<long>")
    def keys(batch: pd.Series) -> pd.Series:
        return pd.Series([of_one(elements) for elements in batch])

    return keys(bits)


def pairs_above(sketches: Sketches, least: float, measure: str = "jaccard", bands: int = BANDS) -> DataFrame:
    """Pairs of unlike sketches with a likeness of at least ``least``.

    ``(set_a, set_b, copies_a, copies_b, shared, score)``, set_a < set_b. Sets with
    the same registers stand as one, named by the least of them, and ``copies_*``
    tells how many they are (``equal_groups`` lists them). ``shared`` counts common
    bits; ``score`` is their share in the union (``jaccard``) or over the geometric
    mean of both counts (``cosine``). Empty sketches have no bits and no pairs.

    The work grows with the sets and with the pairs that share a band: those below
    the threshold rarely do, and copies are one row however many.
    """
    return pairs_above_of_bits(bit_sets(sketches), least, measure, bands)


def pairs_above_of_bits(sets: DataFrame, least: float, measure: str = "jaccard", bands: int = BANDS) -> DataFrame:
    """``pairs_above`` of the rows of ``bit_sets``."""
    if measure not in ("jaccard", "cosine"):
        raise ValueError(f"unknown measure {measure!r}; use jaccard or cosine")
    # A cosine of c means a Jaccard of c^2 at least.
    rows = band_rows(least if measure == "jaccard" else least * least, bands)
    classes = _content(sets, "bits").groupBy("content").agg(
        F.min("set_id").alias("set_id"), F.count("*").alias("copies"), F.first("bits").alias("bits")
    )
    classes = stored(classes.select("set_id", "copies", "bits"), "sketch-classes")
    keyed = classes.select("set_id", F.explode(band_keys(F.col("bits"), rows, bands)).alias("key"))
    a, b = (keyed.select(F.col("set_id").alias(f"set_{side}"), "key") for side in "ab")
    met = a.join(b, "key").where("set_a < set_b").select("set_a", "set_b").distinct()
    for side in "ab":
        columns = [F.col(c).alias(f"{c}_{side}") for c in ("set_id", "copies", "bits")]
        met = met.join(classes.select(*columns).withColumnRenamed(f"set_id_{side}", f"set_{side}"), f"set_{side}")
    shared = met.withColumn("shared", F.size(F.array_intersect("bits_a", "bits_b")).cast("long"))
    n, m, both = F.size("bits_a"), F.size("bits_b"), F.col("shared")
    score = both / (n + m - both) if measure == "jaccard" else both / F.sqrt(n.cast("double") * m)
    found = shared.withColumn("score", score).where(F.col("score") >= least)
    return found.select("set_a", "set_b", "copies_a", "copies_b", "shared", "score")
