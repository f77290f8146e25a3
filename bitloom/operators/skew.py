"""Building blocks that hold when one key has most of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.session import checkpointed


# From how many rows on a key is worth splitting.
HOT_ROWS = 1_000_000


def hot_keys(facts: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys with at least ``hot_rows`` rows."""
    counted = facts.groupBy(*on).agg(F.count("*").alias("_n"))
    return counted.where(F.col("_n") >= hot_rows).select(*on)


def top_k(df: DataFrame, key: str, order: list, k: int, spread_by: list[str], salts: int = 256) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``, for keys of any size.

    Each task keeps k rows per key before its shuffle, each salt of a key keeps k
    after it, and only salts * k rows per key meet at the end.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    part = Window.partitionBy(key, "_salt").orderBy(*order)
    best = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank", "_salt")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def lookup(
    facts: DataFrame,
    dims: DataFrame,
    on: list[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    salts: int = 64,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join many rows to a table with one row per key, splitting the hot keys.

    A key with at least ``hot_rows`` rows is spread over ``salts`` join keys and
    its one row on the other side is repeated as often. There are at most
    rows / hot_rows hot keys, so that list is small by construction; whether it is
    broadcast is left to the run-time size check. ``hot`` gives the keys to split
    where the caller knows them; splitting more or fewer keys never changes the
    result.
    """
    if hot is None:
        hot = hot_keys(facts, on, hot_rows)
    hot = hot.select(*on, F.lit(salts).alias("_salts"))
    right = dims.join(hot, on, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    return _salted_join(facts, hot, right, on, how)


def semi(facts: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is listed; the list is short beside them and each row is read once."""
    return facts.join(keys, on, "left_semi")


def lookup_counted(
    facts: DataFrame, counted: DataFrame, on: list[str], n: str, hot_rows: int = HOT_ROWS, salts: int = 64
) -> DataFrame:
    """Inner ``lookup`` into an aggregate of the facts that also counted them as ``n``."""
    is_hot = F.col(n) >= hot_rows
    right = counted.withColumn("_salts", F.when(is_hot, F.lit(salts)).otherwise(F.lit(1)))
    # Asking for every column makes this the same aggregate as above, so it runs once.
    # A hot key left out here for a null still meets the copy for salt 0.
    whole = [F.col(c).isNotNull() for c in counted.columns if c != n]
    hot = counted.where(reduce(and_, whole, is_hot)).select(*on, F.lit(salts).alias("_salts"))
    return _salted_join(facts, hot, right.drop(n), on, "inner")


def _salted_join(facts: DataFrame, hot: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    # Any column but a map can take part in the hash that picks a row's salt.
    hashable = [c for c, kind in facts.dtypes if "map<" not in kind and "variant" not in kind]
    spread = F.pmod(F.xxhash64(*hashable), F.coalesce("_salts", F.lit(1)))
    left = facts.join(hot, on, "left").withColumn("_salt", spread).drop("_salts")
    copies = F.sequence(F.lit(0).cast("bigint"), F.col("_salts").cast("bigint") - 1)
    right = right.withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def running_total(
    df: DataFrame, keys: list[str], bucket: str, order: list[Column], weight: Column, name: str
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows of the same key.

    Rows are ordered by ``bucket`` and then ``order``. Only rows of one bucket are
    ever sorted together; the buckets' totals are summed on their own, and there
    are few of them. ``keys`` may be empty for one total over the whole table.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("_total"))
    # Without keys this window sees one row per bucket, a number the caller fixes.
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, bucket, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return (
        df.withColumn("_local", local)
        .join(offsets, [*keys, bucket])
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_local", "_offset")
    )


def positions(df: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row within its key, by ``bucket`` then ``order``."""
    return running_total(df, keys, bucket, order, F.lit(1).cast("bigint"), name)


def ranged(df: DataFrame, keys: list[str], order: list[str], bucket: str = "_bucket") -> DataFrame:
    """The rows in ranges of (keys, order), kept once, with the range's number as ``bucket``.

    A key of any number of rows lies in several ranges, which the operators of this
    module stitch together. ``order`` is to tell rows apart where ranges are to stay
    balanced.
    """
    return checkpointed(df.repartitionByRange(*keys, *order).withColumn(bucket, F.spark_partition_id()))


def last_known(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add the last ``value`` that is not null up to each row of its key, by ``bucket`` then ``order``.

    Each bucket is sorted on its own; what it begins with comes from one row per key
    and bucket.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys, bucket).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    ends = df.select(*keys, bucket).distinct().join(ends, [*keys, bucket], "left")
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, bucket, F.last("_end", ignorenulls=True).over(before).alias("_before"))
    local = F.last(value, ignorenulls=True).over(inside)
    rows = df.withColumn("_local", local).join(ends, [*keys, bucket])
    return rows.withColumn(name, F.coalesce("_local", "_before")).drop("_local", "_before")


def following(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], values: list[str], prefix: str = "next_"
) -> DataFrame:
    """Add the values of the next row of the same key, by ``bucket`` then ``order``.

    Each bucket is sorted on its own. The last row of a bucket takes the first row
    of the key's next bucket, found among one row per key and bucket.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    packed = F.struct(*values)
    rows = df.withColumn("_next", F.lead(packed).over(inside)).withColumn("_seen", F.lag(F.lit(True)).over(inside))
    # The rows are shuffled once; both branches read that shuffle.
    first = rows.where("_seen IS NULL").select(*keys, bucket, packed.alias("_first"))
    across = Window.partitionBy(*keys).orderBy(bucket)
    heads = first.select(*keys, bucket, F.lead("_first").over(across).alias("_after"))
    joined = rows.join(heads, [*keys, bucket])
    nxt = F.coalesce("_next", "_after")
    return joined.select(*df.columns, *(nxt[v].alias(f"{prefix}{v}") for v in values))
