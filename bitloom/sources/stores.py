"""Sketches, nodes and entities kept as partitioned Parquet."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from bitloom.session import checkpointed
from bitloom.sources.files import new_folder
from bitloom.operators.sketch import Sketches, concat, union_all

# Partitions of a table that is merged into.
BUCKETS = 64
# Bytes of a row group of a stored index, and rows of its pages: what a look-up reads at least.
ROW_GROUP, PAGE_ROWS = 1 << 22, 1000


def save_sketches(sketches: Sketches, path: str, status: str = "b") -> None:
    """Write registers under ``p=`` and ``status=`` so that later reads prune to them."""
    rows = sketches.rows.select("set_id", "bin", "word", F.lit(sketches.p).alias("p"), F.lit(status).alias("status"))
    rows.write.mode("append").partitionBy("p", "status").parquet(path)


def load_sketches(
    spark: SparkSession, path: str, p: int, status: str = "b", into: Sketches | None = None
) -> Sketches:
    """Read one partition of stored registers; ORs them into ``into`` if given.

    Appended copies of a set merge by OR, so reading twice-written sets is safe.
    """
    rows = spark.read.parquet(path).where((F.col("p") == p) & (F.col("status") == status))
    stored = Sketches(rows.select("set_id", "bin", "word"), p)
    return union_all(concat(into, stored) if into is not None else stored, F.col("set_id"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a result once to shared storage and read it back.

    For results that several branches or later scans use: the work behind them is
    done once, survives lost executors, and scans prune columns and row groups.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_by(df: DataFrame, path: str, *partitions: str) -> None:
    """Append rows under their partition columns."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def scan_status(spark: SparkSession, path: str, status: str) -> DataFrame:
    """All records of one life-cycle status; reads that partition only."""
    return spark.read.parquet(path).where(F.col("status") == status)


def retrieve(spark: SparkSession, path: str, prefix: str, sha1s: DataFrame) -> DataFrame:
    """Stored records of one prefix with any of the listed ids."""
    stored = spark.read.parquet(path).where(F.col("prefix") == prefix)
    return stored.join(sha1s.select("sha1").distinct(), "sha1", "left_semi")


def merge_into(
    spark: SparkSession,
    path: str,
    fresh: DataFrame,
    keys: Sequence[str],
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int = BUCKETS,
) -> int:
    """Merge rows into the table under ``path``; returns how many of its partitions were touched.

    The table lies in ``buckets`` partitions by a hash of the keys. Only partitions
    that fresh rows fall into are read, and they alone are rewritten (by dynamic
    partition overwrite); files of the others stay as they are. ``merge`` makes the
    new rows of old and fresh ones, and must give the same when it is repeated. The
    merged rows are kept before anything is replaced, so a job that failed can be run
    again. A new table begins empty.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    placed = checkpointed(fresh.withColumn("_bucket", bucket))
    # At most as many numbers as there are buckets; they prune the scan.
    touched = [r["_bucket"] for r in placed.select("_bucket").distinct().collect()]
    fresh = placed.drop("_bucket")
    try:
        old = spark.read.parquet(path).where(F.col("_bucket").isin(touched)).drop("_bucket")
    except AnalysisException:
        old = fresh.limit(0)
    if touched:
        merged = checkpointed(merge(old, fresh).withColumn("_bucket", bucket))
        writer = merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("_bucket").parquet(path)
    return len(touched)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that is merged into."""
    return spark.read.parquet(path).drop("_bucket")


def store_sorted(df: DataFrame, path: str, key: str, placed: bool = False) -> None:
    """Write a table for look-ups by one column: sorted, in small row groups and pages with Bloom filters on it.

    Files hold ranges of the key, which takes a second run of what makes the last
    partitions, for a sample. ``placed`` rows stay in the partitions they are in: each
    file is sorted by itself, and a look-up asks the filters of one row group in each.
    """
    options = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.block.size": str(ROW_GROUP), "parquet.page.row.count.limit": str(PAGE_ROWS)}
    rows = df if placed else df.repartitionByRange(key)
    rows.sortWithinPartitions(key).write.options(**options).parquet(path)


def look_up(stored: DataFrame, key: str, values: Sequence, at_once: int = 8) -> DataFrame:
    """Rows of a ``store_sorted`` table with one of the ``values``.

    A few values at a time are asked for by name, as the reader tests names against
    statistics and Bloom filters and skips what can't hold them.
    """
    values = list(dict.fromkeys(values))
    parts = [stored.where(F.col(key).isin(values[at : at + at_once])) for at in range(0, len(values), at_once)]
    out = parts[0] if parts else stored.limit(0)
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def version_of(spark: SparkSession, path: str) -> str:
    """What changes whenever a table's files do: names, lengths and times of change, in one digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    print_ = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    facts = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.bit_xor(print_), F.lit(0)).alias("x"))
    return ":".join(map(str, facts.first()))
