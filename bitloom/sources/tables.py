"""Reading Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One named table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Give every core some rows when a scan has fewer splits than cores.

    Meant for a bare scan ahead of CPU-heavy work such as tokenizing. A large
    table already has more splits than cores and is returned untouched, so no
    shuffle of raw text happens at scale. Hashed on nothing, so no key can skew it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() < cores:
        return scan.repartition(cores)
    return scan
