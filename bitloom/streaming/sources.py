"""Tables as streams, and running a stream over what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitloom.sources.files import new_folder
from bitloom.sources.tables import read_table

WATERMARK = "1 hour"
FILES_PER_BATCH = 64


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One named Parquet table as a stream of its files, a bounded number of them per micro-batch.

    The table may be one file or a folder of files.
    """
    schema = read_table(spark, folder, name).schema
    # A pattern, since a stream takes a plain path for a folder and fails on a file; it matches the name alone.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{folder}/{name}.parque[t]")


# State of a stream that keeps timers or lists has to lie in RocksDB.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_append(stream: DataFrame, label: str, path: str | None = None, state: str | None = None) -> DataFrame:
    """Process everything available, appending finished rows to Parquet; returns them.

    With the ``path`` and ``state`` of an earlier run it goes on where that one ended.
    """
    spark = stream.sparkSession
    path, state = path or new_folder(spark, label), state or new_folder(spark, f"{label}-state")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = (
            stream.writeStream.outputMode("append")
            .format("parquet")
            .option("path", path)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], label: str, mode: str = "append") -> None:
    """Process everything available, handing each micro-batch and its id to ``each``."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(each)
        .option("checkpointLocation", new_folder(stream.sparkSession, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
