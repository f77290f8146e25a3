"""Streaming twins of the daily sketch, the token index and the life cycle.

Event time is read as UTC in any session zone; rows later than the watermark are
dropped. Tables written by batch are versioned by batch id (``store``), so a repeated
batch or a restart never counts anything twice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import estimate, hashing, text
from bitloom.operators import tokens as tok
from bitloom.operators.sketch import filled, pow_sum
from bitloom.streaming import store
from bitloom.streaming.lives import Lives
from bitloom.streaming.sources import WATERMARK, run_batches


def daily_sketches(events: DataFrame, ts: str, key: str, token: Column, p: int = 10) -> DataFrame:
    """Estimated distinct tokens per day and key, once a day is closed.

    The first aggregate keeps the registers of open days as state, at most 2^p
    words per key and day; the second turns each closed day into its estimate.
    """
    h = hashing.token_hash(token)
    timed = events.select(
        text.instant(F.col(ts)).alias("ts"),
        F.col(key).alias("key"),
        hashing.bin_of(h, p).alias("bin"),
        hashing.word_of(h, p).alias("word"),
    ).withWatermark("ts", WATERMARK)
    registers = timed.groupBy(F.window("ts", "1 day").alias("day"), "key", "bin").agg(F.bit_or("word").alias("word"))
    closed = registers.withColumn("at", F.window_time("day"))
    sums = closed.groupBy(F.window("at", "1 day").alias("day"), "key").agg(
        pow_sum(F.col("word")).alias("s"), filled(F.col("word")).alias("n"), F.sum(F.bit_count("word")).alias("n_bits")
    )
    return sums.select(
        text.day_key(text.wall_time(F.col("day")["start"])).alias("day"),
        "key",
        estimate.cardinality("s", "n", p).alias("card"),
        "n_bits",
    )


def distinct_tokens(events: DataFrame, ts: str, keys: list[str], within: str) -> DataFrame:
    """Each key combination once within the watermark; state is dropped after that."""
    timed = events.withColumn("_at", text.instant(F.col(ts))).withWatermark("_at", within)
    return timed.dropDuplicatesWithinWatermark(keys).select(*keys)


INDEX = "id long, token string, ref {ref}, n long"


def _merged_postings(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "token", "ref").agg(F.sum("n").alias("n"))


def index_into(texts: DataFrame, path: str, words) -> None:
    """Add the postings of each micro-batch of ``(ref, batch, text)`` to a versioned index.

    A batch costs what it brings, and a share of what is there when tables merge. A
    repeated batch changes nothing; readers see whole versions.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("ref", "batch", F.explode(words(F.col("text"))).alias("token"))
        store.add(tok.postings(rows, distinct=True), batch_id, path, _merged_postings)

    run_batches(texts, add, "index")


def read_index(spark, path: str, ref: str = "string") -> DataFrame:
    """The postings of the newest version."""
    return store.read(spark, path, INDEX.format(ref=ref), _merged_postings)


def heads_into(versions: DataFrame, path: str, key: str, version: str, value: str) -> None:
    """Keep the newest version of each key in a versioned table.

    A micro-batch is reduced to its own heads, which are merged as tables are: the
    stream itself keeps no state, however many keys there are.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        store.add(_heads(key, version, value)(batch.select(key, version, value)), batch_id, path, _heads(key, version, value))

    run_batches(versions, add, "heads")


def _heads(key: str, version: str, value: str):
    def newest(rows: DataFrame) -> DataFrame:
        heads = rows.groupBy(key).agg(F.max_by(F.struct(version, value), version).alias("head"))
        return heads.select(key, "head.*")

    return newest


def read_heads(spark, path: str, key: str, version: str, value: str, schema: str) -> DataFrame:
    """The current head of each key; older heads are tails."""
    return store.read(spark, path, schema, _heads(key, version, value))


def expired(events: DataFrame, ts: str, key: str, ttl: str) -> DataFrame:
    """Records whose time to live has run out: ``(key, first_seen, expired_at, n)``.

    Each write renews a record's life. State holds the lives that are open, with a
    timer at the end of each; a life is put out, and its state dropped, once the
    watermark has passed its end.
    """
    kind = dict(events.dtypes)[key]
    timed = events.select(text.instant(F.col(ts)).alias("ts"), F.unix_micros(text.instant(F.col(ts))).alias("at_us"), key)
    timed = timed.withWatermark("ts", WATERMARK).where(F.col(key).isNotNull() & F.col("at_us").isNotNull())
    microseconds = int(pd.Timedelta(ttl) / pd.Timedelta(1, "us"))
    lives = timed.groupBy(key).transformWithStateInPandas(
        Lives(microseconds, key), f"{key} {kind}, first_us long, end_us long, n long", "append", "eventTime"
    )
    times = {"first_seen": "first_us", "expired_at": "end_us"}
    return lives.select(key, *(text.wall_time(F.timestamp_micros(c)).alias(n) for n, c in times.items()), "n")
