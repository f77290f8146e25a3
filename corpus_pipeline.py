"""From raw documents to packed training windows, one operator for each stage.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with their
columns; the last gives the packed pieces. ``run`` writes each stage's rows as
Parquet in shared storage and reads them again for the next. So when a stage
begins, the rows of the one before are written, and the tables that it worked with
are cleared. What the last stage's rows are read from is never cleared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import decontaminate, line_dedup, packing, quality, simhash_dedup
from bitloom.llm.common import clear, recording, stored
from bitloom.sources.tables import read_table


_LEFT: list[str] = []
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """A stage that first clears the working tables of the stage before it, whose rows have been written."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark, _LEFT)
        with recording() as paths:
            out = work(spark, docs, sf_dir)
        _LEFT.extend(paths)
        return out

    return run_stage


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; the rejected ones go."""
    return quality.resample(docs, read_table(spark, sf_dir, "labels")).select("doc.*")


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those that were nothing else go."""
    left = line_dedup.dedup_lines(docs)
    left = left.where((F.size("dropped") == 0) | (F.size("dropped") < F.col("n_lines")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


@stage
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles alike by 0.8 or more."""
    return simhash_dedup.one_of_each(docs, k=5)


@stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens in full windows, with the sources' shares in each; its tables stay, for the rows are read later."""
    clear(spark, _LEFT)
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_windows),
]

# Hashed models, fingerprints and tokenizers are beyond SQL: tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stored(work(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
