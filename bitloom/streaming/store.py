"""A table that a stream writes to: versioned, compacted, safe to repeat.

Each micro-batch is one delta. Deltas merge into larger ones as in a log-structured
merge tree: ``FAN`` tables of a level become one of the next, so a row is rewritten
once per level and not once per batch. What is live is named by a small table of its
own, written last: until then readers see the version before, whole. The number of
tables is bounded by the number of levels, and files by that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

FAN = 8
_STATE = "batch long, level int, seq long, live boolean"
_SLOTS = ("slot=0", "slot=1")


def _tables(path: str, entries: list) -> list[str]:
    # Names come round again: a table that a merge has replaced is overwritten some merges later.
    return [f"{path}/level={level}/table={seq % (2 * FAN)}" for level, seq in entries]


def _state(spark: SparkSession, path: str) -> list:
    """The entries of the newest version; one slot is whole at any time."""
    newest: list = []
    for slot in _SLOTS:
        try:
            rows = spark.read.schema(_STATE).parquet(f"{path}/version/{slot}").collect()
        except AnalysisException:
            continue
        if rows and (not newest or rows[0]["batch"] > newest[0]["batch"]):
            newest = rows
    return newest


def version(spark: SparkSession, path: str) -> int | None:
    """The last batch that the table holds."""
    state = _state(spark, path)
    return state[0]["batch"] if state else None


def live_tables(spark: SparkSession, path: str) -> list[str]:
    """The tables of the newest version."""
    return _tables(path, [(r["level"], r["seq"]) for r in _state(spark, path) if r["live"]])


def add(delta: DataFrame, batch_id: int, path: str, merge: Callable[[DataFrame], DataFrame], files: int = 0) -> bool:
    """Add one batch under ``path``; a batch that is there already changes nothing.

    ``merge`` makes one row of the rows of a key, and has to give the same for a
    merge of merges. ``files`` bounds the files of a delta.
    """
    spark = delta.sparkSession
    state = _state(spark, path)
    if state and batch_id <= state[0]["batch"]:
        return False
    last = {r["level"]: -1 for r in state}
    for r in state:
        last[r["level"]] = max(last[r["level"]], r["seq"])
    live = [(r["level"], r["seq"]) for r in state if r["live"]]

    def put(level: int, rows: DataFrame) -> None:
        last[level] = last.get(level, -1) + 1
        rows.write.mode("overwrite").parquet(_tables(path, [(level, last[level])])[0])
        live.append((level, last[level]))

    put(0, delta.coalesce(files) if files else delta)
    level = 0
    while sum(of == level for of, _ in live) >= FAN:
        full = [e for e in live if e[0] == level]
        put(level + 1, merge(spark.read.schema(delta.schema).parquet(*_tables(path, full))))
        live = [e for e in live if e[0] != level]
        level += 1
    entries = sorted({*live, *last.items()})
    rows = [(batch_id, of, seq, (of, seq) in live) for of, seq in entries]
    version_rows = spark.createDataFrame(rows, _STATE).coalesce(1)
    version_rows.write.mode("overwrite").parquet(f"{path}/version/{_SLOTS[batch_id % 2]}")
    return True


def read(spark: SparkSession, path: str, schema, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The merged rows of the newest version; no row if there is none."""
    tables = live_tables(spark, path)
    if not tables:
        return merge(spark.createDataFrame([], schema))
    return merge(spark.read.schema(schema).parquet(*tables))
