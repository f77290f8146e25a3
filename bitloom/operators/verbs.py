"""Data frame verbs: cleaning, filtering, summarising, reshaping."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of a task that collects the distinct values of all columns.
PROFILED = 100_000


def fill_unknown(df: DataFrame, value: str = "unknown") -> DataFrame:
    """Every column as text, with a word in place of what is missing."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit(value)).alias(c) for c in df.columns))


def rows_of_day(df: DataFrame, ts: str, day: str) -> DataFrame:
    """Rows of one calendar day, as a range on the raw column that the scan can push down."""
    column = F.col(ts)
    start = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    return df.where((column >= start) & (column < start + F.expr("INTERVAL 1 DAY")))


def not_prefixed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column does not start with a prefix."""
    return df.where(~F.col(column).startswith(prefix))


def above_mean(df: DataFrame, column: str) -> DataFrame:
    """Rows at or above the mean of a column's non-missing values."""
    mean = df.agg(F.avg(column).alias("mean")).scalar()
    return df.where(F.col(column) >= mean)


def across(
    df: DataFrame, by: Sequence[str], starts: str, ends: str, functions: Iterable[str] = ("mean", "sum")
) -> DataFrame:
    """Apply each function to every numeric column by name prefix or suffix, in one aggregate."""
    calls = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    chosen = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name not in by
        and (f.name.startswith(starts) or f.name.endswith(ends))
    ]
    return df.groupBy(*by).agg(*(calls[fn](c).alias(f"{c}_{fn}") for c in chosen for fn in functions))


def pivot_longer(df: DataFrame, columns: Sequence[str] | None = None, ids: Sequence[str] = ()) -> DataFrame:
    """Columns to rows ``(variable, value)``; values as text, missing values kept."""
    columns = list(columns or [c for c in df.columns if c not in ids])
    as_text = df.select(*ids, *(F.col(c).cast("string").alias(c) for c in columns))
    return as_text.unpivot(list(ids), columns, "variable", "value")


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """The rows of a larger table in partitions of about ``rows``.

    A scan's own partitions tell little: one row group of a file is read by one task.
    """
    parts = -(-df.count() // rows)
    if parts <= 1:
        return df
    return df.withColumn("_row", F.monotonically_increasing_id()).repartition(parts, "_row").drop("_row")


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: type, non-null count, distinct count, least and greatest value as text.

    Values are compared in the column's own type and shown as text afterwards. All
    columns come out of one aggregate, whose tasks hold the distinct values of
    ``PROFILED`` rows before they send them on, however few files the table has;
    ``exact=False`` estimates distinct counts, so that no value is shuffled.
    """
    if exact:
        df = dealt(df, PROFILED)
    distinct = F.count_distinct if exact else F.approx_count_distinct
    facts = [
        F.struct(
            F.lit(name).alias("variable"),
            F.lit(kind).alias("type"),
            F.count(F.col(name)).alias("n_values"),
            distinct(F.col(name)).alias("n_distinct"),
            F.min(F.col(name)).cast("string").alias("least"),
            F.max(F.col(name)).cast("string").alias("greatest"),
        )
        for name, kind in df.dtypes
    ]
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def case_of(cases: Sequence[tuple[Column, str]], default: str) -> Column:
    """First label whose condition holds, else the default."""
    out = F
    for test, label in cases:
        out = out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int, skip: int = 0) -> DataFrame:
    """A page of ``n`` rows in a stated total order."""
    ordered = df.orderBy(*order)
    return (ordered.offset(skip) if skip else ordered).limit(n)
