"""Ingest of table columns: token index, sketch and entity of each, in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import hashing, text
from bitloom.operators import entity, sketch, tokens
from bitloom.operators.sketch import Sketches


def column_postings(
    df: DataFrame, parent: str, columns: Sequence[str], tokenizer: text.Tokenizer = text.distinct_words
) -> DataFrame:
    """Index postings ``(id, token, ref, n)`` of several columns; ``ref`` is the column's id.

    ``n`` counts the values of a column that hold the token; nulls are skipped. The
    table is read once for all columns, and a token's occurrences are counted
    before anything is shuffled.
    """
    rows = tokens.column_tokens(df, parent, columns, tokenizer)
    return tokens.postings(rows.select(F.col("column_id").alias("ref"), F.lit(0).alias("batch"), "token"), distinct=True)


def column_days(
    df: DataFrame, day: Column, parent: str, columns: Sequence[str], p: int = hashing.DEFAULT_P,
    tokenizer: text.Tokenizer = text.distinct_words,
) -> DataFrame:
    """Registers ``(key, day, bin, word)`` of several columns for each day; ``key`` is the column's id.

    The table is read once for all columns and days, and registers are folded before
    the shuffle, so a day or a column that holds most rows sends 2^p rows a task.
    Rows without a day, and null values, are skipped. ``entity.change_series`` takes
    the result.
    """
    dated = df.select(day.alias("_day"), *columns).where(F.col("_day").isNotNull())
    tokens_of = tokens.column_tokens(dated, parent, columns, tokenizer, keep=["_day"])
    daily = sketch.build(tokens_of, F.struct(F.col("column_id").alias("key"), F.col("_day").alias("day")), F.col("token"), p=p)
    return daily.rows.select("set_id.key", "set_id.day", "bin", "word")


def column_entities(postings: DataFrame, p: int = hashing.DEFAULT_P) -> DataFrame:
    """A terminal entity with its dataset for each column of the postings."""
    sketches: Sketches = sketch.build(postings, F.col("ref"), F.col("token"), p=p)
    return entity.with_dataset(entity.build(sketches), sketch.dump_sparse(sketches), ["set_id"])
