"""Text and date expressions: tokenizing, cleaning, keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of letters and digits in any script.
WORD_PATTERN = r"([\p{L}\p{N}]+)"
# The first part of a string that stands in single quotes.
QUOTED_PATTERN = "'([^']*)'"

Tokenizer = Callable[[Column], Column]


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text.cast("string")), F.lit(WORD_PATTERN), F.lit(1))


def distinct_words(text: Column) -> Column:
    """Distinct words of one text; removes repeats before anything is shuffled."""
    return F.array_distinct(words(text))


def split_whitespace(text: Column) -> Column:
    """Runs of non-blank characters."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def split_nonword(text: Column) -> Column:
    """Pieces between runs of characters other than ASCII letters, digits and ``_``."""
    return F.filter(F.split(text, r"\W+"), lambda w: w != "")


def longer_than(token: Column, n_bytes: int = 2) -> Column:
    """True for tokens of more than ``n_bytes`` bytes in UTF-8."""
    return F.octet_length(token) > n_bytes


def quoted_extract(value: Column) -> Column:
    """First single-quoted part; empty when missing or not there."""
    return F.coalesce(F.regexp_extract(value, QUOTED_PATTERN, 1), F.lit(""))


def instant(wall: Column) -> Column:
    """A time without zone as an instant, read as UTC whatever the session's zone."""
    return F.concat(wall.cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp")


def wall_time(at: Column) -> Column:
    """An instant as UTC time without zone, whatever the session's zone."""
    seconds = (F.unix_micros(at) / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)


def day_key(ts: Column) -> Column:
    """``yyyy-MM-dd`` of a timestamp or of a ``yyyy-MM-dd HH:mm:ss`` string."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd")
