"""What the operators of this subpackage share: stored tables, splitting, words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import skew
from bitloom.sources.files import new_folder

# Bytes of text that a Python worker works on at once; one longer text is worked on alone.
SLICE_BYTES = 1_000_000
# Bytes of rows that are sent to a Python worker at once, where the session does not say; Spark's own bounds are 10,000 rows and 64 MB.
BATCH_BYTES = 4_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_RECORDS: list[list[str]] = []
# The allocator of numpy and Python keeps what they free, unless it is told; not all systems can be.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table once to shared storage and read it back.

    What several branches or jobs use is computed once and survives lost executors.
    """
    path = new_folder(df.sparkSession, label)
    for record in _RECORDS:
        record.append(path)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside the block sends rows to Python workers in batches of few bytes, unless the session says how many.

    An executor and its workers hold a batch for each task, and copies of it while it grows.
    """
    unset = spark.conf.get(_BATCH, None) is None
    if unset:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if unset:
            spark.conf.unset(_BATCH)


@contextmanager
def recording() -> Iterator[list[str]]:
    """The folders of all tables that are ``stored`` inside the block."""
    record: list[str] = []
    _RECORDS.append(record)
    try:
        yield record
    finally:
        _RECORDS.remove(record)


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Free the space of stored tables that nothing will read again."""
    while paths:
        spark.range(0).coalesce(1).write.mode("overwrite").parquet(paths.pop())


def nested(docs: DataFrame, name: str = "doc") -> DataFrame:
    """All columns of ``docs`` in one struct, so that no added column can clash with them."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias(name))


def in_order(df: DataFrame, order: list[Column], label: str, part: str = "part") -> DataFrame:
    """The rows range-partitioned and written once, with the range's number as ``part``.

    Ranges follow ``order``, so sorting by ``part`` and then ``order`` is the whole
    order. ``order`` has to be a total order on distinct rows where ranges are to
    stay balanced.
    """
    return stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), label)


def running_start(
    df: DataFrame, order: list[Column], weight: Column, name: str, keys: list[str] | None = None, part: str = "part"
) -> DataFrame:
    """Add the sum of ``weight`` over all rows before, by ``part`` and then ``order``."""
    return skew.running_total(df, keys or [], part, order, weight, name)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of each have at most ``most`` bytes, or are one text."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        ends = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])
        release()


def release() -> None:
    """Give freed memory back to the machine: Python workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def filled(texts: pa.Array) -> pa.Array:
    """Texts in one array with 64-bit offsets, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.large_string()).fill_null("")


def split_words(texts: pa.Array, fold: bool = False) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts between ASCII white space, and where each text's words start.

    Returns the words as a dictionary array over bytes and n + 1 offsets into it.
    ``fold`` lower-cases A-Z where the next byte is ASCII too, so that no
    combining mark follows; other letters keep their case.
    """
    texts = filled(texts)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    packed = data[inside]
    if fold:
        upper = (packed >= 65) & (packed <= 90)
        upper[:-1] &= packed[1:] < 128
        packed[upper] |= 32
    # A word ends where the next one begins without a gap, or before a byte outside words.
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) - starts + 1, out=places[1:])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(packed)]
    )
    return words.dictionary_encode(), np.searchsorted(starts, bounds)


def hashed_words(texts: pa.Array, form: Callable[[bytes], bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of all texts, and where each text's words start.

    ``form`` gives a word's normal form; words whose form is empty are left out.
    """
    words, bounds = split_words(texts)
    known = words.dictionary.to_pylist()
    codes = words.indices.to_numpy(zero_copy_only=False)
    if form is not None:
        known = [form(w) for w in known]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
    if form is not None and not all(known):
        keep = np.fromiter((bool(w) for w in known), bool, len(known))[codes]
        bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
        codes = codes[keep]
    return hashes[codes] if len(known) else np.zeros(0, np.uint64), bounds


# Marks that don't count at a word's ends.
EDGES = b".,;:!?\"'()[]{}<>*_-|#$%&"


def bare(word: bytes) -> bytes:
    """A word without case (of A-Z) and without marks around it."""
    return word.lower().strip(EDGES)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the splitmix64 finaliser)."""
    # The published constants of the finaliser.
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a text, and where each text's runs start.

    A text of fewer words, but not of none, has its whole sequence as its one run.
    """
    odd = np.uint64(0x9E3779B97F4A7C15)
    sizes = np.diff(bounds)
    counts = np.where(sizes == 0, 0, np.maximum(sizes - k + 1, 1))
    starts = np.concatenate(([0], np.cumsum(counts)))
    text = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(starts[-1]) - starts[:-1][text] + bounds[:-1][text]
    ends = bounds[1:][text]
    out = np.full(len(at), k, np.uint64)
    # Only a whole short text can reach its end early: word places are checked for it alone.
    short = bool((counts > 0).any() and (sizes[counts > 0] < k).any())
    for j in range(k):
        if short:
            there = at + j < ends
            word = np.where(there, words[np.minimum(at + j, max(len(words) - 1, 0))], np.uint64(1))
        else:
            word = words[at + j]
        out = mix(out * odd + word)
    return out, starts
