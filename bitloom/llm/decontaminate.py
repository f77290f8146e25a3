"""Benchmark items in documents, by SimHash of item-sized windows.

Documents are looked through in windows of an item's number of words, one from each
word on. A window and an item are compared if their 64-bit fingerprints differ in at
most ``RADIUS`` bits: with RADIUS + 1 blocks, one block at least is then the same,
so an equality join on blocks misses none of them. The five-word shingles of window
and item, weighted by how often they occur, decide.

A window that shares no shingle with any item has similarity 0, so windows are cut
only around words whose shingle an item has. A bit map of fixed size tells most
shingles apart in the scan, an equality join tells the rest; neither loses a hit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import bare, filled, hashed_words, mix, shingles, slices, stored

K = 5
SIMILARITY = 0.8
RADIUS = 11
MAP_BITS = 1 << 22


def _signs(words: np.ndarray) -> np.ndarray:
    """+1 and -1 for the 64 bits of each word's hash."""
    bits = np.unpackbits(mix(words).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _prints(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of the words in each window, each occurrence counted."""
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(words), axis=0, dtype=np.int32)])
    above = total[ends] - total[starts] > 0
    return np.packbits(above, axis=1, bitorder="little").view("<i8").ravel()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, n, fp, runs): each item with words, its size, fingerprint and shingles."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["item"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, at = hashed_words(filled(batch.column(1)), bare)
            runs, run_at = shingles(words, at, K)
            some = np.flatnonzero(np.diff(at) > 0)
            fp = _prints(words, at[:-1][some], at[1:][some]) if len(some) else np.zeros(0, np.int64)
            lists = [runs[run_at[i] : run_at[i + 1]].view(np.int64) for i in some]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array(np.diff(at)[some], pa.int32()), pa.array(fp, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                ["item", "n", "fp", "runs"],
            )

    return rows.mapInArrow(read, f"item {kind}, n int, fp long, runs array<long>")


def _bit_map(items: DataFrame) -> np.ndarray:
    """A bit for each shingle of the items, in a map of fixed size."""
    bit = F.pmod(F.col("run"), F.lit(MAP_BITS))
    cells = items.select(F.explode("runs").alias("run")).groupBy(F.floor(bit / 32).alias("cell"))
    found = cells.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(run, 32) as int))")).alias("bits")).collect()
    cells = np.zeros(MAP_BITS // 32, np.uint32)
    for row in found:
        cells[row["cell"]] = row["bits"]
    return np.unpackbits(cells.view(np.uint8), bitorder="little").astype(bool)


def _stretches(docs: DataFrame, known: np.ndarray, widest: int, id_col: str, text_col: str) -> DataFrame:
    """Stretches of words that hold every window with a shingle in the map."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = filled(batch.column(1))
            words, at = hashed_words(texts, bare)
            runs, run_at = shingles(words, at, K)
            hits = np.flatnonzero(known[(runs.view(np.int64) % MAP_BITS)])
            text = np.searchsorted(run_at, hits, "right") - 1
            take, first, whole, held, places, hashes = [], [], [], [], [], []
            for t in np.unique(text):
                own = hits[text == t] - run_at[t]
                n = int(at[t + 1] - at[t])
                # Windows with the hit reach no farther than the widest item on either side.
                cuts = np.flatnonzero(np.diff(own) > 2 * widest) + 1
                for group in np.split(own, cuts):
                    a, b = max(0, int(group[0]) + K - widest), min(n, int(group[-1]) + widest)
                    take.append(t)
                    first.append(a)
                    whole.append(n)
                    held.append(words[at[t] + a : at[t] + b].view(np.int64))
                    places.append((group - a).astype(np.int32))
                    hashes.append(runs[run_at[t] + group].view(np.int64))
            # The same hash as Spark's xxhash64, so that rows can be found again by id and text.
            digest = np.array([xxhash.xxh64_intdigest(texts[int(t)].as_py().encode(), 42) for t in take], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(take, pa.int64())),
                    pa.array(digest, pa.int64()),
                    pa.array(first, pa.int32()),
                    pa.array(whole, pa.int32()),
                    pa.array(held, pa.list_(pa.int64())),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array(hashes, pa.list_(pa.int64())),
                ],
                ["id", "digest", "first", "whole", "words", "places", "runs"],
            )

    schema = f"id {kind}, digest long, first int, whole int, words array<long>, places array<int>, runs array<long>"
    return rows.mapInArrow(scan, schema)


def _windows(cut: DataFrame) -> DataFrame:
    """(stretch, start, n, fp): item-sized windows around the places asked for."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "key"):
            for stretch, words, asked in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words = np.array(words, np.int64).view(np.uint64)
                by_size: dict[int, list[int]] = {}
                for ask in asked:
                    by_size.setdefault(ask["n"], []).append(ask["place"])
                starts, sizes = [], []
                for n, places in by_size.items():
                    # A document shorter than the item is one window.
                    last = max(0, len(words) - n)
                    own = np.zeros(last + 2, np.int32)
                    for place in places:
                        own[min(max(0, place + K - n), last)] += 1
                        own[min(place, last) + 1] -= 1
                    found = np.flatnonzero(np.cumsum(own[:-1]) > 0)
                    starts.append(found)
                    sizes.append(np.full(len(found), n))
                start, size = np.concatenate(starts), np.concatenate(sizes)
                fp = _prints(words, start, np.minimum(start + size, len(words)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(start), stretch), pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(fp, pa.int64())],
                    ["stretch", "start", "n", "fp"],
                )

    keyed = cut.select(F.lit("").alias("key"), "stretch", "words", "asked")
    return keyed.mapInArrow(prints, "stretch long, start int, n int, fp long")


def _blocks(rows: DataFrame) -> DataFrame:
    """Each row once for every block of its fingerprint, as ``block`` and ``value``."""
    edges = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    values = [
        F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])
    ]
    return rows.select("*", F.posexplode(F.array(*values)).alias("block", "value"))


def _similar(found: DataFrame) -> DataFrame:
    """Weighted Jaccard similarity of each window's and item's shingles."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own, _ = shingles(np.array(words, np.int64).view(np.uint64), np.array([0, len(words)]), K)
                both = (Counter(own.view(np.int64).tolist()) & Counter(runs)).total()
                out.append(both / (len(own) + len(runs) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["at", "item", "similarity"])

    kind = found.schema["item"].dataType.simpleString()
    at = found.schema["at"].dataType.simpleString()
    return found.select("at", "item", "words", "runs").mapInArrow(weigh, f"at {at}, item {kind}, similarity double")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(id, item, ``similarity``, ``start``, ``n_words``, ``digest``): items found in documents.

    Words stand between ASCII white space; case (of A-Z) and marks around them do
    not count, and words of marks only are left out. A window has as many words
    as the item, or is the whole document if that is shorter. Window and item match
    if the weighted Jaccard similarity of their five-word shingles is at least
    ``similarity`` and their fingerprints differ in at most ``RADIUS`` bits (equal
    passages: none). One row per id, text and item, with its best window, the
    first of the best; ``start`` counts words. An item or text with fewer than five
    words has its whole sequence as its shingle; without words it matches nothing,
    as do null texts. Rows that repeat an id and a text give one row. Other columns
    are not carried; an empty table on either side gives no rows.
    """
    items = _items(benchmark, item_col, item_text_col).withColumn("index", F.monotonically_increasing_id())
    items = stored(items, "leaks-items")
    widest = items.agg(F.max("n")).first()[0] or 0
    scanned = _stretches(docs, _bit_map(items), max(widest, K), id_col, text_col)
    stretches = stored(scanned.withColumn("stretch", F.monotonically_increasing_id()), "leaks-stretches")
    hits = stretches.select("stretch", F.explode(F.arrays_zip("places", "runs")).alias("hit")).select("stretch", "hit.places", "hit.runs")
    sizes = items.select("n", F.explode(F.array_distinct("runs")).alias("runs")).distinct()
    asked = hits.join(sizes, "runs").groupBy("stretch").agg(F.collect_set(F.struct("n", F.col("places").alias("place"))).alias("asked"))
    windows = _windows(stretches.select("stretch", "words").join(asked, "stretch"))
    blocks = _blocks(items.select("index", "n", "fp")).withColumnRenamed("fp", "item_fp")
    near = _blocks(windows).join(blocks, ["n", "block", "value"])
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.select("stretch", "start", "n", "index").distinct()
    found = near.join(items.select("index", "item", "runs"), "index").join(stretches.select("stretch", "id", "digest", "first", "words"), "stretch")
    at = F.struct("id", "digest", (F.col("first") + F.col("start")).alias("start"), F.least("n", F.size("words")).alias("n_words"))
    found = found.select(at.alias("at"), "item", F.slice("words", F.col("start") + 1, F.col("n")).alias("words"), "runs")
    verified = _similar(found).where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("similarity", "at.start", "at.n_words"), F.struct("similarity", -F.col("at.start")))
    verified = verified.groupBy(F.col("at.id").alias("id"), F.col("at.digest").alias("digest"), "item").agg(best.alias("best"))
    return verified.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.*", "digest")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names
) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; null texts stay. See ``leaks``."""
    found = leaks(docs, benchmark, id_col, text_col, **names)
    # Two longs for each leaked row: a small table for Spark to send to the texts if it can.
    gone = found.select(F.col(id_col).alias("leaked_id"), F.col("digest").alias("leaked_digest")).distinct()
    same = docs[id_col].eqNullSafe(F.col("leaked_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("leaked_digest"))
    return docs.join(gone, same, "left_anti")
