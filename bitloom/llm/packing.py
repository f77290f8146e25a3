"""Packing token streams into full windows with the mixture held in every window.

Each source is a queue of its documents' tokens. Deficit round-robin serves the
queues: token j of a source with share w is due at (j + 1/2) / w, and windows take
tokens as they fall due. So every window has each source's share to within a token,
and what a source was short of in one window it gets in the next. How many tokens
of each source come before any window follows from the totals alone: a task can cut
its documents without what other tasks did, and deficits carry across tasks exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import BATCH_BYTES, slices, stored
from bitloom.llm.token_counts import pieces_of, token_ids

WINDOW = 2048
# The id put behind each document.
END_ID = 1
# Sources are the parts of a mixture and few; their totals are held by every task.
MOST_SOURCES = 10_000


class _Phase:
    """A stretch of windows in which the same queues have tokens left."""

    def __init__(self, start: list[int], shares: list[int]):
        self.start, self.shares = start, shares
        self.before, self.whole = sum(start), sum(shares)

    def served(self, taken: int) -> list[int]:
        """Tokens of each queue among the first ``taken`` that fall due."""
        whole = self.whole
        counts = [(2 * taken * w + whole) // (2 * whole) for w in self.shares]
        off = taken - sum(counts)
        while off:  # at most half as often as there are queues
            live = [s for s, w in enumerate(self.shares) if w]
            if off > 0:
                s = min(live, key=lambda s: (Fraction(2 * counts[s] + 1, self.shares[s]), s))
            else:
                s = max((s for s in live if counts[s]), key=lambda s: (Fraction(2 * counts[s] - 1, self.shares[s]), s))
            counts[s] += 1 if off > 0 else -1
            off -= 1 if off > 0 else -1
        return counts


class Mixture:
    """How many tokens of each queue come before a window."""

    def __init__(self, totals: list[int], shares: list[int] | None = None, window: int = WINDOW):
        self.totals, self.total, self.window = totals, sum(totals), window
        self.phases = []
        start = [0] * len(totals)
        if shares is None and self.total:  # all queues end together
            self.phases.append(_Phase(start, totals))
        while shares is not None and sum(start) < self.total:
            left = [t - a for t, a in zip(totals, start)]
            # Queues without a share of their own go last, in proportion to their length.
            now = [w if n else 0 for w, n in zip(shares, left)]
            now = now if any(now) else left
            self.phases.append(_Phase(start, now))
            last, s = min((Fraction(2 * n - 1, 2 * w), i) for i, (n, w) in enumerate(zip(left, now)) if w)
            due = [int(last * w + Fraction(1, 2)) - (last * w + Fraction(1, 2) == int(last * w + Fraction(1, 2)) and i > s) for i, w in enumerate(now)]
            start = [a + max(0, k) for a, k in zip(start, due)]
        self.cache: dict[int, list[int]] = {}

    def before(self, window: int) -> list[int]:
        """Tokens of each queue in all windows before ``window``."""
        if window not in self.cache:
            if len(self.cache) > 100_000:
                self.cache.clear()
            taken = min(window * self.window, self.total)
            phase = next((p for p in reversed(self.phases) if p.before <= taken), None)
            served = phase.served(taken - phase.before) if phase else [0] * len(self.totals)
            self.cache[window] = [a + n for a, n in zip(phase.start, served)] if phase else served
        return self.cache[window]

    def window_of(self, queue: int, place: int) -> int:
        """The window that holds the token at ``place`` of ``queue``."""
        low, high = 0, -(-self.total // self.window) - 1
        guess = place * self.total // self.totals[queue] // self.window
        step = 1
        while low < high:
            guess = min(max(guess, low), high)
            if self.before(guess)[queue] > place:
                high = guess - 1
                guess -= step
            elif self.before(guess + 1)[queue] <= place:
                low = guess + 1
                guess += step
            else:
                return guess
            step *= 2
            if step > 64:
                guess = (low + high) // 2
        return low

    def cuts(self, queue: int, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the text, length, window, offset there) of a text's pieces."""
        at, window = 0, self.window_of(queue, start) if length else 0
        while at < length:
            here, after = self.before(window), self.before(window + 1)
            take = min(length - at, after[queue] - (start + at))
            if take > 0:
                ahead = sum(after[:queue]) - sum(here[:queue])
                yield at, take, window, ahead + start + at - here[queue]
                at += take
            window += 1


def _tokens(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str | None) -> DataFrame:
    """Each text's ids, with how many of its queue come before it in its task."""
    source = F.col(source_col).cast("string")
    queue = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), queue.alias("queue"))
    kind = rows.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = pieces_of(path), TaskContext.get().partitionId(), {}
        # A batch as ``stored`` sends them, with the row that goes beyond its bytes, is encoded whole.
        for batch in slices(batches, "text", BATCH_BYTES * 9 // 8):
            ids = [np.append(i, np.uint32(END_ID)) for i in token_ids(batch.column(1), encoder)]
            local = []
            for queue, own in zip(batch.column(2).to_pylist(), ids):
                local.append(seen.get(queue, 0))
                seen[queue] = local[-1] + len(own)
            # Ids of small vocabularies are kept in two bytes.
            small = encoder.whole.get_vocab_size() <= 1 << 16
            data = [i.astype("<u2" if small else "<u4").tobytes() for i in ids]
            n = pa.array([len(i) for i in ids], pa.int64())
            columns = [batch.column(0), batch.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(local, pa.int64()), n, pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "queue", "part", "local", "n", "ids"])

    return rows.mapInArrow(encode, f"id {kind}, queue string, part int, local long, n long, ids binary")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    shares: dict[str, int] | None = None,
    window: int = WINDOW,
    path: str | None = None,
) -> DataFrame:
    """One row per piece: id, ``source``, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document's tokens are those of its whole text and then one end id; a null
    text counts as empty. ``ids`` holds the piece's ids as little-endian 32-bit
    integers. All windows but the last are full, so padding is less than one
    window in all. Each window holds the sources in their target proportions:
    ``shares`` by source, or else the sources' shares of all tokens, with which
    all queues end together. When a queue ends, the others share its place;
    queues without a share come last. A null source is a queue of its own. Within
    a queue, documents follow the order of reading. Repeated rows are packed as
    often as they are there; other columns are not carried; an empty table gives
    no rows. More than ``MOST_SOURCES`` sources raise an error.
    """
    tokens = stored(_tokens(docs, id_col, text_col, source_col, path), "pack-tokens")
    sums = tokens.groupBy("queue", "part").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sums.withColumn("offset", F.coalesce(F.sum("total").over(earlier), F.lit(0))), "pack-offsets")
    lengths = offsets.groupBy("queue").agg(F.sum("total").alias("total")).orderBy("queue").limit(MOST_SOURCES + 1).collect()
    if len(lengths) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: give a coarser column")
    names = [r["queue"] for r in lengths]
    wanted = [shares.get(q[1:], 0) if q else 0 for q in names] if shares is not None else None
    mixture = Mixture([r["total"] for r in lengths], wanted, window)
    place = {q: i for i, q in enumerate(names)}
    kind = tokens.schema["id"].dataType.simpleString()
    schema = f"id {kind}, queue string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            take, columns = [], [[] for _ in range(6)]
            queues = batch.column(1).to_pylist()
            starts, sizes, data = (batch.column(i).to_pylist() for i in (2, 3, 4))
            for row, (queue, begin, n, raw) in enumerate(zip(queues, starts, sizes, data)):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                for at, length, sequence, offset in mixture.cuts(place[queue], begin, n):
                    take.append(row)
                    for column, value in zip(columns, (at, length, ids[4 * at : 4 * (at + length)], n, sequence, offset)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            own = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["id", "queue", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    begun = tokens.join(offsets.drop("total"), ["queue", "part"])
    begun = begun.select("id", "queue", (F.col("offset") + F.col("local")).alias("begin"), "n", "ids")
    pieces = begun.mapInArrow(cut, schema)
    source = F.when(F.col("queue") != "", F.expr("substring(queue, 2)"))
    return pieces.select(F.col("id").alias(id_col), source.alias(source_col), *[c for c in pieces.columns if c not in ("id", "queue")])
