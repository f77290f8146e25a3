"""Shards of nearly equal size by the smallest capacity that a contiguous cut needs.

Groups of rows that must stay together are put in order and cut into at most
``shards`` runs so that the largest run is as small as possible. A binary search
finds the capacity; a greedy fill checks each: a shard takes groups up to the last
one that still fits. The driver fills from a summary of the running sums, a bounded
number of cells with their least and greatest sum. Where a fill ends inside a cell
and the answer hangs on it, those cells are counted anew at a finer width, until
the fills are exact; each time that is one scan.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import in_order, running_start, stored

# Cells of the driver's first summary, and about how many each finer one adds.
CELLS = 4096


class _Sums:
    """What the driver knows of the sorted running sums: cells with least, greatest and count."""

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        self.cells = np.zeros((0, 3), np.int64)
        self._count([(0, total)], max(1, -(-total // CELLS)))

    def _count(self, spans: list[tuple[int, int]], width: int) -> None:
        inside = reduce(or_, (F.col("end").between(a, b) for a, b in spans))
        cell = F.floor(F.col("end") / F.lit(width).cast("decimal(20,0)"))
        found = self.ends.where(inside).groupBy(cell).agg(F.min("end"), F.max("end"), F.count_distinct("end"))
        new = np.array([tuple(r)[1:] for r in found.collect()], np.int64).reshape(-1, 3)
        cells = np.concatenate([self.cells, new])
        self.cells = cells[np.argsort(cells[:, 0])]

    def last(self, most: int, low: bool) -> int:
        """The last sum up to ``most``: a lower or an upper bound of it."""
        i = int(np.searchsorted(self.cells[:, 0], most, "right")) - 1
        if i < 0:
            return 0
        least, greatest, n = (int(x) for x in self.cells[i])
        if most >= greatest:
            return greatest
        return least if low or n <= 2 else most

    def fill(self, capacity: int, shards: int, low: bool) -> list[int]:
        """Ends of the greedy shards, with every end at its lower or upper bound."""
        cuts = [0]
        while len(cuts) <= shards and cuts[-1] < self.total:
            cuts.append(self.last(cuts[-1] + capacity, low))
        return cuts[1:]

    def least_fit(self, low: int, high: int, shards: int, sure: bool) -> int:
        """The least capacity up to ``high`` whose fill, by lower or upper bounds, comes to the end."""
        while low < high:
            middle = (low + high) // 2
            if self.fill(middle, shards, sure)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def refine(self, low: int, high: int, shards: int) -> bool:
        """Count anew the cells in which fills of these capacities can end; false if there is none."""
        spans = list(zip(self.fill(low, shards, True), self.fill(high, shards, False)))
        rough = (self.cells[:, 2] > 2) & np.logical_or.reduce(
            [(self.cells[:, 0] <= b) & (self.cells[:, 1] >= a) for a, b in spans]
        )
        if not rough.any():
            return False
        redo, self.cells = self.cells[rough], self.cells[~rough]
        merged: list[list[int]] = []
        for least, greatest, _ in redo.tolist():
            if merged and not ((self.cells[:, 0] > merged[-1][1]) & (self.cells[:, 0] < least)).any():
                merged[-1][1] = greatest
            else:
                merged.append([least, greatest])
        length = int((redo[:, 1] - redo[:, 0]).sum())
        self._count([tuple(m) for m in merged], max(1, length // CELLS))
        return True


def smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The least capacity whose greedy fill needs at most ``shards`` shards, and its shards' ends.

    ``ends`` has the running sum of sizes behind each group as ``end``.
    """
    sums = _Sums(ends, total)
    low = max(-(-total // shards), largest)
    # Greedy shards with this much room are each fuller than the mean, so it suffices.
    high = low + largest
    while True:
        low = sums.least_fit(low, high, shards, sure=False)
        high = sums.least_fit(low, high, shards, sure=True)
        fill = sums.fill(high, shards, True)
        if low == high and fill[-1] >= total:
            return high, fill
        if not sums.refine(low, high, shards):
            raise RuntimeError("the sums do not add up to the total")


def minimax_shards(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its id, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Rows with equal texts form one group and share a shard (null texts are one
    group of their own). A row's ``size`` is its text's UTF-8 bytes, none for null,
    plus 1. Groups follow their smallest id (nulls last), then the text's digest;
    the shards are runs of them whose largest total is as small as any such cut
    allows, filled greedily, so late shards may be empty if there are few groups.
    ``slot`` counts a shard's rows from 0 without gaps, by group, id and the order
    of reading, so repeated rows get slots of their own. Other columns are not
    carried. An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("total"), F.min("id").alias("first"))
    order = [F.col("first").asc_nulls_last(), F.col("digest")]
    ordered = in_order(groups, order, "shard-groups")
    ends = running_start(ordered, order, F.col("total"), "before")
    ends = stored(ends.withColumn("end", F.col("before") + F.col("total")).drop("before", "part"), "shard-ends")
    total, largest = ends.agg(F.max("end"), F.max("total")).first()
    cuts: list[int] = []
    if total is not None:
        _, cuts = smallest_capacity(ends.select("end"), total, largest, shards)
    shard = sum(((F.col("end") > cut).cast("int") for cut in cuts[:-1]), F.lit(0))
    placed = rows.join(ends.select("digest", "first", shard.alias("shard")), "digest")
    row_order = [*order, F.col("id").asc_nulls_last(), F.col("row")]
    ranged = in_order(placed, row_order, "shard-placed")
    slots = running_start(ranged, row_order, F.lit(1).cast("long"), "slot", keys=["shard"])
    return slots.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
