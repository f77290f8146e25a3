"""Nearest vectors by cosine through a few stable projections.

Unit vectors are projected on ``DIMENSIONS`` Gaussian directions. Two vectors at a
distance d have projections whose squared distance is d^2 times a chi-square value
of as many degrees of freedom. So a query looks at vectors in the order of their
projected distance, and stops when the next one is so far off that a vector nearer
than the k-th found would lie there only with a probability of 1 - ``CONFIDENCE``.
There is no cap: a query goes on until that test holds.

The projections are indexed by a kd-tree, fitted on a bounded sample; every vector
is in one cell of it. A query visits cells in the order of their distance, first
one, then four, sixteen and so on; within a cell it verifies by projected distance.
Queries and cells meet in a cogroup of bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import stored
from bitloom.operators import skew

DIMENSIONS = 8
CONFIDENCE = 0.96
# Vectors that a cell has on average; those that a larger one is dealt into, and queries of a block.
CELL_ROWS, PART_ROWS, BLOCK = 2048, 4096, 512
# About so many vectors are sampled to fit the tree, and so many of them a cell has at least.
SAMPLE_ROWS, SUPPORT = 65_536, 32
# How many candidates a query verifies before it looks at its test again.
STEP = 128
SEED = 11


def chi_square_below(x: float, degrees: int) -> float:
    """The chance that a chi-square value of an even number of degrees is at most ``x``."""
    return 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(degrees // 2))


def chi_square_quantile(chance: float, degrees: int) -> float:
    """Where ``chi_square_below`` is ``chance``, by halving."""
    low, high = 0.0, 1.0
    while chi_square_below(high, degrees) < chance:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, degrees) < chance else (low, middle)
    return high


def _units(raw: pa.Array) -> np.ndarray:
    """Vectors of one dimension, scaled to length 1; large numbers don't overflow."""
    raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
    x = raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, DIMENSIONS))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * DIMENSIONS, pa.int32()), pa.array(x.ravel()))


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vecs = batch.column(batch.schema.get_field_index("vec"))
        dims = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
        out = np.empty((len(dims), DIMENSIONS))
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            out[own] = _units(vecs.take(pa.array(own))) @ _directions(int(dim))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(dims, pa.int32()), _lists(out)], [*batch.schema.names, "dim", "point"]
        )


class Tree:
    """A kd-tree over points: each node is cut at the median of its widest axis."""

    def __init__(self, sample: np.ndarray, rows: float):
        depth = max(0, int(np.ceil(np.log2(max(rows, 1) / CELL_ROWS))))
        self.depth = min(depth, max(0, int(np.log2(max(len(sample), 1) / SUPPORT))))
        self.axis, self.cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        node = np.ones(len(sample), np.int64)
        for level in range(self.depth):
            for n in range(1 << level, 2 << level):
                own = sample[node == n]
                if len(own):
                    self.axis[n] = np.argmax(own.max(axis=0) - own.min(axis=0))
                    self.cut[n] = np.median(own[:, self.axis[n]])
            node = self._down(sample, node)
        self.low = self.high = None

    def _down(self, points: np.ndarray, node: np.ndarray) -> np.ndarray:
        return 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = self._down(points, node)
        return node - (1 << self.depth)

    def enclose(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Take the smallest boxes around the cells' points; cells without points are never visited."""
        self.low = np.full((1 << self.depth, DIMENSIONS), np.inf)
        self.high = np.full((1 << self.depth, DIMENSIONS), np.inf)
        self.low[cells], self.high[cells] = low, high

    def nearest(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells in the order of their squared distance from a point, and that distance."""
        away = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        away = (away * away).sum(axis=1)
        order = np.argsort(away, kind="stable")
        return order, away[order]


def _assign(trees: dict[int, Tree]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            dims = batch.column(names.index("dim")).to_numpy()
            points = _matrix(batch.column(names.index("point")))
            cells = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                if dim in trees:
                    cells[dims == dim] = trees[dim].cells(points[dims == dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*names, "cell"])

    return assign


def _index(classes: DataFrame) -> tuple[DataFrame, dict[int, Tree]]:
    """Every class with its cell, stored, and the trees by dimension."""
    schema = ", ".join(f"{n} {t}" for n, t in classes.dtypes)
    placed = stored(classes.mapInArrow(_project, f"{schema}, dim int, point array<double>"), "search-points")
    rows = placed.count()
    # Chosen by their hash; twice as many as meant is beyond all chance.
    some = placed.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_ROWS / max(rows, 1))))
    sample = some.select("dim", "point").limit(2 * SAMPLE_ROWS).toArrow()
    dims, points = sample.column("dim").to_numpy(), _matrix(sample.column("point"))
    share = max(rows, 1) / max(len(dims), 1)
    trees = {int(d): Tree(points[dims == d], share * (dims == d).sum()) for d in np.unique(dims)}
    index = stored(placed.mapInArrow(_assign(trees), f"{schema}, dim int, point array<double>, cell int"), "search-index")
    # One row per cell of a tree: bounded by the sample.
    known = F.col("dim").isin(list(trees)) if trees else F.lit(False)
    ends = [f(F.col("point")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(DIMENSIONS)]
    boxes = index.where(known).groupBy("dim", "cell").agg(*ends).toArrow()
    low, high = (np.stack([boxes.column(f"{name}{i}").to_numpy() for i in range(DIMENSIONS)], axis=1) for name in ("low", "high"))
    for dim, tree in trees.items():
        own = boxes.column("dim").to_numpy() == dim
        tree.enclose(boxes.column("cell").to_numpy()[own], low[own], high[own])
    return index, trees


def _visits(trees: dict[int, Tree], first: int, many: int, quantile: float):
    """(cid, dim, cell): the next cells of each query, as long as its test doesn't hold."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, dims = batch.column(0), batch.column(1).to_numpy()
            points, far = _matrix(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False)
            row, cell = [], []
            for i, dim in enumerate(dims):
                # A dimension that the sample has none of is rare: it has one cell.
                order, away = trees[dim].nearest(points[i]) if dim in trees else (np.zeros(1, np.int64), np.zeros(1))
                order, away = order[first : first + many], away[first : first + many]
                near = order[np.isfinite(away) & (away < quantile * (far[i] + 1e-12))]
                row.append(np.full(len(near), i))
                cell.append(near)
            if row:
                row = np.concatenate(row)
                yield pa.RecordBatch.from_arrays(
                    [cid.take(pa.array(row)), pa.array(dims[row], pa.int32()), pa.array(np.concatenate(cell), pa.int32())],
                    ["cid", "dim", "cell"],
                )

    return visits


FOUND = "cid long, score double, id long, own boolean"


def _search(most: int, quantile: float):
    """The ``most`` nearest rows of a block of vectors for each query of a block."""

    def search(queries: pa.Table, block: pa.Table) -> pa.Table:
        ids = block.column("ids").combine_chunks()
        entry = np.repeat(np.arange(len(ids)), pc.list_value_length(ids).to_numpy(zero_copy_only=False))
        ids = ids.flatten().to_numpy(zero_copy_only=False)
        cids = block.column("cid").to_numpy()[entry]
        if not queries.num_rows or not len(ids):
            return pa.table({"cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "id": pa.array([], pa.int64()), "own": pa.array([], pa.bool_())})
        units, points = _units(block.column("vec"))[entry], _matrix(block.column("point"))[entry]
        asks, at = _units(queries.column("vec")), _matrix(queries.column("point"))
        away = np.maximum((at * at).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * at @ points.T, 0)
        order = np.argsort(away, axis=1, kind="stable")
        away = np.take_along_axis(away, order, axis=1)
        # The squared distance of the last that counts: what was found before, then what is found here.
        far = queries.column("far").to_numpy(zero_copy_only=False).copy()
        best = np.full((len(asks), most), -np.inf)
        held = np.full((len(asks), most), -1)
        active = np.arange(len(asks))
        for start in range(0, len(ids), STEP):
            active = active[away[active, start] < quantile * (far[active] + 1e-12)]
            if not len(active):
                break
            for some in np.array_split(active, -(-len(active) // 64)):
                near = order[some, start : start + STEP]
                score = np.einsum("qd,qed->qe", asks[some], units[near])
                score[away[some, start : start + STEP] >= quantile * (far[some] + 1e-12)[:, None]] = -np.inf
                score, near = np.hstack([best[some], score]), np.hstack([held[some], near])
                first = np.lexsort((np.where(near < 0, -1, ids[near]), -score), axis=-1)[:, :most]
                best[some], held[some] = np.take_along_axis(score, first, 1), np.take_along_axis(near, first, 1)
                far[some] = np.minimum(far[some], np.maximum(2 - 2 * best[some, -1], 0))
        query, place = np.nonzero(np.isfinite(best))
        found = held[query, place]
        cid = queries.column("cid").to_numpy()[query]
        return pa.table({"cid": cid, "score": best[query, place], "id": ids[found], "own": cids[found] == cid})

    return search


def _best(found: DataFrame, most: int) -> DataFrame:
    """(cid, best, far): each query's nearest so far, and the squared distance of the last if there are enough."""
    order = Window.partitionBy("cid").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    entries = F.array_sort(F.collect_list(F.struct("at", "score", "id", "own")))
    best = ranked.groupBy("cid").agg(entries.alias("best"))
    far = F.when(F.size("best") == most, F.greatest(F.lit(0.0), 2 - 2 * F.element_at("best", -1)["score"]))
    return best.withColumn("far", F.coalesce(far, F.lit(float("inf"))))


def nearest(
    vectors: DataFrame,
    asked: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``asked``, the ``k`` nearest others found.

    Nearness is the cosine in double precision, ties go to the smaller id. Every row
    is in the index. A near one is missed with a probability of 1 - ``confidence``
    at most, counted for the k-th; nearer ones are missed less.

    Vectors that are null, empty or zero, or have a null or non-finite number, take no
    part, nor do rows with a null id; vectors of unlike dimensions never meet. Equal
    vectors are searched for and verified once, however many there are. Rows that
    share an id are rows like others: each is a candidate for the rest. With fewer
    than ``k`` candidates all are returned, with none there is no row. Other columns
    are not carried; an empty table gives no rows.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec"), asked.alias("asked"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    # Of equal vectors the least ids are enough: one more than asked for, as one may be the query itself.
    most = k + 1
    least = skew.top_k(rows.select("vec", "id"), "vec", [F.asc("id")], most, ["id"])
    classes = least.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    index, trees = _index(stored(classes.withColumn("cid", F.monotonically_increasing_id()), "search-classes"))
    asking = skew.lookup(rows.where("asked").select("id", "vec"), index.select("vec", "cid"), ["vec"]).select("id", "cid")
    asking = stored(asking, "search-asking")
    queries = stored(index.join(asking.select("cid").distinct(), "cid", "left_semi").select("cid", "dim", "vec", "point"), "search-queries")
    parts = index.groupBy("dim", "cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    quantile = chi_square_quantile(confidence, DIMENSIONS)
    best = stored(queries.select("cid", F.lit(None).cast("array<struct<at:int,score:double,id:long,own:boolean>>").alias("best"), F.lit(float("inf")).alias("far")), "search-best")
    first, many, cells = 0, 1, max([1, *(1 << t.depth for t in trees.values())])
    while first < cells:
        open_ = queries.join(best, "cid").select("cid", "dim", "point", "far")
        visits = stored(open_.mapInArrow(_visits(trees, first, many, quantile), "cid long, dim int, cell int"), "search-visits")
        wanted = visits.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        wanted = stored(wanted.join(parts, ["dim", "cell"]), "search-wanted")
        if wanted.isEmpty():
            break
        # A block of a cell's queries meets each part of its vectors.
        left = visits.join(wanted, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        left = left.join(queries.select("cid", "vec", "point"), "cid").join(best.select("cid", "far"), "cid")
        right = index.join(wanted, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int"))
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        group = ["dim", "cell", "part", "block"]
        left = left.select(*group, "cid", "vec", "point", "far").groupBy(*group)
        right = right.select(*group, "cid", "vec", "point", "ids").groupBy(*group)
        found = left.cogroup(right).applyInArrow(_search(most, quantile), FOUND)
        before = best.select("cid", F.explode("best").alias("b")).select("cid", "b.score", "b.id", "b.own")
        best = stored(_best(found.unionAll(before), most), "search-best")
        first, many = first + many, 4 * many
    named = skew.lookup(asking, best.select("cid", "best"), ["cid"])
    # One entry is the query's own row.
    itself = F.array_position(F.transform("best", lambda b: b["own"] & (b["id"] == F.col("id"))), True)
    others = named.select("id", "best", itself.alias("itself"))
    others = others.select("id", F.slice(F.filter("best", lambda b, i: i + 1 != F.col("itself")), 1, k).alias("best"))
    out = others.select(F.col("id").alias("query_id"), F.posexplode("best").alias("place", "b"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
