"""Near copies among vectors by a forest of random-projection trees.

Each tree splits the vectors again and again at the median of a random projection;
those near a split go to both sides. A pair is compared in every leaf that holds
both, and trees differ, so a pair that one tree parts meets in another. Thresholds
are fitted on a bounded sample, all vectors are then sent down the trees. Below
the depth that the sample supports, a node splits at its sampled mean.

With unit vectors of dimension d and links from cosine c on, linked vectors are at
most sqrt(2 - 2c) apart, so their projections differ by about sqrt((2 - 2c) / d);
the overlap on each side of a split is ``spill`` times that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import stored
from bitloom.llm.components import components

THRESHOLD = 0.93
TREES = 8
SPILL = 0.5
# Vectors that a leaf has on average, and that are compared with each other at once.
LEAF_ROWS = 1024
BLOCK = 1024
# The sample that trees are fitted on: at most so many vectors, and so many numbers.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 4_000_000
# From how many sampled vectors on a node has a median of its own.
SUPPORT = 32
SEED = 7


def _units(raw: list | np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; large numbers don't overflow."""
    x = np.asarray(raw, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    """Random-projection trees for vectors of one dimension; small whatever the table."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf_rows: int, spill: float):
        rng = np.random.default_rng(SEED)
        depth = max(0, int(np.ceil(np.log2(max(rows, 1) / leaf_rows))))
        self.directions = rng.standard_normal((trees, depth, sample.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True) if depth else 1
        self.spill = spill
        fitted = max(0, min(depth, int(np.log2(max(len(sample), 1) / SUPPORT))))
        # at[tree][level][node]: where the node splits; below the fitted depth, by its fitted ancestor.
        self.at, self.fitted = [], fitted
        for tree in range(trees):
            levels, idx, node = [], np.arange(len(sample)), np.zeros(len(sample), np.int64)
            for level in range(fitted):
                p = sample @ self.directions[tree, level]
                cut = np.array([np.median(p[idx[node == n]]) if (node == n).any() else 0.0 for n in range(1 << level)])
                levels.append(cut)
                idx, node = self._split(p, cut, idx, node, node)
            mean = np.array([sample[idx[node == n]].mean(axis=0) if (node == n).any() else np.zeros(sample.shape[1]) for n in range(1 << fitted)])
            levels += [mean @ self.directions[tree, level] for level in range(fitted, depth)]
            self.at.append(levels)

    def _split(self, p, cut, idx, node, top):
        beyond = p[idx] - cut[top]
        left, right = beyond < self.spill, beyond >= -self.spill
        return np.concatenate([idx[left], idx[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])

    def leaves(self, units: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each tree, (row, leaf) pairs; a row near splits has several leaves."""
        for tree, levels in enumerate(self.at):
            idx, node = np.arange(len(units)), np.zeros(len(units), np.int64)
            for level, cut in enumerate(levels):
                top = node >> max(0, level - self.fitted)
                idx, node = self._split(units @ self.directions[tree, level], cut, idx, node, top)
            yield tree, idx, node


def _compare(threshold: float):
    """Pairs of one block, or of two blocks with each other, from ``threshold`` on."""

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        cid = table.column("cid").to_numpy()
        part = table.column("part").to_numpy()
        units = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(cid), -1)
        i, j = key[-2].as_py(), key[-1].as_py()
        one, two = np.flatnonzero(part == i), np.flatnonzero(part == j)
        found_a, found_b = [], []
        for at in range(0, len(one), BLOCK):
            rows = one[at : at + BLOCK]
            cosine = units[rows] @ units[two].T
            a, b = np.nonzero(cosine >= threshold - 1e-9)
            near = cosine[a, b] < threshold + 1e-9
            a, b = rows[a], two[b]
            sure = ~near
            # The sum's order may matter this close to the threshold.
            sure[near] = (units[a[near]] * units[b[near]]).sum(axis=1) >= threshold
            if i == j:
                sure &= cid[a] < cid[b]
            found_a.append(cid[a[sure]])
            found_b.append(cid[b[sure]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return pairs


def _candidates(classes: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """(tree, leaf, label, dim, cid, unit): every class in every leaf that it falls into."""
    kind = classes.schema["label"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, label, vec = (batch.column(i) for i in range(3))
            dims = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                units = _units(vec.take(pa.array(own)).to_pylist())
                # A dimension that the sample has none of is rare: it has one leaf.
                routed = forests[dim].leaves(units) if dim in forests else [(0, np.arange(len(own)), np.zeros(len(own), np.int64))]
                data = np.array([u.tobytes() for u in units], object)
                for tree, idx, leaf in routed:
                    take = pa.array(own[idx])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(idx), tree), pa.int32()), pa.array(leaf), label.take(take), pa.array(np.full(len(idx), dim), pa.int32()), cid.take(take), pa.array(data[idx], pa.binary())],
                        ["tree", "leaf", "label", "dim", "cid", "unit"],
                    )

    return classes.select("cid", "label", "vec").mapInArrow(
        route, f"tree int, leaf long, label {kind}, dim int, cid long, unit binary"
    )


def links(classes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf_rows: int = LEAF_ROWS, spill: float = SPILL) -> DataFrame:
    """(a, b): linked classes, each pair once. ``classes`` has ``cid``, ``label`` and ``vec``."""
    dims = classes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    widest = classes.agg(F.max(F.size("vec"))).first()[0]
    if widest is None:
        return classes.select(F.col("cid").alias("a"), F.col("cid").alias("b")).limit(0)
    most = max(SUPPORT, min(SAMPLE_ROWS, SAMPLE_NUMBERS // widest))
    sampled = classes.orderBy(F.xxhash64("vec"), "cid").limit(most).select("vec").collect()
    by_dim: dict[int, list] = {}
    for row in sampled:
        by_dim.setdefault(len(row["vec"]), []).append(row["vec"])
    counts = {r["dim"]: r["n"] for r in dims.where(F.col("dim").isin(list(by_dim))).collect()}
    forests = {
        d: Forest(_units(x), counts[d], trees, leaf_rows, spill * np.sqrt((2 - 2 * threshold) / d)) for d, x in by_dim.items()
    }
    spread = _candidates(classes, forests)
    group = ["tree", "leaf", "label", "dim"]
    # A leaf with more rows than a block is dealt into parts, and every two parts are compared.
    large = spread.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / BLOCK).cast("int")
    dealt = spread.join(large, group, "left").withColumn("parts", parts)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.withColumn("other", other).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    found = dealt.select(*group, "i", "j", "cid", "part", "unit").groupBy(*group, "i", "j")
    return found.applyInArrow(_compare(threshold), "a long, b long").distinct()


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    spill: float = SPILL,
) -> DataFrame:
    """One row per vector: its id, ``n_links``, ``component_id`` and ``kept``.

    Two vectors are linked if their labels are equal and not null and their cosine
    is at least ``threshold`` in double precision. A vector that is null, empty or
    zero, or has a null or non-finite number, is linked with nothing, nor are
    vectors of unlike dimensions. Equal vectors of one label are compared once and
    counted as often as they are there. ``component_id`` is the least id that links
    reach; ids that are null give none. ``kept`` tells whether that is the row's
    own id, so rows that repeat an id are all kept or all not. No pair below the
    threshold is linked; of the others a share is missed that trees and spill set
    (none in tables of one leaf). Other columns are not carried; an empty table
    gives no rows.
    """
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label")
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    grouped = rows.where("fit").groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    pairs = stored(links(classes, threshold, trees, leaf_rows, spill), "vector-links")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select(F.col("cid").alias("b"), "n"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    roots = components(pairs).withColumnRenamed("node", "cid")
    facts = classes.join(degree, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = facts.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = facts.join(least, "root").select(
        "label", "vec", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.lit(True).alias("fit")
    )
    joined = rows.join(facts, ["label", "vec", "fit"], "left")
    component = F.when(F.col("fit"), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


# Every pair compared.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS vec_id, b AS other FROM link UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other),
least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id,
       vec_id <= coalesce(other, vec_id) AS kept
FROM embeddings LEFT JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)
"""
