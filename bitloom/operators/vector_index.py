"""A stored index for nearest vectors: an inverted file of coarse cells.

Centres are fitted on a bounded sample, every vector is stored under the cell of its
nearest centre, and a query looks into the cells whose centres are nearest to it. How
many it has to look into is measured on the sample when the index is built. A batch
of queries reads only the partitions of the cells that it asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators.search import _best_of_batch, _ranked

# The sample that centres are fitted on, and the most cells that it supports.
SAMPLE_ROWS, MOST_CELLS = 20_000, 512
# Queries of the sample that the number of probes is measured on.
TRIALS = 200
# Vectors and queries that meet in one task.
PART_ROWS, BLOCK = 4096, 1024


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies, its centres (a few hundred rows) and the cells that a query probes."""

    path: str
    centres: np.ndarray
    probes: int


def _near_cells(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each vector all cells, the nearest first."""
    away = (centres * centres).sum(axis=1) - 2 * vectors @ centres.T
    return np.argsort(away, axis=1, kind="stable")


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """How many cells hold a share ``recall`` of the sample's own k nearest."""
    cell = _near_cells(sample, centres)[:, 0]
    ranks = []
    for i in range(min(TRIALS, len(sample))):
        away = ((sample - sample[i]) ** 2).sum(axis=1)
        away[i] = np.inf
        near = np.argsort(away, kind="stable")[: min(k, len(sample) - 1)]
        place = np.argsort(_near_cells(sample[i : i + 1], centres)[0])
        ranks.append(place[cell[near]])
    ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(1, int)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1


def build(
    corpus: DataFrame, path: str, k: int = 10, recall: float = 0.97, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> VectorIndex:
    """Write an index of ``corpus`` (id, vec) under a new ``path``.

    Every row is indexed; rows without a vector are left out. At most about
    ``sample_rows`` vectors, chosen by a hash of their id, fit the centres and measure
    how many cells a query has to probe to find a share ``recall`` of its ``k``
    nearest. ``cells`` defaults to the square root of the rows, up to ``MOST_CELLS``.
    """
    rows = corpus.select("id", "vec").where("vec IS NOT NULL")
    n = rows.count()
    chosen = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(n, 1)))
    sample = rows.where(chosen).limit(2 * sample_rows)
    held = sample.select("vec").toPandas()["vec"]
    width = int(np.sqrt(n)) if cells is None else cells
    width = max(1, min(width, MOST_CELLS, len(held) // 4 or 1))
    if width > 1:
        fit = sample.select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
        model = KMeans(k=width, maxIter=10, seed=seed).fit(fit)
        centres = np.array(model.clusterCenters())
    else:
        centres = _stack(held).mean(axis=0, keepdims=True) if len(held) else np.zeros((1, 1))
    probes = _probes(_stack(held), centres, k, recall) if len(held) else 1
    index = VectorIndex(path, centres, probes)
    facts = corpus.sparkSession.createDataFrame([(i, [float(x) for x in c], probes) for i, c in enumerate(centres)], "cell int, centre array<double>, probes int")
    facts.write.parquet(f"{path}/centres")
    add(index, rows)
    return index


def add(index: VectorIndex, rows: DataFrame) -> None:
    """Store more rows (id, vec) under the cells there are; their centres stay as they were."""
    centres = index.centres
    schema = ", ".join(f"{c} {t}" for c, t in rows.select("id", "vec").dtypes)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=_near_cells(_stack(batch["vec"]), centres)[:, 0].astype(np.int32))

    placed = rows.select("id", "vec").where("vec IS NOT NULL").mapInPandas(assign, f"{schema}, cell int")
    # Without a shuffle each task would write a file for each cell.
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16)))
    dealt.write.mode("append").partitionBy("cell").parquet(f"{index.path}/rows")


def load(spark: SparkSession, path: str) -> VectorIndex:
    """The index under ``path``."""
    facts = spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()
    return VectorIndex(path, _stack(facts["centre"]), int(facts["probes"].iloc[0]))


def _visits(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, vec, cell): each query once for every cell that it probes."""
    centres = index.centres
    kinds = dict(queries.dtypes)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = _near_cells(_stack(batch["vec"]), centres)[:, :probes]
                wide = batch.loc[batch.index.repeat(near.shape[1])].rename(columns={"id": "query_id"})
                yield wide.assign(cell=near.ravel().astype(np.int32))

    rows = queries.select("id", "vec").where("vec IS NOT NULL")
    return rows.mapInPandas(probe, f"query_id {kinds['id']}, vec {kinds['vec']}, cell int")


def cell_rows(spark: SparkSession, index: VectorIndex) -> DataFrame:
    """(cell, n): how many rows each cell holds."""
    return spark.read.parquet(f"{index.path}/rows").groupBy("cell").agg(F.count("*").alias("n"))


def pairs_compared(index: VectorIndex, queries: DataFrame, probes: int | None = None) -> int:
    """How many vectors ``nearest`` compares with these queries."""
    visits = _visits(index, queries, probes or index.probes)
    return visits.join(cell_rows(queries.sparkSession, index), "cell").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def nearest(index: VectorIndex, queries: DataFrame, k: int, metric: str = "l2", probes: int | None = None, digits: int = 6) -> DataFrame:
    """The ``k`` nearest rows found for each query (id, vec): ``(query_id, id, score, rank)``.

    Exact among the cells probed; ties go to the smaller id. A row is missed if its
    cell is not probed, so ``probes`` sets the recall (by default as measured when the
    index was built; as many as there are cells make it exact). Cells are parted and
    their queries dealt into blocks, so no task holds a whole cell or all queries.
    """
    spark = queries.sparkSession
    asked = _visits(index, queries, probes or index.probes)
    wanted = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # At most one number per cell; it prunes the scan to the partitions asked for.
    cells = [r["cell"] for r in wanted.select("cell").collect()]
    rows = spark.read.parquet(f"{index.path}/rows").where(F.col("cell").isin(cells) if cells else F.lit(False))
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    sizes = wanted.join(parts, "cell")

    def numbers(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("block", numbers("blocks"))
    right = asked.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("part", numbers("parts"))
    group = ["cell", "part", "block"]

    def search(found: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(queries):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return _best_of_batch(found, queries.rename(columns={"query_id": "id"}), k, metric)

    id_type, query_type = rows.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    left, right = left.select(*group, "id", "vec"), right.select(*group, "query_id", "vec")
    best = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(search, f"query_id {query_type}, id {id_type}, score double")
    return _ranked(best, k, digits)
