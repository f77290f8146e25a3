"""Search: label filters, nearest sketches and vectors, n-grams, samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import hashing, text
from bitloom.operators import skew
from bitloom.operators.sketch import Sketches
from bitloom.session import checkpointed


def label_filter(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Rows whose label list has every given label."""
    keep = F.lit(True)
    for label in labels:
        keep = keep & F.array_contains(column, label)
    return df.where(keep)


def word_filter(df: DataFrame, column: str, word: str) -> DataFrame:
    """Rows whose text has a word, as the tokenizer splits it and in any case."""
    return df.where(F.array_contains(text.words(F.col(column)), word.lower()))


# Scores of one query against a batch, lower is nearer. Each row is reduced on its
# own, so equal rows score equally.
def _vector_scores(batch: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(((batch - query) ** 2).sum(axis=1))
    inner = (batch * query).sum(axis=1)
    if metric == "ip":
        return 1.0 - inner
    norms = np.sqrt((batch**2).sum(axis=1)) * np.sqrt((query**2).sum())
    return 1.0 - np.divide(inner, norms, out=np.zeros_like(inner), where=norms != 0)


# Numbers that one block of vectors holds at most, and so a task at a time.
BLOCK_NUMBERS = 1 << 22


def _best_of_batch(pdf: pd.DataFrame, asked: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    out = []
    ids = pdf["id"].to_numpy()
    batch = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]])
    for query_id, query in zip(asked["id"], asked["vec"]):
        scores = _vector_scores(batch, np.asarray(query, dtype=np.float64), metric) + 0.0
        best = np.lexsort((ids, scores))[:k]
        out.append(pd.DataFrame({"query_id": query_id, "id": ids[best], "score": scores[best]}))
    return pd.concat(out, ignore_index=True)


def _blocks(df: DataFrame, block_numbers: int) -> int:
    """How many blocks of bounded size the vectors make."""
    n, width = df.agg(F.count("*"), F.max(F.size("vec"))).first()
    return max(1, -(-n // max(1, block_numbers // max(1, width or 1))))


def _check_metric(metric: str) -> None:
    if metric not in ("l2", "ip", "cosine"):
        raise ValueError(f"unknown metric {metric!r}; use l2, ip or cosine")


def _ranked(best: DataFrame, k: int, digits: int) -> DataFrame:
    """The k first by the whole score, which is rounded only to be shown."""
    ranked = skew.top_k(best, "query_id", ["score", "id"], k, ["id"])
    return ranked.withColumn("score", F.round("score", digits))


def nearest(
    corpus: DataFrame, queries: DataFrame, k: int, metric: str = "l2", digits: int = 6, block_numbers: int = BLOCK_NUMBERS
) -> DataFrame:
    """The ``k`` nearest corpus rows of each query: ``(query_id, id, score, rank)``.

    ``corpus`` and ``queries`` have ``(id, vec)``; ties go to the smaller id. Both
    are dealt into blocks of at most ``block_numbers`` numbers, and every block of
    queries meets every block of the corpus in a task of its own, which keeps k
    rows for each query. Only the numbers of rows reach the driver.
    """
    _check_metric(metric)
    id_type, query_type = corpus.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    schema = f"query_id {query_type}, id {id_type}, score double"
    corpus, queries = corpus.select("id", "vec"), queries.select("id", "vec")
    chunks, blocks = _blocks(corpus, block_numbers), _blocks(queries, block_numbers)
    # Small tables are dealt to a few tasks more, so that the cores share them.
    chunks = max(chunks, corpus.sparkSession.sparkContext.defaultParallelism)

    def numbers(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    rows = corpus.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("block", numbers(blocks))
    asks = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("chunk", numbers(chunks))

    def per_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return _best_of_batch(left, right, k, metric)

    best = rows.groupBy("block", "chunk").cogroup(asks.groupBy("block", "chunk")).applyInPandas(per_block, schema)
    return _ranked(best, k, digits)


def result_page(
    found: DataFrame, rows: DataFrame, key: str, fields: Sequence[str], offset: int = 0, limit: int = 10
) -> DataFrame:
    """One page of each query's hits, with fields of the rows that were found.

    ``found`` has ``(query_id, id, score, rank)``; ranks ``offset + 1`` to
    ``offset + limit`` stay, and a page past the last hit is empty. ``key`` names the
    rows' id, which is unique, and a hit without a row keeps null fields. Only the page's hits meet the
    rows, of which no other column is read. A field named like a column of ``found``
    is refused.
    """
    clash = {"query_id", "id", "score", "rank"} & set(fields)
    if clash or offset < 0 or limit < 1:
        raise ValueError(f"bad page: offset {offset}, limit {limit}, clashing fields {sorted(clash)}")
    # Kept, as the search behind it is dear and the hits are looked at twice.
    page = checkpointed(found.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)))
    wanted = rows.select(F.col(key).alias("id"), *fields)
    # Hits are few beside the rows, but a row may be a hit of very many queries.
    return skew.lookup(page, wanted, ["id"], how="left")


def nearest_sketches(corpus: Sketches, queries: Sketches, k: int, metric: str = "cosine", digits: int = 6) -> DataFrame:
    """The same over sketches, compared by the bits they share.

    Registers meet in an equality join on their number; what sets share is summed
    on the map side, so the task of a register sends one row per pair that has it.
    """
    _check_metric(metric)
    corpus.same_p(queries)
    mine = corpus.rows.select(F.col("set_id").alias("id"), "bin", F.col("word").alias("w"))
    asked = queries.rows.select(F.col("set_id").alias("query_id"), "bin", F.col("word").alias("q"))
    shared = mine.join(asked, "bin").groupBy("query_id", "id").agg(
        F.sum(F.bit_count(F.col("w").bitwiseAND(F.col("q")))).cast("double").alias("shared")
    )
    bits = F.sum(F.bit_count("word")).cast("double")
    sizes = corpus.rows.groupBy(F.col("set_id").alias("id")).agg(bits.alias("n"))
    wanted = queries.rows.groupBy(F.col("set_id").alias("query_id")).agg(bits.alias("m"))
    n, m, both = F.col("n"), F.col("m"), F.col("shared")
    score = {"ip": -both, "l2": F.sqrt(n + m - 2 * both), "cosine": 1 - both / F.sqrt(n * m)}[metric]
    found = shared.join(sizes, "id").join(wanted, "query_id").select("query_id", "id", score.alias("score"))
    return _ranked(found, k, digits)


def ngrams(df: DataFrame, key: str, order: str, value: str, n: int, bucket_rows: int = 4096) -> DataFrame:
    """All windows of ``n`` consecutive values per key: ``(key, pos, items)``; none if shorter.

    A key of any length is cut into blocks of ``bucket_rows`` positions, each with
    the first n - 1 rows of the next block appended, so no task sorts a whole key.
    ``order`` may be of any type that sorts; a missing value is an item like others.
    """
    if not 1 <= n <= bucket_rows:
        raise ValueError(f"n must be in 1..{bucket_rows}, got {n}")
    coarse = df.select(key, F.col(order).alias("_o"), F.col(value).alias("_v"))
    # Ranges of the order hold bounded runs of a key; written, so that they stay the same.
    coarse = checkpointed(coarse.repartitionByRange(key, "_o").withColumn("_bucket", F.spark_partition_id()))
    placed = skew.positions(coarse, [key], "_bucket", [F.col("_o")])
    block = F.floor(F.col("pos") / bucket_rows)
    lent = (block > 0) & (F.col("pos") % bucket_rows < n - 1)
    copies = F.explode(F.when(lent, F.array(block, block - 1)).otherwise(F.array(block)))
    rows = placed.select(key, "pos", "_v", copies.alias("_block"))
    ahead = Window.partitionBy(key, "_block").orderBy("pos").rowsBetween(0, n - 1)
    # Collected in structs, as a bare null would be left out.
    held = F.collect_list(F.struct("_v")).over(ahead)
    windows = rows.withColumn("items", F.transform(held, lambda x: x["_v"]))
    own = F.floor(F.col("pos") / bucket_rows) == F.col("_block")
    return windows.where(own & (F.size("items") == n)).select(key, "pos", "items")


def draws(spark, n: int, seed: int) -> DataFrame:
    """``n`` seeded 63-bit numbers: ``(draw, h)``."""
    return spark.range(n).select(
        F.col("id").alias("draw"), hashing.token_hash(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))).alias("h")
    )


# A level of the line of weights is cut into so many pieces, by so many bits of the hash.
LEVEL_BITS = 10


def _drawn(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` items (draw, item) of ``rows`` (item, h, w), with odds by ``w``.

    Items lie end to end on a line in the order of their hash ``h``. Two levels of
    pieces, by the leading bits of the hash, know their total only; a draw finds its
    piece of the first level, then of the second among those of that piece. Items are
    ranked in the pieces that were hit, and nowhere else.
    """
    pieces = [f"_p{level}" for level in (1, 2)]
    for level, name in enumerate(pieces, 1):
        rows = rows.withColumn(name, F.shiftrightunsigned("h", hashing.HASH_BITS - level * LEVEL_BITS))
    total = rows.agg(F.sum("w").alias("total")).scalar()
    points = draws(rows.sparkSession, n, seed).withColumn("total", total).where("total > 0")
    points = checkpointed(points.select("draw", (F.col("h") % F.col("total")).alias("at"), F.lit(0).alias("_p0")))
    rows, above = rows.withColumn("_p0", F.lit(0)), "_p0"
    for name in pieces:
        hit = skew.semi(rows, points.select(above).distinct(), [above]) if above != "_p0" else rows
        sums = hit.groupBy(above, name).agg(F.sum("w").alias("size"))
        # At most 2^LEVEL_BITS pieces within one of the level above.
        ordered = Window.partitionBy(above).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("start", F.coalesce(F.sum("size").over(ordered), F.lit(0)))
        inside = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("size"))
        found = points.join(sums, above).where(inside)
        points = checkpointed(found.select("draw", (F.col("at") - F.col("start")).alias("at"), name))
        above = name
    ranked = skew.semi(rows, points.select(above).distinct(), [above])
    ordered = Window.partitionBy(above).orderBy("h", "item").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("start", F.coalesce(F.sum("w").over(ordered), F.lit(0)))
    inside = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("w"))
    return points.join(ranked, above).where(inside).select("draw", "item")


def weighted_sample(terms: DataFrame, term: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` terms with replacement, with odds proportional to an integer weight: ``(draw, term)``.

    No order of the whole vocabulary is made: see ``_drawn``.
    """
    rows = terms.select(F.col(term).alias("item"), F.col(weight).cast("bigint").alias("w")).where("w > 0")
    # Counted terms are used several times; what made them runs once.
    rows = checkpointed(rows.withColumn("h", hashing.token_hash(F.col("item").cast("string"))))
    return _drawn(rows, n, seed).withColumnRenamed("item", "term")


def sample_keys(keys: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` records' keys with replacement, each record equally likely: ``(draw, key)``."""
    rows = keys.select(F.col(key).alias("item"))
    hashed = rows.groupBy("item").agg(F.count("*").alias("w"))
    hashed = hashed.withColumn("h", hashing.token_hash(F.coalesce(F.col("item").cast("string"), F.lit(""))))
    return _drawn(hashed, n, seed).withColumnRenamed("item", "key")
