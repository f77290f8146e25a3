"""Graph of sketch nodes and labelled edges, as a pair of tables.

Nodes are ``(status, sha1, labels)`` with their sketch keyed by sha1; edges are
``(status, source, target, r_type, props)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import hashing
from bitloom.operators import similarity as sim
from bitloom.operators import skew, sketch
from bitloom.operators.sketch import Sketches
from bitloom.session import checkpointed
from bitloom.sources import files


def nodes(sketches: Sketches, labels: DataFrame, status: str = "b") -> DataFrame:
    """One node per set, named by its content; ``labels`` has rows ``(set_id, label)``."""
    listed = labels.groupBy("set_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return (
        sketch.meta(sketches).join(listed, "set_id", "left")
        .select(F.lit(status).alias("status"), "set_id", "sha1", "labels", "card", "n_bits")
    )


def upsert_nodes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Nodes by (status, sha1) with the set-union of old and new labels.

    Labels are combined as a set on the map side, so a node updated very often
    sends one short list per task.
    """
    columns = ["status", "sha1", "labels"]
    both = stored.select(*columns).unionByName(fresh.select(*columns))
    single = both.select("status", "sha1", F.explode_outer("labels").alias("label"))
    return single.groupBy("status", "sha1").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def upsert_edges(edges: DataFrame, seq: str) -> DataFrame:
    """Last write per (status, source, target), by ``seq``."""
    last = F.max_by(F.struct("r_type", "props"), seq)
    kept = edges.groupBy("status", "source", "target").agg(last.alias("last"))
    return kept.select("status", "source", "target", "last.*")


def newest_edges(old: DataFrame, fresh: DataFrame, seq: str) -> DataFrame:
    """Both tables' edges by their last write, with ``seq``: to be merged again with later ones."""
    columns = ["status", "source", "target", "r_type", "props", seq]
    last = F.max_by(F.struct("r_type", "props", seq), seq).alias("last")
    both = old.select(*columns).unionByName(fresh.select(*columns))
    return both.groupBy("status", "source", "target").agg(last).select("status", "source", "target", "last.*")


def newest_fields(old: DataFrame, fresh: DataFrame, by: list[str]) -> DataFrame:
    """Both tables' fields ``(key, field, value, *by)`` by their last write."""
    columns = ["key", "field", "value", *by]
    last = F.max_by(F.struct("value", *by), F.struct(*by)).alias("last")
    both = old.select(*columns).unionByName(fresh.select(*columns))
    return both.groupBy("key", "field").agg(last).select("key", "field", "last.*")


def stamped_upsert(updates: DataFrame, by: list[str]) -> DataFrame:
    """Latest value of each field of each key, and the key's last time of change.

    ``updates`` has ``(key, field, value, ts)``; ``by`` orders the writes.
    """
    latest = updates.groupBy("key", "field").agg(
        F.max_by("value", F.struct(*by)).alias("value"), F.max("ts").alias("ts")
    )
    stamps = latest.groupBy("key").agg(F.max("ts").alias("last_modified"))
    return latest.select("key", "field", "value").join(stamps, "key")


def derived_nodes(
    sketches: Sketches, pairs: DataFrame, op: str, sha1s: DataFrame, label: str
) -> tuple[DataFrame, Sketches, DataFrame]:
    """Derived nodes of one operation on each pair, their sketches and their edges.

    ``sha1s`` maps ``set_id`` to ``sha1``. A node's id follows from its arguments'
    ids alone; each argument gets an edge to it, with the argument's position.
    """
    named = (
        pairs.select(*sim.PAIR)
        .join(sha1s.select(F.col("set_id").alias("set_a"), F.col("sha1").alias("sha_a")), "set_a")
        .join(sha1s.select(F.col("set_id").alias("set_b"), F.col("sha1").alias("sha_b")), "set_b")
        .withColumn("sha1", hashing.derived_id(op, F.col("sha_a"), F.col("sha_b")))
    )
    result = sim.apply_op(sketches, pairs, op).join(named.select(*sim.PAIR, "sha1"), sim.PAIR)
    node_sketches = sim.as_sketches(result, F.col("sha1"), sketches.p)
    made = named.select(F.lit("b").alias("status"), "sha1", F.array(F.lit(label)).alias("labels"))
    ends = F.inline(
        F.array(
            F.struct(F.col("sha_a").alias("source"), F.lit(0).alias("pos")),
            F.struct(F.col("sha_b").alias("source"), F.lit(1).alias("pos")),
        )
    )
    edges = named.select(F.col("sha1").alias("target"), ends).select(
        F.lit("b").alias("status"),
        "source",
        "target",
        F.lit(op).alias("r_type"),
        F.create_map(F.lit("pos"), F.col("pos").cast("string")).alias("props"),
    )
    return made, node_sketches, edges


def attach_ends(
    edges: DataFrame, nodes: DataFrame, key: str, attributes: list[str], hot_rows: int = skew.HOT_ROWS, salts: int = 64
) -> DataFrame:
    """Node attributes for both ends of each edge; hubs are split over many tasks."""
    out = edges
    for end in ("source", "target"):
        side = nodes.select(F.col(key).alias(end), *(F.col(a).alias(f"{end}_{a}") for a in attributes))
        # Hubs are counted on the bare edges, not on what the first join made.
        hubs = skew.hot_keys(edges, [end], hot_rows)
        out = skew.lookup(out, side, [end], salts=salts, hot=hubs)
    return out


def find_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes by ``(status, sha1)``; ``wanted`` may list one more than once."""
    return nodes.join(wanted.select("status", "sha1").distinct(), ["status", "sha1"], "left_semi")


def find_edges(edges: DataFrame, wanted: DataFrame, status: str, **skew_options) -> DataFrame:
    """Edges of one status by ``(source, target)``; ``wanted`` lists each pair once."""
    live = edges.where(F.col("status") == status)
    return skew.lookup(live, wanted.select("source", "target"), ["source", "target"], **skew_options)


def assemble(nodes: DataFrame, edges: DataFrame, status: str) -> DataFrame:
    """Nodes of one status with their in- and out-degree among edges of that status."""
    ends = F.inline(
        F.array(
            F.struct(F.col("source").alias("sha1"), F.lit(1).alias("out"), F.lit(0).alias("inn")),
            F.struct(F.col("target").alias("sha1"), F.lit(0).alias("out"), F.lit(1).alias("inn")),
        )
    )
    live = edges.where(F.col("status") == status).select(ends)
    degrees = live.groupBy("sha1").agg(F.sum("out").alias("out_degree"), F.sum("inn").alias("in_degree"))
    zero = F.lit(0).cast("bigint")
    return (
        nodes.where(F.col("status") == status)
        .join(degrees, "sha1", "left")
        .withColumn("out_degree", F.coalesce("out_degree", zero))
        .withColumn("in_degree", F.coalesce("in_degree", zero))
    )


def equal_rows(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both tables by key, with a flag telling whether all other fields agree."""
    fields = [c for c in left.columns if c not in key]
    l = left.select(*key, F.struct(*fields).alias("l"))
    r = right.select(*key, F.struct(*fields).alias("r"))
    return l.join(r, key).select(*key, F.col("l").eqNullSafe(F.col("r")).alias("is_equal"))


def levels(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(target, level): how many steps at most lead from base nodes to each derived node.

    ``ids`` lists the base nodes as ``set_id``; without it they are the arguments
    that no edge leads to. Only (source, target) is read, and each round keeps only
    the edges whose source has no level yet. A node that never gets one, for an
    unknown argument or a circle of edges, raises an error.
    """
    ends = edges.select("source", "target").distinct()
    leaves = ends.join(ends.select(F.col("target").alias("source")), "source", "left_anti").select("source")
    known = (leaves if ids is None else ids.select(F.col("set_id").alias("source"))).distinct()
    left, pending = checkpointed(ends), checkpointed(ends.select("target").distinct())
    found = []
    while not pending.isEmpty():
        left = checkpointed(left.join(known, "source", "left_anti"))
        waiting = checkpointed(left.select("target").distinct())
        ready = checkpointed(pending.join(waiting, "target", "left_anti"))
        if ready.isEmpty():
            raise ValueError("no further node has all its arguments: some are unknown or the edges run in a circle")
        found.append(ready.withColumn("level", F.lit(len(found) + 1)))
        known, pending = ready.withColumnRenamed("target", "source"), waiting
    return reduce(DataFrame.unionByName, found) if found else pending.withColumn("level", F.lit(0))


def regenerate(base: Sketches, edges: DataFrame, ids: DataFrame | None = None) -> Sketches:
    """Sketches of derived nodes, recomputed from their arguments along the edges.

    ``base`` is keyed by sha1 and ``ids`` lists its nodes, as in ``levels``. They
    are known whether or not their sketch has rows, as an empty sketch has none;
    edges that lead to a base node are not followed. Levels are found first. Then
    edges lie stored by level, and registers too, so that a level reads its own
    edges and the levels that its arguments are in, by one join and one aggregate.
    """
    spark = base.rows.sparkSession
    if ids is not None:
        edges = edges.join(ids.select(F.col("set_id").alias("target")), "target", "left_anti")
    placed = levels(edges, ids)
    flat = edges.select("source", "target", "r_type", F.col("props")["pos"].alias("pos")).join(placed, "target")
    of_source = placed.select(F.col("target").alias("source"), F.col("level").alias("source_level"))
    flat = flat.join(of_source, "source", "left").withColumn("source_level", F.coalesce("source_level", F.lit(0)))
    folder = files.new_folder(spark, "lineage")
    flat.write.partitionBy("level").parquet(f"{folder}/edges")
    stored = spark.read.schema(flat.schema).parquet(f"{folder}/edges")
    # One row for each two levels: their number goes with the depth, not with the nodes.
    uses: dict[int, list[int]] = {}
    for level, source_level in stored.select("level", "source_level").distinct().collect():
        uses.setdefault(level, []).append(source_level)
    rows = base.rows.select("set_id", "bin", "word")

    def made(of: list[int]) -> DataFrame:
        return spark.read.schema(rows.schema).parquet(*(f"{folder}/registers/{level}" for level in of))

    for level in sorted(uses):
        known = made([at for at in uses[level] if at]) if max(uses[level]) else rows
        if 0 in uses[level] and max(uses[level]):
            known = known.unionByName(rows)
        asked = stored.where(F.col("level") == level).select("source", "target", "r_type", "pos")
        _apply(asked, base.with_rows(known)).write.parquet(f"{folder}/registers/{level}")
    return base.with_rows(made(sorted(uses)) if uses else rows.limit(0))


def _apply(edges: DataFrame, known: Sketches) -> DataFrame:
    """Registers ``(set_id, bin, word)`` of the targets, all of whose arguments are known."""
    word, first = F.col("word"), F.col("pos") == "0"
    per_bin = (
        sketch.meet(edges, known, on="source")
        .groupBy("target", "r_type", "bin")
        .agg(
            F.bit_or(word).alias("any"),
            F.bit_xor(word).alias("odd"),
            F.bit_or(F.when(first, word).otherwise(F.lit(0))).alias("w0"),
            F.bit_or(F.when(first, F.lit(0)).otherwise(word)).alias("w1"),
        )
    )
    result = (
        F.when(F.col("r_type") == "union", F.col("any"))
        .when(F.col("r_type") == "intersect", F.col("w0").bitwiseAND(F.col("w1")))
        .when(F.col("r_type") == "xor", F.col("odd"))
        .when(F.col("r_type") == "comp", F.col("w0").bitwiseAND(F.bitwise_not(F.col("w1"))))
    )
    return per_bin.select(F.col("target").alias("set_id"), "bin", result.alias("word")).where("word <> 0")


def props_map(props: Column) -> Column:
    """Dynamic JSON properties as a map of text."""
    return F.from_json(props, "map<string,string>")
