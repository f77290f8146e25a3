"""Commits, branches and the buffer / head / tail life cycle.

State lives in two append-only tables: the log ``(branch, seq, message, ts,
snapshot_id)`` and the snapshots ``(snapshot_id, key, value)``. Branches share
snapshots by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.operators import skew
from bitloom.session import checkpointed

# Commits that a row of the matrix meets at once.
BLOCK = 256
LOG = ["branch", "seq", "message", "ts", "snapshot_id"]


def last_seq(log: DataFrame, branch: str) -> Column:
    """Number of commits on a branch, as a scalar."""
    here = log.where(F.col("branch") == branch)
    return here.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).scalar()


def commit(log: DataFrame, branch: str, data: DataFrame, snapshot_id: str, message: str, ts: str):
    """One more commit: the new log row and the data's copy as a snapshot.

    Both are to be appended; nothing that is stored is rewritten.
    """
    row = log.sparkSession.range(1).select(
        F.lit(branch).alias("branch"),
        (last_seq(log, branch) + 1).alias("seq"),
        F.lit(message).alias("message"),
        F.lit(ts).alias("ts"),
        F.lit(snapshot_id).alias("snapshot_id"),
    )
    return row, data.select(F.lit(snapshot_id).alias("snapshot_id"), "key", "value")


def checkout(log: DataFrame, snapshots: DataFrame, branch: str, n: int, current: DataFrame) -> DataFrame:
    """State of the n-th commit (from 1); the current state if there is no such commit."""
    wanted = log.where((F.col("branch") == branch) & (F.col("seq") == n)).select("snapshot_id")
    missing = wanted.agg((F.count("*") == 0).alias("missing")).scalar()
    state = snapshots.join(wanted, "snapshot_id", "left_semi").select("key", "value")
    return state.unionByName(current.select("key", "value").where(missing))


def create_branch(log: DataFrame, source: str, name: str) -> DataFrame:
    """The log with the commits of one branch also listed under another name.

    A branch of that name is replaced; a branch copied to its own name stays as it is.
    """
    if source == name:
        return log.select(*LOG)
    copied = log.where(F.col("branch") == source).withColumn("branch", F.lit(name))
    others = log.where(~F.col("branch").eqNullSafe(F.lit(name)))
    return others.select(*LOG).unionByName(copied.select(*LOG))


def merge_branch(log: DataFrame, into: str, other: str) -> DataFrame:
    """The log with another branch's commits after ours; duplicates stay.

    Commits are numbered from 1 without gaps, so theirs shift by our last number.
    An unknown branch adds nothing.
    """
    moved = (
        log.where(F.col("branch") == other)
        .withColumn("seq", F.col("seq") + last_seq(log, into))
        .withColumn("branch", F.lit(into))
    )
    return log.select(*LOG).unionByName(moved.select(*LOG))


def head_tail(
    versions: DataFrame, key: str, version: str, deleted: Column, hot_rows: int = skew.HOT_ROWS, salts: int = 64
) -> DataFrame:
    """Add ``status``: the newest version of a key is its head, older ones its tail.

    A newest version that marks a removal is ``deleted``. The newest version comes
    from a combining aggregate, and a key with very many versions is split.
    """
    counted = versions.groupBy(key).agg(F.max(version).alias("_newest"), F.count("*").alias("_n"))
    rows = skew.lookup_counted(versions, counted, [key], "_n", hot_rows, salts)
    is_head = F.col(version) == F.col("_newest")
    status = F.when(is_head & deleted, "deleted").when(is_head, "head").otherwise("tail")
    return rows.withColumn("status", status).drop("_newest")


def commit_intervals(versions: DataFrame, key: str, committed: str, deleted: str) -> DataFrame:
    """What each item version is over time: ``(key, committed, since, until, status)``.

    ``versions`` has at most one version of a key per commit. A version is head (or
    deleted) from its own commit until the key's next one, and tail from then on;
    ``until`` is not included, null has no end. Two rows for each version at most,
    however many commits there are.
    """
    rows = skew.following(versions.select(key, committed, deleted), [key], committed, [committed], [committed])
    since, until = F.col(committed), F.col(f"next_{committed}")
    status = F.when(F.col(deleted), "deleted").otherwise("head")
    none = F.lit(None).cast(versions.schema[committed].dataType)
    first = F.struct(since.alias("since"), until.alias("until"), status.alias("status"))
    then = F.struct(until.alias("since"), none.alias("until"), F.lit("tail").alias("status"))
    parts = F.filter(F.array(first, then), lambda part: part["since"].isNotNull())
    return rows.select(key, committed, F.inline(parts))


def status_as_of(versions: DataFrame, asks: DataFrame, key: str, committed: str, deleted: str, at: str) -> DataFrame:
    """Each row of ``asks`` (key, at, ...) with the key's version as of then: ``committed`` and ``status``.

    An as-of join: both tables lie in one order and each ask takes the last version
    at or before it, so no pair of rows is ever formed. Null where the key has no
    version yet. A key with very many rows is split.
    """
    kind = versions.schema[committed].dataType
    carried = [c for c in asks.columns if c not in (key, at)]
    have = versions.select(
        key, F.col(committed).alias("_t"), F.lit(0).alias("_ask"),
        F.struct(F.col(committed).alias("c"), F.col(deleted).alias("d")).alias("_version"),
        F.lit(None).cast(asks.select(F.struct(*carried, F.lit(1).alias("_")).alias("x")).schema["x"].dataType).alias("_row"),
    )
    want = asks.select(
        key, F.col(at).cast(kind).alias("_t"), F.lit(1).alias("_ask"),
        F.lit(None).cast(have.schema["_version"].dataType).alias("_version"),
        F.struct(*carried, F.lit(1).alias("_")).alias("_row"),
    )
    both = skew.ranged(have.unionByName(want), [key], ["_t", "_ask"])
    known = skew.last_known(both, [key], "_bucket", ["_t", "_ask"], "_version", "_last")
    status = F.when(F.col("_last.d"), "deleted").when(F.col("_last.c").isNotNull(), "head")
    return known.where("_ask = 1").select(
        key, F.col("_t").alias(at), *(F.col(f"_row.`{c}`").alias(c) for c in carried), F.col("_last.c").alias(committed), status.alias("status")
    )


def commit_matrix(
    versions: DataFrame, key: str, committed: str, deleted: str, commits: list | DataFrame | None = None
) -> DataFrame:
    """Status of every item version as of each commit, or of the asked ones.

    ``commits`` lists the asked commits, as values or as the one column of a table.
    They are numbered in their order, and an interval of ``commit_intervals`` covers
    a run of numbers: the work follows the asked commits, and no list of more than
    ``BLOCK`` commits is ever one value.
    """
    spark, kind = versions.sparkSession, versions.schema[committed].dataType
    if commits is None:
        asked = versions.select(F.col(committed).alias("commit"))
    elif isinstance(commits, DataFrame):
        asked = commits.toDF("commit").select(F.col("commit").cast(kind).alias("commit"))
    else:
        asked = spark.createDataFrame([(c,) for c in commits], T.StructType([T.StructField("commit", kind)]))
    asked = asked.where("commit IS NOT NULL").distinct().withColumn("_asked", F.lit(1).cast("long"))
    intervals = checkpointed(commit_intervals(versions, key, committed, deleted))
    ends = [intervals.select(F.col(c).alias("commit"), F.lit(0).cast("long").alias("_asked")) for c in ("since", "until")]
    times = asked.unionByName(ends[0]).unionByName(ends[1]).where("commit IS NOT NULL").groupBy("commit").agg(F.max("_asked").alias("_asked"))
    times = skew.ranged(times, [], ["commit"])
    # How many asked commits come before each time; for an asked one its own number.
    numbered = checkpointed(skew.running_total(times, [], "_bucket", [F.col("commit")], F.col("_asked"), "_number"))
    total = numbered.agg(F.coalesce(F.sum("_asked"), F.lit(0)).alias("n")).scalar()
    rows = intervals
    for end in ("since", "until"):
        at = numbered.select(F.col("commit").alias(end), F.col("_number").alias(f"_{end}"))
        rows = skew.lookup(rows, at, [end], "left")
    rows = rows.withColumn("_until", F.coalesce("_until", total)).where(F.col("_since") < F.col("_until"))
    # Consecutive commits come in blocks: a row meets a block once, and its commits are laid out where the row
    # then is, so what is written is never shuffled.
    place = F.struct("_number", "commit")
    blocks = numbered.where("_asked = 1").groupBy(F.expr(f"_number div {BLOCK}").alias("_block"))
    blocks = blocks.agg(F.sort_array(F.collect_list(place)).alias("_commits"))
    rows = rows.withColumn("_block", F.explode(F.sequence(F.expr(f"_since div {BLOCK}"), F.expr(f"(_until - 1) div {BLOCK}"))))
    met = skew.lookup(rows, blocks, ["_block"])
    begin = F.col("_block") * BLOCK
    first, last = F.greatest("_since", begin) - begin, F.least("_until", begin + BLOCK) - begin
    held = F.slice("_commits", (first + 1).cast("int"), (last - first).cast("int"))
    return met.select(key, committed, F.explode(held["commit"]).alias("commit"), "status")


def expire(records: DataFrame, modified: str, asof: Column, ttl: str) -> DataFrame:
    """Records changed within the time to live before ``asof``."""
    return records.where(F.col(modified) >= asof - F.expr(f"INTERVAL {ttl}"))
