"""A Merkle manifest of a dataset, built and proved by cogrouped subtree exchange.

Each row becomes a leaf. The leaves of a group stand in the order of their ids, and
every ``ARITY`` consecutive nodes become one, until one is left: the group's subroot.
The subroots, in the order of the groups, give the root in the same way.

A superblock is an aligned run of ARITY ** LEVELS nodes, so it reduces to one node
without knowing any other. These nodes are few; they are reduced and proved by the
same step, up to the root. What a superblock needs from outside are the siblings on
its way to the root, a handful of digests. Leaves and that outer way are cogrouped by
superblock, where one function reduces the block, joins the proofs and folds them.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import in_order, stored
from bitloom.operators import skew

ARITY = 8
# Levels of a superblock: 512 leaves.
LEVELS = 3
WAY = "grp string, pos long, way string"


def joined_hash(parts: list[str]) -> str:
    """Lowercase hex SHA-256 of texts in a row."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(leaf: str, way: str) -> str:
    """The root that a leaf's digest and its proof give.

    A proof has one entry per level, divided by blanks: the node's place in its run,
    a colon, and the digests of the run's other nodes.
    """
    node = leaf
    for step in way.split():
        at, others = step.split(":")
        cut = 64 * int(at)
        node = joined_hash([others[:cut], node, others[cut:]])
    return node


def siblings(way: str) -> str:
    """All digests of a proof, level by level, left to right."""
    return "".join(step.split(":")[1] for step in way.split())


def _levels(nodes: list[str], n: int) -> list[list[str]]:
    """A superblock's nodes, level by level; ``n`` is the number of nodes in the whole group."""
    levels = [nodes]
    while n > 1 and len(levels) <= LEVELS:
        below, n = levels[-1], -(-n // ARITY)
        levels.append([joined_hash(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def _way(levels: list[list[str]], at: int) -> list[str]:
    """The steps of the node at place ``at`` up to the top of its superblock."""
    steps = []
    for level in levels[:-1]:
        start = at - at % ARITY
        steps.append(f"{at - start}:{''.join(level[start:at] + level[at + 1 : start + ARITY])}")
        at //= ARITY
    return steps


def _reduce(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("pos")
    n = int(block["n"].iloc[0])
    top = _levels(block["digest"].tolist(), n)[-1][0]
    return pd.DataFrame({"grp": block["grp"].iloc[:1], "n": -(-n // ARITY**LEVELS), "pos": block["block"].iloc[:1], "digest": top})


def _extend(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("pos")
    levels, beyond = _levels(block["digest"].tolist(), int(block["n"].iloc[0])), outer["way"].iloc[0]
    ways = [" ".join([*_way(levels, i), *([beyond] if beyond else [])]) for i in range(len(block))]
    return pd.DataFrame({"grp": block["grp"], "pos": block["pos"], "way": ways})


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The way of each node to its group's top, and the tops (grp, digest).

    ``nodes`` are stored and have ``grp``, ``n``, ``pos`` and ``digest``. A step
    leaves one node of ARITY ** LEVELS, so a few steps do for any table.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return nodes.select("grp", "pos", F.lit("").alias("way")), nodes.select("grp", "digest")
    dealt = nodes.withColumn("block", F.floor(F.col("pos") / ARITY**LEVELS))
    by_block = dealt.groupBy("grp", "block")
    above = stored(by_block.applyInPandas(_reduce, "grp string, n long, pos long, digest string"), "merkle-nodes")
    outer, tops = _climb(above)
    outer = outer.withColumnRenamed("pos", "block").groupBy("grp", "block")
    return by_block.cogroup(outer).applyInPandas(_extend, WAY), tops


def _placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Add ``pos``, a row's place in its group by ``order``, and ``n``, the group's rows."""
    rows = in_order(rows, [F.col("grp"), *(F.col(c) for c in order)], label)
    sizes = rows.groupBy("grp", "part").agg(F.count("*").alias("_n"))
    # One row per range of a group: few, as ranges hold many rows.
    over = Window.partitionBy("grp")
    before = F.sum("_n").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = sizes.select("grp", "part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(over).alias("n"))
    inside = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order))
    placed = rows.withColumn("_at", inside).join(ranges, ["grp", "part"])
    return placed.withColumn("pos", F.col("_before") + F.col("_at") - 1).drop("_at", "_before", "part")


def digest(columns: list[Column]) -> Column:
    """A row's digest over its values: each ``-`` if null, else its UTF-8 length, a colon and the value."""

    def field(column: Column) -> Column:
        text = column.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def _finish(with_proof: bool):
    def finish(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        leaves = [d.hex() for d in block["leaf"]]
        levels = _levels(leaves, int(block["n"].iloc[0]))
        beyond, subroot, root = (outer[c].iloc[0] for c in ("way", "subroot", "root"))
        proofs, folded = [], []
        for i, (leaf, other) in enumerate(zip(leaves, block["changed"], strict=True)):
            proofs.append(" ".join([*_way(levels, i), *([beyond] if beyond else [])]))
            folded.append(fold(leaf if other is None else other.hex(), proofs[-1]))
        return pd.DataFrame(
            {
                "id": block["id"],
                "leaf": leaves,
                "subroot": subroot,
                "root": root,
                "proof": proofs if with_proof else None,
                "proof_sha256": [joined_hash([siblings(way)]) for way in proofs],
                "folded_root": folded,
            }
        )

    return finish


def manifest(
    docs: DataFrame,
    columns: list[str],
    id_col: str = "doc_id",
    group_col: str = "lang",
    now: dict[str, Column] | None = None,
    with_proof: bool = False,
) -> DataFrame:
    """One row per document: its id, ``leaf``, ``subroot``, ``root``, ``proof``,
    ``proof_sha256``, ``folded_root`` and ``verified``.

    ``columns`` are the values that a leaf covers. ``now`` gives what some of them
    have become since; the tree stands for ``docs`` as they were. ``folded_root`` is
    what a row's present leaf and the tree's siblings give, and ``verified`` whether
    that is the root. ``proof`` (read by ``fold``) is null unless asked for.

    Null values count as ``-``, so a null and an empty text differ. Null groups come
    first, null ids first in their group. Rows that share an id are ordered by their
    digest, and equal rows are leaves of their own. A group of one row has its leaf
    as subroot, one group alone its subroot as root, and a row alone no siblings.
    Other columns are not carried; an empty table gives no rows. Texts stay where
    they are read: digests alone are shuffled.
    """
    was = {c: F.col(f"`{c}`") for c in columns}
    leaf, present = digest(list(was.values())), digest(list((was | (now or {})).values()))
    # Null groups first: the empty text comes before all that begin with a mark.
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    rows = docs.select(
        group.alias("grp"),
        F.col(f"`{id_col}`").alias("id"),
        F.unhex(leaf).alias("leaf"),
        F.unhex(F.nullif(present, leaf)).alias("changed"),
    )
    leaves = _placed(rows, ["id", "leaf"], "merkle-leaves")
    leaves = stored(leaves.withColumn("block", F.floor(F.col("pos") / ARITY**LEVELS)), "merkle-blocks")
    named = leaves.select("grp", "n", "pos", "block", F.lower(F.hex("leaf")).alias("digest"))
    above = named.groupBy("grp", "block").applyInPandas(_reduce, "grp string, n long, pos long, digest string")
    ways, tops = _climb(stored(above, "merkle-nodes"))
    # The groups' tops are nodes of one more tree.
    tops = _placed(tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), ["of"], "merkle-groups")
    tops = stored(tops, "merkle-tops")
    last, roots = _climb(tops)
    facts = tops.join(last, ["grp", "pos"]).join(roots.withColumnRenamed("digest", "root"), "grp")
    facts = facts.select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("way").alias("last"))
    outer = skew.lookup(ways.withColumnRenamed("pos", "block"), facts, ["grp"])
    outer = outer.select("grp", "block", F.trim(F.concat_ws(" ", "way", "last")).alias("way"), "subroot", "root")
    kind = rows.schema["id"].dataType.simpleString()
    proved = leaves.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(
        _finish(with_proof),
        f"id {kind}, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string",
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id_col)


# The levels one after another. CRC-32 is worked out bit by bit, as there is no function for it.
SQL = """
WITH RECURSIVE
field AS (SELECT doc_id, lang, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents),
crc(doc_id, digits, state, step) AS (
  SELECT doc_id, doc_id::VARCHAR, 4294967295::BIGINT, 0 FROM field WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, digits, CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, step + 1
  FROM (SELECT *, CASE WHEN step % 8 = 0 THEN xor(state, ascii(digits[step // 8 + 1])) ELSE state END AS s FROM crc)
  WHERE step < 8 * length(digits)),
hit AS (SELECT DISTINCT doc_id FROM crc WHERE step = 8 * length(digits) AND xor(state, 4294967295) % 3 = 0),
row AS (SELECT f.doc_id, coalesce('=' || lang, '') AS grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN h.doc_id IS NULL THEN NULL ELSE sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS changed
  FROM field f LEFT JOIN hit h ON f.doc_id = h.doc_id),
leaf AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY grp) AS n FROM row),
node(grp, level, pos, n, digest) AS (
  SELECT grp, 0, pos, n, leaf FROM leaf
  UNION ALL
  SELECT grp, any_value(level) + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM node WHERE n > 1 GROUP BY grp, pos // 8),
sub AS (SELECT grp, digest, level, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
top(level, pos, n, digest) AS (
  SELECT 0, pos, n, digest FROM sub
  UNION ALL
  SELECT any_value(level) + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY pos // 8),
root AS (SELECT digest AS root FROM top WHERE n = 1),
-- Each level of a leaf's way: what stands before its node in the run, and after.
near AS (SELECT l.grp, l.pos AS leaf_pos, d.level AS step,
    coalesce(string_agg(d.digest, '' ORDER BY d.pos) FILTER (d.pos < l.pos // pow(8, d.level)::BIGINT), '') AS before,
    coalesce(string_agg(d.digest, '' ORDER BY d.pos) FILTER (d.pos > l.pos // pow(8, d.level)::BIGINT), '') AS after
  FROM leaf l JOIN node d ON d.grp = l.grp AND d.n > 1 AND d.pos // 8 = l.pos // pow(8, d.level + 1)::BIGINT GROUP BY ALL),
far AS (SELECT s.grp, t.level + s.level AS step,
    coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < s.pos // pow(8, t.level)::BIGINT), '') AS before,
    coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > s.pos // pow(8, t.level)::BIGINT), '') AS after
  FROM sub s JOIN top t ON t.n > 1 AND t.pos // 8 = s.pos // pow(8, t.level + 1)::BIGINT GROUP BY ALL),
way AS (SELECT grp, pos, list(struct_pack(before := before, after := after) ORDER BY step) AS steps FROM
  (SELECT grp, leaf_pos AS pos, step, before, after FROM near
   UNION ALL SELECT l.grp, l.pos, f.step, f.before, f.after FROM leaf l JOIN far f ON f.grp = l.grp) GROUP BY grp, pos),
proof AS (SELECT l.*, coalesce(w.steps, []) AS steps FROM leaf l LEFT JOIN way w ON w.grp = l.grp AND w.pos = l.pos),
fold(grp, pos, step, digest, steps) AS (
  SELECT grp, pos, 0, coalesce(changed, leaf), steps FROM proof
  UNION ALL
  SELECT grp, pos, step + 1, sha256(steps[step + 1].before || digest || steps[step + 1].after), steps FROM fold WHERE step < len(steps))
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.root,
    sha256(array_to_string(list_transform(p.steps, lambda x: x.before || x.after), '')) AS proof_sha256,
    f.digest AS folded_root, f.digest = r.root AS verified
FROM proof p JOIN sub s ON s.grp = p.grp JOIN fold f ON f.grp = p.grp AND f.pos = p.pos AND f.step = len(p.steps) CROSS JOIN root r
"""
