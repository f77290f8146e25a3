"""The inverted token index and conditional search over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import hashing, text
from bitloom.operators import skew
from bitloom.sources.stores import stored

# Refs whose bits share one number.
REF_BITS = 64


def column_id(parent: Column, column: Column) -> Column:
    """Id of one column of a parent table."""
    return F.sha1(F.concat_ws(":", F.lit("column"), parent, column))


def column_tokens(
    df: DataFrame, parent: str, columns: Sequence[str], tokenizer: text.Tokenizer = text.words, keep: Sequence[str] = ()
) -> DataFrame:
    """Tokens of several columns in one pass: ``(*keep, column_id, token)``; nulls are skipped."""
    values = df.select(*keep, *(F.col(c).cast("string").alias(c) for c in columns))
    long = values.unpivot(list(keep), list(columns), "column", "value").where("value IS NOT NULL")
    return long.select(
        *keep,
        column_id(F.lit(parent), F.col("column")).alias("column_id"),
        F.explode(tokenizer(F.col("value"))).alias("token"),
    )


def with_id(tokens: DataFrame) -> DataFrame:
    """Add the hash id of each token; missing tokens are skipped."""
    return tokens.where(F.col("token").isNotNull()).withColumn("id", hashing.token_hash(F.col("token")))


def postings(tokens: DataFrame, distinct: bool = False) -> DataFrame:
    """Long form of the index: ``(id, token, ref, n)`` from rows ``(ref, batch, token)``.

    ``n`` counts the batches of a ref that hold the token. Pass ``distinct=True``
    when rows are already distinct, as they are when each batch is one text whose
    repeats were removed in place; that saves a shuffle of all tokens.
    """
    rows = tokens.select("ref", "batch", "token")
    if not distinct:
        rows = rows.distinct()
    # Counting by token first leaves one hash per distinct (ref, token).
    counted = rows.groupBy("ref", "token").agg(F.count("*").alias("n"))
    return with_id(counted).select("id", "token", "ref", "n")


def index_counts(post: DataFrame) -> DataFrame:
    """Per id, without lists: ``tf`` (batches), ``df`` (refs). Holds for any number of refs."""
    per_ref = post.groupBy("id", "ref").agg(F.sum("n").alias("n"))
    return per_ref.groupBy("id").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def index_batch(post: DataFrame, p: int = 10) -> DataFrame:
    """One record per id: ``(id, bin, zeros, tokens, refs, tf)``, tf counting batches.

    Tokens share an id only when their hashes collide, and refs are the catalogue
    of ingested columns; both lists are short. Where refs are unbounded use
    ``postings`` or ``index_counts``.
    """
    listed = post.groupBy("id").agg(
        F.array_sort(F.collect_set("token")).alias("tokens"),
        F.array_sort(F.collect_set("ref")).alias("refs"),
        F.sum("n").alias("tf"),
    )
    return _with_coordinates(listed, p)


def _numbered_refs(refs: DataFrame) -> DataFrame:
    """(ref, part, place): distinct refs numbered in order, ``REF_BITS`` of them to a ``part``.

    Written once, so that its size is known where the join with the texts is planned.
    """
    rows = skew.ranged(refs.where("ref IS NOT NULL").distinct(), [], ["ref"])
    at = skew.positions(rows, [], "_bucket", ["ref"], "at")
    return stored(at.select("ref", F.expr(f"at div {REF_BITS}").alias("part"), F.expr(f"cast(at % {REF_BITS} as int)").alias("place")), "refs")


def index_texts(texts: DataFrame, n_bytes: int = 2, p: int = 10) -> DataFrame:
    """``index_batch`` of texts ``(ref, text)``, each one batch, with words of more than ``n_bytes`` bytes.

    A token's refs are bits of a few numbers until all its rows have met. So words
    are shuffled once, as one row per token, part of the catalogue and task, and
    lists are made of distinct tokens only. Texts meet their refs' numbers in a join,
    which leaves the texts where they are as long as the catalogue is short.
    """
    refs = _numbered_refs(texts.select("ref"))
    placed = texts.join(refs, "ref", "left").withColumn("bit", F.expr("shiftleft(1L, place)"))
    rows = placed.select("part", "bit", F.explode(text.distinct_words(F.col("text"))).alias("token"))
    rows = rows.where(text.longer_than(F.col("token"), n_bytes))
    # Tokens of texts without a ref have no part and no bits, but count.
    per_token = rows.groupBy("token", "part").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
    names = refs.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", "ref"))).alias("names"))
    held = F.filter("names", lambda x: F.call_function("shiftright", F.col("bits"), x["place"]).bitwiseAND(F.lit(1)) == 1)
    listed = F.coalesce(F.transform(held, lambda x: x["ref"]), F.array().cast("array<string>"))
    records = with_id(per_token.join(names, "part", "left").select("token", "n", listed.alias("refs")))
    # Most ids have one record, which needs no lists to be merged; those that have more are merged where they lie.
    placed = records.repartition("id").withColumn("same", F.count("*").over(Window.partitionBy("id")))
    one = placed.where("same = 1").select("id", F.array("token").alias("tokens"), "refs", F.col("n").alias("tf"))
    more = placed.where("same > 1").groupBy("id").agg(
        F.array_sort(F.collect_set("token")).alias("tokens"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"),
        F.sum("n").alias("tf"),
    )
    return _with_coordinates(one.unionAll(more), p)


def index_refs(post: DataFrame, p: int = 10) -> DataFrame:
    """The same with ``tf`` = further refs after the first, and ``df`` = all refs."""
    listed = post.groupBy("id").agg(
        F.array_sort(F.collect_set("token")).alias("tokens"),
        F.array_sort(F.collect_set("ref")).alias("refs"),
    )
    n_refs = F.size("refs").cast("bigint")
    counted = listed.select("id", "tokens", "refs", (n_refs - 1).alias("tf"), n_refs.alias("df"))
    return _with_coordinates(counted, p)


def _with_coordinates(index: DataFrame, p: int) -> DataFrame:
    rest = [c for c in index.columns if c != "id"]
    return index.select(
        "id",
        (hashing.bin_of(F.col("id"), p) + 1).alias("bin"),
        (hashing.top_bit(hashing.word_of(F.col("id"), p)) - 1).alias("zeros"),
        *rest,
    )


def merge_postings(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fold new postings into stored ones; refs and batch counts add up."""
    both = stored.select("id", "token", "ref", "n").unionByName(fresh.select("id", "token", "ref", "n"))
    return both.groupBy("id", "token", "ref").agg(F.sum("n").alias("n"))


def token_lookup(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Index records whose id is listed."""
    return index.join(ids.select("id").distinct(), "id", "left_semi")


def condition(field: str, op: str, value, is_list: bool) -> Column:
    """One search condition; a missing field fails it."""
    column = F.col(field)
    as_text = F.array_join(column, ",") if is_list else column.cast("string")
    items = column if is_list else F.split(column.cast("string"), ",")
    if op == "==":
        test = as_text == str(value)
    elif op == "!=":
        test = as_text != str(value)
    elif op in (">", "<"):
        number = as_text.try_cast("double") if is_list else column.try_cast("double")
        limit = F.lit(float(value))
        test = number > limit if op == ">" else number < limit
    elif op == "has":
        test = F.array_contains(items, str(value))
    elif op == "match":
        wanted = str(value).split()
        test = F.arrays_overlap(items, F.array(*map(F.lit, wanted))) if wanted else F.lit(False)
    else:
        test = F.lit(False)
    return F.coalesce(test, F.lit(False))


def token_query(index: DataFrame, conditions: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Records meeting every ``(field, operator, value)``: ``(id, tf)``.

    The conditions fold into one predicate, so a stored index prunes on it.
    """
    types = dict(index.dtypes)
    keep = F.lit(True)
    for field, op, value in conditions:
        if field not in types:
            keep = F.lit(False)
            break
        keep = keep & condition(field, op, value, types[field].startswith("array"))
    return index.where(keep).select("id", "tf")


def refs_match(post: DataFrame, refs: DataFrame) -> DataFrame:
    """Ids with at least one of the listed refs, from the long form."""
    hits = post.join(refs.select("ref").distinct(), "ref", "left_semi")
    return hits.groupBy("id").agg(F.count_distinct("ref").alias("n_refs"))


def text_to_tokens(texts: DataFrame, key: str, index: DataFrame, hot_tf: int = skew.HOT_ROWS) -> DataFrame:
    """Index records of each text's words: ``key`` beside the record.

    Words that are frequent in the index are taken to be frequent in the texts too
    and are split over tasks.
    """
    return skew.lookup(_text_ids(texts, key), index, ["id"], hot=_frequent(index, hot_tf))


def _frequent(index: DataFrame, hot_tf: int) -> DataFrame:
    return index.where(F.col("tf") >= hot_tf).select("id")


def _text_ids(texts: DataFrame, key: str) -> DataFrame:
    """Distinct token ids of each text, one text per row of ``key``."""
    ids = F.array_distinct(F.transform(text.distinct_words(F.col("text")), lambda w: hashing.token_hash(w)))
    return texts.select(key, F.explode(ids).alias("id"))


def text_to_refs(
    texts: DataFrame, key: str, index: DataFrame, k: int, hot_tf: int = skew.HOT_ROWS
) -> DataFrame:
    """The ``k`` refs that hold most of each text's words, ties by ref.

    A frequent word is split over tasks and meets one index record. Refs are the
    catalogue of ingested columns, so a record fans out to a short list.
    """
    hot = _frequent(index, hot_tf)
    held = skew.lookup(_text_ids(texts, key), index.select("id", "refs"), ["id"], hot=hot)
    scored = held.select(key, F.explode("refs").alias("ref")).groupBy(key, "ref").agg(F.count("*").alias("matched"))
    return skew.top_k(scored, key, [F.desc("matched"), "ref"], k, ["ref"])
