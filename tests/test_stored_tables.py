"""Tables that are merged into in place, and look-ups that read little of a stored index."""

import os
import random

import pytest
from pyspark.sql import functions as F

from bitloom.functions import hashing
from bitloom.operators import graph
from bitloom.sources import files, stores

NODES = "status string, sha1 string, labels array<string>"
KEYS = ["status", "sha1"]


def listing(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def rows_of(df):
    return sorted((r["status"], r["sha1"], tuple(r["labels"])) for r in df.collect())


def test_only_touched_partitions_are_rewritten(spark):
    path = files.new_folder(spark, "nodes")
    rng = random.Random(1)
    first = spark.createDataFrame([("b", f"n{i}", [rng.choice("xyz")]) for i in range(500)], NODES)
    assert stores.merge_into(spark, path, first, KEYS, graph.upsert_nodes) == stores.BUCKETS
    before = listing(path)
    fresh = spark.createDataFrame([("b", "n7", ["new"]), ("b", "n8", ["x", "new"]), ("t", "n7", ["other"]), ("b", "n7", ["more"])], NODES)
    touched = stores.merge_into(spark, path, fresh, KEYS, graph.upsert_nodes)
    after = listing(path)
    assert 1 <= touched <= 3
    kept = {f for f, at in before.items() if after.get(f) == at}
    assert len(kept) == stores.BUCKETS - touched
    assert rows_of(stores.read_merged(spark, path)) == rows_of(graph.upsert_nodes(first, fresh))
    # A batch that is run again changes nothing but the files' times.
    stores.merge_into(spark, path, fresh, KEYS, graph.upsert_nodes)
    assert rows_of(stores.read_merged(spark, path)) == rows_of(graph.upsert_nodes(first, fresh))
    assert stores.merge_into(spark, path, fresh.limit(0), KEYS, graph.upsert_nodes) == 0


def test_a_merge_that_fails_leaves_the_table(spark):
    path = files.new_folder(spark, "nodes")
    first = spark.createDataFrame([("b", f"n{i}", ["x"]) for i in range(50)], NODES)
    stores.merge_into(spark, path, first, KEYS, graph.upsert_nodes, buckets=4)
    before = rows_of(stores.read_merged(spark, path))

    def broken(old, new):
        return graph.upsert_nodes(old, new).withColumn("sha1", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        stores.merge_into(spark, path, first.limit(3), KEYS, broken, buckets=4)
    assert rows_of(stores.read_merged(spark, path)) == before


def test_edges_and_fields_in_any_order_of_batches(spark):
    rng = random.Random(2)
    writes = [("b", f"s{rng.randint(0, 9)}", f"t{rng.randint(0, 3)}", f"r{i}", f"p{i}", i) for i in range(200)]
    schema = "status string, source string, target string, r_type string, props string, seq int"
    want = sorted(map(tuple, graph.upsert_edges(spark.createDataFrame(writes, schema), "seq").collect()))
    for seed in (1, 2):
        random.Random(seed).shuffle(writes)
        path = files.new_folder(spark, "edges")
        for at in range(0, 200, 67):
            part = spark.createDataFrame(writes[at : at + 67], schema)
            stores.merge_into(spark, path, part, ["status", "source", "target"], lambda a, b: graph.newest_edges(a, b, "seq"), buckets=4)
        assert sorted(map(tuple, stores.read_merged(spark, path).drop("seq").select("status", "source", "target", "r_type", "props").collect())) == want


def rows_read(df):
    """Rows that the scans of a frame gave, after it was collected."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_look_up_reads_a_small_part_of_the_index(spark):
    path = files.new_folder(spark, "index")
    rows = spark.range(400_000).select(hashing.token_hash(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("tokens"))
    stores.store_sorted(rows, path, "id")
    asked = [hashing.hash_of(f"w{i}") for i in (3, 77, 123_456, 399_999)] + [hashing.hash_of("absent"), hashing.hash_of("w3")]
    found = stores.look_up(spark.read.parquet(path), "id", asked)
    got = {r["id"] for r in found.collect()}
    assert got == set(asked[:4])
    assert rows_read(found) < 400_000 / 10
    many = [hashing.hash_of(f"w{i}") for i in range(0, 400_000, 20_000)]
    assert stores.look_up(spark.read.parquet(path), "id", many).count() == len(many)
    assert stores.look_up(spark.read.parquet(path), "id", []).isEmpty()


def test_hash_of_a_named_token(spark):
    words = ["a", "Ünï", "", "long " * 50]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.token_hash(F.col("w")).alias("h"))
    assert {r["w"]: r["h"] for r in df.collect()} == {w: hashing.hash_of(w) for w in words}


def test_a_rewritten_table_gets_a_new_index(spark, tmp_path):
    """The same path with other rows: nothing of the index before is seen."""
    from bitloom.plans import load_all
    from bitloom.plans.tokens import doc_index

    load_all()
    folder = str(tmp_path)
    schema = "doc_id long, text string, source string"

    def write(text):
        spark.createDataFrame([(1, text, "s")], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")

    def words():
        return sorted(t for r in doc_index(spark, folder).collect() for t in r["tokens"])

    write("alpha beta")
    assert words() == ["alpha", "beta"] and words() == ["alpha", "beta"]
    write("gamma delta")
    assert words() == ["delta", "gamma"]
