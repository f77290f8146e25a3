"""Versions, probability, files and streams on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import text
from bitloom.operators import probability, tokens, verbs, versions
from bitloom.session import checkpointed
from bitloom.sources import files, stores
from bitloom.streaming import jobs
from bitloom.streaming.sources import run_append, table_stream

FOLDER = "/root/testdata/sf0.01"
LOG = "branch string, seq long, message string, ts string, snapshot_id string"


def staged_stream(spark, df, n_files):
    """A frame laid out as several files and streamed one file per micro-batch."""
    path = files.new_folder(spark, "staged")
    df.repartition(n_files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)



@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([("main", 1, "one", "t1", "s1"), ("main", 2, "two", "t2", "s2")], LOG)


@pytest.fixture(scope="module")
def snapshots(spark):
    return spark.createDataFrame([("s1", "a", 1), ("s2", "a", 2), ("s2", "b", 3)], "snapshot_id string, key string, value long")


def test_commit_and_checkout(spark, log, snapshots):
    current = spark.createDataFrame([("c", 9)], "key string, value long")

    def at(n, branch="main"):
        return sorted(tuple(r) for r in versions.checkout(log, snapshots, branch, n, current).collect())

    assert at(1) == [("a", 1)] and at(2) == [("a", 2), ("b", 3)]
    assert at(0) == at(3) == at(1, "other") == [("c", 9)]
    row, copy = versions.commit(log, "main", current, "s3", "three", "t3")
    assert tuple(row.first()) == ("main", 3, "three", "t3", "s3")
    assert tuple(copy.first()) == ("s3", "c", 9)
    assert versions.commit(log, "fresh", current, "s4", "m", "t")[0].first()["seq"] == 1


def test_branches(log):
    branched = versions.create_branch(log, "main", "dev")
    merged = versions.merge_branch(branched, "main", "dev")
    main = sorted((r["seq"], r["snapshot_id"]) for r in merged.where("branch = 'main'").collect())
    assert main == [(1, "s1"), (2, "s2"), (3, "s1"), (4, "s2")]
    assert versions.merge_branch(log, "main", "nobody").count() == 2


def test_head_tail_and_matrix(spark):
    rows = [("x", 1, False), ("x", 3, False), ("y", 2, True), ("z", 1, False)]
    df = spark.createDataFrame(rows, "k string, c int, gone boolean")
    status = {(r["k"], r["c"]): r["status"] for r in versions.head_tail(df, "k", "c", F.col("gone"), hot_rows=2, salts=3).collect()}
    assert status == {("x", 1): "tail", ("x", 3): "head", ("y", 2): "deleted", ("z", 1): "head"}
    matrix = {(r["k"], r["c"], r["commit"]): r["status"] for r in versions.commit_matrix(df, "k", "c", "gone", [1, 2, 3]).collect()}
    every = versions.commit_matrix(df, "k", "c", "gone")
    assert {(r["k"], r["c"], r["commit"]): r["status"] for r in every.collect()} == matrix
    assert matrix == {
        ("x", 1, 1): "head", ("x", 1, 2): "head", ("x", 1, 3): "tail", ("x", 3, 3): "head",
        ("y", 2, 2): "deleted", ("y", 2, 3): "deleted",
        ("z", 1, 1): "head", ("z", 1, 2): "head", ("z", 1, 3): "head",
    }


EVENTS = [{1, 2, 3}, {2, 3, 4}, {3, 4, 5}, {1, 5, 6}]


def matrix_of(df):
    return {(r["i"], r["j"]): r["p"] for r in df.collect()}


def test_conditional_and_joint(spark):
    rows = [(f"E{i}", e) for i, s in enumerate(EVENTS) for e in s for _ in range(1 + e % 2)]
    cells = probability.overlaps(spark.createDataFrame(rows, "item_set string, element int"))
    c = probability.conditional(cells)
    got = matrix_of(c)
    n = len(EVENTS)
    want = {
        (f"E{i}", f"E{j}"): 1.0 if i == j else len(EVENTS[i] & EVENTS[j]) / len(EVENTS[max(i, j)])
        for i in range(n) for j in range(n)
    }
    assert got == pytest.approx(want)
    m = np.array([[want[f"E{i}", f"E{j}"] for j in range(n)] for i in range(n)])
    joint = {(r["a"], r["b"]): r["p"] for r in probability.joint(c).collect()}
    assert joint == pytest.approx({(f"E{a}", f"E{b}"): m[a, 0] * np.prod(m[b, 1:]) for a in range(n) for b in range(n)})


def test_weighted_conditional_and_feasibility(spark):
    freq = {1: 5, 2: 3, 3: 2, 4: 4, 5: 1}
    sets = {"A": {1, 2, 3}, "B": {2, 3, 4}, "C": {1, 5, 3}}
    rows = [(name, e, freq[e]) for name, s in sets.items() for e in s]
    pool = spark.createDataFrame(rows, "item_set string, element int, f long")
    # Each element's pool frequency counts once, in whichever sets hold it.
    per_set = pool.select("item_set", "element", F.col("f"))
    holders = per_set.groupBy("element").agg(F.count("*").alias("n"))
    shared = per_set.join(holders, "element").select("item_set", "element", (F.col("f") / F.col("n")).alias("f"))
    c = probability.conditional_weighted(probability.overlaps(shared, F.col("f")))
    total = {k: sum(freq[e] for e in s) for k, s in sets.items()}
    want = {
        (i, j): 1.0 if i == j else sum(freq[e] for e in sets[i] & sets[j]) / total[j] for i in sets for j in sets
    }
    assert matrix_of(c) == pytest.approx(want)
    rows = probability.row_stochastic(c).collect()
    assert {r["i"]: r["feasible"] for r in rows}["A"] is False
    sums = {}
    for r in rows:
        sums[r["i"]] = sums.get(r["i"], 0) + r["p"]
    assert sums == pytest.approx({"A": 1, "B": 1, "C": 1})


def test_markov_projection(spark):
    t = np.array([[0.5, 0.3, 0.2], [0.1, 0.6, 0.3], [0.2, 0.2, 0.6]])
    rows = [(i, j, float(t[i, j])) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(rows, "i int, j int, p double")
    got = {r["state"]: r["p"] for r in probability.project(df, 5).collect()}
    want = np.full(3, 1 / 3) @ np.linalg.matrix_power(t, 5)
    assert [got[i] for i in range(3)] == pytest.approx(list(want))


def test_small_frame_verbs(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (1, 5), (2, 7), (None, None)], "group int, weight int")
    out = df.na.drop("any").where("weight < 6").groupBy("group").agg(F.sum("weight").alias("w"))
    assert {r["group"]: r["w"] for r in out.collect()} == {1: 6, 2: 3}
    assert verbs.fill_unknown(df).where("group = 'unknown' AND weight = 'unknown'").count() == 1
    assert sorted(r["weight"] for r in verbs.above_mean(df, "weight").collect()) == [5, 7]
    assert [r["weight"] for r in verbs.first_rows(df.na.drop(), ["weight"], 2, skip=1).collect()] == [3, 5]


def test_files_round_trip(spark):
    df = spark.createDataFrame([(1, "a,\"b\"", 1.5), (2, None, -0.25)], "i int, s string, d double")
    path = files.new_folder(spark, "test-csv")
    files.write_csv(df, path)
    assert sorted(map(tuple, files.read_csv(spark, path, df.schema, ["i", "s", "d"]).collect())) == sorted(map(tuple, df.collect()))
    listed = files.dir_manifest(spark, path, "csv").collect()
    assert listed and all(r["item"].endswith(".csv") and r["status"] == "waiting" for r in listed)
    assert "content" not in files.dir_manifest(spark, path, "csv")._jdf.queryExecution().executedPlan().toString()


def test_status_scan_reads_one_partition(spark):
    path = files.new_folder(spark, "test-nodes")
    stores.save_by(spark.createDataFrame([("h", "1"), ("b", "2")], "status string, sha1 string"), path, "status")
    found = stores.scan_status(spark, path, "b")
    assert [r["sha1"] for r in found.collect()] == ["2"]
    assert "PartitionFilters: [isnotnull(status" in found._jdf.queryExecution().executedPlan().toString()


def test_stream_index_equals_batch(spark):
    rows = [(f"r{i % 3}", i, f"alpha beta w{i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, "ref string, batch int, text string")
    path = files.new_folder(spark, "test-index")
    jobs.index_into(staged_stream(spark, df, 4), path, text.distinct_words)
    exploded = df.select("ref", "batch", F.explode(text.distinct_words(F.col("text"))).alias("token"))
    want = sorted(map(tuple, tokens.postings(exploded).collect()))
    assert sorted(map(tuple, jobs.read_index(spark, path).collect())) == want


def test_stream_heads_over_many_batches(spark):
    rows = [(i, f"u{i % 4}", "error" if i == 39 else "view") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user string, kind string")
    path = files.new_folder(spark, "test-heads")
    jobs.heads_into(staged_stream(spark, df, 5), path, "user", "event_id", "kind")
    found = jobs.read_heads(spark, path, "user", "event_id", "kind", "user string, event_id long, kind string")
    heads = {r["user"]: (r["event_id"], r["kind"]) for r in found.collect()}
    assert heads == {"u0": (36, "view"), "u1": (37, "view"), "u2": (38, "view"), "u3": (39, "error")}


def test_late_rows_are_dropped(spark):
    schema = "user_id long, event_type string, ts timestamp_ntz"
    path = files.new_folder(spark, "test-late")
    days = ["2024-01-01 10:00:00", "2024-01-03 10:00:00", "2024-01-04 10:00:00", "2024-01-01 11:00:00", "2024-01-06 10:00:00"]
    for i, day in enumerate(days):
        spark.sql(f"SELECT {i}L AS user_id, 'x' AS event_type, TIMESTAMP_NTZ'{day}' AS ts").write.mode("append").parquet(path)
    # One file per micro-batch, in order of writing; the fourth arrives after its day was closed.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = run_append(jobs.daily_sketches(stream, "ts", "event_type", F.col("user_id").cast("string")), "late")
    assert sorted((r["day"], r["n_bits"]) for r in out.collect()) == [("2024-01-01", 1), ("2024-01-03", 1), ("2024-01-04", 1)]


def test_stream_of_table_reads_only_that_table(spark):
    stream = table_stream(spark, "/root/testdata/sf0.001", "region")
    assert run_append(stream.select("r_name"), "region").count() == 5


def test_streams_and_days_do_not_depend_on_the_session_zone(spark):
    from compare import difference, duck

    import __spark_entry__ as driver

    names = ("stream_ttl", "stream_daily_sketch", "stream_dedup", "daily_sketch", "change_series", "transition_counts", "ttl_expire", "filter_day", "commit_matrix")
    con, sqls = duck(FOLDER), driver.oracle_sql()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        notes = {n: difference(spark, con, FOLDER, n, driver.queries()[n], sqls[n]) for n in names}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert notes == dict.fromkeys(names)


def test_branch_of_an_existing_name_is_replaced(spark):
    rows = [("main", 1, "m1"), ("main", 2, "m2"), ("dev", 1, "old")]
    log = spark.createDataFrame(rows, "branch string, seq long, message string")
    log = log.withColumns({"ts": F.lit("t"), "snapshot_id": F.lit("s")})
    got = versions.create_branch(log, "main", "dev").select("branch", "seq", "message").collect()
    assert sorted(map(tuple, got)) == [("dev", 1, "m1"), ("dev", 2, "m2"), ("main", 1, "m1"), ("main", 2, "m2")]
    assert versions.create_branch(log, "dev", "dev").count() == 3


def test_csv_keeps_any_text(spark, tmp_path):
    from bitloom.sources import files

    texts = ["a,b", 'say "hi"', "two\nlines", "\r\n", "", None, " lead", "tail ", "#x", "\\", "'", '"', "é\u2028", "\t", "null"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    files.write_csv(df, f"{tmp_path}/x")
    got = dict(map(tuple, files.read_csv(spark, f"{tmp_path}/x", df.schema, ["id", "t"]).collect()))
    assert got == dict(enumerate(texts))


def test_profile_and_longer_form(spark):
    from bitloom.operators import verbs

    df = spark.createDataFrame([(9, "b", None), (10, None, 2.5), (None, "a", -1.0)], "i long, s string, d double")
    want = [("d", "double", 2, 2, "-1.0", "2.5"), ("i", "bigint", 2, 2, "9", "10"), ("s", "string", 2, 2, "a", "b")]
    assert sorted(map(tuple, verbs.column_profile(df).collect())) == want
    assert sorted(map(tuple, verbs.column_profile(df, exact=False).collect())) == want
    long = verbs.pivot_longer(df)
    assert long.count() == 9 and long.where("value IS NULL").count() == 3


def test_profile_deals_out_a_table_of_one_file(spark, monkeypatch):
    """A task holds the distinct values of a bounded number of rows."""
    from bitloom.operators import verbs

    monkeypatch.setattr(verbs, "PROFILED", 100)
    df = spark.range(1000).selectExpr("id", "cast(id % 7 AS string) s", "if(id % 3 = 0, null, id / 2) d").coalesce(1)
    assert sorted(r[0] for r in verbs.dealt(df, 100).groupBy(F.spark_partition_id()).count().select("count").collect())[-1] < 200
    assert "REPARTITION" in verbs.column_profile(df)._jdf.queryExecution().executedPlan().toString()
    got = {r["variable"]: tuple(r)[2:] for r in verbs.column_profile(df).collect()}
    assert got == {"id": (1000, 1000, "0", "999"), "s": (1000, 7, "0", "6"), "d": (666, 666, "0.5", "499.0")}
