"""Streams that keep state: lives of records, and versioned tables."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from bitloom.sources import files
from bitloom.streaming import jobs, store
from bitloom.streaming.lives import Lives, add_writes
from bitloom.streaming.sources import run_append

POSTS = "id long, token string, ref string, n long"
START = dt.datetime(2024, 1, 1)


def posts(spark, rows):
    return spark.createDataFrame(rows, POSTS)


def merged(rows):
    return rows.groupBy("id", "token", "ref").agg(F.sum("n").alias("n"))


def test_repeated_batches_change_nothing_and_versions_are_whole(spark):
    path = files.new_folder(spark, "store")
    assert store.version(spark, path) is None and store.read(spark, path, POSTS, merged).isEmpty()
    total, most = {}, 0
    for batch in range(20):
        rows = [(i, f"t{i}", f"r{batch % 3}", 1 + batch) for i in range(batch, batch + 4)]
        for i, t, r, n in rows:
            total[i, t, r] = total.get((i, t, r), 0) + n
        assert store.add(posts(spark, rows).coalesce(1), batch, path, merged)
        # The stream hands in a batch again after a crash: this one and older ones.
        assert not store.add(posts(spark, rows), batch, path, merged)
        assert not store.add(posts(spark, [(0, "other", "r", 9)]), max(0, batch - 5), path, merged)
        assert store.version(spark, path) == batch
        most = max(most, len(store.live_tables(spark, path)))
    got = {(r["id"], r["token"], r["ref"]): r["n"] for r in store.read(spark, path, POSTS, merged).collect()}
    assert got == total
    # 20 batches: two full merges and four deltas.
    assert len(store.live_tables(spark, path)) == 6 and most <= 2 * store.FAN
    folders = [d for level in os.listdir(path) if level.startswith("level") for d in os.listdir(f"{path}/{level}")]
    assert len(folders) <= 2 * store.FAN * 2


def test_a_crash_before_the_pointer_moves(spark):
    """Tables of an unfinished batch are not seen, and the batch can be run again."""
    path = files.new_folder(spark, "store")
    for batch in range(store.FAN - 1):
        store.add(posts(spark, [(batch, "t", "r", 1)]).coalesce(1), batch, path, merged)
    before = sorted(map(tuple, store.read(spark, path, POSTS, merged).collect()))

    def broken(rows):
        raise RuntimeError("lost")

    # The delta is written, the merge that is due fails.
    with pytest.raises(RuntimeError):
        store.add(posts(spark, [(99, "t", "r", 1)]).coalesce(1), store.FAN - 1, path, broken)
    assert store.version(spark, path) == store.FAN - 2
    assert sorted(map(tuple, store.read(spark, path, POSTS, merged).collect())) == before
    assert store.add(posts(spark, [(99, "t", "r", 1)]).coalesce(1), store.FAN - 1, path, merged)
    after = sorted(map(tuple, store.read(spark, path, POSTS, merged).collect()))
    assert after == sorted([*before, (99, "t", "r", 1)]) and len(store.live_tables(spark, path)) == 1


def test_readers_keep_their_version(spark):
    path = files.new_folder(spark, "store")
    store.add(posts(spark, [(1, "t", "r", 1)]).coalesce(1), 0, path, merged)
    old = store.read(spark, path, POSTS, merged)
    for batch in range(1, store.FAN + 2):
        store.add(posts(spark, [(1, "t", "r", 1)]).coalesce(1), batch, path, merged)
    assert old.collect()[0]["n"] == 1
    assert store.read(spark, path, POSTS, merged).collect()[0]["n"] == store.FAN + 2


def lives_of(rows, ttl):
    """Sessions by key, in plain Python."""
    by_key = {}
    for key, at in rows:
        by_key.setdefault(key, []).append(at)
    out = []
    for key, times in by_key.items():
        times.sort()
        life = [times[0]]
        for at in times[1:]:
            if at >= life[-1] + ttl:
                out.append((key, life[0], life[-1] + ttl, len(life)))
                life = []
            life.append(at)
        out.append((key, life[0], life[-1] + ttl, len(life)))
    return out


def test_lives_in_any_order():
    rng = random.Random(3)
    for _ in range(300):
        times, ttl = [rng.randint(0, 60) for _ in range(rng.randint(1, 12))], rng.randint(1, 9)
        lives = []
        cut = rng.randint(0, len(times))
        for part in (times[:cut], times[cut:]):
            lives = add_writes(lives, part, ttl)
        assert [("k", *life) for life in lives] == sorted(lives_of([("k", t) for t in times], ttl))


def write_file(spark, path, rows):
    text_rows = [(k, (START + dt.timedelta(hours=h)).isoformat(" ")) for k, h in rows]
    df = spark.createDataFrame(text_rows, "user long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.mode("append").parquet(path)


def shown(out):
    hours = [F.round((F.unix_micros(F.col(c).cast("timestamp")) - F.lit(int(START.replace(tzinfo=dt.UTC).timestamp() * 1e6))) / 3.6e9, 6) for c in ("first_seen", "expired_at")]
    return sorted(tuple(r) for r in out.select("user", *hours, "n").collect())


def test_renewal_restart_and_shrinking_state(spark):
    source, out, state = (files.new_folder(spark, n) for n in ("lives-in", "lives-out", "lives-state"))

    def run():
        stream = spark.readStream.schema("user long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(source)
        return shown(run_append(jobs.expired(stream, "ts", "user", "6 hours"), "lives", out, state))

    # User 1 is renewed before its end, user 2 is not; user 3 only moves the clock.
    write_file(spark, source, [(1, 0), (2, 0), (2, 1)])
    write_file(spark, source, [(1, 5), (3, 9)])
    assert run() == [(2, 0, 7, 2)]
    # After a restart the state is still there: user 1 lives on from hour 0, and a late row counts.
    write_file(spark, source, [(1, 8.5), (3, 12)])
    assert run() == [(2, 0, 7, 2)]
    write_file(spark, source, [(3, 30)])
    assert run() == [(1, 0, 14.5, 3), (2, 0, 7, 2), (3, 9, 18, 2)]
    # What has been put out is no longer held: all that is left is user 3's new life.
    rows = spark.read.format("statestore").option("path", state).option("stateVarName", "open").load()
    assert [r["key"]["user"] for r in rows.collect()] == [3]
    # Nothing new: nothing is put out twice.
    assert run() == [(1, 0, 14.5, 3), (2, 0, 7, 2), (3, 9, 18, 2)]


def test_lives_of_one_batch_and_null_rows(spark):
    """Several lives of a key in one batch, a write at the very end of a life, missing keys and times."""
    rng = random.Random(4)
    rows = [(rng.randint(1, 5), round(rng.random() * 100, 2)) for _ in range(200)] + [(9, 0), (9, 6), (9, 12), (7, 200)]
    source = files.new_folder(spark, "lives-in")
    write_file(spark, source, rows)
    spark.sql("SELECT CAST(NULL AS LONG) AS user, TIMESTAMP_NTZ'2024-01-01' AS ts UNION ALL SELECT 1L, NULL").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("user long, ts timestamp_ntz").parquet(source)
    got = shown(run_append(jobs.expired(stream, "ts", "user", "6 hours"), "lives"))
    want = sorted((k, round(a, 6), round(b, 6), n) for k, a, b, n in lives_of(rows, 6) if b <= 199)
    assert got == want and (9, 0, 6, 1) in got


class OneKey:
    """State and timers of one key, as a processor's handle shows them."""

    def __init__(self):
        self.state, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.state is not None

    def get(self):
        return self.state

    def update(self, value):
        self.state = value

    def clear(self):
        self.state = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_key_is_visited_once_for_each_step_of_the_watermark():
    """However many lives a key has, one timer waits, and one visit puts out all that is over."""
    rng = random.Random(5)
    for steps in (1, 3):
        lives, handle, out, visits = Lives(6_000_000, "user"), OneKey(), [], 0
        lives.init(handle)
        times = sorted(rng.randint(0, 500_000_000) for _ in range(60))
        for step in range(steps):
            part = times[step * 60 // steps : (step + 1) * 60 // steps]
            list(lives.handleInputRows((7,), iter([pd.DataFrame({"at_us": part})]), TimerValues(-1, -1)))
            assert len(handle.timers) == 1
            watermark = part[-1] // 1000
            while handle.timers and min(handle.timers) <= watermark:
                at = min(handle.timers)
                handle.timers.remove(at)
                visits += 1
                for rows in lives.handleExpiredTimer((7,), TimerValues(-1, watermark), ExpiredTimerInfo(at)):
                    out += [tuple(r) for r in rows.itertuples(index=False, name=None)]
        want = [life for life in lives_of([(7, t) for t in times], 6_000_000) if life[2] <= watermark * 1000]
        assert out == want and len(out) > 20 and visits == steps
        assert len(handle.state[0]) == 1 and handle.timers == {-(-handle.state[1][0] // 1000)}


def test_stream_of_a_table_in_many_files(spark, tmp_path):
    """A table that is a folder of files is read as one that is a file is."""
    from bitloom.plans import load_all
    from bitloom.plans.registry import REGISTRY

    load_all()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents2.parquet")
    build = REGISTRY["stream_token_index"].build
    got, want = (sorted(map(tuple, build(spark, folder).collect())) for folder in (str(tmp_path), "/root/testdata/sf0.001"))
    assert got == want and got
