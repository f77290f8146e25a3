"""Streaming runs over the events and documents, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.functions import text
from bitloom.operators import sketch
from bitloom.plans import oracle as o
from bitloom.plans.registry import query
from bitloom.plans.tokens import POST
from bitloom.sources import files
from bitloom.sources.tables import read_table
from bitloom.streaming import jobs
from bitloom.streaming.sources import run_append, table_stream

DAY_KEYS = (
    "ev AS (SELECT strftime(ts, '%Y-%m-%d') || '|' || event_type AS k, user_id::VARCHAR AS token FROM events), "
    f"sk AS ({o.sketch('ev', 'k')})"
)


def daily_sql(closed: str) -> str:
    return f"""WITH {o.segments(10)}, {DAY_KEYS}, r AS (SELECT set_id, {o.card_agg('word', 10)} AS raw,
      sum(bit_count(word))::BIGINT AS n_bits FROM sk GROUP BY 1)
    SELECT split_part(set_id, '|', 1) AS day, split_part(set_id, '|', 2) AS key, {o.card_of()} AS card, n_bits FROM r {closed}"""


# A day is closed once the latest event, less the watermark's hour, lies past its end.
CLOSED = "WHERE split_part(set_id, '|', 1)::TIMESTAMP + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query("daily_sketch", lambda: daily_sql(""))
def daily_sketch(spark, folder):
    events = read_table(spark, folder, "events")
    key = F.struct(text.day_key(F.col("ts")).alias("day"), F.col("event_type").alias("key"))
    meta = sketch.meta(sketch.build(events, key, F.col("user_id").cast("string")))
    return meta.select("set_id.day", "set_id.key", "card", "n_bits")


@query("stream_daily_sketch", lambda: daily_sql(CLOSED))
def stream_daily_sketch(spark, folder):
    events = table_stream(spark, folder, "events")
    return run_append(jobs.daily_sketches(events, "ts", "event_type", F.col("user_id").cast("string")), "daily")


@query(
    "stream_token_index",
    f"WITH {POST.replace('WHERE strlen(token) > 2', '')} SELECT id, token, ref, n FROM post",
)
def stream_token_index(spark, folder):
    docs = table_stream(spark, folder, "documents").select(F.col("source").alias("ref"), F.col("doc_id").alias("batch"), "text")
    path = files.new_folder(spark, "index")
    jobs.index_into(docs, path, text.distinct_words)
    return jobs.read_index(spark, path)


@query(
    "stream_commit",
    """SELECT event_id, user_id, CASE WHEN event_id < max(event_id) OVER (PARTITION BY user_id) THEN 'tail'
      WHEN event_type = 'error' THEN 'deleted' ELSE 'head' END AS status FROM events""",
)
def stream_commit(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "user_id", "event_type")
    path = files.new_folder(spark, "heads")
    stream = table_stream(spark, folder, "events").select("event_id", "user_id", "event_type")
    jobs.heads_into(stream, path, "user_id", "event_id", "event_type")
    schema = "user_id long, event_id long, event_type string"
    heads = jobs.read_heads(spark, path, "user_id", "event_id", "event_type", schema)
    status = F.when(F.col("event_type") == "error", "deleted").otherwise("head")
    current = heads.select("event_id", "user_id", status.alias("status"))
    old = events.join(heads.select("event_id"), "event_id", "left_anti")
    return current.unionByName(old.select("event_id", "user_id", F.lit("tail").alias("status")))


@query(
    "stream_dedup",
    "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, user_id, event_type FROM events",
)
def stream_dedup(spark, folder):
    events = table_stream(spark, folder, "events").withColumn("day", text.day_key(F.col("ts")))
    return run_append(jobs.distinct_tokens(events, "ts", ["day", "user_id", "event_type"], "1 day"), "dedup")


@query(
    "stream_ttl",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS life FROM g),
    l AS (SELECT user_id, min(ts) AS first_seen, max(ts) + INTERVAL 6 HOUR AS expired_at, count(*) AS n FROM s GROUP BY user_id, life)
    SELECT user_id, strftime(first_seen, '%Y-%m-%d %H:%M:%S.%f') AS first_seen,
      strftime(expired_at, '%Y-%m-%d %H:%M:%S.%f') AS expired_at, n FROM l
    WHERE expired_at <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stream_ttl(spark, folder):
    lives = run_append(jobs.expired(table_stream(spark, folder, "events"), "ts", "user_id", "6 hours"), "ttl")
    shown = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    times = [F.date_format(c, shown).alias(c) for c in ("first_seen", "expired_at")]
    return lives.select("user_id", *times, "n")
