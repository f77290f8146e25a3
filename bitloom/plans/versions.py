"""Commits and life cycle over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators import versions
from bitloom.plans.registry import query
from bitloom.sources.tables import read_table

# Each year of orders is one commit; its snapshot holds every customer's order count so far.
SNAPSHOTS = """per AS (SELECT o_custkey AS key, extract('year' FROM o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY ALL),
    years AS (SELECT DISTINCT y FROM per),
    snap AS (SELECT 'y' || years.y AS snapshot_id, key, sum(n)::BIGINT AS value FROM per JOIN years ON per.y <= years.y GROUP BY ALL),
    log AS (SELECT 'main' AS branch, row_number() OVER (ORDER BY y) AS seq, 'orders of ' || y AS message,
      y || '-12-31' AS ts, 'y' || y AS snapshot_id FROM years)"""


def order_history(spark, folder):
    """The commit log and its snapshots."""
    orders = read_table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("y"))
    per_year = orders.groupBy("key", "y").agg(F.count("*").alias("n"))
    span = orders.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).select(F.struct("lo", "hi").alias("s")).scalar()
    spread = per_year.withColumn("s", span).select("key", "n", F.explode(F.sequence(F.col("y"), F.col("s.hi"))).alias("y"))
    name = F.concat(F.lit("y"), F.col("y").cast("string"))
    snapshots = spread.groupBy(name.alias("snapshot_id"), "key").agg(F.sum("n").alias("value"))
    years = orders.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    listed = years.select("lo", F.explode(F.sequence("lo", "hi")).alias("y"))
    log = listed.select(
        F.lit("main").alias("branch"),
        (F.col("y") - F.col("lo") + 1).cast("bigint").alias("seq"),
        F.concat(F.lit("orders of "), F.col("y").cast("string")).alias("message"),
        F.concat(F.col("y").cast("string"), F.lit("-12-31")).alias("ts"),
        name.alias("snapshot_id"),
    )
    return log, snapshots


@query(
    "commit_snapshot",
    f"""WITH {SNAPSHOTS}, state AS (SELECT c_custkey AS key, c_nationkey::BIGINT AS value FROM customer),
    more AS (SELECT * FROM log UNION ALL SELECT 'main', (SELECT max(seq) FROM log) + 1, 'nations', '2030-01-01', 'nations')
    SELECT branch, seq, message, ts, snapshot_id, count(*) AS n_keys, sum(value)::BIGINT AS total FROM more
    JOIN (SELECT * FROM snap UNION ALL SELECT 'nations', key, value FROM state) USING (snapshot_id) GROUP BY ALL""",
)
def commit_snapshot(spark, folder):
    log, snapshots = order_history(spark, folder)
    state = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("bigint").alias("value"))
    row, copy = versions.commit(log, "main", state, "nations", "nations", "2030-01-01")
    both = snapshots.select("snapshot_id", "key", "value").unionByName(copy)
    sizes = both.groupBy("snapshot_id").agg(F.count("*").alias("n_keys"), F.sum("value").alias("total"))
    return log.unionByName(row).join(sizes, "snapshot_id")


@query("checkout", f"WITH {SNAPSHOTS} SELECT key, value FROM snap WHERE snapshot_id = (SELECT snapshot_id FROM log WHERE seq = 3)")
def checkout(spark, folder):
    log, snapshots = order_history(spark, folder)
    current = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.lit(0).cast("bigint").alias("value"))
    return versions.checkout(log, snapshots, "main", 3, current)


@query("checkout_out_of_range", "SELECT c_custkey AS key, 0::BIGINT AS value FROM customer")
def checkout_out_of_range(spark, folder):
    log, snapshots = order_history(spark, folder)
    current = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.lit(0).cast("bigint").alias("value"))
    return versions.checkout(log, snapshots, "main", 99, current)


@query("create_branch", f"WITH {SNAPSHOTS} SELECT * FROM log UNION ALL SELECT 'trial', seq, message, ts, snapshot_id FROM log")
def create_branch(spark, folder):
    log, _ = order_history(spark, folder)
    return versions.create_branch(log, "main", "trial")


@query(
    "replace_branch",
    f"""WITH {SNAPSHOTS} SELECT * FROM log
    UNION ALL SELECT 'trial', seq, 'again ' || message, ts, snapshot_id FROM log
    UNION ALL SELECT 'draft', seq, 'again ' || message, ts, snapshot_id FROM log""",
)
def replace_branch(spark, folder):
    log, _ = order_history(spark, folder)
    both = versions.create_branch(log, "main", "trial")
    draft = log.withColumns({"branch": F.lit("draft"), "message": F.concat(F.lit("again "), "message")})
    return versions.create_branch(both.unionByName(draft), "draft", "trial")


@query(
    "merge_branch",
    f"""WITH {SNAPSHOTS} SELECT * FROM log UNION ALL SELECT 'trial', seq, message, ts, snapshot_id FROM log
    UNION ALL SELECT 'main', seq + (SELECT max(seq) FROM log), message, ts, snapshot_id FROM log""",
)
def merge_branch(spark, folder):
    log, _ = order_history(spark, folder)
    branched = versions.create_branch(log, "main", "trial")
    merged = versions.merge_branch(branched, "main", "trial")
    return versions.merge_branch(merged, "main", "no such branch")


@query(
    "commit_head_tail",
    """SELECT event_id, user_id, CASE WHEN event_id < max(event_id) OVER (PARTITION BY user_id) THEN 'tail'
      WHEN event_type = 'error' THEN 'deleted' ELSE 'head' END AS status FROM events""",
)
def commit_head_tail(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "user_id", "event_type")
    staged = versions.head_tail(events, "user_id", "event_id", F.col("event_type") == "error")
    return staged.select("event_id", "user_id", "status")


def daily_versions(spark, folder):
    """A user's day as one version; it is a removal if the day's last event is an error."""
    events = read_table(spark, folder, "events")
    return events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        (F.max_by("event_type", "event_id") == "error").alias("removed")
    )


@query(
    "commit_matrix",
    """WITH v AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_max(event_type, event_id) = 'error' AS removed
      FROM events GROUP BY 1, 2),
    n AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS next_day FROM v),
    c AS (SELECT DISTINCT day AS commit FROM v)
    SELECT user_id, day, commit, CASE WHEN next_day <= commit THEN 'tail' WHEN removed THEN 'deleted' ELSE 'head' END AS status
    FROM n JOIN c ON day <= commit""",
)
def commit_matrix(spark, folder):
    return versions.commit_matrix(daily_versions(spark, folder), "user_id", "day", "removed")


DAILY = """v AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_max(event_type, event_id) = 'error' AS removed FROM events GROUP BY 1, 2)"""


@query(
    "commit_intervals",
    f"""WITH {DAILY}, n AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS next_day FROM v)
    SELECT user_id, day, day AS since, next_day AS until, CASE WHEN removed THEN 'deleted' ELSE 'head' END AS status FROM n
    UNION ALL SELECT user_id, day, next_day, NULL, 'tail' FROM n WHERE next_day IS NOT NULL""",
)
def commit_intervals(spark, folder):
    return versions.commit_intervals(daily_versions(spark, folder), "user_id", "day", "removed")


@query(
    "commit_matrix_asked",
    f"""WITH {DAILY}, n AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS next_day FROM v),
    c AS (SELECT DISTINCT day AS commit FROM v WHERE day LIKE '%1')
    SELECT user_id, day, commit, CASE WHEN next_day <= commit THEN 'tail' WHEN removed THEN 'deleted' ELSE 'head' END AS status
    FROM n JOIN c ON day <= commit""",
)
def commit_matrix_asked(spark, folder):
    daily = daily_versions(spark, folder)
    return versions.commit_matrix(daily, "user_id", "day", "removed", daily.where("day LIKE '%1'").select("day").distinct())


@query(
    "status_as_of",
    f"""WITH {DAILY}, a AS (SELECT o_orderkey, o_custkey AS user_id, '2024-01-' || lpad((o_orderkey % 31 + 1)::VARCHAR, 2, '0') AS at FROM orders)
    SELECT a.user_id, a.at, a.o_orderkey, v.day, CASE WHEN v.removed THEN 'deleted' WHEN v.day IS NOT NULL THEN 'head' END AS status
    FROM a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.at >= v.day""",
)
def status_as_of(spark, folder):
    orders = read_table(spark, folder, "orders")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("o_orderkey") % 31 + 1).cast("string"), 2, "0"))
    asks = orders.select(F.col("o_custkey").alias("user_id"), day.alias("at"), "o_orderkey")
    return versions.status_as_of(daily_versions(spark, folder), asks, "user_id", "day", "removed", "at")


@query("ttl_expire", "SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def ttl_expire(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "user_id", "ts")
    newest = events.agg(F.max("ts").alias("t")).scalar()
    return versions.expire(events, "ts", newest, "7 DAYS").select("event_id", "user_id")
