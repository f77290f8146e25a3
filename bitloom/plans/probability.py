"""Set probability over the event types: which users act on which days."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators import probability
from bitloom.plans.registry import query
from bitloom.sources.tables import read_table

MEMBERS = "m AS (SELECT event_type AS s, user_id || ':' || strftime(ts, '%Y-%m-%d') AS e FROM events)"
CELLS = f"""{MEMBERS}, d AS (SELECT DISTINCT s, e FROM m), sets AS (SELECT DISTINCT s FROM m),
    f AS (SELECT e, 1 AS w FROM d GROUP BY 1),
    sh AS (SELECT a.s AS i, b.s AS j, sum(w)::BIGINT AS w FROM d a JOIN d b USING (e) JOIN f USING (e) GROUP BY 1, 2),
    cells AS (SELECT a.s AS i, b.s AS j, coalesce(w, 0) AS w FROM sets a JOIN sets b ON TRUE LEFT JOIN sh ON i = a.s AND j = b.s)"""
WEIGHTED = CELLS.replace("SELECT e, 1 AS w FROM d GROUP BY 1", "SELECT e, count(*) AS w FROM m GROUP BY 1")
SIZED = "z AS (SELECT c.*, x.w AS size_i, y.w AS size_j FROM cells c JOIN cells x ON x.i = c.i AND x.j = c.i JOIN cells y ON y.i = c.j AND y.j = c.j)"
COND = f"{CELLS}, {SIZED}, c AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE w::DOUBLE / CASE WHEN i < j THEN size_j ELSE size_i END END AS p FROM z)"
WCOND = f"{WEIGHTED}, {SIZED}, c AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE w::DOUBLE / size_j END AS p FROM z)"
JOINT = f"""{COND}, fst AS (SELECT min(j) AS m FROM c), jt AS (SELECT x.i AS a, r.b, x.p * r.p AS p FROM c x
    JOIN (SELECT i AS b, product(p) AS p FROM c WHERE j <> (SELECT m FROM fst) GROUP BY 1) r ON x.j = (SELECT m FROM fst))"""


def members(spark, folder):
    element = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return read_table(spark, folder, "events").select(F.col("event_type").alias("item_set"), element.alias("element"))


def rounded(df, *columns, digits=9):
    return df.select(*(F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns))


def conditional(spark, folder):
    return probability.conditional(probability.overlaps(members(spark, folder)))


def weighted(spark, folder):
    cells = probability.overlaps(members(spark, folder), F.lit(1).cast("bigint"))
    return probability.conditional_weighted(cells)


@query("cond_prob_matrix", f"WITH {COND} SELECT i, j, round(p, 9) AS p FROM c")
def cond_prob_matrix(spark, folder):
    return rounded(conditional(spark, folder), "p")


@query("weighted_cond_prob", f"WITH {WCOND} SELECT i, j, round(p, 9) AS p FROM c")
def weighted_cond_prob(spark, folder):
    return rounded(weighted(spark, folder), "p")


@query("joint_from_matrix", f"WITH {JOINT} SELECT a, b, round(p, 9) AS p FROM jt")
def joint_from_matrix(spark, folder):
    return rounded(probability.joint(conditional(spark, folder)), "p")


@query(
    "posterior_given",
    f"""WITH {JOINT} SELECT a, round(p / (SELECT sum(p) FROM jt WHERE b = 'error'), 9) AS p FROM jt WHERE b = 'error'""",
)
def posterior_given(spark, folder):
    return rounded(probability.posterior(probability.joint(conditional(spark, folder)), "error"), "p")


@query(
    "row_stochastic",
    f"""WITH {WCOND}, rest AS (SELECT i, 1.0::DOUBLE - sum(CASE WHEN i <> j THEN p ELSE 0 END) AS r FROM c GROUP BY 1)
    SELECT i, j, round(CASE WHEN i = j THEN r ELSE p END, 9) AS p, r >= 0 AS feasible FROM c JOIN rest USING (i)""",
)
def row_stochastic(spark, folder):
    return rounded(probability.row_stochastic(weighted(spark, folder)), "p")


COUNTS = """t AS (SELECT i, j, count(*) AS n FROM (SELECT event_type AS i,
    lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM events) WHERE j IS NOT NULL GROUP BY 1, 2)"""
MATRIX = f"{COUNTS}, mx AS (SELECT i, j, n::DOUBLE / sum(n) OVER (PARTITION BY i) AS p FROM t)"


def counts(spark, folder):
    events = read_table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    hourly = events.withColumn("hour", F.date_trunc("hour", F.col("ts")))
    return probability.transitions(hourly, "user_id", "hour", ["ts", "event_id"], "event_type")


@query("transition_counts", f"WITH {COUNTS} SELECT i, j, n FROM t")
def transition_counts(spark, folder):
    return counts(spark, folder)


CHAIN = f"""{MATRIX}, st AS (SELECT i AS a, sum(n)::DOUBLE / (SELECT sum(n) FROM t) AS p FROM t GROUP BY 1),
    ch AS (SELECT a, x.j AS b, y.j AS c, st.p * x.p * y.p AS p FROM st JOIN mx x ON x.i = a JOIN mx y ON y.i = x.j)"""


@query("chain_joint", f"WITH {CHAIN} SELECT a, b, c, round(p, 9) AS p FROM ch")
def chain_joint(spark, folder):
    return rounded(probability.chain_joint(counts(spark, folder)), "p")


@query("chain_marginal", f"WITH {CHAIN} SELECT a, c, round(sum(p), 9) AS p FROM ch GROUP BY 1, 2")
def chain_marginal(spark, folder):
    chain = probability.chain_joint(counts(spark, folder))
    return rounded(chain.groupBy("a", "c").agg(F.sum("p").alias("p")), "p")


PROJECTED = f"""{MATRIX}, states AS (SELECT DISTINCT i FROM mx), s0 AS (SELECT i, 1.0::DOUBLE / (SELECT count(*) FROM states) AS v FROM states),
    {", ".join(f"s{k} AS (SELECT j AS i, sum(p * v) AS v FROM mx JOIN s{k - 1} USING (i) GROUP BY 1)" for k in range(1, 6))}"""


@query("markov_project", f"WITH {PROJECTED} SELECT i AS state, round(v, 9) AS p FROM s5")
def markov_project(spark, folder):
    return rounded(probability.project(probability.transition_matrix(counts(spark, folder)), 5), "p")


@query(
    "state_element_join",
    f"""WITH {PROJECTED}, el AS (SELECT event_type AS i, arg_max(user_id, (value, event_id)) AS element FROM events GROUP BY 1)
    SELECT element, round(v, 9) AS p FROM s5 JOIN el USING (i)""",
)
def state_element_join(spark, folder):
    projected = probability.project(probability.transition_matrix(counts(spark, folder)), 5)
    top = F.max_by("user_id", F.struct("value", "event_id"))
    elements = read_table(spark, folder, "events").groupBy(F.col("event_type").alias("state")).agg(top.alias("element"))
    return rounded(probability.state_elements(projected, elements), "p")
