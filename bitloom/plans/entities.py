"""Entities over the documents' languages and the days of the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators import entity, ingest, sketch
from bitloom.plans import oracle as o
from bitloom.plans.algebra import DAYS, LANG, day_pairs, day_sketches, lang_pairs
from bitloom.plans.registry import query
from bitloom.plans.sketches import doc_sketches
from bitloom.session import checkpointed
from bitloom.sources import files, stores
from bitloom.sources.tables import read_table

ID_OF = {
    name: f"coalesce(sha1(string_agg(bin || ':' || {w}, ',' ORDER BY bin) FILTER ({w} <> 0)), sha1(''))"
    for name, w in o.PAIR_OPS.items()
}


def measured(base: str) -> str:
    """CTE ``m``: ids, estimates and bit counts of both sides and every combination."""
    ids = ", ".join(f"{expr} AS id_{n}" for n, expr in ID_OF.items())
    return (
        f"{base}, {o.pair_cards()}, ids AS (SELECT set_a, set_b, {ids} FROM al GROUP BY 1, 2), "
        "m AS (SELECT * FROM pc JOIN ids USING (set_a, set_b))"
    )


# The operations' rules written out in SQL, apart from the code that they check:
# the result's view of the pair, its gradient and its operands.
BOTH = "id_a || ',' || id_b"
RULES = {
    "union": ("union", "0.0::DOUBLE", BOTH),
    "intersect": ("intersect", "0.0::DOUBLE", BOTH),
    "xor": ("xor", "0.0::DOUBLE", BOTH),
    "comp": ("comp", "CASE WHEN bits_a <> 0 THEN card_comp::DOUBLE / card_a END", BOTH),
    "deleted": ("comp", "CASE WHEN bits_a <> 0 THEN card_comp::DOUBLE / card_a END", BOTH),
    "retained": ("intersect", "CASE WHEN bits_union <> 0 THEN card_intersect::DOUBLE / card_union END", BOTH),
    "added": ("comp_rev", "CASE WHEN bits_b <> 0 THEN card_comp_rev::DOUBLE / card_b END", BOTH),
    "advance": (
        "b",
        "CASE WHEN bits_b <> 0 THEN card_a::DOUBLE / card_b END",
        "id_comp || ',' || id_intersect || ',' || id_comp_rev",
    ),
}
# What each operand, counted from 1, does with the gradient in back-propagation.
ADDED = "('union', 1), ('union', 2), ('intersect', 1), ('intersect', 2), ('xor', 1), ('xor', 2), ('comp', 1)"
MULTIPLIED = (
    "('added', 2), ('deleted', 1), ('retained', 1), ('retained', 2), ('advance', 1), ('advance', 2), ('advance', 3)"
)


def result(op: str) -> str:
    view, grad, args = RULES[op]
    return (
        f"SELECT set_a, set_b, id_{view} AS sha1, card_{view} AS card, bits_{view} AS n_bits, "
        f"{grad} AS grad, '{op}' AS op, {args} AS args FROM m"
    )


def results_sql(base: str, *ops: str) -> str:
    rows = " UNION ALL ".join(result(op) for op in ops)
    return f"WITH {measured(base)}, e AS ({rows}) SELECT * REPLACE (round(grad, 6) AS grad) FROM e"


def shown(entities):
    columns = {"grad": F.round("grad", 6).alias("grad"), "args": F.array_join("args", ",").alias("args")}
    return entities.select(*(columns.get(c, F.col(c)) for c in entities.columns))


def on_langs(spark, folder, *ops):
    return entity.combine(doc_sketches(spark, folder, "lang").once(), lang_pairs(spark, folder), *ops)


def on_days(spark, folder, *ops):
    return entity.combine(day_sketches(spark, folder).once(), day_pairs(spark, folder), *ops)


BUILD = f"""{o.doc_sketch('source')}, r AS (SELECT set_id, {o.CONTENT_ID} AS sha1, {o.card_agg('word', 10)} AS raw,
    sum(bit_count(word))::BIGINT AS n_bits FROM sk GROUP BY 1)"""


def build_sql(grad: str, extra: str = "") -> str:
    return f"""WITH {o.segments(10)}, {BUILD} SELECT set_id, sha1, {o.card_of()} AS card, n_bits, {grad} AS grad,
      NULL::VARCHAR AS op, '' AS args, 'b' AS prefix FROM r {extra}"""


@query("entity_build", lambda: build_sql("0.0::DOUBLE"))
def entity_build(spark, folder):
    return shown(entity.build(doc_sketches(spark, folder, "source")))


@query(
    "entity_copy",
    lambda: results_sql(LANG, "retained").replace("SELECT * REPLACE", "SELECT 'copy' AS made_by, * REPLACE"),
)
def entity_copy(spark, folder):
    return shown(entity.copy(on_langs(spark, folder, "retained"))).select(F.lit("copy").alias("made_by"), "*")


@query(
    "entity_negate",
    lambda: results_sql(LANG, "retained").replace("round(grad, 6)", "round(-grad, 6)"),
)
def entity_negate(spark, folder):
    return shown(entity.negate(on_langs(spark, folder, "retained")))


@query("entity_union", lambda: results_sql(LANG, "union"))
def entity_union(spark, folder):
    return shown(on_langs(spark, folder, "union"))


@query("entity_intersect", lambda: results_sql(LANG, "intersect"))
def entity_intersect(spark, folder):
    return shown(on_langs(spark, folder, "intersect"))


@query("entity_xor", lambda: results_sql(LANG, "xor"))
def entity_xor(spark, folder):
    return shown(on_langs(spark, folder, "xor"))


@query("entity_comp", lambda: results_sql(LANG, "comp"))
def entity_comp(spark, folder):
    sketches, pairs = doc_sketches(spark, folder, "lang").once(), lang_pairs(spark, folder)
    return shown(entity.combine(sketches, pairs, "comp", strict=True))


@query("entity_added", lambda: results_sql(DAYS, "added"))
def entity_added(spark, folder):
    return shown(on_days(spark, folder, "added"))


@query("entity_deleted", lambda: results_sql(DAYS, "deleted"))
def entity_deleted(spark, folder):
    return shown(on_days(spark, folder, "deleted"))


@query("entity_retained", lambda: results_sql(DAYS, "retained"))
def entity_retained(spark, folder):
    return shown(on_days(spark, folder, "retained"))


@query("entity_diff", lambda: results_sql(DAYS, "deleted", "retained", "added"))
def entity_diff(spark, folder):
    return shown(entity.diff(day_sketches(spark, folder), day_pairs(spark, folder)))


@query("entity_advance", lambda: results_sql(DAYS, "advance"))
def entity_advance(spark, folder):
    return shown(on_days(spark, folder, "advance"))


def backprop_sql() -> str:
    ops = ("deleted", "retained", "added", "advance", "union")
    rows = " UNION ALL ".join(result(op) for op in ops)
    return f"""WITH {measured(DAYS)}, res AS ({rows}), adds(op, pos) AS (VALUES {ADDED}), times(op, pos) AS (VALUES {MULTIPLIED}),
    rules AS (SELECT *, 'add' AS how FROM adds UNION ALL SELECT *, 'multiply' FROM times),
    base AS (SELECT DISTINCT id_a AS sha1, card_a AS card, NULL::VARCHAR AS op, 1.0::DOUBLE AS grad FROM m
      UNION SELECT id_b, card_b, NULL, 1.0 FROM m),
    derived AS (SELECT sha1, max(card) AS card, min(op) AS op, max(grad) AS grad FROM res
      WHERE op IN ('deleted', 'retained', 'added') GROUP BY 1),
    ents AS (SELECT * FROM base UNION ALL SELECT * FROM derived WHERE sha1 NOT IN (SELECT sha1 FROM base)),
    edge AS (SELECT op, grad, string_split(args, ',')[pos] AS arg, pos, how FROM res JOIN rules USING (op)
      WHERE pos <= len(string_split(args, ','))),
    upd AS (SELECT arg AS sha1, sum(CASE WHEN how = 'add' THEN grad ELSE 0 END) AS plus,
      product(CASE WHEN how = 'multiply' THEN grad ELSE 1 END) AS t_all,
      product(CASE WHEN how = 'multiply' AND op <> 'advance' THEN grad ELSE 1 END) AS t_term FROM edge GROUP BY 1)
    SELECT sha1, card, op, round((grad + coalesce(plus, 0)) * coalesce(CASE WHEN op IS NULL THEN t_term ELSE t_all END, 1), 6)
      AS grad FROM ents LEFT JOIN upd USING (sha1)"""


@query("grad_backprop", backprop_sql)
def grad_backprop(spark, folder):
    sketches, pairs = day_sketches(spark, folder), day_pairs(spark, folder)
    # Registers are small beside the events behind them, and used twice.
    sketches = sketches.once()
    results = checkpointed(entity.combine(sketches, pairs, "deleted", "retained", "added", "advance", "union"))
    base = entity.build(sketches).select("sha1", "card", "op", F.lit(1.0).alias("grad")).distinct()
    changes = results.where(F.col("op").isin("deleted", "retained", "added"))
    derived = changes.groupBy("sha1").agg(F.max("card").alias("card"), F.min("op").alias("op"), F.max("grad").alias("grad"))
    entities = base.unionByName(derived.join(base, "sha1", "left_anti"))
    return entity.backprop(entities, results).withColumn("grad", F.round("grad", 6))


@query(
    "entity_equal",
    lambda: f"""WITH {o.doc_sketch('source')}, a AS (SELECT set_id, {o.CONTENT_ID} AS sha1 FROM sk GROUP BY 1),
    tok2 AS (SELECT source, token FROM ({o.tokens('documents', 'source, lang')}) WHERE lang <> 'es'),
    sk2 AS ({o.sketch('tok2', 'source')}),
    b AS (SELECT set_id, {o.CONTENT_ID} AS sha1 FROM sk2 GROUP BY 1)
    SELECT set_id, a.sha1 = b.sha1 AS is_equal FROM a JOIN b USING (set_id)""",
)
def entity_equal(spark, folder):
    from bitloom.plans.sketches import doc_words

    words = doc_words(spark, folder, "source", "lang")
    every = entity.build(sketch.build(words, F.col("source"), F.col("token")))
    some = entity.build(sketch.build(words.where("lang <> 'es'"), F.col("source"), F.col("token")))
    return entity.equal(every, some, "set_id")


STORED = f"""{BUILD}, e AS (SELECT set_id, sha1, {o.card_of()} AS card, n_bits, 0.0::DOUBLE AS grad,
    NULL::VARCHAR AS op, '' AS args, 'b' AS prefix FROM r)"""


def stored_entities(spark, folder):
    path = files.new_folder(spark, "entities")
    stores.save_by(entity.build(doc_sketches(spark, folder, "source")), path, "prefix")
    return path


@query(
    "entity_store",
    lambda: f"WITH {o.segments(10)}, {STORED} SELECT sha1, card, grad, op, args, prefix FROM e",
)
def entity_store(spark, folder):
    saved = spark.read.parquet(stored_entities(spark, folder)).where("prefix = 'b'")
    return shown(saved.select("sha1", "card", "grad", "op", "args", "prefix"))


@query(
    "entity_retrieve",
    lambda: f"""WITH {o.segments(10)}, {STORED} SELECT sha1, card, grad, op, args, prefix FROM e
    WHERE card > (SELECT avg(card) FROM e)""",
)
def entity_retrieve(spark, folder):
    path = stored_entities(spark, folder)
    saved = spark.read.parquet(path)
    wanted = saved.where(F.col("card") > saved.agg(F.avg("card").alias("m")).scalar()).select("sha1")
    found = stores.retrieve(spark, path, "b", wanted)
    return shown(found.select("sha1", "card", "grad", "op", "args", "prefix"))


DAILY = (
    "ev AS (SELECT event_type AS key, ts::DATE AS day, user_id::VARCHAR AS token FROM events), "
    f"dk AS (SELECT key, day, {o.hash63('token')} AS h FROM ev), "
    f"sk AS (SELECT key, day, {o.token_bin('h', 10)} AS bin, bit_or({o.token_word('h', 10)}) AS word FROM dk GROUP BY ALL)"
)


def changes_sql(daily: str) -> str:
    """The day-over-day changes of the registers ``sk`` that ``daily`` makes."""
    return f"""WITH {daily}, sides AS (SELECT key, day, bin, word, TRUE AS is_new FROM sk
      UNION ALL SELECT key, day + 1, bin, word, FALSE FROM sk),
    al AS (SELECT key, day, bin, bit_or(CASE WHEN is_new THEN 0 ELSE word END) AS wa,
      bit_or(CASE WHEN is_new THEN word ELSE 0 END) AS wb FROM sides
      WHERE day > (SELECT min(day) FROM sk) AND day <= (SELECT max(day) FROM sk) GROUP BY ALL),
    {o.pair_cards(by='key, day')}
    SELECT key, strftime(day, '%Y-%m-%d') AS day, card_comp AS n_deleted, card_intersect AS n_retained,
      card_comp_rev AS n_added,
      round(CASE WHEN bits_a <> 0 THEN card_comp::DOUBLE / card_a END, 6) AS grad_deleted,
      round(CASE WHEN bits_union <> 0 THEN card_intersect::DOUBLE / card_union END, 6) AS grad_retained,
      round(CASE WHEN bits_b <> 0 THEN card_comp_rev::DOUBLE / card_b END, 6) AS grad_added,
      round(CASE WHEN bits_b <> 0 THEN card_a::DOUBLE / card_b END, 6) AS grad_advance FROM pc"""


@query("change_series", lambda: changes_sql(DAILY))
def change_series(spark, folder):
    events = read_table(spark, folder, "events").select(
        F.col("event_type").alias("key"), F.col("ts").cast("date").alias("day"), F.col("user_id").cast("string").alias("token")
    )
    keyed = sketch.build(events, F.struct("key", "day"), F.col("token"))
    daily = keyed.rows.select("set_id.key", "set_id.day", "bin", "word")
    return shown_changes(daily, events.select("day"))


def shown_changes(daily, days):
    first = days.agg(F.min("day").alias("d")).scalar()
    last = days.agg(F.max("day").alias("d")).scalar()
    series = entity.change_series(daily, 10, first, last)
    rounded = [F.round(c, 6).alias(c) if c.startswith("grad") else F.col(c) for c in series.columns]
    return series.select(*rounded).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


EVENT_COLUMNS = ["event_type", "user_id", "props"]
COLUMN_DAYS = " UNION ALL ".join(
    f"SELECT sha1('column:events:{c}') AS key, ts::DATE AS day, unnest(list_distinct({o.words(c + '::VARCHAR')})) AS token FROM events"
    for c in EVENT_COLUMNS
)


@query(
    "column_changes",
    lambda: changes_sql(
        f"ev AS ({COLUMN_DAYS}), dk AS (SELECT key, day, {o.hash63('token')} AS h FROM ev), "
        f"sk AS (SELECT key, day, {o.token_bin('h', 10)} AS bin, bit_or({o.token_word('h', 10)}) AS word FROM dk GROUP BY ALL)"
    ),
)
def column_changes(spark, folder):
    """Several columns ingested day by day, and each column's change from day to day."""
    events = read_table(spark, folder, "events")
    day = F.col("ts").cast("date")
    return shown_changes(ingest.column_days(events, day, "events", EVENT_COLUMNS), events.select(day.alias("day")))
