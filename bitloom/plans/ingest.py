"""Columns ingested end to end, and entities stored with their datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators import entity, ingest, sketch
from bitloom.operators import similarity as sim
from bitloom.plans import oracle as o
from bitloom.plans.algebra import LANG, lang_pairs
from bitloom.plans.entities import measured, shown
from bitloom.plans.registry import query
from bitloom.plans.sketches import doc_sketches
from bitloom.sources import files, stores
from bitloom.sources.tables import read_table

COLUMNS = {"customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_type"], "documents": ["text"]}
VALUES = " UNION ALL ".join(
    f"SELECT sha1('column:{table}:{c}') AS column_id, {c} AS val FROM {table}" for table, cs in COLUMNS.items() for c in cs
)


@query(
    "column_ingest",
    lambda: f"""WITH {o.segments(10)}, v AS ({VALUES}),
    tok AS (SELECT column_id, unnest(list_distinct({o.words('val')})) AS token FROM v),
    sk AS ({o.sketch('tok', 'column_id')}),
    r AS (SELECT set_id, {o.CONTENT_ID} AS sha1, {o.card_agg('word', 10)} AS raw, sum(bit_count(word))::BIGINT AS n_bits,
      count(*) AS n_registers FROM sk GROUP BY 1),
    t AS (SELECT column_id, count(DISTINCT token) AS n_tokens, count(*) AS n_held FROM tok GROUP BY 1)
    SELECT column_id, sha1, {o.card_of()} AS card, n_bits, n_registers, n_tokens, n_held FROM r JOIN t ON set_id = column_id""",
)
def column_ingest(spark, folder):
    parts = [ingest.column_postings(read_table(spark, folder, t), t, columns) for t, columns in COLUMNS.items()]
    index, entities = files.new_folder(spark, "column-index"), files.new_folder(spark, "column-entities")
    reduce(DataFrame.unionByName, parts).write.parquet(index)
    postings = spark.read.parquet(index)
    stores.save_by(ingest.column_entities(postings), entities, "prefix")
    held = postings.groupBy(F.col("ref").alias("set_id")).agg(F.count("*").alias("n_tokens"), F.sum("n").alias("n_held"))
    saved = spark.read.parquet(entities).where("prefix = 'b'").join(held, "set_id")
    return saved.select(
        F.col("set_id").alias("column_id"),
        "sha1",
        "card",
        "n_bits",
        F.size("registers").cast("bigint").alias("n_registers"),
        "n_tokens",
        "n_held",
    )


@query(
    "entity_dataset",
    lambda: f"""WITH {measured(LANG)}, n AS (SELECT set_a, set_b, count(*) AS n_registers FROM al WHERE (wa | wb) <> 0 GROUP BY 1, 2)
    SELECT id_union AS sha1, card_union AS card, 'union' AS op, id_a || ',' || id_b AS args, n_registers, true AS intact
    FROM m JOIN n USING (set_a, set_b)""",
)
def entity_dataset(spark, folder):
    """Derived entities go out with dataset, operation and operands, and come back whole."""
    sketches, pairs = doc_sketches(spark, folder, "lang").once(), lang_pairs(spark, folder)
    word = sim.word_views(["union"])["union"]
    held = F.collect_list(F.when(word != 0, F.struct("bin", word.alias("word"))))
    datasets = sim.align(sketches, pairs).groupBy(*sim.PAIR).agg(F.array_sort(held).alias("registers"))
    unions = entity.with_dataset(entity.combine(sketches, pairs, "union"), datasets, sim.PAIR)
    path = files.new_folder(spark, "derived-entities")
    stores.save_by(unions.withColumn("prefix", F.lit("d")), path, "prefix")
    back = stores.retrieve(spark, path, "d", spark.read.parquet(path).select("sha1"))
    dumps = back.select(F.concat_ws(":", "set_a", "set_b").alias("set_id"), "registers")
    again = sketch.meta(sketch.restore(dumps, sketches.p)).select("set_id", F.col("sha1").alias("found"))
    joined = back.withColumn("set_id", F.concat_ws(":", "set_a", "set_b")).join(again, "set_id")
    n = F.size("registers").cast("bigint").alias("n_registers")
    return shown(joined).select("sha1", "card", "op", "args", n, (F.col("found") == F.col("sha1")).alias("intact"))
