"""Sketch building, estimating, dumping (documents as collections of words)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import hashing, text, vectors
from bitloom.operators import candidates, sketch
from bitloom.plans import oracle as o
from bitloom.plans.registry import query
from bitloom.session import checkpointed
from bitloom.sources.tables import read_table, spread


def doc_words(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """Distinct words of each document beside some of its columns."""
    docs = spread(read_table(spark, folder, "documents").select(*keys, "text"))
    return docs.select(*keys, F.explode(text.distinct_words(F.col("text"))).alias("token"))


def doc_sketches(spark: SparkSession, folder: str, key: str, p: int = 10) -> sketch.Sketches:
    """One sketch of the words per value of a documents column."""
    return sketch.build(doc_words(spark, folder, key), F.col(key), F.col("token"), p)


def doc_bits(spark: SparkSession, folder: str, key: str, p: int = 10) -> DataFrame:
    """The bit set of the words per value of a documents column that tells most rows apart."""
    docs = spread(read_table(spark, folder, "documents").select(key, "text"))
    return candidates.bit_sets_of_rows(docs, F.col(key), text.distinct_words(F.col("text")), p)


HASHED = f"tok AS ({o.tokens('documents', 'doc_id')}), h AS (SELECT doc_id, token, {o.hash63('token')} AS h FROM tok)"


@query(
    "token_hash",
    f"""WITH t AS (SELECT DISTINCT token FROM ({o.tokens('documents', 'doc_id')})),
    h AS (SELECT token, {o.hash63('token')} AS h FROM t)
    SELECT token, h AS hash, {o.hash63("h || ':7'")} AS hash_seed7, ({o.token_bin('h', 10)} + 1)::INT AS bin,
      (length(bin({o.token_word('h', 10)})) - 1)::INT AS zeros FROM h""",
)
def token_hash(spark, folder):
    h = F.col("hash")
    distinct = doc_words(spark, folder).select("token").distinct()
    hashed = distinct.select(
        "token",
        hashing.token_hash(F.col("token")).alias("hash"),
        hashing.token_hash(F.col("token"), seed=7).alias("hash_seed7"),
    )
    return hashed.select(
        "*",
        (hashing.bin_of(h, 10) + 1).alias("bin"),
        (hashing.top_bit(hashing.word_of(h, 10)) - 1).alias("zeros"),
    )


@query("token_bin", f"WITH {HASHED} SELECT ({o.token_bin('h', 10)} + 1)::INT AS bin, count(*) AS n FROM h GROUP BY 1")
def token_bin(spark, folder):
    words = doc_words(spark, folder)
    bins = words.select((hashing.bin_of(hashing.token_hash(F.col("token")), 10) + 1).alias("bin"))
    return bins.groupBy("bin").agg(F.count("*").alias("n"))


@query(
    "token_rank",
    f"WITH {HASHED} SELECT length(bin({o.token_word('h', 10)}))::INT AS rank, count(*) AS n FROM h GROUP BY 1",
)
def token_rank(spark, folder):
    words = doc_words(spark, folder)
    word = hashing.word_of(hashing.token_hash(F.col("token")), 10)
    return words.select(hashing.top_bit(word).alias("rank")).groupBy("rank").agg(F.count("*").alias("n"))


@query("sketch_build", f"WITH {o.doc_sketch('lang')} SELECT set_id, bin, word FROM sk")
def sketch_build(spark, folder):
    return doc_sketches(spark, folder, "lang").rows


@query(
    "column_sketch",
    f"""WITH c AS (
      SELECT 'customer' AS parent, col, val FROM (UNPIVOT (SELECT c_name, c_mktsegment FROM customer)
        ON c_name, c_mktsegment INTO NAME col VALUE val)
      UNION ALL
      SELECT 'part', col, val FROM (UNPIVOT (SELECT p_name, p_brand, p_type, p_size::VARCHAR AS p_size FROM part)
        ON p_name, p_brand, p_type, p_size INTO NAME col VALUE val)),
    tok AS (SELECT sha1('column:' || parent || ':' || col) AS column_id,
      unnest({o.words('val')}) AS token FROM c),
    sk AS ({o.sketch('tok', 'column_id')}) SELECT set_id, bin, word FROM sk""",
)
def column_sketch(spark, folder):
    from bitloom.operators import tokens

    parts = [
        tokens.column_tokens(read_table(spark, folder, "customer"), "customer", ["c_name", "c_mktsegment"]),
        tokens.column_tokens(
            read_table(spark, folder, "part"), "part", ["p_name", "p_brand", "p_type", "p_size"]
        ),
    ]
    both = parts[0].unionByName(parts[1])
    return sketch.build(both, F.col("column_id"), F.col("token")).rows


@query(
    "union_all_sketches",
    f"""WITH {o.doc_sketch('source')} SELECT 'all' AS set_id, bin, bit_or(word) AS word FROM sk GROUP BY bin""",
)
def union_all_sketches(spark, folder):
    return sketch.union_all(doc_sketches(spark, folder, "source"), F.lit("all")).rows


@query(
    "intersect_all_sketches",
    f"""WITH {o.doc_sketch('source')} SELECT 'all' AS set_id, bin, bit_and(word) AS word FROM sk GROUP BY bin
    HAVING count(*) = (SELECT count(DISTINCT set_id) FROM sk) AND bit_and(word) <> 0""",
)
def intersect_all_sketches(spark, folder):
    sketches = doc_sketches(spark, folder, "source")
    registry = read_table(spark, folder, "documents").select(F.lit("all").alias("group"), F.col("source").alias("set_id"))
    return sketch.intersect_all(sketches, registry.distinct()).rows


@query("sketch_copy", f"WITH {o.doc_sketch('lang')} SELECT 'copy:' || set_id AS set_id, bin, word FROM sk")
def sketch_copy(spark, folder):
    return sketch.copy(doc_sketches(spark, folder, "lang"), F.concat(F.lit("copy:"), F.col("set_id"))).rows


@query(
    "sketch_max_rank",
    f"WITH {o.doc_sketch('source')} SELECT set_id, bin, {o.rank('word')}::INT AS max_rank FROM sk",
)
def sketch_max_rank(spark, folder):
    return sketch.max_ranks(doc_sketches(spark, folder, "source"))


@query(
    "sketch_raw_estimate",
    f"WITH {o.doc_sketch('source')} SELECT set_id, round({o.card_agg('word', 10)}, 6) AS raw FROM sk GROUP BY 1",
)
def sketch_raw_estimate(spark, folder):
    return sketch.raw_estimates(doc_sketches(spark, folder, "source")).withColumn("raw", F.round("raw", 6))


def card_sql(key: str, p: int) -> str:
    return f"""WITH {o.segments(p)}, {o.doc_sketch(key, p)},
    r AS (SELECT set_id, {o.card_agg('word', p)} AS raw FROM sk GROUP BY 1)
    SELECT set_id, {o.card_of()} AS card FROM r"""


@query("sketch_card", lambda: card_sql("source", 10))
def sketch_card(spark, folder):
    return sketch.cards(doc_sketches(spark, folder, "source"))


@query("sketch_card_p14", lambda: card_sql("lang", 14))
def sketch_card_p14(spark, folder):
    return sketch.cards(doc_sketches(spark, folder, "lang", 14))


@query(
    "sketch_id",
    f"WITH {o.doc_sketch('source')} SELECT set_id, {o.CONTENT_ID} AS sha1, sum(bit_count(word))::BIGINT AS n_bits FROM sk GROUP BY 1",
)
def sketch_id(spark, folder):
    return sketch.meta(doc_sketches(spark, folder, "source")).select("set_id", "sha1", "n_bits")


@query(
    "sketch_is_empty",
    f"""WITH tok AS (SELECT source, unnest(list_distinct(
        regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}]+)', 1))) AS token FROM documents WHERE lang = 'de'),
    sk AS ({o.sketch('tok', 'source')})
    SELECT set_id, set_id NOT IN (SELECT set_id FROM sk) AS is_empty
    FROM (SELECT DISTINCT source || CASE WHEN k = 1 THEN '' ELSE ':none' END AS set_id
      FROM documents, (VALUES (1), (2)) v(k))""",
)
def sketch_is_empty(spark, folder):
    docs = read_table(spark, folder, "documents")
    german = docs.where("lang = 'de'").select("source", F.explode(text.distinct_words(F.col("text"))).alias("token"))
    both = F.explode(F.array("source", F.concat("source", F.lit(":none"))))
    registry = docs.select(both.alias("set_id"))
    return sketch.empty_sets(sketch.build(german, F.col("source"), F.col("token")), registry)


@query(
    "sketch_dump_dense",
    f"""WITH {o.doc_sketch('lang')}, ids AS (SELECT DISTINCT set_id FROM sk),
    grid AS (SELECT set_id, b::INT AS bin FROM ids, range(1024) r(b))
    SELECT set_id, string_agg(coalesce(word, 0)::VARCHAR, ',' ORDER BY bin) AS words, count(*) AS n_words
    FROM grid LEFT JOIN sk USING (set_id, bin) GROUP BY 1""",
)
def sketch_dump_dense(spark, folder):
    dense = sketch.dump_dense(doc_sketches(spark, folder, "lang"))
    joined = F.array_join(F.col("words").cast("array<string>"), ",")
    return dense.select("set_id", joined.alias("words"), F.size("words").cast("bigint").alias("n_words"))


@query(
    "sketch_dump_sparse",
    f"""WITH {o.doc_sketch('lang')}
    SELECT set_id, string_agg(bin || ':' || word, ',' ORDER BY bin) AS registers FROM sk GROUP BY 1""",
)
def sketch_dump_sparse(spark, folder):
    sparse = sketch.dump_sparse(doc_sketches(spark, folder, "lang"))
    text_form = F.transform("registers", lambda r: F.concat_ws(":", r["bin"].cast("string"), r["word"].cast("string")))
    return sparse.select("set_id", F.array_join(text_form, ",").alias("registers"))


@query(
    "sketch_restore",
    f"""WITH {o.doc_sketch('source')},
    de AS (SELECT source AS set_id, token FROM ({o.tokens('documents', 'source, lang')}) WHERE lang = 'de'),
    sk2 AS ({o.sketch('de', 'set_id')})
    SELECT set_id, bin, bit_or(word) AS word FROM (SELECT * FROM sk UNION ALL SELECT * FROM sk2) GROUP BY ALL""",
)
def sketch_restore(spark, folder):
    words = doc_words(spark, folder, "source", "lang")
    german = sketch.build(words.where("lang = 'de'"), F.col("source"), F.col("token"))
    dumps = sketch.dump_dense(sketch.build(words, F.col("source"), F.col("token")))
    return sketch.restore(dumps, 10, into=german).rows


@query(
    "vector_bit_ops",
    f"""WITH {o.doc_sketch('lang')}, g AS (SELECT bin,
      list(word ORDER BY set_id) AS w, list((bin + word % 1000)::BIGINT ORDER BY set_id) AS v FROM sk GROUP BY bin)
    SELECT bin,
      array_to_string(list_transform(list_zip(w, v), lambda x: (x[1] & x[2])::VARCHAR), ',') AS v_and,
      array_to_string(list_transform(list_zip(w, v), lambda x: (x[1] | x[2])::VARCHAR), ',') AS v_or,
      array_to_string(list_transform(list_zip(w, v), lambda x: xor(x[1], x[2])::VARCHAR), ',') AS v_xor FROM g""",
)
def vector_bit_ops(spark, folder):
    listed = F.array_sort(F.collect_list(F.struct("set_id", "word")))
    grouped = doc_sketches(spark, folder, "lang").rows.groupBy("bin").agg(listed.alias("l"))
    a = F.col("l.word")
    b = F.transform(a, lambda x: F.col("bin") + x % 1000)
    return grouped.select(
        "bin",
        *(
            F.array_join(vectors.bit_op(a, b, op).cast("array<string>"), ",").alias(f"v_{op.lower()}")
            for op in ("AND", "OR", "XOR")
        ),
    )


@query(
    "word_bit_indices",
    f"""WITH {o.doc_sketch('lang')} SELECT set_id, bin, array_to_string(list_filter(
      list_transform(range(1, length(bin(word)) + 1), lambda i: CASE WHEN substr(bin(word), i::INT, 1) = '1'
      THEN i::VARCHAR END), lambda x: x IS NOT NULL), ',') AS ones FROM sk""",
)
def word_bit_indices(spark, folder):
    rows = doc_sketches(spark, folder, "lang").rows
    ones = hashing.bit_indices(F.col("word")).cast("array<string>")
    return rows.select("set_id", "bin", F.array_join(ones, ",").alias("ones"))


@query(
    "sketch_thin",
    f"""WITH {o.doc_sketch('lang')},
    bits AS (SELECT set_id, bin, i AS bit FROM sk, range(63) r(i) WHERE ((word >> i::INT) & 1) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY set_id
      ORDER BY md5('11:' || bin || ':' || bit), bin, bit) AS pos FROM bits)
    SELECT set_id, bin, bit_or(1::BIGINT << bit::INT) AS word FROM ranked WHERE pos > 500 GROUP BY ALL""",
)
def sketch_thin(spark, folder):
    return sketch.thin(doc_sketches(spark, folder, "lang"), 500, seed=11).rows


@query(
    "estimate_vs_exact",
    lambda: f"""WITH {o.segments(10)}, {o.doc_sketch('source')},
    e AS (SELECT source AS set_id, count(DISTINCT token) AS exact FROM tok GROUP BY 1),
    r AS (SELECT set_id, {o.card_agg('word', 10)} AS raw FROM sk GROUP BY 1)
    SELECT set_id, exact, {o.card_of()} AS card,
      round(({o.card_of()} - exact)::DOUBLE / exact, 6) AS rel_error FROM r JOIN e USING (set_id)""",
)
def estimate_vs_exact(spark, folder):
    # The distinct words are found once and feed both the count and the sketch.
    words = checkpointed(doc_words(spark, folder, "source").distinct())
    exact = words.groupBy(F.col("source").alias("set_id")).agg(F.count("token").alias("exact"))
    cards = sketch.cards(sketch.build(words, F.col("source"), F.col("token")))
    error = (F.col("card") - F.col("exact")).cast("double") / F.col("exact")
    return exact.join(cards, "set_id").select("set_id", "exact", "card", F.round(error, 6).alias("rel_error"))
