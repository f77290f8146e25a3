"""Nearest neighbours, n-grams and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators import search, vector_index
from bitloom.plans import oracle as o
from bitloom.plans.registry import query
from bitloom.plans.sketches import doc_sketches
from bitloom.plans.tokens import POST, doc_postings
from bitloom.sources.files import new_folder
from bitloom.sources.tables import read_table


def corpus(spark, folder):
    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def asked(spark, folder):
    """The vectors that are searched for: every row whose id is divisible by 100."""
    return corpus(spark, folder).where(F.col("id") % 100 == 0)


def knn_sql(score: str, k: int) -> str:
    return f"""WITH c AS (SELECT vec_id AS id, list_transform(embedding, lambda e: e::DOUBLE) AS w FROM embeddings),
    q AS (SELECT id AS query_id, w AS v FROM c WHERE id % 100 = 0),
    s AS (SELECT query_id, id, {score} AS score FROM q, c)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INT AS rank FROM s
    QUALIFY rank <= {k}"""


@query("knn_vectors_l2", knn_sql("list_distance(v, w)", 10))
def knn_vectors_l2(spark, folder):
    return search.nearest(corpus(spark, folder), asked(spark, folder), 10, "l2")


@query("knn_vectors_cosine", knn_sql("1 - list_cosine_similarity(v, w)", 100))
def knn_vectors_cosine(spark, folder):
    return search.nearest(corpus(spark, folder), asked(spark, folder), 100, "cosine")


@query("knn_vectors_ip", knn_sql("1 - list_inner_product(v, w)", 10))
def knn_vectors_ip(spark, folder):
    return search.nearest(corpus(spark, folder), asked(spark, folder), 10, "ip")


@query(
    "knn_result_page",
    f"""WITH k AS ({knn_sql("list_distance(v, w)", 20)})
    SELECT query_id, k.id, score, rank, label FROM k JOIN embeddings e ON e.vec_id = k.id WHERE rank > 10""",
)
def knn_result_page(spark, folder):
    """The second page of ten hits, with the label of each."""
    found = search.nearest(corpus(spark, folder), asked(spark, folder), 20, "l2")
    return search.result_page(found, read_table(spark, folder, "embeddings"), "vec_id", ["label"], offset=10)


KNN_SK = (
    f"{o.doc_sketch('source', name='sk')}, tq AS ({o.tokens('documents', 'lang')}), qk AS ({o.sketch('tq', 'lang')}), "
    "nb AS (SELECT set_id, sum(bit_count(word)) AS n FROM sk GROUP BY 1), "
    "nq AS (SELECT set_id, sum(bit_count(word)) AS n FROM qk GROUP BY 1), "
    "sh AS (SELECT qk.set_id AS query_id, sk.set_id AS id, sum(bit_count(qk.word & sk.word)) AS shared "
    "FROM qk JOIN sk USING (bin) GROUP BY 1, 2)"
)


def knn_sketch_sql(score: str) -> str:
    return f"""WITH {KNN_SK}, s AS (SELECT query_id, id, {score} AS score
      FROM sh JOIN nb ON nb.set_id = id JOIN nq ON nq.set_id = query_id)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INT AS rank FROM s
    QUALIFY rank <= 10"""


@query("knn_sketch", knn_sketch_sql("1 - shared / sqrt(nb.n::DOUBLE * nq.n)"))
def knn_sketch(spark, folder):
    return search.nearest_sketches(doc_sketches(spark, folder, "source"), doc_sketches(spark, folder, "lang"), 10)


@query("knn_sketch_l2", knn_sketch_sql("sqrt(nb.n::DOUBLE + nq.n - 2 * shared)"))
def knn_sketch_l2(spark, folder):
    return search.nearest_sketches(doc_sketches(spark, folder, "source"), doc_sketches(spark, folder, "lang"), 10, "l2")


@query("knn_approx")
def knn_approx(spark, folder):
    index = vector_index.build(corpus(spark, folder), new_folder(spark, "vector-index"))
    return vector_index.nearest(index, asked(spark, folder), 10)


@query(
    "ngram_windows",
    """WITH w AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
      list(role || ':' || sha1(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS l
      FROM conversations)
    SELECT conv_id, pos, array_to_string(l, '>') AS items FROM w WHERE len(l) = 3""",
)
def ngram_windows(spark, folder):
    turns = read_table(spark, folder, "conversations")
    item = F.concat_ws(":", "role", F.sha1("text"))
    windows = search.ngrams(turns.select("conv_id", "turn", item.alias("item")), "conv_id", "turn", "item", 3)
    return windows.select("conv_id", "pos", F.array_join("items", ">").alias("items"))


@query(
    "ngram_windows_11",
    """WITH w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
      list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS l FROM events)
    SELECT user_id, pos, array_to_string(l, '>') AS items FROM w WHERE len(l) = 11""",
)
def ngram_windows_11(spark, folder):
    windows = search.ngrams(read_table(spark, folder, "events"), "user_id", "event_id", "event_type", 11)
    return windows.select("user_id", "pos", F.array_join("items", ">").alias("items"))


@query(
    "weighted_term_sample",
    f"""WITH {POST}, t AS (SELECT token AS term, sum(n)::BIGINT AS w FROM post GROUP BY 1),
    c AS (SELECT term, w, (sum(w) OVER (ORDER BY {o.hash63('term')}, term) - w)::BIGINT AS start FROM t),
    d AS (SELECT i AS draw, {o.hash63("('5:' || i)")} AS h FROM range(1000) r(i)),
    p AS (SELECT draw, h % (SELECT sum(w)::BIGINT FROM t) AS point FROM d)
    SELECT draw, term FROM p JOIN c ON point >= start AND point < start + w""",
)
def weighted_term_sample(spark, folder):
    terms = doc_postings(spark, folder).groupBy("token").agg(F.sum("n").alias("tf"))
    return search.weighted_sample(terms, "token", "tf", 1000, seed=5)


@query(
    "random_sample_keys",
    f"""WITH k AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY {o.hash63('o_orderkey::VARCHAR')}, o_orderkey) - 1
      AS pos FROM orders), d AS (SELECT i AS draw, {o.hash63("('3:' || i)")} AS h FROM range(500) r(i))
    SELECT draw, key FROM d JOIN k ON pos = h % (SELECT count(*) FROM orders)""",
)
def random_sample_keys(spark, folder):
    return search.sample_keys(read_table(spark, folder, "orders"), "o_orderkey", 500, seed=3)
