"""The token index over the documents, and searches on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.functions import hashing, text
from bitloom.operators import sketch, tokens, verbs
from bitloom.plans import oracle as o
from bitloom.plans.registry import query
from bitloom.sources import files, stores
from bitloom.sources.tables import read_table, spread


def doc_texts(spark, folder, ref="source"):
    """The documents' texts with their ref; each document is one batch."""
    return spread(read_table(spark, folder, "documents").select(F.col(ref).alias("ref"), F.col("doc_id").alias("batch"), "text"))


def doc_postings(spark, folder, ref="source", n_bytes=2):
    """Postings of the documents' words of more than two bytes."""
    rows = doc_texts(spark, folder, ref).select("ref", "batch", F.explode(text.distinct_words(F.col("text"))).alias("token"))
    rows = rows.where(text.longer_than(F.col("token"), n_bytes))
    return tokens.postings(rows, distinct=True)


_STORED: dict[tuple, str] = {}


def doc_index(spark, folder):
    """The documents' index, written once for each version of the table's files; searches scan what is stored."""
    path = f"{folder}/documents.parquet"
    version = (spark.sparkContext.applicationId, path, stores.version_of(spark, path))
    if version not in _STORED:
        index = files.new_folder(spark, "index")
        stores.store_sorted(tokens.index_texts(doc_texts(spark, folder)), index, "id", placed=True)
        _STORED[version] = index
    return spark.read.parquet(_STORED[version])


POST = (
    f"tok AS (SELECT * FROM ({o.tokens('documents', 'source AS ref, doc_id AS batch')}) WHERE strlen(token) > 2), "
    f"post AS (SELECT {o.hash63('token')} AS id, token, ref, count(*) AS n FROM tok GROUP BY ALL)"
)
COORD = f"({o.token_bin('id', 10)} + 1)::INT AS bin, (length(bin({o.token_word('id', 10)})) - 1)::INT AS zeros"
LISTS = "string_agg(DISTINCT token, ',' ORDER BY token) AS tokens, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs"
IX = f"{POST}, ix AS (SELECT id, {COORD}, {LISTS}, sum(n)::BIGINT AS tf FROM post GROUP BY id)"


def shown(index):
    """Lists as comma-joined text."""
    return index.select(*(F.array_join(c, ",").alias(c) if t.startswith("array") else c for c, t in index.dtypes))


@query("token_index_batch", f"WITH {IX} SELECT * FROM ix")
def token_index_batch(spark, folder):
    return shown(tokens.index_texts(doc_texts(spark, folder)))


@query(
    "token_index_refs",
    f"""WITH {POST.replace('WHERE strlen(token) > 2', '')} SELECT id, {COORD}, {LISTS},
      count(DISTINCT ref) - 1 AS tf, count(DISTINCT ref) AS df FROM post GROUP BY id""",
)
def token_index_refs(spark, folder):
    return shown(tokens.index_refs(doc_postings(spark, folder, n_bytes=0)))


@query(
    "token_index_counts",
    f"WITH {POST} SELECT id, sum(n)::BIGINT AS tf, count(DISTINCT ref) AS df FROM post GROUP BY id",
)
def token_index_counts(spark, folder):
    return tokens.index_counts(doc_postings(spark, folder))


@query("token_postings", f"WITH {POST} SELECT id, token, ref, n FROM post")
def token_postings(spark, folder):
    return doc_postings(spark, folder)


@query(
    "index_scan_page",
    f"WITH {IX} SELECT id, tokens, tf FROM ix ORDER BY tf DESC, id LIMIT 25 OFFSET 50",
)
def index_scan_page(spark, folder):
    index = tokens.index_texts(doc_texts(spark, folder)).select("id", "tokens", "tf")
    return shown(verbs.first_rows(index, [F.desc("tf"), "id"], 25, skip=50))


@query(
    "token_lookup",
    f"""WITH {IX}, q AS (SELECT DISTINCT {o.hash63('token')} AS id FROM ({o.tokens('benchmark', 'item_id')}))
    SELECT * FROM ix WHERE id IN (SELECT id FROM q)""",
)
def token_lookup(spark, folder):
    asked = read_table(spark, folder, "benchmark").select(F.explode(text.distinct_words(F.col("text"))).alias("token"))
    return shown(tokens.token_lookup(doc_index(spark, folder), tokens.with_id(asked)))


LOOKED_UP = ("and", "les", "sich", "para", "heron", "no such word")


@query(
    "token_find",
    f"""WITH {IX} SELECT * FROM ix WHERE id IN (SELECT {o.hash63('w')} FROM (VALUES {', '.join(f"('{w}')" for w in LOOKED_UP)}) t(w))""",
)
def token_find(spark, folder):
    """A few named tokens: the stored index is read where they can be, and nowhere else."""
    ids = [hashing.hash_of(word) for word in LOOKED_UP]
    return shown(stores.look_up(doc_index(spark, folder), "id", ids))


@query(
    "refs_match_join",
    f"""WITH {POST}, wanted AS (SELECT source AS ref FROM documents GROUP BY 1 HAVING avg(n_chars) >
      (SELECT avg(n_chars) FROM documents))
    SELECT id, count(DISTINCT ref) AS n_refs FROM post WHERE ref IN (SELECT ref FROM wanted) GROUP BY 1""",
)
def refs_match_join(spark, folder):
    docs = read_table(spark, folder, "documents").select(F.col("source").alias("ref"), "n_chars")
    long_ones = docs.groupBy("ref").agg(F.avg("n_chars").alias("mean"))
    wanted = long_ones.where(F.col("mean") > docs.agg(F.avg("n_chars").alias("m")).scalar())
    return tokens.refs_match(doc_postings(spark, folder), wanted)


@query(
    "token_query",
    f"""WITH {IX} SELECT id, tf FROM ix WHERE list_has_any(string_split(refs, ','), ['src1', 'src2'])
      AND list_contains(string_split(refs, ','), 'src7') AND tf > 4 AND zeros < 3 AND bin <> 17""",
)
def token_query(spark, folder):
    index = doc_index(spark, folder)
    return tokens.token_query(
        index,
        [("refs", "match", "src1 src2"), ("refs", "has", "src7"), ("tf", ">", 4), ("zeros", "<", 3), ("bin", "!=", "17")],
    )


@query(
    "text_to_tokens",
    f"""WITH {IX}, q AS (SELECT DISTINCT item_id, {o.hash63('token')} AS id FROM ({o.tokens('benchmark', 'item_id')}))
    SELECT item_id, ix.* FROM q JOIN ix USING (id)""",
)
def text_to_tokens(spark, folder):
    index = doc_index(spark, folder)
    return shown(tokens.text_to_tokens(read_table(spark, folder, "benchmark"), "item_id", index))


@query(
    "text_to_refs",
    f"""WITH {POST}, q AS (SELECT DISTINCT item_id, {o.hash63('token')} AS id FROM ({o.tokens('benchmark', 'item_id')})),
    s AS (SELECT item_id, ref, count(*) AS matched FROM q JOIN (SELECT DISTINCT id, ref FROM post) USING (id) GROUP BY 1, 2)
    SELECT item_id, ref, matched, row_number() OVER (PARTITION BY item_id ORDER BY matched DESC, ref)::INT AS rank
    FROM s QUALIFY rank <= 5""",
)
def text_to_refs(spark, folder):
    index = doc_index(spark, folder)
    return tokens.text_to_refs(read_table(spark, folder, "benchmark"), "item_id", index, 5)


@query(
    "query_sketch",
    f"WITH tok AS ({o.tokens('benchmark', 'item_id')}), sk AS ({o.sketch('tok', 'item_id', 8)}) SELECT * FROM sk",
)
def query_sketch(spark, folder):
    words = read_table(spark, folder, "benchmark").select("item_id", F.explode(text.distinct_words(F.col("text"))).alias("token"))
    return sketch.build(words, F.col("item_id"), F.col("token"), p=8).rows


@query(
    "label_filter",
    f"""WITH {IX}, l AS (SELECT source, list_sort(list(DISTINCT lang)) AS labels FROM documents GROUP BY 1)
    SELECT 'label' AS kind, source AS item FROM l WHERE list_contains(labels, 'es') AND list_contains(labels, 'de')
    UNION ALL SELECT 'text', tokens FROM ix WHERE list_contains(string_split(tokens, ','), 'the')""",
)
def label_filter(spark, folder):
    from bitloom.operators import search

    docs = read_table(spark, folder, "documents")
    labels = docs.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("labels"))
    index = shown(doc_index(spark, folder))
    tagged = search.label_filter(labels, "labels", ["es", "de"]).select(F.lit("label").alias("kind"), F.col("source").alias("item"))
    worded = search.word_filter(index, "tokens", "the").select(F.lit("text").alias("kind"), F.col("tokens").alias("item"))
    return tagged.unionByName(worded)
