"""Data frame verbs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.functions import text, vectors
from bitloom.operators import verbs
from bitloom.plans import oracle as o
from bitloom.plans.registry import query
from bitloom.sources.tables import read_table, spread


def labelled(spark, folder):
    """Documents with their labels, where they have any (both sides have unique keys)."""
    docs = read_table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read_table(spark, folder, "labels"), "doc_id", "left")


LABELLED = "l AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


@query(
    "quoted_extract",
    """WITH m AS (SELECT 'c' || c_custkey AS id, 'frozenset({''' || c_name || '''})' AS addr FROM customer UNION ALL
      SELECT 's' || s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name END FROM supplier UNION ALL
      SELECT 'p' || page_id, html FROM pages)
    SELECT id, coalesce(regexp_extract(addr, '''([^'']*)''', 1), '') AS quoted FROM m""",
)
def quoted_extract(spark, folder):
    named = F.concat(F.lit("frozenset({'"), F.col("c_name"), F.lit("'})"))
    customers = read_table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), named.alias("addr"))
    suppliers = read_table(spark, folder, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey"), F.when(F.col("s_acctbal") > 0, F.col("s_name"))
    )
    pages = read_table(spark, folder, "pages").select(F.concat(F.lit("p"), "page_id"), "html")
    return customers.union(suppliers).union(pages).select("id", text.quoted_extract(F.col("addr")).alias("quoted"))


@query("day_key", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def day_key(spark, folder):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    events = read_table(spark, folder, "events").select("event_id", stamp.alias("stamp"))
    return events.select("event_id", text.day_key(F.col("stamp")).alias("day"))


@query(
    "fill_unknown",
    f"""WITH {LABELLED} SELECT coalesce(doc_id::VARCHAR, 'unknown') AS doc_id, coalesce(lang, 'unknown') AS lang,
      coalesce(source, 'unknown') AS source, coalesce(n_chars::VARCHAR, 'unknown') AS n_chars,
      coalesce(quality::VARCHAR, 'unknown') AS quality, coalesce(toxic::VARCHAR, 'unknown') AS toxic FROM l""",
)
def fill_unknown(spark, folder):
    return verbs.fill_unknown(labelled(spark, folder))


@query("distinct_days", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events ORDER BY 1")
def distinct_days(spark, folder):
    return read_table(spark, folder, "events").select(text.day_key(F.col("ts")).alias("day")).distinct().orderBy("day")


@query(
    "filter_day",
    "SELECT event_id, user_id, event_type, value FROM events WHERE ts >= '2024-01-15' AND ts < '2024-01-16'",
)
def filter_day(spark, folder):
    day = verbs.rows_of_day(read_table(spark, folder, "events"), "ts", "2024-01-15")
    return day.select("event_id", "user_id", "event_type", "value")


@query("not_prefix_filter", "SELECT p_partkey, p_name FROM part WHERE NOT starts_with(p_name, 's')")
def not_prefix_filter(spark, folder):
    return verbs.not_prefixed(read_table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", "s")


@query(
    "case_when_mutate",
    """SELECT p_partkey, p_retailprice, p_retailprice * p_retailprice AS price_squared, round(p_retailprice) AS price_rounded,
      CASE WHEN p_retailprice >= p_size::DOUBLE * p_size THEN 'good' WHEN p_retailprice < 950 THEN 'poor'
      ELSE 'fair' END AS worth FROM part""",
)
def case_when_mutate(spark, folder):
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    worth = verbs.case_of([(price >= size * size, "good"), (price < 950, "poor")], "fair")
    return read_table(spark, folder, "part").select(
        "p_partkey",
        "p_retailprice",
        (price * price).alias("price_squared"),
        F.round(price).alias("price_rounded"),
        worth.alias("worth"),
    )


@query(
    "in_filter",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
def in_filter(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))


# The chained example: filter, group, summarise, mutate, filter, arrange.
CHAIN = """WITH g AS (SELECT p_size, avg(p_retailprice) AS price FROM part WHERE NOT starts_with(p_name, 's') GROUP BY 1)
    SELECT p_size, round(price, 6) AS price, round(price * price, 4) AS price_squared, round(price) AS price_rounded,
      CASE WHEN price >= p_size::DOUBLE * p_size THEN 'good' WHEN price < 1000 THEN 'poor'
      ELSE 'fair' END AS worth FROM g"""


@query("verb_chain", f"SELECT * FROM ({CHAIN}) WHERE worth IN ('fair', 'good') ORDER BY price_rounded DESC")
def verb_chain(spark, folder):
    price, size = F.col("price"), F.col("p_size").cast("double")
    worth = verbs.case_of([(price >= size * size, "good"), (price < 1000, "poor")], "fair")
    return (
        verbs.not_prefixed(read_table(spark, folder, "part"), "p_name", "s")
        .groupBy("p_size")
        .agg(F.avg("p_retailprice").alias("price"))
        .select(
            "p_size",
            F.round(price, 6).alias("price"),
            F.round(price * price, 4).alias("price_squared"),
            F.round(price).alias("price_rounded"),
            worth.alias("worth"),
        )
        .where(F.col("worth").isin("fair", "good"))
        .orderBy(F.desc("price_rounded"))
    )


@query(
    "filter_above_mean",
    """SELECT o_orderkey, o_totalprice / 1000000 AS millions FROM orders
    WHERE o_totalprice >= (SELECT avg(o_totalprice) FROM orders)""",
)
def filter_above_mean(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return verbs.above_mean(orders, "o_totalprice").select("o_orderkey", (F.col("o_totalprice") / 1_000_000).alias("millions"))


@query("drop_missing", f"WITH {LABELLED} SELECT * FROM l WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def drop_missing(spark, folder):
    return labelled(spark, folder).na.drop("any")


@query("select_slice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def select_slice(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return verbs.first_rows(orders, ["o_orderkey"], 5)


def profile_sql() -> str:
    kinds = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, '{kind}' AS type, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct, "
        f"min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest FROM customer"
        for c, kind in kinds.items()
    )


@query("column_profile", profile_sql())
def column_profile(spark, folder):
    return verbs.column_profile(read_table(spark, folder, "customer"))


SCALED = "list_transform(embedding, lambda x: floor(x::DOUBLE * 100)::BIGINT)"


@query(
    "array_filter_sum",
    f"""SELECT vec_id, coalesce(list_sum(list_filter({SCALED}, lambda x: x % 2 <> 0)), 0)::BIGINT AS odd_sum,
      len(list_filter({SCALED}, lambda x: x % 2 <> 0)) AS n_odd FROM embeddings""",
)
def array_filter_sum(spark, folder):
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100))
    rows = read_table(spark, folder, "embeddings").select("vec_id", scaled.alias("v"))
    n_odd = F.size(F.filter("v", lambda x: x % 2 != 0)).cast("bigint")
    return rows.select("vec_id", vectors.odd_sum(F.col("v")).alias("odd_sum"), n_odd.alias("n_odd"))


@query(
    "array_sqrt",
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: sqrt(abs(x::DOUBLE)))), 6) AS total,
      round(list_max(list_transform(embedding, lambda x: sqrt(abs(x::DOUBLE)))), 6) AS greatest FROM embeddings""",
)
def array_sqrt(spark, folder):
    roots = vectors.sqrt_each(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    rows = read_table(spark, folder, "embeddings").select("vec_id", roots.alias("r"))
    total = F.aggregate("r", F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.round(total, 6).alias("total"), F.round(F.array_max("r"), 6).alias("greatest"))


@query(
    "split_words",
    r"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS a,
      list_filter(string_split_regex(text, '\W+'), lambda w: w <> '') AS b FROM documents)
    SELECT doc_id, len(a) AS n_blank, sha1(array_to_string(a, ' ')) AS blank_id,
      len(b) AS n_nonword, sha1(array_to_string(b, ' ')) AS nonword_id FROM s""",
)
def split_words(spark, folder):
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text"))
    a, b = text.split_whitespace(F.col("text")), text.split_nonword(F.col("text"))
    return docs.select("doc_id", a.alias("a"), b.alias("b")).select(
        "doc_id",
        F.size("a").cast("bigint").alias("n_blank"),
        F.sha1(F.array_join("a", " ")).alias("blank_id"),
        F.size("b").cast("bigint").alias("n_nonword"),
        F.sha1(F.array_join("b", " ")).alias("nonword_id"),
    )


@query(
    "tokenize",
    f"""WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL
      SELECT 'c' || conv_id || ':' || turn, text FROM conversations UNION ALL SELECT 'p' || page_id, html FROM pages),
    w AS (SELECT id, {o.words('text')} AS w FROM t)
    SELECT id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, sha1(array_to_string(w, ' ')) AS words_id FROM w""",
)
def tokenize(spark, folder):
    docs = read_table(spark, folder, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = read_table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), "text"
    )
    pages = read_table(spark, folder, "pages").select(F.concat(F.lit("p"), "page_id"), "html")
    rows = spread(docs).union(spread(turns)).union(spread(pages))
    listed = rows.select("id", text.words(F.col("text")).alias("w"))
    return listed.select(
        "id",
        F.size("w").cast("bigint").alias("n_words"),
        F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"),
        F.sha1(F.array_join("w", " ")).alias("words_id"),
    )


@query(
    "token_len_filter",
    f"""WITH t AS ({o.tokens('documents', 'lang')}) SELECT lang, token, count(*) AS n FROM t
    WHERE strlen(token) > 2 GROUP BY 1, 2""",
)
def token_len_filter(spark, folder):
    docs = spread(read_table(spark, folder, "documents").select("lang", "text"))
    tokens = docs.select("lang", F.explode(text.distinct_words(F.col("text"))).alias("token"))
    return tokens.where(text.longer_than(F.col("token"))).groupBy("lang", "token").agg(F.count("*").alias("n"))


@query("group_mean", "SELECT p_type, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1")
def group_mean(spark, folder):
    return read_table(spark, folder, "part").groupBy("p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("price"))


@query(
    "group_sum_filtered",
    f"""WITH {LABELLED} SELECT lang, sum(n_chars)::BIGINT AS total FROM l
    WHERE quality IS NOT NULL AND toxic IS NOT NULL AND n_chars < 5000 GROUP BY 1""",
)
def group_sum_filtered(spark, folder):
    return labelled(spark, folder).na.drop("any").where("n_chars < 5000").groupBy("lang").agg(F.sum("n_chars").alias("total"))


@query(
    "across_agg",
    f"""WITH d AS (SELECT lang, n_chars, len({o.words('text')}) AS n_words, strlen(text) AS all_bytes FROM documents)
    SELECT lang, round(avg(n_chars), 6) AS n_chars_mean, sum(n_chars)::BIGINT AS n_chars_sum,
      round(avg(n_words), 6) AS n_words_mean, sum(n_words)::BIGINT AS n_words_sum,
      round(avg(all_bytes), 6) AS all_bytes_mean, sum(all_bytes)::BIGINT AS all_bytes_sum FROM d GROUP BY 1""",
)
def across_agg(spark, folder):
    docs = spread(read_table(spark, folder, "documents").select("lang", "n_chars", "text"))
    wide = docs.select(
        "lang", "n_chars", F.size(text.words(F.col("text"))).alias("n_words"), F.octet_length("text").alias("all_bytes")
    )
    out = verbs.across(wide, ["lang"], "a", "s")
    return out.select(*(F.round(c, 6).alias(c) if c.endswith("_mean") else F.col(c) for c in out.columns))


@query(
    "distinct_count_rows",
    "SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
)
def distinct_count_rows(spark, folder):
    # One row per (type, user) before the final count, so a frequent type combines early.
    seen = read_table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return seen.groupBy("event_type").agg(F.sum("n").alias("n_rows"), F.count("user_id").alias("n_users"))


@query("sort_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_desc(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey")


DE_EN = (
    f"t AS ({o.tokens('documents', 'lang')}), de AS (SELECT DISTINCT token FROM t WHERE lang = 'de'), "
    "en AS (SELECT DISTINCT token FROM t WHERE lang = 'en')"
)


def vocabulary(spark, folder, lang):
    docs = read_table(spark, folder, "documents").where(F.col("lang") == lang).select("text")
    return spread(docs).select(F.explode(text.distinct_words(F.col("text"))).alias("token"))


@query("set_union", f"WITH {DE_EN} SELECT token FROM de UNION SELECT token FROM en")
def set_union(spark, folder):
    return vocabulary(spark, folder, "de").union(vocabulary(spark, folder, "en")).distinct()


@query("set_intersect", f"WITH {DE_EN} SELECT token FROM de INTERSECT SELECT token FROM en")
def set_intersect(spark, folder):
    return vocabulary(spark, folder, "de").intersect(vocabulary(spark, folder, "en"))


@query("set_except", f"WITH {DE_EN} SELECT token FROM de EXCEPT SELECT token FROM en")
def set_except(spark, folder):
    return vocabulary(spark, folder, "de").subtract(vocabulary(spark, folder, "en"))


@query(
    "pivot_longer",
    """UNPIVOT (SELECT p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size,
      p_retailprice::VARCHAR AS p_retailprice FROM part)
    ON p_name, p_brand, p_type, p_size, p_retailprice INTO NAME variable VALUE value""",
)
def pivot_longer(spark, folder):
    return verbs.pivot_longer(read_table(spark, folder, "part"), ids=["p_partkey"])


@query(
    "pivot_longer_missing",
    """SELECT doc_id, 'quality' AS variable, quality::VARCHAR AS value FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR FROM documents LEFT JOIN labels USING (doc_id)""",
)
def pivot_longer_missing(spark, folder):
    labels = read_table(spark, folder, "labels")
    rows = read_table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left")
    return verbs.pivot_longer(rows.select("doc_id", "quality", "toxic"), ids=["doc_id"])
