"""Operations on pairs of sketches (languages and sources of the documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.functions import text
from bitloom.operators import similarity as sim
from bitloom.operators import candidates, sketch
from bitloom.plans import oracle as o
from bitloom.plans.registry import query
from bitloom.plans.sketches import doc_bits, doc_sketches, doc_words
from bitloom.sources.tables import read_table


def registry(spark, folder, key):
    """The set ids of the documents' sketches, read from the one column that holds them."""
    return read_table(spark, folder, "documents").select(F.col(key).alias("set_id")).distinct()


def day_sketches(spark, folder, p=10):
    """One sketch per day of the users' actions."""
    events = read_table(spark, folder, "events")
    token = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return sketch.build(events, text.day_key(F.col("ts")), token, p)


def day_pairs(spark, folder):
    """Each day (set_b) with the day before it (set_a), where both have events."""
    days = read_table(spark, folder, "events").select(text.day_key(F.col("ts")).alias("set_b")).distinct()
    before = F.date_format(F.date_sub(F.col("set_b").cast("date"), 1), "yyyy-MM-dd")
    pairs = days.withColumn("set_a", before)
    return pairs.join(days.select(F.col("set_b").alias("set_a")), "set_a", "left_semi").select("set_a", "set_b")


def lang_pairs(spark, folder):
    return sim.all_pairs(registry(spark, folder, "lang"))


LANG = f"{o.doc_sketch('lang')}, {o.ALL_PAIRS}, al AS ({o.aligned()})"
SOURCE = f"{o.doc_sketch('source')}, {o.ALL_PAIRS}, al AS ({o.aligned()})"


@query(
    "vocabulary_similarity",
    lambda: f"""WITH {LANG}, {o.pair_cards()}
    SELECT set_a AS lang_a, set_b AS lang_b, card_a, card_b,
      round_even(card_intersect::DOUBLE / card_union * 100, 0)::BIGINT AS jaccard,
      round(bits_intersect / sqrt(bits_a::DOUBLE * bits_b), 6) AS cosine FROM pc""",
)
def vocabulary_similarity(spark, folder):
    views = ("a", "b", "union", "intersect")
    cards = sim.pair_cards(doc_sketches(spark, folder, "lang"), lang_pairs(spark, folder), views)
    return cards.select(
        F.col("set_a").alias("lang_a"),
        F.col("set_b").alias("lang_b"),
        "card_a",
        "card_b",
        sim.jaccard_pct().alias("jaccard"),
        F.round(sim.cosine(), 6).alias("cosine"),
    )


DAY_SK = (
    "ev AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id || ':' || event_type AS token FROM events), "
    f"sk AS ({o.sketch('ev', 'day')})"
)
DAY_PAIRS = (
    "days AS (SELECT DISTINCT set_id FROM sk), "
    "prs AS (SELECT a.set_id AS set_a, b.set_id AS set_b FROM days a JOIN days b "
    "ON a.set_id::DATE + 1 = b.set_id::DATE)"
)
DAYS = f"{DAY_SK}, {DAY_PAIRS}, al AS ({o.aligned()})"


@query("sketch_pair_join", f"WITH {LANG} SELECT set_a, set_b, bin, wa AS word_a, wb AS word_b FROM al")
def sketch_pair_join(spark, folder):
    return sim.align(doc_sketches(spark, folder, "lang"), lang_pairs(spark, folder))


def op_sql(op: str) -> str:
    word = o.PAIR_OPS[op]
    return f"WITH {LANG} SELECT set_a, set_b, bin, {word} AS word FROM al WHERE {word} <> 0"


@query("sketch_union", op_sql("union"))
def sketch_union(spark, folder):
    return sim.apply_op(doc_sketches(spark, folder, "lang"), lang_pairs(spark, folder), "union")


@query("sketch_intersect", op_sql("intersect"))
def sketch_intersect(spark, folder):
    return sim.apply_op(doc_sketches(spark, folder, "lang"), lang_pairs(spark, folder), "intersect")


@query("sketch_xor", op_sql("xor"))
def sketch_xor(spark, folder):
    return sim.apply_op(doc_sketches(spark, folder, "lang"), lang_pairs(spark, folder), "xor")


@query("sketch_diff_comp", op_sql("comp"))
def sketch_diff_comp(spark, folder):
    return sim.apply_op(doc_sketches(spark, folder, "lang"), lang_pairs(spark, folder), "comp")


@query("sketch_added", f"WITH {DAYS} SELECT set_a, set_b, bin, (wb & ~wa) AS word FROM al WHERE (wb & ~wa) <> 0")
def sketch_added(spark, folder):
    return sim.apply_op(day_sketches(spark, folder), day_pairs(spark, folder), "comp_rev")


@query("sketch_deleted", f"WITH {DAYS} SELECT set_a, set_b, bin, (wa & ~wb) AS word FROM al WHERE (wa & ~wb) <> 0")
def sketch_deleted(spark, folder):
    return sim.apply_op(day_sketches(spark, folder), day_pairs(spark, folder), "comp")


@query(
    "sketch_change3",
    lambda: f"""WITH {DAYS}, w AS (
      SELECT set_a, set_b, 'deleted' AS part, (wa & ~wb) AS word FROM al UNION ALL
      SELECT set_a, set_b, 'retained', (wa & wb) FROM al UNION ALL
      SELECT set_a, set_b, 'added', (wb & ~wa) FROM al),
    {o.segments(10)}, r AS (SELECT set_a, set_b, part, {o.card_agg('word', 10)} AS raw,
      sum(bit_count(word))::BIGINT AS n_bits FROM w WHERE word <> 0 GROUP BY ALL)
    SELECT set_a, set_b, part, {o.card_of()} AS card, n_bits FROM r""",
)
def sketch_change3(spark, folder):
    parts = sim.change_parts(day_sketches(spark, folder), day_pairs(spark, folder))
    keyed = sim.as_sketches(parts, F.struct("set_a", "set_b", "part"), 10)
    return sketch.meta(keyed).select("set_id.set_a", "set_id.set_b", "set_id.part", "card", "n_bits")


@query(
    "sketch_equal",
    f"""WITH {o.doc_sketch('lang', name='one')},
    sk AS (SELECT set_id, bin, word FROM one UNION ALL SELECT 'copy:' || set_id, bin, word FROM one),
    {o.ALL_PAIRS}, al AS ({o.aligned()})
    SELECT set_a, set_b, bool_and(wa = wb) AS is_equal FROM al GROUP BY 1, 2""",
)
def sketch_equal(spark, folder):
    one = doc_sketches(spark, folder, "lang")
    both = sketch.concat(one, sketch.copy(one, F.concat(F.lit("copy:"), F.col("set_id"))))
    ids = registry(spark, folder, "lang")
    copies = ids.select(F.concat(F.lit("copy:"), F.col("set_id")).alias("set_id"))
    return sim.equal_pairs(both, sim.all_pairs(ids.unionByName(copies)))


@query(
    "sketch_jaccard_pct",
    lambda: f"""WITH {SOURCE}, {o.pair_cards()} SELECT set_a, set_b,
      round_even(card_intersect::DOUBLE / card_union * 100, 0)::BIGINT AS jaccard_pct FROM pc""",
)
def sketch_jaccard_pct(spark, folder):
    pairs = sim.all_pairs(registry(spark, folder, "source"))
    cards = sim.pair_cards(doc_sketches(spark, folder, "source"), pairs, ("union", "intersect"))
    return cards.select("set_a", "set_b", sim.jaccard_pct().alias("jaccard_pct"))


@query(
    "sketch_cosine",
    lambda: f"""WITH {SOURCE}, {o.pair_cards()} SELECT set_a, set_b,
      round(bits_intersect / sqrt(bits_a::DOUBLE * bits_b), 6) AS cosine FROM pc""",
)
def sketch_cosine(spark, folder):
    pairs = sim.all_pairs(registry(spark, folder, "source"))
    cards = sim.pair_cards(doc_sketches(spark, folder, "source"), pairs, ("a", "b", "intersect"))
    return cards.select("set_a", "set_b", F.round(sim.cosine(), 6).alias("cosine"))


@query(
    "sketch_cond_prob",
    lambda: f"""WITH {LANG}, {o.pair_cards()},
    u AS (SELECT 'U' AS set_a, bin, bit_or(word) AS w FROM sk GROUP BY bin),
    ur AS (SELECT {o.card_agg('w', 10)} AS raw FROM u), uc AS (SELECT {o.card_of()} AS card_u FROM ur)
    SELECT set_a, set_b, card_a, card_b, card_intersect AS card_ab, card_u,
      round(card_a::DOUBLE / card_u, 6) AS p_a, round(card_b::DOUBLE / card_u, 6) AS p_b,
      round(card_intersect::DOUBLE / card_b, 6) AS p_a_given_b,
      round(card_intersect::DOUBLE / card_a, 6) AS p_b_given_a FROM pc, uc""",
)
def sketch_cond_prob(spark, folder):
    sketches = doc_sketches(spark, folder, "lang")
    return sim.conditional(sketches, lang_pairs(spark, folder))


@query(
    "sketch_pairwise",
    f"""WITH {o.doc_sketch('source')} SELECT a.set_id AS set_a, b.set_id AS set_b,
      sum(bit_count(a.word & b.word))::BIGINT AS shared
    FROM sk a JOIN sk b ON a.bin = b.bin AND a.set_id < b.set_id GROUP BY 1, 2
    HAVING sum(bit_count(a.word & b.word)) > 0""",
)
def sketch_pairwise(spark, folder):
    return sim.shared_bits(doc_sketches(spark, folder, "source"))


DOC_CLASSES = f"""{o.doc_sketch('doc_id')},
    reg AS (SELECT set_id, string_agg(bin || ':' || word, ',' ORDER BY bin) AS content, sum(bit_count(word))::BIGINT AS n FROM sk GROUP BY 1),
    cls AS (SELECT min(set_id) AS set_id, count(*) AS copies, any_value(n) AS n FROM reg GROUP BY content),
    rep AS (SELECT sk.*, copies, n FROM sk JOIN cls USING (set_id)),
    sh AS (SELECT a.set_id AS set_a, b.set_id AS set_b, a.copies AS copies_a, b.copies AS copies_b, a.n, b.n AS m,
      sum(bit_count(a.word & b.word))::BIGINT AS shared FROM rep a JOIN rep b ON a.bin = b.bin AND a.set_id < b.set_id GROUP BY ALL)"""


@query(
    "sketch_pairs_above",
    f"""WITH {DOC_CLASSES} SELECT set_a, set_b, copies_a, copies_b, shared, round(shared / (n + m - shared), 6) AS jaccard
    FROM sh WHERE shared / (n + m - shared) >= 0.8""",
)
def sketch_pairs_above(spark, folder):
    pairs = candidates.pairs_above_of_bits(doc_bits(spark, folder, "doc_id"), 0.8)
    return pairs.withColumn("score", F.round("score", 6)).withColumnRenamed("score", "jaccard")


@query(
    "sketch_cosine_above",
    f"""WITH {DOC_CLASSES} SELECT set_a, set_b, copies_a, copies_b, shared, round(shared / sqrt(n::DOUBLE * m), 6) AS cosine
    FROM sh WHERE shared / sqrt(n::DOUBLE * m) >= 0.9""",
)
def sketch_cosine_above(spark, folder):
    pairs = candidates.pairs_above_of_bits(doc_bits(spark, folder, "doc_id"), 0.9, "cosine")
    return pairs.withColumn("score", F.round("score", 6)).withColumnRenamed("score", "cosine")


@query(
    "sketch_equal_groups",
    f"""WITH {DOC_CLASSES} SELECT set_id, min(set_id) OVER (PARTITION BY content) AS group_id FROM reg""",
)
def sketch_equal_groups(spark, folder):
    return candidates.equal_groups_of_bits(doc_bits(spark, folder, "doc_id"))


@query(
    "matrix_contract",
    """WITH a AS (SELECT l_returnflag AS i, l_partkey AS k, sum(l_quantity) AS a FROM lineitem GROUP BY 1, 2),
    b AS (SELECT l_linestatus AS j, l_partkey AS k, sum(l_quantity) AS b FROM lineitem GROUP BY 1, 2)
    SELECT i, j, sum(a * b) AS value FROM a JOIN b USING (k) GROUP BY 1, 2""",
)
def matrix_contract(spark, folder):
    items = read_table(spark, folder, "lineitem")
    k, value = F.col("l_partkey").alias("k"), F.col("l_quantity")
    return sim.contract(
        items.select(F.col("l_returnflag").alias("i"), k, value.alias("a")),
        items.select(F.col("l_linestatus").alias("j"), k, value.alias("b")),
    )


@query(
    "matrix_diagonal",
    """WITH a AS (SELECT l_partkey AS i, l_returnflag AS k, sum(l_quantity) AS a FROM lineitem GROUP BY 1, 2),
    b AS (SELECT l_partkey AS i, l_returnflag AS k, sum(l_linenumber) AS b FROM lineitem GROUP BY 1, 2)
    SELECT i, sum(a * b) AS value FROM a JOIN b USING (i, k) GROUP BY 1""",
)
def matrix_diagonal(spark, folder):
    items = read_table(spark, folder, "lineitem")
    k = F.col("l_returnflag").alias("k")
    return sim.contract_diagonal(
        items.select(F.col("l_partkey").alias("i"), k, F.col("l_quantity").alias("a")),
        items.select(F.col("l_partkey").alias("j"), k, F.col("l_linenumber").alias("b")),
    )


def laws_sql() -> str:
    laws = {
        "union commutes": ("wa | wb", "wb | wa"),
        "intersection commutes": ("wa & wb", "wb & wa"),
        "union associates": ("(wa | wb) | wc", "wa | (wb | wc)"),
        "intersection associates": ("(wa & wb) & wc", "wa & (wb & wc)"),
        "intersection distributes": ("(wa | wb) & wc", "(wa & wc) | (wb & wc)"),
        "union distributes": ("(wa & wb) | wc", "(wa | wc) & (wb | wc)"),
        "union with empty": ("wa | 0", "wa"),
        "intersection with universe": ("wa & (wa | wb | wc)", "wa"),
        "union idempotent": ("wa | wa", "wa"),
        "intersection idempotent": ("wa & wa", "wa"),
    }
    words = ", ".join(
        f"bit_or(CASE WHEN set_id = '{lang}' THEN word ELSE 0 END) AS {w}"
        for lang, w in (("de", "wa"), ("en", "wb"), ("es", "wc"))
    )
    rows = " UNION ALL ".join(
        f"SELECT '{law}' AS law, bool_and(({x}) = ({y})) AS holds FROM w" for law, (x, y) in laws.items()
    )
    return f"WITH {o.doc_sketch('lang')}, w AS (SELECT bin, {words} FROM sk GROUP BY bin) {rows}"


@query("set_laws", laws_sql())
def set_laws(spark, folder):
    return sim.set_laws(doc_sketches(spark, folder, "lang"), "de", "en", "es")


@query(
    "sketch_intersect_est",
    f"""WITH {o.doc_sketch('lang')}, {o.ALL_PAIRS}, t AS (SELECT DISTINCT lang, token FROM tok),
    n AS (SELECT lang, count(*) AS n FROM t GROUP BY 1),
    ab AS (SELECT a.lang AS set_a, b.lang AS set_b, count(*) AS n_ab FROM t a JOIN t b
      ON a.token = b.token AND a.lang < b.lang GROUP BY 1, 2)
    SELECT set_a, set_b, coalesce(n_ab, 0)::BIGINT AS n_intersect, (na.n - coalesce(n_ab, 0))::BIGINT AS n_comp,
      (na.n + nb.n - coalesce(n_ab, 0))::BIGINT AS n_union, true AS within
    FROM prs LEFT JOIN ab USING (set_a, set_b) JOIN n na ON na.lang = set_a JOIN n nb ON nb.lang = set_b""",
)
def sketch_intersect_est(spark, folder):
    """Exact sizes by a join, and whether all estimates lie within five standard errors of the union."""
    words = doc_words(spark, folder, "lang")
    pairs = lang_pairs(spark, folder)
    exact = sim.intersect_exact(words, F.col("lang"), F.col("token"), pairs)
    guess = sim.intersect_estimate(words, F.col("lang"), F.col("token"), pairs, lg_k=12)
    sizes = ["n_intersect", "n_comp", "n_union"]
    guess = guess.withColumnsRenamed({c: f"est_{c}" for c in sizes})
    error = 5 * F.col("n_union") / float(1 << 6)
    within = [F.abs(F.col(f"est_{c}") - F.col(c)) <= error for c in sizes]
    both = exact.join(guess, ["set_a", "set_b"])
    return both.select("set_a", "set_b", *sizes, (within[0] & within[1] & within[2]).alias("within"))
