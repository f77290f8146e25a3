"""Graph queries: sketch nodes of the documents, edges of orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.functions import hashing
from bitloom.operators import graph, sketch
from bitloom.operators import similarity as sim
from bitloom.plans import oracle as o
from bitloom.plans.algebra import LANG, lang_pairs
from bitloom.plans.registry import query
from bitloom.plans.sketches import doc_sketches
from bitloom.session import checkpointed
from bitloom.sources import files, stores
from bitloom.sources.tables import read_table

IDS = f"ids AS (SELECT set_id, {o.CONTENT_ID} AS sha1, sum(bit_count(word))::BIGINT AS n_bits FROM sk GROUP BY 1)"
LABELS = "labels_of AS (SELECT source AS set_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS labels FROM documents GROUP BY 1)"


def source_nodes(spark, folder, status="b"):
    labels = read_table(spark, folder, "documents").select(F.col("source").alias("set_id"), F.col("lang").alias("label"))
    return graph.nodes(doc_sketches(spark, folder, "source"), labels, status)


def shown(df):
    return df.select(*(F.array_join(c, ",").alias(c) if t.startswith("array") else c for c, t in df.dtypes))


@query(
    "node_create",
    f"""WITH {o.doc_sketch('source')}, {IDS}, {LABELS} SELECT 'b' AS status, set_id, sha1, labels, n_bits
    FROM ids JOIN labels_of USING (set_id)""",
)
def node_create(spark, folder):
    return shown(source_nodes(spark, folder).drop("card"))


@query(
    "node_card",
    lambda: f"""WITH {o.segments(10)}, {o.doc_sketch('source')}, {IDS},
    r AS (SELECT set_id, {o.card_agg('word', 10)} AS raw FROM sk GROUP BY 1)
    SELECT sha1, {o.card_of()} AS card FROM r JOIN ids USING (set_id)""",
)
def node_card(spark, folder):
    return source_nodes(spark, folder).select("sha1", "card")


@query(
    "node_upsert",
    f"""WITH {o.doc_sketch('source')}, {IDS}, l AS (
      SELECT source AS set_id, lang AS label FROM documents UNION SELECT source, CASE WHEN n_chars > 2000 THEN 'long'
      ELSE 'short' END FROM documents)
    SELECT 'b' AS status, sha1, string_agg(label, ',' ORDER BY label) AS labels FROM ids JOIN l USING (set_id) GROUP BY sha1""",
)
def node_upsert(spark, folder):
    stored = checkpointed(source_nodes(spark, folder))
    size = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    docs = read_table(spark, folder, "documents").select(F.col("source").alias("set_id"), F.array(size).alias("labels"))
    fresh = docs.distinct().join(stored.select("set_id", "status", "sha1"), "set_id")
    return shown(graph.upsert_nodes(stored, fresh))


EDGES = """SELECT 'b' AS status, user_id::VARCHAR AS source, event_type AS target,
      'did' || extract('hour' FROM ts)::VARCHAR AS r_type, props, event_id FROM events"""


def event_edges(spark, folder):
    return read_table(spark, folder, "events").select(
        F.lit("b").alias("status"),
        F.col("user_id").cast("string").alias("source"),
        F.col("event_type").alias("target"),
        F.concat(F.lit("did"), F.hour("ts").cast("string")).alias("r_type"),
        "props",
        "event_id",
    )


@query(
    "edge_upsert",
    f"""SELECT status, source, target, r_type, props FROM ({EDGES})
    QUALIFY row_number() OVER (PARTITION BY status, source, target ORDER BY event_id DESC) = 1""",
)
def edge_upsert(spark, folder):
    return graph.upsert_edges(event_edges(spark, folder), "event_id")


@query(
    "stamped_upsert",
    """WITH u AS (UNPIVOT (SELECT user_id AS key, ts, event_id, event_type, value::VARCHAR AS value_text, props FROM events)
      ON event_type, value_text, props INTO NAME field VALUE value)
    SELECT key, field, arg_max(value, (ts, event_id)) AS value,
      (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events e WHERE e.user_id = key) AS last_modified
    FROM u GROUP BY key, field""",
)
def stamped_upsert(spark, folder):
    events = read_table(spark, folder, "events").select(
        F.col("user_id").alias("key"), "ts", "event_id", "event_type", F.col("value").cast("string").alias("value_text"), "props"
    )
    updates = events.unpivot(["key", "ts", "event_id"], ["event_type", "value_text", "props"], "field", "value")
    latest = graph.stamped_upsert(updates, ["ts", "event_id"])
    return latest.withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss"))


@query(
    "node_upsert_stored",
    f"""WITH {o.doc_sketch('source')}, {IDS}, l AS (
      SELECT source AS set_id, lang AS label FROM documents UNION SELECT source, CASE WHEN n_chars > 2000 THEN 'long'
      ELSE 'short' END FROM documents)
    SELECT 'b' AS status, sha1, string_agg(label, ',' ORDER BY label) AS labels FROM ids JOIN l USING (set_id) GROUP BY sha1""",
)
def node_upsert_stored(spark, folder):
    """A stored graph: its nodes are written once, later labels are merged into the partitions they fall into."""
    path = files.new_folder(spark, "nodes")
    nodes = checkpointed(source_nodes(spark, folder))
    stores.merge_into(spark, path, nodes.select("status", "sha1", "labels"), ["status", "sha1"], graph.upsert_nodes)
    size = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    docs = read_table(spark, folder, "documents").select(F.col("source").alias("set_id"), F.array(size).alias("labels"))
    fresh = docs.distinct().join(nodes.select("set_id", "status", "sha1"), "set_id").select("status", "sha1", "labels")
    stores.merge_into(spark, path, fresh, ["status", "sha1"], graph.upsert_nodes)
    return shown(stores.read_merged(spark, path))


@query(
    "edge_upsert_stored",
    f"""SELECT status, source, target, r_type, props FROM ({EDGES})
    QUALIFY row_number() OVER (PARTITION BY status, source, target ORDER BY event_id DESC) = 1""",
)
def edge_upsert_stored(spark, folder):
    """The events' edges in two halves, the later one first: writes that come late lose."""
    path, edges = files.new_folder(spark, "edges"), event_edges(spark, folder)
    half = edges.agg((F.max("event_id") / 2).alias("h")).scalar()
    for part in (edges.where(F.col("event_id") > half), edges.where(F.col("event_id") <= half)):
        stores.merge_into(spark, path, part, ["status", "source", "target"], lambda old, new: graph.newest_edges(old, new, "event_id"))
    return stores.read_merged(spark, path).drop("event_id")


@query(
    "stamped_upsert_stored",
    """WITH u AS (UNPIVOT (SELECT user_id AS key, event_id, event_type, value::VARCHAR AS value_text, props FROM events)
      ON event_type, value_text, props INTO NAME field VALUE value)
    SELECT key, field, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM u GROUP BY key, field""",
)
def stamped_upsert_stored(spark, folder):
    path = files.new_folder(spark, "fields")
    events = read_table(spark, folder, "events").select(
        F.col("user_id").alias("key"), "event_id", "event_type", F.col("value").cast("string").alias("value_text"), "props"
    )
    updates = events.unpivot(["key", "event_id"], ["event_type", "value_text", "props"], "field", "value").where("value IS NOT NULL")
    for part in (updates.where("event_id % 3 <> 0"), updates.where("event_id % 3 = 0")):
        stores.merge_into(spark, path, part, ["key"], lambda old, new: graph.newest_fields(old, new, ["event_id"]))
    return stores.read_merged(spark, path)


def node_op_sql(op: str) -> str:
    word = o.PAIR_OPS[op]
    args = "x.sha1 || ':' || y.sha1" if op == "comp" else "least(x.sha1, y.sha1) || ':' || greatest(x.sha1, y.sha1)"
    return f"""WITH {LANG}, {IDS}, {o.segments(10)},
    r AS (SELECT set_a, set_b, {o.card_agg(word, 10)} AS raw, sum(bit_count({word}))::BIGINT AS n_bits FROM al GROUP BY 1, 2),
    n AS (SELECT x.sha1 AS sha_a, y.sha1 AS sha_b, sha1('{op}:' || {args}) AS target, {o.card_of()} AS card, r.n_bits
      FROM r JOIN ids x ON x.set_id = set_a JOIN ids y ON y.set_id = set_b)
    SELECT sha_a AS source, target, '{op}' AS r_type, '0' AS pos, card, n_bits, 'derived' AS labels FROM n
    UNION ALL SELECT sha_b, target, '{op}', '1', card, n_bits, 'derived' FROM n"""


def node_op(spark, folder, op):
    sketches = doc_sketches(spark, folder, "lang").once()
    sha1s = sketch.meta(sketches).select("set_id", "sha1")
    made, registers, edges = graph.derived_nodes(sketches, lang_pairs(spark, folder), op, sha1s, "derived")
    cards = sketch.meta(registers).select(F.col("set_id").alias("target"), "card", "n_bits")
    named = made.select(F.col("sha1").alias("target"), "labels")
    joined = edges.join(cards, "target").join(named, "target")
    return shown(joined.select("source", "target", "r_type", F.col("props")["pos"].alias("pos"), "card", "n_bits", "labels"))


@query("node_union", lambda: node_op_sql("union"))
def node_union(spark, folder):
    return node_op(spark, folder, "union")


@query("node_intersect", lambda: node_op_sql("intersect"))
def node_intersect(spark, folder):
    return node_op(spark, folder, "intersect")


@query("node_comp", lambda: node_op_sql("comp"))
def node_comp(spark, folder):
    return node_op(spark, folder, "comp")


@query("node_xor", lambda: node_op_sql("xor"))
def node_xor(spark, folder):
    return node_op(spark, folder, "xor")


@query(
    "derived_id",
    """WITH p AS (SELECT o_orderkey, o_custkey::VARCHAR AS a, o_orderpriority AS b FROM orders)
    SELECT o_orderkey, sha1('union:' || least(a, b) || ':' || greatest(a, b)) AS union_id,
      sha1('union:' || least(b, a) || ':' || greatest(b, a)) AS union_id_swapped,
      sha1('xor:' || least(a, b) || ':' || greatest(a, b)) AS xor_id,
      sha1('comp:' || a || ':' || b) AS comp_id, sha1('comp:' || b || ':' || a) AS comp_id_swapped FROM p""",
)
def derived_id(spark, folder):
    orders = read_table(spark, folder, "orders")
    a, b = F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    return orders.select(
        "o_orderkey",
        hashing.derived_id("union", a, b).alias("union_id"),
        hashing.derived_id("union", b, a).alias("union_id_swapped"),
        hashing.derived_id("xor", a, b).alias("xor_id"),
        hashing.derived_id("comp", a, b).alias("comp_id"),
        hashing.derived_id("comp", b, a).alias("comp_id_swapped"),
    )


@query(
    "column_id",
    """SELECT col AS column_name, sha1('column:customer:' || col) AS column_id, count(*) AS n_values
    FROM (UNPIVOT (SELECT c_name, c_mktsegment, c_acctbal::VARCHAR AS c_acctbal FROM customer)
      ON c_name, c_mktsegment, c_acctbal INTO NAME col VALUE val) GROUP BY col""",
)
def column_id(spark, folder):
    from bitloom.operators import tokens, verbs

    long = verbs.pivot_longer(read_table(spark, folder, "customer").select("c_name", "c_mktsegment", "c_acctbal"))
    long = long.where("value IS NOT NULL")
    counted = long.groupBy(F.col("variable").alias("column_name")).agg(F.count("*").alias("n_values"))
    return counted.withColumn("column_id", tokens.column_id(F.lit("customer"), F.col("column_name")))


@query(
    "node_sketches",
    f"""WITH {o.doc_sketch('source')}, {IDS}, s AS (SELECT set_id, string_agg(bin || ':' || word, ',' ORDER BY bin) AS registers
      FROM sk GROUP BY 1), l AS (SELECT source AS set_id FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 3)
    SELECT sha1, registers FROM l JOIN ids USING (set_id) JOIN s USING (set_id)""",
)
def node_sketches(spark, folder):
    chosen = source_nodes(spark, folder).where(F.size("labels") > 3).select("set_id", "sha1")
    dumps = sketch.dump_sparse(doc_sketches(spark, folder, "source"))
    text_form = F.transform("registers", lambda r: F.concat_ws(":", r["bin"].cast("string"), r["word"].cast("string")))
    return chosen.join(dumps, "set_id").select("sha1", F.array_join(text_form, ",").alias("registers"))


@query(
    "node_lookup",
    f"""WITH {o.doc_sketch('source')}, {IDS}, {LABELS}, q AS (SELECT source FROM documents GROUP BY 1
      HAVING sum(n_chars) > (SELECT sum(n_chars)::DOUBLE / count(DISTINCT source) FROM documents))
    SELECT 'b' AS status, sha1, labels FROM ids JOIN labels_of USING (set_id) WHERE set_id IN (SELECT source FROM q)""",
)
def node_lookup(spark, folder):
    docs = read_table(spark, folder, "documents").select("source", "n_chars")
    sizes = docs.groupBy("source").agg(F.sum("n_chars").alias("n"))
    mean = sizes.agg((F.sum("n").cast("double") / F.count("*")).alias("m")).scalar()
    big = sizes.where(F.col("n") > mean).select(F.col("source").alias("set_id"))
    nodes = source_nodes(spark, folder)
    wanted = nodes.join(big, "set_id", "left_semi").select(F.lit("b").alias("status"), "sha1")
    return shown(graph.find_nodes(nodes, wanted).select("status", "sha1", "labels"))


@query(
    "edge_lookup",
    f"""WITH e AS ({EDGES}), q AS (SELECT user_id::VARCHAR AS source, min_by(event_type, event_id) AS target FROM events GROUP BY 1)
    SELECT source, target, r_type, event_id FROM e WHERE status = 'b' AND (source, target) IN (SELECT source, target FROM q)""",
)
def edge_lookup(spark, folder):
    edges = event_edges(spark, folder)
    wanted = edges.groupBy("source").agg(F.min_by("target", "event_id").alias("target"))
    return graph.find_edges(edges, wanted, "b").select("source", "target", "r_type", "event_id")


@query(
    "edge_endpoints",
    """SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS source, 'p' || l_partkey AS target,
      s_name AS source_label, p_name AS target_label, 'supplier' AS source_kind, 'part' AS target_kind
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
)
def edge_endpoints(spark, folder):
    edges = read_table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("s"), "l_suppkey").alias("source"),
        F.concat(F.lit("p"), "l_partkey").alias("target"),
    )
    suppliers = read_table(spark, folder, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("supplier").alias("kind")
    )
    parts = read_table(spark, folder, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit("part").alias("kind")
    )
    return graph.attach_ends(edges, suppliers.unionByName(parts), "id", ["label", "kind"])


@query(
    "node_equal",
    f"""WITH {o.doc_sketch('source')}, {IDS}, {LABELS}, other AS (SELECT source AS set_id,
      string_agg(DISTINCT lang, ',' ORDER BY lang) AS labels FROM documents WHERE n_chars < 2000 GROUP BY 1)
    SELECT sha1, l.labels IS NOT DISTINCT FROM r.labels AS is_equal
    FROM ids JOIN labels_of l USING (set_id) JOIN other r USING (set_id)""",
)
def node_equal(spark, folder):
    left = checkpointed(source_nodes(spark, folder))
    docs = read_table(spark, folder, "documents").where("n_chars < 2000")
    other = docs.groupBy(F.col("source").alias("set_id")).agg(F.array_sort(F.collect_set("lang")).alias("labels"))
    right = left.drop("labels").join(other, "set_id").select(*left.columns)
    return graph.equal_rows(left.drop("set_id"), right.drop("set_id"), ["sha1"])


@query(
    "edge_equal",
    f"""WITH e AS (SELECT * FROM ({EDGES}) QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY event_id DESC) = 1),
    f AS (SELECT * FROM ({EDGES}) QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY event_id) = 1)
    SELECT status, source, target, e.r_type IS NOT DISTINCT FROM f.r_type AND e.props IS NOT DISTINCT FROM f.props AS is_equal
    FROM e JOIN f USING (status, source, target)""",
)
def edge_equal(spark, folder):
    edges = event_edges(spark, folder)
    last = graph.upsert_edges(edges, "event_id")
    first = graph.upsert_edges(edges.withColumn("event_id", -F.col("event_id")), "event_id")
    return graph.equal_rows(last, first, ["status", "source", "target"])


STATUS_OF = "CASE WHEN o_orderstatus = 'O' THEN 'h' WHEN o_orderstatus = 'F' THEN 't' ELSE 'b' END"


@query(
    "graph_assemble",
    f"""WITH e AS (SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target, {STATUS_OF} AS status FROM orders),
    n AS (SELECT 'c' || c_custkey AS sha1, 'h' AS status FROM customer UNION ALL SELECT target, status FROM e),
    d AS (SELECT sha1, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (
      SELECT source AS sha1, 1 AS o, 0 AS i FROM e WHERE status = 'h' UNION ALL
      SELECT target, 0, 1 FROM e WHERE status = 'h') GROUP BY 1)
    SELECT n.sha1, status, coalesce(out_degree, 0)::BIGINT AS out_degree, coalesce(in_degree, 0)::BIGINT AS in_degree
    FROM n LEFT JOIN d USING (sha1) WHERE status = 'h'""",
)
def graph_assemble(spark, folder):
    edges, nodes = order_graph(spark, folder)
    return graph.assemble(nodes, edges, "h")


def order_graph(spark, folder):
    """Customers and orders as nodes; an edge from each customer to each of their orders."""
    status = F.when(F.col("o_orderstatus") == "O", "h").when(F.col("o_orderstatus") == "F", "t").otherwise("b")
    orders = read_table(spark, folder, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"), status.alias("status")
    )
    customers = read_table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("sha1"), F.lit("h").alias("status"))
    return orders, customers.unionByName(orders.select(F.col("target").alias("sha1"), "status"))


@query(
    "scan_status",
    f"""WITH e AS (SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target, {STATUS_OF} AS status FROM orders)
    SELECT 'edge' AS kind, target AS item FROM e WHERE status = 'b'
    UNION ALL SELECT 'node', target FROM e WHERE status = 'b'""",
)
def scan_status(spark, folder):
    edges, nodes = order_graph(spark, folder)
    edge_path, node_path = files.new_folder(spark, "edges"), files.new_folder(spark, "nodes")
    stores.save_by(edges, edge_path, "status")
    stores.save_by(nodes, node_path, "status")
    found = stores.scan_status(spark, edge_path, "b").select(F.lit("edge").alias("kind"), F.col("target").alias("item"))
    return found.unionByName(
        stores.scan_status(spark, node_path, "b").select(F.lit("node").alias("kind"), F.col("sha1").alias("item"))
    )


@query(
    "edge_props",
    """SELECT event_id, props ->> '$.k' AS k, len(json_keys(props))::INT AS n_props,
      CASE WHEN (props ->> '$.k')::INT > 50 THEN 'high' ELSE 'low' END AS level FROM events""",
)
def edge_props(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", graph.props_map(F.col("props")).alias("m"))
    k = F.col("m")["k"]
    return events.select(
        "event_id",
        k.alias("k"),
        F.size(F.map_keys("m")).alias("n_props"),
        F.when(k.cast("int") > 50, "high").otherwise("low").alias("level"),
    )


@query(
    "lineage_regen",
    f"""WITH {LANG}, {IDS},
    n1 AS (SELECT set_a, set_b, x.sha1 AS sha_a, y.sha1 AS sha_b,
      sha1('union:' || least(x.sha1, y.sha1) || ':' || greatest(x.sha1, y.sha1)) AS id1
      FROM prs JOIN ids x ON x.set_id = set_a JOIN ids y ON y.set_id = set_b)
    SELECT id1 AS set_id, bin, (wa | wb) AS word FROM n1 JOIN al USING (set_a, set_b) WHERE (wa | wb) <> 0
    UNION ALL
    SELECT sha1('comp:' || id1 || ':' || sha_a), bin, (wa | wb) & ~wa FROM n1 JOIN al USING (set_a, set_b)
    WHERE ((wa | wb) & ~wa) <> 0""",
)
def lineage_regen(spark, folder):
    sketches = doc_sketches(spark, folder, "lang").once()
    sha1s = checkpointed(sketch.meta(sketches).select("set_id", "sha1"))
    base = sketches.with_rows(sketches.rows.join(sha1s, "set_id").select(F.col("sha1").alias("set_id"), "bin", "word"))
    base = base.once()
    pairs = sim.all_pairs(sha1s.select("set_id"))
    _, _, first = graph.derived_nodes(sketches, pairs, "union", sha1s, "derived")
    # A second level: each union without its first argument.
    lower = pairs.join(sha1s.withColumnRenamed("set_id", "set_a").withColumnRenamed("sha1", "sha_a"), "set_a").join(
        sha1s.withColumnRenamed("set_id", "set_b").withColumnRenamed("sha1", "sha_b"), "set_b"
    )
    second = lower.select(
        hashing.derived_id("union", F.col("sha_a"), F.col("sha_b")).alias("id1"), "sha_a"
    ).withColumn("target", hashing.derived_id("comp", F.col("id1"), F.col("sha_a")))
    ends = F.inline(
        F.array(
            F.struct(F.col("id1").alias("source"), F.lit("0").alias("pos")),
            F.struct(F.col("sha_a").alias("source"), F.lit("1").alias("pos")),
        )
    )
    second = second.select("target", ends).select(
        F.lit("b").alias("status"), "source", "target", F.lit("comp").alias("r_type"),
        F.create_map(F.lit("pos"), "pos").alias("props"),
    )
    edges = checkpointed(first.unionByName(second))
    return graph.regenerate(base, edges).rows
