import hashlib

import pytest
from pyspark.sql import functions as F
from plain_sets import registers
from test_sketch import A, B, C, build, collected, pairs_of

from bitloom.operators import entity, graph, ingest, search, sketch

ENTITY = "sha1 string, card long, grad double, op string, args array<string>"


def test_change_operations(spark):
    sketches = build(spark, {"old": A, "new": B})
    rows = {r["op"]: r for r in entity.combine(sketches, pairs_of(spark, ("old", "new")), *entity.OPERATIONS).collect()}
    ids = {r["set_id"]: r["sha1"] for r in entity.build(sketches).collect()}
    # Advancing adds what is new to what is retained, which is the new set.
    assert rows["advance"]["sha1"] == ids["new"]
    assert rows["advance"]["args"] == [rows[op]["sha1"] for op in ("deleted", "retained", "added")]
    assert rows["added"]["args"] == [ids["old"], ids["new"]]
    card = {k: r["card"] for k, r in rows.items()}
    assert rows["deleted"]["grad"] == pytest.approx(card["deleted"] / rows["union"]["card"] * rows["union"]["card"] / 12, abs=0.1)
    assert rows["retained"]["grad"] == pytest.approx(card["retained"] / card["union"])
    assert [rows[op]["grad"] for op in ("union", "intersect", "xor")] == [0.0, 0.0, 0.0]
    assert rows["comp"]["sha1"] == rows["deleted"]["sha1"] and rows["retained"]["sha1"] == rows["intersect"]["sha1"]


def test_complement_by_empty(spark):
    sketches, pairs = build(spark, {"A": A}), pairs_of(spark, ("A", "Z"))
    row = entity.combine(sketches, pairs, "comp", "added").collect()
    assert {r["op"]: r["grad"] for r in row} == {"comp": 1.0, "added": None}
    with pytest.raises(Exception, match="empty sketch"):
        entity.combine(sketches, pairs, "comp", strict=True).collect()


@pytest.mark.parametrize(
    "op, args, want",
    [
        ("union", ["x", "y"], (2.5, 3.5)),
        ("intersect", ["x", "y"], (2.5, 3.5)),
        ("xor", ["x", "y"], (2.5, 3.5)),
        ("comp", ["x", "y"], (2.5, 3.0)),
        ("added", ["x", "y"], (2.0, 1.5)),
        ("deleted", ["x", "y"], (1.0, 3.0)),
        ("retained", ["x", "y"], (1.0, 1.5)),
        # y is derived, x is terminal.
        ("advance", ["x", "y"], (2.0, 1.5)),
    ],
)
def test_backprop_rules(spark, op, args, want):
    base = spark.createDataFrame([("x", 1, 2.0, None, []), ("y", 1, 3.0, "added", ["p", "q"])], ENTITY)
    result = spark.createDataFrame([("r", 1, 0.5, op, args)], ENTITY)
    got = {r["sha1"]: r["grad"] for r in entity.backprop(base, result).collect()}
    assert (got["x"], got["y"]) == pytest.approx(want)


def test_backprop_leaves_untouched_entities(spark):
    base = spark.createDataFrame([("x", 1, 2.0, None, [])], ENTITY)
    terminal = spark.createDataFrame([("r", 1, 0.5, None, [])], ENTITY)
    assert entity.backprop(base, terminal).first()["grad"] == 2.0


def test_node_and_edge_upsert(spark):
    schema = "status string, sha1 string, labels array<string>"
    old = spark.createDataFrame([("b", "1", ["x", "y"]), ("b", "2", [])], schema)
    new = spark.createDataFrame([("b", "1", ["z", "y"]), ("h", "1", ["w"])], schema)
    got = {(r["status"], r["sha1"]): r["labels"] for r in graph.upsert_nodes(old, new).collect()}
    assert got == {("b", "1"): ["x", "y", "z"], ("b", "2"): [], ("h", "1"): ["w"]}
    edges = spark.createDataFrame(
        [("b", "1", "2", "first", "{}", 1), ("b", "1", "2", "last", "{}", 3), ("b", "1", "2", "mid", "{}", 2)],
        "status string, source string, target string, r_type string, props string, seq int",
    )
    assert [r["r_type"] for r in graph.upsert_edges(edges, "seq").collect()] == ["last"]


def test_regenerate_from_lineage(spark):
    sketches = build(spark, {"a": A, "b": B, "c": C})
    edge = "source string, target string, r_type string, pos string"
    edges = spark.createDataFrame(
        [
            ("a", "u", "union", "0"), ("b", "u", "union", "1"),
            ("u", "k", "comp", "0"), ("c", "k", "comp", "1"),
            ("k", "x", "xor", "0"), ("a", "x", "xor", "1"),
            ("x", "y", "union", "0"), ("u", "y", "union", "1"), ("y", "z", "union", "0"), ("c", "z", "union", "1"),
            ("empty", "from_empty", "union", "0"), ("a", "from_empty", "union", "1"),
        ],
        edge,
    ).select("source", "target", "r_type", F.create_map(F.lit("pos"), "pos").alias("props"))
    got = collected(graph.regenerate(sketches, edges))
    ra, rb, rc = registers(A), registers(B), registers(C)
    u = {b: ra.get(b, 0) | rb.get(b, 0) for b in ra.keys() | rb.keys()}
    k = {b: w & ~rc.get(b, 0) for b, w in u.items()}
    x = {b: k.get(b, 0) ^ ra.get(b, 0) for b in k.keys() | ra.keys()}
    y = {b: x.get(b, 0) | u.get(b, 0) for b in x.keys() | u.keys()}
    z = {b: y.get(b, 0) | rc.get(b, 0) for b in y.keys() | rc.keys()}
    want = {"u": u, "k": k, "x": x, "y": y, "z": z, "from_empty": ra}
    assert got == {n: {b: w for b, w in s.items() if w} for n, s in want.items()}
    # An argument that is no base node, and edges in a circle, are errors.
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "set_id string")
    with pytest.raises(ValueError):
        graph.regenerate(sketches, edges, ids)
    circle = edges.where("target = 'u'").unionByName(edges.where("source = 'u'").withColumns({"source": F.lit("k"), "target": F.lit("b")}))
    with pytest.raises(ValueError):
        graph.regenerate(sketches, circle.unionByName(edges.where("target = 'k'")))


def chain(spark, depth):
    """A chain of xor with one base node in turn; every tenth step goes back to the first step too."""
    rows = []
    for i in range(depth):
        rows += [("a" if i == 0 else f"n{i - 1}", f"n{i}", "xor", "0"), ("bc"[i % 2], f"n{i}", "xor", "1")]
        if i and i % 10 == 0:
            rows.append(("n0", f"n{i}", "xor", "2"))
    edges = spark.createDataFrame(rows, "source string, target string, r_type string, pos string")
    return rows, edges.select("source", "target", "r_type", F.create_map(F.lit("pos"), "pos").alias("props"))


def test_deep_lineage_goes_level_by_level(spark):
    rows, edges = chain(spark, 50)
    want = {"a": registers(A), "b": registers(B), "c": registers(C)}
    for source, target, _, _ in rows:
        have = want.setdefault(target, {})
        want[target] = {b: have.get(b, 0) ^ want[source].get(b, 0) for b in have.keys() | want[source].keys()}
    got = collected(graph.regenerate(build(spark, {"a": A, "b": B, "c": C}), edges))
    assert set(got) <= {f"n{i}" for i in range(50)}
    for i in range(50):
        assert got.get(f"n{i}", {}) == {b: w for b, w in want[f"n{i}"].items() if w}


def test_levels(spark):
    _, edges = chain(spark, 4)
    shortcut = [("a", "n9", "union", None), ("n2", "n9", "union", None), ("n2", "n9", "union", None)]
    more = spark.createDataFrame(shortcut, "source string, target string, r_type string, props map<string,string>")
    got = graph.levels(edges.unionByName(more)).collect()
    assert sorted(tuple(r) for r in got) == [("n0", 1), ("n1", 2), ("n2", 3), ("n3", 4), ("n9", 4)]
    assert graph.levels(edges.limit(0)).count() == 0
    # A base node is not made again, and nothing is waited for behind it.
    ids = spark.createDataFrame([("b",), ("c",), ("n1",)], "set_id string")
    short = edges.where("target IN ('n2', 'n1', 'n3')")
    with pytest.raises(ValueError):
        graph.levels(short, ids)
    made = graph.regenerate(build(spark, {"b": B, "c": C, "n1": A}), short, ids).rows
    assert {r[0] for r in made.select("set_id").distinct().collect()} == {"n2", "n3"}


def test_attach_ends_splits_hubs(spark):
    edges = spark.createDataFrame([(i, "hub", f"n{i % 5}") for i in range(200)], "e int, source string, target string")
    nodes = spark.createDataFrame([("hub", "H")] + [(f"n{i}", f"N{i}") for i in range(5)], "id string, label string")
    got = graph.attach_ends(edges, nodes, "id", ["label"], hot_rows=50, salts=4).collect()
    assert len(got) == 200 and all((r["source_label"], r["target_label"]) == ("H", f"N{r['e'] % 5}") for r in got)


def test_change_series_has_gap_days(spark):
    rows = [("k", "2024-01-01", "a"), ("k", "2024-01-03", "b")]
    df = spark.createDataFrame(rows, "key string, day string, t string").withColumn("day", F.col("day").cast("date"))
    keyed = sketch.build(df, F.struct("key", "day"), F.col("t"))
    daily = keyed.rows.select("set_id.key", "set_id.day", "bin", "word")
    first, last = F.lit("2024-01-01").cast("date"), F.lit("2024-01-03").cast("date")
    got = {str(r["day"]): r for r in entity.change_series(daily, 10, first, last).collect()}
    assert set(got) == {"2024-01-02", "2024-01-03"}
    assert (got["2024-01-02"]["grad_deleted"], got["2024-01-02"]["grad_added"]) == (1.0, None)
    assert (got["2024-01-03"]["grad_deleted"], got["2024-01-03"]["grad_added"]) == (None, 1.0)


def test_columns_change_day_by_day(spark):
    rows = [("2024-01-01", "x y", "p"), ("2024-01-02", "y z", None), (None, "lost", "lost"), ("2024-01-02", None, "")]
    df = spark.createDataFrame(rows, "d string, one string, two string")
    daily = ingest.column_days(df, F.col("d").cast("date"), "t", ["one", "two"])
    first, last = F.lit("2024-01-01").cast("date"), F.lit("2024-01-02").cast("date")
    got = {r["key"]: r for r in entity.change_series(daily, 10, first, last).collect()}
    one, two = (hashlib.sha1(f"column:t:{c}".encode()).hexdigest() for c in ("one", "two"))
    assert set(got) == {one, two}
    assert (got[two]["grad_deleted"], got[two]["grad_added"]) == (1.0, None)
    # Exactly the registers of each day and column, counted plainly.
    held = {}
    for r in daily.collect():
        held.setdefault((r["key"], str(r["day"])), {})[r["bin"]] = r["word"]
    assert held == {
        (one, "2024-01-01"): registers({"x", "y"}), (one, "2024-01-02"): registers({"y", "z"}), (two, "2024-01-01"): registers({"p"}),
    }
    assert ingest.column_days(df.limit(0), F.col("d").cast("date"), "t", ["one"]).count() == 0


def test_result_page(spark):
    found = spark.createDataFrame(
        [(q, i, float(i), i) for q in (1, 2) for i in range(1, 6)], "query_id long, id long, score double, rank int"
    )
    nodes = spark.createDataFrame([(i, f"L{i}", "unread") for i in range(1, 5)], "node long, label string, more string")
    got = search.result_page(found, nodes, "node", ["label"], offset=3, limit=3).collect()
    assert sorted((r["query_id"], r["rank"], r["label"]) for r in got if r["label"]) == [(1, 4, "L4"), (2, 4, "L4")]
    assert sorted((r["query_id"], r["id"]) for r in got if r["label"] is None) == [(1, 5), (2, 5)]
    assert search.result_page(found, nodes, "node", ["label"], offset=5).count() == 0
    for bad in ({"offset": -1}, {"limit": 0}):
        with pytest.raises(ValueError):
            search.result_page(found, nodes, "node", ["label"], **bad)
    with pytest.raises(ValueError):
        search.result_page(found, nodes.withColumnRenamed("label", "score"), "node", ["score"])


def test_operands_without_registers_have_the_empty_id(spark):
    """Also for a set in all pairs, one paired with itself, and one that no sketch knows."""
    rows = [("x", t) for t in "abc"] + [("y", "b")]
    sketches = sketch.build(spark.createDataFrame(rows, "s string, t string"), F.col("s"), F.col("t"))
    ids = {r["set_id"]: r["sha1"] for r in sketch.meta(sketches).collect()}
    ids["none"] = hashlib.sha1(b"").hexdigest()
    pairs = [("x", "y"), ("x", "x"), ("x", "none"), ("none", "y")]
    found = entity.combine(sketches, pairs_of(spark, *pairs), "union", "deleted").collect()
    assert len(found) == 8 and {(r["set_a"], r["set_b"]) for r in found} == set(pairs)
    assert all(r["args"] == [ids[r["set_a"]], ids[r["set_b"]]] for r in found)
    assert all(r["sha1"] == ids["x"] for r in found if r["op"] == "union" and r["set_a"] == "x")
