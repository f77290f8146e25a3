import pytest
from pyspark.sql import functions as F
from plain_sets import h63

from bitloom.functions import text, vectors
from bitloom.operators import tokens

ROWS = [("r1", 1, "aaa"), ("r1", 1, "aaa"), ("r1", 2, "aaa"), ("r2", 3, "aaa"), ("r2", 3, "bbb"), ("r3", 4, None)]


@pytest.fixture(scope="module")
def post(spark):
    return tokens.postings(spark.createDataFrame(ROWS, "ref string, batch int, token string"))


def test_indexes(post):
    batch = {r["id"]: r for r in tokens.index_batch(post).collect()}
    refs = {r["id"]: r for r in tokens.index_refs(post).collect()}
    a, b = h63("aaa"), h63("bbb")
    assert set(batch) == {a, b}
    assert (batch[a]["tokens"], batch[a]["refs"], batch[a]["tf"]) == (["aaa"], ["r1", "r2"], 3)
    assert (refs[a]["tf"], refs[a]["df"], refs[b]["tf"], refs[b]["df"]) == (1, 2, 0, 1)
    assert batch[a]["bin"] == (a >> 53) + 1
    low = a & ((1 << 54) - 1)
    assert batch[a]["zeros"] == (low & -low).bit_length() - 1


def test_merging_equals_ingesting_at_once(spark, post):
    df = spark.createDataFrame(ROWS, "ref string, batch int, token string")
    parts = [tokens.postings(df.where(F.col("batch") <= 2)), tokens.postings(df.where(F.col("batch") > 2))]
    merged = tokens.merge_postings(*parts)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, post.collect()))


@pytest.mark.parametrize(
    "conditions, hits",
    [
        ([("refs", "match", "r1 r9")], ["aaa"]),
        ([("refs", "has", "r2")], ["aaa", "bbb"]),
        ([("refs", "has", "r")], []),
        ([("refs", "match", "")], []),
        ([("tf", ">", 1), ("refs", "has", "r2")], ["aaa"]),
        ([("tf", "<", "2")], ["bbb"]),
        ([("tf", "==", 3)], ["aaa"]),
        ([("tf", "!=", 3)], ["bbb"]),
        ([("refs", "==", "r1,r2")], ["aaa"]),
        ([("nothing", "==", 1)], []),
        ([("tf", "~", 1)], []),
        ([], ["aaa", "bbb"]),
    ],
)
def test_token_query(post, conditions, hits):
    found = tokens.token_query(tokens.index_batch(post), conditions)
    assert sorted(r["id"] for r in found.collect()) == sorted(h63(t) for t in hits)


def test_text_search_ranks_and_breaks_ties(spark, post):
    texts = spark.createDataFrame([(1, "BBB aaa"), (2, "nothing here")], "q int, text string")
    got = [tuple(r) for r in tokens.text_to_refs(texts, "q", tokens.index_batch(post), 5).collect()]
    assert sorted(got) == [(1, "r1", 1, 2), (1, "r2", 2, 1)]
    index = tokens.index_batch(post)
    assert tokens.text_to_tokens(texts, "q", index).count() == 2


def test_column_tokens(spark):
    df = spark.createDataFrame([("Ab c", 7), (None, 8)], "x string, y int")
    rows = tokens.column_tokens(df, "t", ["x", "y"]).collect()
    assert sorted(r["token"] for r in rows) == ["7", "8", "ab", "c"]
    assert len({r["column_id"] for r in rows}) == 2


def test_text_functions(spark):
    df = spark.createDataFrame([("Ärger, isn't 'x y' 'z'",), (None,), ("  ",)], "s string")
    s = F.col("s")
    got = df.select(text.words(s), text.quoted_extract(s), text.split_whitespace(s)).collect()
    assert got[0][0] == ["ärger", "isn", "t", "x", "y", "z"]
    assert got[0][1] == "t " and got[1][1] == "" and got[2][1] == ""
    assert got[1][0] is None and got[2][0] == [] and got[2][2] == []
    lens = spark.createDataFrame([("ab",), ("äb",), ("é",), ("abc",)], "t string")
    assert [r[0] for r in lens.where(text.longer_than(F.col("t"))).collect()] == ["äb", "abc"]


def test_vector_functions(spark):
    df = spark.createDataFrame([([4, 21, 63, 114], [5, 223, 200, 123])], "a array<bigint>, b array<bigint>")
    a, b = F.col("a"), F.col("b")
    row = df.select(*(vectors.bit_op(a, b, op) for op in ("XOR", "AND", "OR"))).first()
    assert list(row) == [[1, 202, 247, 9], [4, 21, 8, 114], [5, 223, 255, 123]]
    with pytest.raises(ValueError):
        vectors.bit_op(a, b, "NAND")
    with pytest.raises(Exception, match="same length"):
        df.select(vectors.bit_op(a, F.slice(b, 1, 2), "OR")).collect()
    assert df.select(vectors.odd_sum(a)).first()[0] == 84


def test_index_of_texts_shuffles_its_words_once(spark):
    words = ["Alpha beta", "beta beta gamma", "", None, "gamma delta xy", "ärger"]
    rows = [(f"r{i % 151:03}" if i % 7 else None, i, words[i % 6] + f" w{i % 11}w" if words[i % 6] is not None else None) for i in range(600)]
    texts = spark.createDataFrame(rows, "ref string, batch int, text string")
    long = texts.select("ref", "batch", F.explode(text.distinct_words(F.col("text"))).alias("token")).where(text.longer_than(F.col("token")))
    got, want = tokens.index_texts(texts), tokens.index_batch(tokens.postings(long, distinct=True))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # More refs than one number has bits, and tokens that no text with a ref has.
    assert max(len(r["refs"]) for r in got.collect()) > tokens.REF_BITS
    alone = tokens.index_texts(spark.createDataFrame([(None, 1, "lone")], "ref string, batch int, text string")).first()
    assert (alone["tokens"], alone["refs"], alone["tf"]) == (["lone"], [], 1)
    assert tokens.index_texts(texts.limit(0)).count() == 0


def test_documents_are_not_indexed_by_ref_and_token(spark):
    import __spark_entry__ as driver

    plan = driver.queries()["token_index_batch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ref" not in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
