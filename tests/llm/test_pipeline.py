"""The pipeline, stage by stage, against brute force on what the stage before kept."""

import re

import pytest
from plain_llm import as_rows
from pyspark.sql import functions as F
from test_line_dedup import plain as plain_lines
from test_passages import plain_leaks
from test_simhash import check_one_of_each
from test_token_counts import check_pieces, tokenizer  # noqa: F401

import corpus_pipeline
from bitloom.llm.common import stored
from bitloom.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = read_table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        out.append((name, docs))
    return dict(out)


def test_stages_are_brute_force_on_the_stage_before(spark, outputs, tokenizer):  # noqa: F811
    source = read_table(spark, FOLDER, "documents")
    quality, lines, near, clean = (outputs[n] for n in ("quality", "line_dedup", "near_dedup", "decontamination"))
    assert all(df.columns == source.columns for df in (quality, lines, near, clean))
    assert set(as_rows(quality)) <= set(as_rows(source))

    rows = sorted((r["doc_id"], r["text"]) for r in quality.collect())
    kept = [(d, t) for (d, t, gone), (_, old) in zip(plain_lines(rows, 50), rows) if len(gone) < len(old.split("\n"))]
    assert as_rows(lines, "doc_id", "text") == sorted(kept, key=repr)
    assert lines.where(F.col("n_chars") != F.length("text")).count() == 0

    rows = sorted((r["doc_id"], r["text"]) for r in lines.collect())
    check_one_of_each(rows, as_rows(near, "doc_id", "text"))

    rows = as_rows(near, "doc_id", "text")
    items = [tuple(r) for r in read_table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    leaked = {r[0] for r in plain_leaks(rows, items)}
    assert as_rows(clean, "doc_id", "text") == [r for r in rows if r[0] not in leaked]

    check_pieces(outputs["packing"].collect(), clean, tokenizer, 2048)


def test_run_is_all_stages(spark, outputs):
    columns = ["doc_id", "start", "length", "doc_tokens"]
    got = corpus_pipeline.run(spark, FOLDER).groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens"))
    want = outputs["packing"].groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens"))
    assert as_rows(got) == as_rows(want) and set(columns) <= set(outputs["packing"].columns)


def test_stages_hold_on_edge_rows(spark, docs, empty):
    docs = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            table = stored(stage(spark, table, FOLDER), name)  # as run() does
        assert not re.search("void", str(table.dtypes))
        table.collect()
