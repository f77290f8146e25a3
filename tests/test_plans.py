"""Physical plans: what is read, pushed down, shuffled and kept out."""

import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    df = driver.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_is_used(spark):
    text = plan(spark, "sketch_build")
    assert "ReadSchema: struct<text:string,lang:string>" in text
    assert "partial_bit_or" in text
    assert "Python" not in text and "ArrowEval" not in text


def test_day_filter_is_pushed_down(spark):
    assert "GreaterThanOrEqual(ts" in plan(spark, "filter_day")


def test_in_filter_is_pushed_down(spark):
    assert "PushedFilters: [In(o_orderpriority" in plan(spark, "in_filter")


def test_top_k_prunes_before_its_shuffle(spark):
    text = plan(spark, "knn_vectors_l2")
    assert text.count("WindowGroupLimit") == 4 and text.count("Partial") >= 2


@pytest.mark.parametrize("name", sorted(n for n, q in driver.queries().items() if not n.startswith("stream_")))
def test_no_cross_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
