"""What a Python worker gets and makes at once is bounded by bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from bitloom.llm import common

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_bytes(spark):
    """The bytes of each batch that stored rows come from: 20 MB of texts in one task, under 10,000 rows."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    return [r["n"] for r in common.stored(texts.mapInArrow(sizes, "n long"), "batches").collect()]


def test_batches_are_cut_by_bytes(spark):
    found = batch_bytes(spark)
    assert sum(found) >= 20_000_000
    assert max(found) < 1.1 * common.BATCH_BYTES
    assert spark.conf.get(SETTING, None) is None


def test_a_setting_of_the_session_holds(spark):
    spark.conf.set(SETTING, "10m")
    try:
        assert max(batch_bytes(spark)) > 8_000_000
        assert spark.conf.get(SETTING) == "10m"
    finally:
        spark.conf.unset(SETTING)


def test_words_at_the_ends_of_texts():
    texts = pa.array(["x", "a b", None, "", " ", "c", "d e ", "\tf"])
    words, starts = common.split_words(texts.slice(1))
    assert words.to_pylist() == [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert starts.tolist() == [0, 2, 2, 2, 2, 3, 5, 6]
