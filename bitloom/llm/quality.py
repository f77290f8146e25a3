"""Quality by importance resampling: target against raw text, in hashed n-gram models.

Three generative models of hashed n-grams are counted over all texts (raw) and over
texts labelled as good (target): words, pairs of words, and runs of bytes in words.
The log ratio of an n-gram says how much likelier it is in the target. A text is as
good as its worst part: words and pairs are summed over windows of ``WINDOW`` words
and byte runs over single words, and the least sum counts. So a few bad words are
not outweighed by a long text around them, and long texts are not judged by length.
Both sums are scaled alike on labelled rows that no model was counted on. The k
texts with the greatest log weight plus Gumbel noise are drawn without replacement,
where k is how many texts weigh more than the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import filled, in_order, mix, nested, running_start, slices, small_batches, split_words, stored

BUCKETS = 1 << 17
WINDOW = 16
GRAM = 5
# Pseudo-counts on either side of a ratio: n-grams hardly ever seen say nothing.
PRIOR = 1.0
# Log ratios are multiples of one over it, so that sums are exact in any order and batch.
GRAIN = 1 << 20
# Labelled rows: three quarters of them, by hash, are counted in models, the others scale the sums.
LABELLED = 20_000
# The share of good labelled texts that each of the two sums may fall below its cut for.
LOSS = 0.002
# Gumbel noise is scaled by it; a typical good text weighs 1, one at the cut 0.
TEMPERATURE = 0.01
MODELS = ("word", "pair", "bytes")
# What orders rows of the same draw.
TIES = ("key", "row")
_MARKS = b".,;:!?\"'()%$#&*|"


class _Batch:
    """The n-grams of a batch of texts as buckets."""

    def __init__(self, texts: pa.Array):
        words, self.bounds = split_words(texts)
        known = words.dictionary.to_pylist()
        self.codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.n_known = len(known)
        mask = np.uint64(BUCKETS - 1)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
        self.word = (mix(hashes) & mask).astype(np.int64)
        own = hashes[self.codes] if len(known) else np.zeros(0, np.uint64)
        self.pair = (mix(own[:-1] * np.uint64(3) + own[1:]) & mask).astype(np.int64)
        # A pair is counted at its first word; the last word of a text has none.
        self.paired = np.ones(len(self.pair), bool)
        ends = self.bounds[1:-1]
        self.paired[ends[(ends > 0) & (ends <= len(self.paired))] - 1] = False
        marked = [b"\x01" + w.lower().strip(_MARKS) + b"\x02" for w in known]
        data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        starts = np.cumsum(sizes) - sizes
        grams = np.zeros(max(len(data) - GRAM + 1, 0), np.uint64)
        for j in range(GRAM):
            grams = (grams << np.uint64(8)) | data[j : j + len(grams)]
        of = np.repeat(np.arange(len(marked)), sizes)[: len(grams)]
        inside = np.arange(len(grams)) + GRAM <= (starts + sizes)[of]
        self.gram = (mix(grams[inside]) & mask).astype(np.int64)
        self.gram_of = of[inside]

    def texts_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def counts(self, chosen: np.ndarray | None) -> np.ndarray:
        """How often each bucket occurs, by model, in all texts or in the chosen ones."""
        weight = np.ones(len(self.codes)) if chosen is None else chosen[self.texts_of_words()].astype(float)
        by_word = np.bincount(self.codes, weight, self.n_known)
        pair_weight = weight[:-1][self.paired] if len(weight) else weight
        return np.stack(
            [
                np.bincount(self.word, by_word, BUCKETS),
                np.bincount(self.pair[self.paired], pair_weight, BUCKETS),
                np.bincount(self.gram, by_word[self.gram_of], BUCKETS),
            ]
        )

    def worst(self, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, its least window sum and its least word sum; 0 without words."""
        n = len(self.codes)
        flow = ratios[0][self.word][self.codes] if n else np.zeros(0)
        flow[:-1] += np.where(self.paired, ratios[1][self.pair], 0) if n else 0
        total = np.concatenate(([0.0], np.cumsum(flow)))
        text = self.texts_of_words()
        ends = np.minimum(np.arange(n) + WINDOW, self.bounds[1:][text])
        whole = (ends - np.arange(n) == WINDOW) | (np.arange(n) == self.bounds[:-1][text])
        windows = np.where(whole, total[ends] - total[:-1], np.inf)
        letters = np.bincount(self.gram_of, ratios[2][self.gram], self.n_known)[self.codes] if n else np.zeros(0)
        some = np.diff(self.bounds) > 0
        out = []
        for values in (windows, letters):
            least = np.zeros(len(some))
            least[some] = np.minimum.reduceat(values, self.bounds[:-1][some]) if some.any() else 0
            out.append(least)
        return out[0], out[1]


def _labelled(labels: DataFrame, id_col: str, quality_col: str, toxic_col: str, most: int) -> DataFrame:
    """(id, good, fit): at most ``most`` labelled ids; ``fit`` are those to count in models."""
    known = labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("quality"), F.col(toxic_col).alias("toxic")).dropna()
    one = known.groupBy("id").agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good"))
    chosen = one.orderBy(F.xxhash64("id"), "id").limit(most)
    return chosen.withColumn("fit", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) > 0)


def log_ratios(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """The log ratio of each bucket of each model; a table of fixed size."""
    target = labelled.where("good AND fit").select("id", F.lit(True).alias("target"))
    # The labelled ids are bounded in number, so the texts need no shuffle to meet them.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(target), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros((2, len(MODELS), BUCKETS))
        for batch in slices(batches, "text"):
            own = _Batch(batch.column(0))
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            raw += own.counts(None)
            if chosen.any():
                good += own.counts(chosen)
        model, bucket = np.nonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (model.astype(np.int32), bucket.astype(np.int32), raw[model, bucket], good[model, bucket])],
            ["model", "bucket", "raw", "good"],
        )

    sums = rows.mapInArrow(count, "model int, bucket int, raw double, good double")
    # At most a row for each bucket, fetched as Arrow columns: as Python objects they take some 200 MB of the driver.
    sums = sums.groupBy("model", "bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    with small_batches(docs.sparkSession):
        sums = sums.toArrow()
    raw, good = np.zeros((2, len(MODELS), BUCKETS))
    for part in sums.to_batches():
        model, bucket, n_raw, n_good = (column.to_numpy(zero_copy_only=False) for column in part.columns)
        raw[model, bucket], good[model, bucket] = n_raw, n_good
    expected = raw * good.sum(axis=1, keepdims=True) / np.maximum(raw.sum(axis=1, keepdims=True), 1)
    return np.round(np.log((good + PRIOR) / (expected + PRIOR)) * GRAIN) / GRAIN


def _worst(text: Column, ratios: np.ndarray) -> Column:
    @F.arrow_udf("flow double, letters double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], ["text"])
            parts = [_Batch(filled(b.column(0))).worst(ratios) for b in slices(iter([batch]), "text")]
            flow, letters = (np.concatenate(x) if parts else np.zeros(0) for x in (list(zip(*parts)) or ((), ())))
            yield pa.StructArray.from_arrays([pa.array(flow), pa.array(letters)], ["flow", "letters"])

    return of(text)


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    toxic_col: str = "toxic",
    most_labelled: int = LABELLED,
    loss: float = LOSS,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """The texts drawn: all columns of ``docs`` as the struct ``doc``, and ``log_weight``.

    Labels are 1 or 0; a text is good if its least quality is 1 and its greatest
    toxicity 0, rows with a null say nothing. At most ``most_labelled`` ids are
    used, the first by hash. A null text counts as empty, and a text without words
    has all ratios 1. Without labels that fit and scale the models every row
    weighs 1 and is kept. Noise follows from a row's id and text, so the draw is the
    same however the table is partitioned. Rows alike in both have the same noise;
    where the last place falls among them, the first in the order of reading are
    drawn. An empty table gives no rows.
    """
    keyed = nested(docs)
    labelled = stored(_labelled(labels, id_col, quality_col, toxic_col, most_labelled), "quality-labels")
    ratios = log_ratios(docs, labelled, id_col, text_col)
    held = labelled.where("good AND NOT fit").select(F.col("id").alias("labelled_id"))
    scored = keyed.withColumn("worst", _worst(F.col(f"doc.{text_col}").cast("string"), ratios))
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "quality-scores")
    sums = scored.select(F.col(f"doc.{id_col}").alias("id"), "row", "worst.*")
    known = sums.join(F.broadcast(held), F.col("id") == F.col("labelled_id"), "left_semi")
    at = known.agg(*(F.percentile(c, F.array(F.lit(loss), F.lit(0.5))).alias(c) for c in ("flow", "letters"))).first()
    weights = []
    for c in ("flow", "letters"):
        cut, middle = at[c] or (0.0, 0.0)
        # Without spread among good texts the sum can't tell texts apart.
        weights.append((F.col(f"worst.{c}") - cut) / (middle - cut) if middle > cut else F.lit(1.0))
    weight = F.least(*weights)
    key = F.xxhash64(f"doc.{id_col}", F.coalesce(F.col(f"doc.{text_col}").cast("string"), F.lit("")))
    share = (F.pmod(F.xxhash64("key", F.lit(2)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = scored.withColumn("log_weight", weight).withColumn("key", key)
    scored = scored.withColumn("draw", F.col("log_weight") - temperature * F.log(-F.log(share)))
    k = scored.where("log_weight >= 0").count()
    order = [F.col("draw").desc(), *(F.col(c) for c in TIES)]
    ranked = running_start(in_order(scored.select("draw", *TIES), order, "quality-order"), order, F.lit(1), "rank")
    last = ranked.where(F.col("rank") == k - 1).first()
    if last is None:
        return scored.select("doc", "log_weight").limit(0)
    tied = F.struct(*TIES) <= F.struct(*(F.lit(last[c]).alias(c) for c in TIES))
    drawn = (F.col("draw") > last["draw"]) | ((F.col("draw") == last["draw"]) & tied)
    return scored.where(drawn).select("doc", "log_weight")
