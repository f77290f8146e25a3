"""License notices in documents, by MinHash of overlapping windows.

A notice of n five-word shingles is looked for in windows of 2S shingles, one from
every S-th shingle on, where S is the least power of two not below n: so one window
holds any passage of n shingles whole. Each of ``BANDS`` bands is one MinHash value.
A window that holds 0.8 of a notice has a Jaccard similarity of at least 0.19 with
it, one that holds it whole 0.25, so they share a band with a probability of 0.998
and 0.9999. Windows and notices that share a band are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import bare, filled, hashed_words, mix, shingles, slices, stored

K = 5
CONTAINMENT = 0.8
BANDS = 32
MAP_BITS = 1 << 22
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)

# Notices of public licenses.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "MIT": "Released under the MIT License",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
}


def notices(spark: SparkSession) -> DataFrame:
    """(license, text): the notices looked for unless others are given."""
    return spark.createDataFrame(sorted(NOTICES.items()), "license string, text string")


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _templates(texts: DataFrame) -> DataFrame:
    """(license, s, runs, values): each notice's size class, shingles and MinHash values."""
    kind = texts.schema["license"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            runs, at = shingles(*hashed_words(filled(batch.column(1)), bare), K)
            some = np.flatnonzero(np.diff(at) > 0)
            own = [np.unique(runs[at[i] : at[i + 1]]) for i in some]
            classes = [1 << int(np.diff(at)[i] - 1).bit_length() for i in some]
            values = [_signed((r[:, None] * _SEEDS).min(axis=0)) for r in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array(classes, pa.int32()), pa.array(map(_signed, own), pa.list_(pa.int64())), pa.array(values, pa.list_(pa.int64()))],
                ["license", "s", "runs", "values"],
            )

    return texts.mapInArrow(read, f"license {kind}, s int, runs array<long>, values array<long>")


def _place(values: np.ndarray, size: int, band: int) -> np.ndarray:
    """Where a band's values stand in the bit map."""
    return (values * np.uint64(2 * size + 1) + np.uint64(band)) >> np.uint64(64 - MAP_BITS.bit_length() + 1)


def _bit_map(bands: DataFrame) -> np.ndarray:
    """A bit for each band value of the notices, in a map of fixed size."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, band, value = (batch.column(i).to_numpy() for i in range(3))
            at = [_place(np.array([v], np.int64).view(np.uint64), int(c), int(b))[0] for c, b, v in zip(s, band, value)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(at, np.int64))], ["at"])

    found = bands.select("s", "band", "value").mapInArrow(mark, "at long").distinct().toPandas()
    known = np.zeros(MAP_BITS, bool)
    known[found["at"]] = True
    return known


def _candidates(docs: DataFrame, known: np.ndarray, classes: list[int], id_col: str, text_col: str) -> DataFrame:
    """Windows with a band in the map: id, size class, start, shingles, bands and values."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            runs, at = shingles(*hashed_words(filled(batch.column(1)), bare), K)
            found: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for band in range(BANDS):
                size, blocks = 1, runs * _SEEDS[band]
                while len(blocks) and size <= classes[-1]:
                    if size in classes:
                        # Windows run on into the next text; its shingles are left out below.
                        least = np.minimum(blocks, np.append(blocks[1:], blocks[-1]))
                        for w in np.flatnonzero(known[_place(least, size, band)]):
                            found.setdefault((size, int(w)), []).append((band, int(least[w])))
                    if len(blocks) % 2:
                        blocks = np.append(blocks, blocks[-1])
                    blocks = np.minimum(blocks[::2], blocks[1::2])
                    size *= 2
            out = [[] for _ in range(6)]
            for (size, w), bands in found.items():
                a, b = w * size, min((w + 2) * size, len(runs))
                for t in range(int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, b, "left"))):
                    low, high = max(a, int(at[t])), min(b, int(at[t + 1]))
                    if low < high:
                        values = np.array([v for _, v in bands], np.uint64)
                        for column, value in zip(out, (t, size, low - int(at[t]), _signed(runs[low:high]), [x for x, _ in bands], _signed(values))):
                            column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(c, k) for c, k in zip(out[1:], kinds))],
                ["id", "s", "start", "runs", "bands", "values"],
            )

    schema = f"id {kind}, s int, start int, runs array<long>, bands array<int>, values array<long>"
    return rows.mapInArrow(scan, schema)


def license_notices(
    docs: DataFrame,
    texts: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(id, ``license``, ``containment``, ``start``): the notices that documents hold.

    ``texts`` has the columns license and text. A document holds a notice if a
    window has at least ``containment`` of its distinct five-word shingles; words
    are compared without case (of A-Z) and marks around them, words of marks only
    are left out. One row per id and notice, with the greatest containment and the
    first shingle of the first window that has it. A notice or text of fewer than
    five words has its whole sequence as its shingle; one without words, or null,
    matches nothing. Rows that repeat an id are one document. Other columns are not
    carried; an empty table on either side gives no rows.
    """
    texts = notices(docs.sparkSession) if texts is None else texts.select("license", F.col("text").cast("string"))
    templates = stored(_templates(texts).withColumn("notice", F.monotonically_increasing_id()), "license-templates")
    bands = templates.select("notice", "s", F.posexplode("values").alias("band", "value"))
    classes = [r["s"] for r in templates.select("s").distinct().orderBy("s").collect()]
    if not classes:
        return docs.select(F.col(id_col), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("start")).limit(0)
    found = _candidates(docs, _bit_map(bands), classes, id_col, text_col)
    windows = stored(found.withColumn("window", F.monotonically_increasing_id()), "license-windows")
    keys = windows.select("window", "s", F.explode(F.arrays_zip("bands", "values")).alias("key"))
    keys = keys.select("window", "s", F.col("key.bands").alias("band"), F.col("key.values").alias("value"))
    pairs = keys.join(bands, ["s", "band", "value"]).select("window", "notice").distinct()
    both = pairs.join(windows.select("window", "id", "start", "runs"), "window").join(
        templates.select("notice", "license", F.col("runs").alias("wanted")), "notice"
    )
    share = F.size(F.array_intersect("runs", "wanted")) / F.size("wanted")
    held = both.withColumn("containment", share).where(F.col("containment") >= containment)
    best = F.max_by(F.struct("containment", "start"), F.struct("containment", -F.col("start")))
    return held.groupBy(F.col("id").alias(id_col), "license").agg(best.alias("best")).select(id_col, "license", "best.*")
