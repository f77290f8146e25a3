"""Phrases whose words come together more often than apart, by prefix-free parsing.

A piece of text is cut where a window of ``LONGEST - 1`` words has a hash that the
modulus ``EVERY`` divides, so equal passages are cut alike wherever they stand. Chunks
overlap by that window: every phrase lies whole in the chunk that its first word
belongs to, and the window's own words count in the next chunk alone. The distinct
chunks are a dictionary with how often each occurs in the parse, and phrases are
counted inside distinct chunks, weighted by it.

Words, pairs and longer phrases are counted one length after another. A phrase that
is frequent has frequent parts only, so a map of fixed size tells most others apart
before they are shuffled; what passes it is counted by its text, so the map loses and
adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import filled, mix, stored
from bitloom.operators import skew

LONGEST = 3
# Bytes of text, or of chunks, that are worked on at once: more, as equal phrases meet early.
SLICE_BYTES = 8_000_000
# One window of words in so many ends a chunk.
EVERY = 8
# A chunk has at most so many words, whatever they are.
MOST_WORDS = 512
# Bits of the map of frequent words or phrases; two megabytes.
MAP_BITS = 1 << 24
# What ends a piece, and what divides words.
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS)] = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _segments(text: bytes, most: int) -> Iterator[tuple[bytes, bool]]:
    """A long text in segments of about ``most`` bytes, and whether a segment's last piece goes on in the next.

    A segment ends where a piece ends if that is near, else after a word; then the
    next one begins with the last LONGEST - 1 words again, as chunks do.
    """
    start = 0
    while len(text) - start > most:
        kinds = _KIND[np.frombuffer(text, np.uint8, min(2 * most, len(text) - start), start)]
        marks = np.flatnonzero(kinds[:most] == 2)
        if len(marks) and marks[-1] >= most // 2:
            stop = int(marks[-1]) + 1
            yield text[start : start + stop], False
            start += stop
            continue
        gaps = np.flatnonzero(kinds[most:])
        stop = most + int(gaps[0]) if len(gaps) else len(kinds)
        inside = kinds[:stop] == 0
        first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        first = first[first > marks[-1]] if len(marks) else first
        if not len(gaps) or len(first) <= LONGEST:
            # Hardly a word in all these bytes: segments have to be longer.
            yield from _segments(text[start:], 2 * most)
            return
        yield text[start : start + stop], True
        start += int(first[-(LONGEST - 1)])
    yield text[start:], False


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Words with A-Z lower-cased, where each piece's words start (one place more), and each piece's text.

    ``data`` are the bytes of texts, ``bounds`` where each starts and the last ends;
    pieces without words are left out.
    """
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    kinds = _KIND[data]
    inside = kinds == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    packed = data[inside]
    places = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, len(packed))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(packed)])
    text = np.searchsorted(bounds, starts, "right") - 1
    # Both only grow, so their sum changes where either does.
    heads = np.flatnonzero(np.diff(np.cumsum(kinds == 2)[starts] + text, prepend=-1))
    return words.cast(pa.large_string()).dictionary_encode(), np.append(heads, len(starts)), text[heads]


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _chunks(words: pa.DictionaryArray, pieces: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Chunks as words with one blank between, whether each is its piece's last, and its piece."""
    codes = words.indices.to_numpy(zero_copy_only=False)
    hashes = _hashes(words.dictionary)[codes]
    n, wide = len(codes), LONGEST - 1
    place = np.arange(n)
    head, end = (np.repeat(at, np.diff(pieces)) for at in (pieces[:-1], pieces[1:]))
    window = np.zeros(n, np.uint64)
    for j in range(wide):
        window = mix(window * _ODD + hashes[np.minimum(place + j, n - 1)])
    cut = (window % np.uint64(EVERY) == 0) | ((place - head) % MOST_WORDS == 0)
    starts = np.flatnonzero(cut & (place + wide <= end) | (place == head))
    following = np.append(starts[1:], n)
    last = following >= end[starts]
    sizes = np.where(last, end[starts], following + wide) - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    each = words.dictionary.take(pa.array(codes[take], pa.int64()))
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), each)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())), last, np.searchsorted(pieces, starts, "right") - 1


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(bytes, bounds, rows, goes on): as many texts as a slice holds, or a segment of a longer one."""
    texts = filled(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        if len(part) > SLICE_BYTES:
            for segment, goes_on in _segments(part.tobytes(), SLICE_BYTES):
                yield np.frombuffer(segment, np.uint8), np.array([0, len(segment)]), np.array([at]), goes_on
        else:
            yield part, offsets[at : to + 1] - offsets[at], np.arange(at, to), False
        at = to


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, chunk, last): each text's parse."""
    for batch in batches:
        for data, bounds, rows, goes_on in _slices(batch.column(1)):
            words, pieces, text = _words(data, bounds)
            if len(words):
                chunks, last, piece = _chunks(words, pieces)
                last[-1] &= not goes_on
                lang = batch.column(0).take(pa.array(rows[text[piece]], pa.int64()))
                yield pa.RecordBatch.from_arrays([lang, chunks.cast(pa.string()), pa.array(last)], ["lang", "chunk", "last"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together, up to about ``SLICE_BYTES``, so that equal phrases meet early."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class _Phrases:
    """The words of a table's texts (single blanks between), by code, with hashes of runs of words."""

    def __init__(self, table: pa.Table):
        texts = filled(table.column(1))
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        words, self.at, _ = _words(data, bounds - bounds[0])
        self.words, self.codes = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        langs = table.column(0).combine_chunks().dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.at))
        self._lang_hash, self._word_hash = _hashes(self.langs), _hashes(self.words)

    def bits(self, places: np.ndarray, length: int) -> np.ndarray:
        """Which bit of the map stands for the run of words at each place."""
        run = self._lang_hash[self.lang[self.row[places]]]
        for j in range(length):
            run = mix(run * _ODD + self._word_hash[self.codes[places + j]])
        return (run % np.uint64(MAP_BITS)).astype(np.int64)


def _count(length: int, frequent: np.ndarray | None):
    """(lang, phrase, f): phrases of ``length`` words, chunks weighted by how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            if not table.num_rows:
                continue
            held = _Phrases(table)
            end = held.at[1:][held.row]
            place = np.arange(len(held.codes))
            own = table.column(2).to_numpy()[held.row] | (place < end - (LONGEST - 1))
            place = place[own & (place + length <= end)]
            if frequent is not None:
                for shift in range(2):
                    bits = held.bits(place + shift, length - 1)
                    place = place[(frequent[bits // 8] >> (bits % 8).astype(np.uint8) & 1).astype(bool)]
            key = held.lang[held.row[place]]
            for j in range(length):
                key = np.unique(key * len(held.words) + held.codes[place + j], return_inverse=True)[1]
            _, first, kinds = np.unique(key, return_index=True, return_inverse=True)
            # Whole numbers below 2^53, so the sum is exact.
            f = np.bincount(kinds, table.column(3).to_numpy()[held.row[place]], len(first)).astype(np.int64)
            at = place[first]
            parts = [held.words.take(pa.array(held.codes[at + j])) for j in range(length)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
            lang = held.langs.take(pa.array(held.lang[held.row[at]]))
            yield pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(f)], ["lang", "phrase", "f"])

    return count


def _map(phrases: DataFrame, length: int) -> np.ndarray:
    """The bits of all ``phrases`` (lang, phrase) of one length, in a map of fixed size."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            if table.num_rows:
                held = _Phrases(table)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(held.bits(held.at[:-1], length)))], ["bit"])

    found = phrases.select("lang", "phrase").mapInArrow(bits, "bit long")
    cells = found.groupBy(F.expr("bit div 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    out = np.zeros(MAP_BITS // 64, np.int64)
    # At most MAP_BITS / 64 rows.
    table = cells.toArrow()
    out[table.column("cell").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint8)


def dictionary(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, chunk, last, n): the distinct chunks of the parse and how often each occurs.

    ``last`` tells a chunk that ends its piece from one that another follows, whose
    last LONGEST - 1 words belong to the next.
    """
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    parsed = docs.select(lang.alias("lang"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        _parse, "lang string, chunk string, last boolean"
    )
    return parsed.groupBy("lang", "chunk", "last").agg(F.count("*").alias("n"))


def phrase_counts(chunks: DataFrame, least: int) -> list[DataFrame]:
    """(lang, phrase, f) for one word, two words and so on; from two words on, ``f`` is ``least`` or more."""

    def counted(length: int, frequent: np.ndarray | None) -> DataFrame:
        found = chunks.select("lang", "chunk", "last", "n").mapInArrow(_count(length, frequent), "lang string, phrase string, f long")
        return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))

    out = [stored(counted(1, None), "phrases-1")]
    for length in range(2, LONGEST + 1):
        frequent = _map(out[-1].where(F.col("f") >= least), length - 1)
        out.append(stored(counted(length, frequent).where(F.col("f") >= least), f"phrases-{length}"))
    return out


def _scored(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, a) with ``l``, ``r`` and ``score`` of their lowest-scoring cut."""
    words = F.split("phrase", " ")
    sides = [
        F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.array_join(cut, " ").alias("part"))
        for k in range(1, LONGEST)
        for side, cut in (("l", F.slice(words, 1, k)), ("r", F.slice(words, k + 1, F.size(words))))
    ]
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.array(*sides)).alias("cut")).select("lang", "phrase", "a", "cut.*")
    cuts = cuts.where(F.col("k") < F.size(words))
    found = skew.lookup(cuts, parts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    f = {
        (k, side): F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
        for k in range(1, LONGEST)
        for side in "lr"
    }
    wide = found.groupBy("lang", "phrase", "a").agg(*f.values())
    whole = "cast({} as decimal(20,0))".format

    def cut(k: int) -> Column:
        # Products of up to 38 digits, exact for counts below 10^16; the score fits a long.
        score = F.expr(f"({whole('a')} * {whole('a')} * 1000000) div ({whole(f'l{k}')} * {whole(f'r{k}')})")
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    # Two elements at least, as the least of one is asked for in the same way.
    least = F.array_min(F.array(*(cut(k) for k in range(1, LONGEST)))).alias("cut")
    return wide.select("lang", "phrase", "a", least).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _shorter(phrase: Column) -> Column:
    """All phrases of two words or more inside a phrase."""
    words = F.split(phrase, " ")

    def runs(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - size + 1))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))

    return F.array_remove(F.array_distinct(F.flatten(F.array(*(runs(size) for size in range(2, LONGEST))))), phrase)


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = 10,
    share: int = 50,
    top: int = 2000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to LONGEST words.

    A phrase has at least ``least`` occurrences ``a`` inside pieces of text, overlapping
    ones included; ``n`` counts the language's words. Of the ways to cut it in two the
    one with the lowest floor(10^6 a a / (l r)) counts, the first of equal ones. A
    phrase inside a longer one that has at least ``share`` percent of its occurrences
    is left out. Ranks follow score and ``a``, descending, and then the phrase's bytes.

    A null text is empty, a null language is ``und``. Only A-Z are lower-cased.
    Repeated rows count as often as they are there. Ids and other columns play no
    part; texts without two words and an empty table give no rows. Texts above
    ``SLICE_BYTES`` are worked through in segments.
    """
    chunks = stored(dictionary(docs, lang_col, text_col), "phrases-chunks")
    counted = phrase_counts(chunks, least)
    total = counted[0].groupBy("lang").agg(F.sum("f").alias("n"))
    common = [c.where(F.col("f") >= least) for c in counted]
    candidates, parts = common[1], common[0]
    for longer, shorter in zip(common[2:], common[1:-1]):
        candidates, parts = candidates.unionAll(longer), parts.unionAll(shorter)
    scored = _scored(candidates.withColumnRenamed("f", "a"), parts)
    inside = candidates.where(F.size(F.split("phrase", " ")) > 2)
    inside = inside.select("lang", F.explode(_shorter(F.col("phrase"))).alias("phrase"), F.col("f").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = skew.top_k(kept.drop("longer"), "lang", order, top, ["phrase"])
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


# Every phrase of every piece counted by itself.
SQL = r"""
WITH piece AS (SELECT lang, row_number() OVER () AS id, p FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS p FROM documents)),
word AS (SELECT lang, id, unnest(regexp_extract_all(p, '[^ \t]+')) AS w, generate_subscripts(regexp_extract_all(p, '[^ \t]+'), 1) AS i FROM piece),
run AS (SELECT lang, w, lead(w) OVER win AS w2, lead(w, 2) OVER win AS w3 FROM word WINDOW win AS (PARTITION BY id ORDER BY i)),
occ AS (SELECT lang, 1 AS k, w AS phrase FROM run UNION ALL SELECT lang, 2, w || ' ' || w2 FROM run WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM run WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS f FROM occ GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, k, phrase, a, c, array_to_string(ws[1:c], ' ') AS lp, array_to_string(ws[c + 1:k], ' ') AS rp
  FROM cand, (VALUES (1), (2)) AS s(c) WHERE c < k),
scored AS (SELECT cut.lang, cut.k, cut.phrase, a, l.f AS l, r.f AS r, c,
    ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a AS longer FROM cand WHERE k = 3),
hidden AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN hidden h ON b.k = 2 AND h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang) WHERE rank <= 2000
"""
