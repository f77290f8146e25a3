"""Repeated runs of lines by a suffix array over line ids, built by prefix doubling.

Every line is a symbol. Round k ranks all suffixes by their first 2^k lines, from
the ranks of the round before at the suffix and 2^(k-1) lines on; a suffix whose
first lines occur once needs no more rounds and leaves. Suffixes that agree on a
given number of lines form an interval of the suffix array; two overlapping ranks
name it. A run is worth removing from ``min_words`` words on, so of every repeated
run only the intervals of its shortest pieces with that many words, one from each
line on and one up to each line, are needed: together they cover the run and
nothing else, however long it is. All but the first of an interval are deleted.
Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import in_order, nested, running_start, stored

MIN_WORDS = 50
# Fixed value: a word is what stands between ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_table(keyed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, n, g, rem, h1, h2, words): the corpus' lines; ``g`` numbers them in its order."""
    text = F.col(f"doc.{text_col}").cast("string")
    # Two hashes with unlike seeds make the line id, as one is too short for all the lines of a large corpus.
    symbol = lambda line: F.struct(
        F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), F.regexp_count(line, F.lit(WORD)).alias("words")
    )
    texts = keyed.where(text.isNotNull()).select(
        F.col(f"doc.{id_col}").alias("id"), F.xxhash64(text).alias("digest"), "row", F.transform(_lines(text), symbol).alias("lines")
    )
    order = [F.col("id").asc_nulls_last(), F.col("digest"), F.col("row")]
    ordered = in_order(texts, order, "lines-texts")
    begun = running_start(ordered, order, F.size("lines").cast("long"), "start")
    lines = begun.select("row", "start", F.size("lines").alias("size"), F.posexplode("lines").alias("n", "line"))
    return stored(
        lines.select("row", "n", (F.col("start") + F.col("n")).alias("g"), (F.col("size") - F.col("n")).alias("rem"), "line.*"),
        "lines",
    )


def _ranked(suffixes: DataFrame, symbols: list[str], label: str) -> DataFrame:
    """Suffixes whose symbols occur twice or more, with their ``rank`` in place of the symbols.

    The rank is the number of such suffixes with lesser symbols, so it keeps the order.
    """
    shared = suffixes.groupBy(*symbols).agg(F.count("*").alias("n")).where("n > 1")
    order = [F.col(s) for s in symbols]
    ranks = running_start(in_order(shared, order, f"{label}-symbols"), order, F.col("n"), "rank")
    return stored(suffixes.join(ranks.select(*symbols, "rank"), symbols).drop(*symbols), label)


def _doubled(ranks: DataFrame, span: int, label: str) -> DataFrame:
    """Ranks by twice as many lines as ``span``, the number that ``ranks`` go by."""
    here = ranks.where(F.col("rem") > span).select((F.col("g") + span).alias("at"), "g", "rem", F.col("rank").alias("r1"))
    there = ranks.select(F.col("g").alias("at"), F.col("rank").alias("r2"))
    return _ranked(stored(here.join(there, "at").drop("at"), f"{label}-pairs"), ["r1", "r2"], label)


def _pieces(lines: DataFrame, min_words: int) -> DataFrame:
    """(row, base, s, len): the shortest pieces of ``min_words`` words from and up to each line.

    ``lines`` are the lines that occur more than once; pieces with another line in
    them occur once and are left out.
    """
    by_n = Window.partitionBy("row").orderBy("n")
    lines = lines.withColumn("streak", F.col("n") - F.row_number().over(by_n))
    upto = F.sum("words").over(Window.partitionBy("row", "streak").orderBy("n"))
    lines = lines.withColumns({"upto": upto, "base": F.col("g") - F.col("n")}).withColumn("before", F.col("upto") - F.col("words"))
    # Marks and wishes of both directions in one table: one sort finds, for each line, the best line among those
    # whose mark meets its wish. Ahead that is the first mark of its key or more, back the last of its key or less.
    asks = [(1, 0, -F.col("upto")), (1, 1, -(F.col("before") + min_words)), (0, 0, F.col("before")), (0, 1, F.col("upto") - min_words)]
    points = F.array(*(F.struct(F.lit(d).alias("ahead"), F.lit(a).alias("asks"), key.cast("long").alias("key")) for d, a, key in asks))
    points = lines.select("row", "base", "streak", "n", F.explode(points).alias("point")).select("row", "base", "streak", "n", "point.*")
    over = Window.partitionBy("row", "streak", "ahead").orderBy("key", "asks").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("asks") == 0, F.col("n"))
    found = points.withColumns({"least": F.min(mark).over(over), "most": F.max(mark).over(over)}).where("asks = 1 AND least IS NOT NULL")
    s = F.when(F.col("ahead") == 1, F.col("n")).otherwise(F.col("most"))
    upto = F.when(F.col("ahead") == 1, F.col("least")).otherwise(F.col("n"))
    return found.select("row", "base", s.alias("s"), (upto - s + 1).alias("len")).distinct()


def repeated_lines(keyed: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, dropped): the line numbers of each row that belong to later copies of runs."""
    lines = _line_table(keyed, id_col, text_col)
    ranks = _ranked(lines, ["h1", "h2"], "lines-ranks")
    pieces = stored(_pieces(ranks, min_words), "lines-pieces")
    longest = pieces.agg(F.max("len")).first()[0] or 0
    level, span = ranks.select("g", "rem", "rank"), 1
    levels = level.select(F.lit(0).alias("k"), "g", "rank")
    k = 0
    while 2 * span <= longest:
        level = _doubled(level, span, "lines-ranks")
        span, k = 2 * span, k + 1
        levels = levels.unionAll(level.select(F.lit(k).alias("k"), "g", "rank"))
    top = F.length(F.bin(F.col("len").cast("long"))) - 1
    asked = pieces.withColumns({"k": top.cast("int"), "g": F.col("base") + F.col("s")})
    asked = asked.join(levels.withColumnRenamed("rank", "r1"), ["k", "g"])
    asked = asked.withColumnRenamed("g", "begin").withColumn("g", F.expr("begin + len - shiftleft(1L, k)"))
    asked = stored(asked.join(levels.withColumnRenamed("rank", "r2"), ["k", "g"]), "lines-intervals")
    interval = ["len", "r1", "r2"]
    first = asked.groupBy(*interval).agg(F.min("begin").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written, so that the join shuffles both sides itself and can split an interval of very many copies.
    first = stored(first.drop("n"), "lines-firsts")
    later = asked.join(first, interval).where(F.col("begin") > F.col("first"))
    n = F.explode(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1))
    return later.select("row", n.alias("n")).groupBy("row").agg(F.collect_set("n").alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` as the struct ``doc``, with ``text`` left over, ``n_lines`` and ``dropped``.

    A line is what stands between line feeds. Every run of lines with at least
    ``min_words`` words that occurs, line for line, earlier in the corpus is
    removed; ``dropped`` has the 0-based numbers of its lines. Runs do not cross
    documents. Earlier means a smaller id (nulls last), then the text's digest and
    the order of reading, then the line; so of repeated rows the first is kept. A
    null text stays null and has no lines; an empty text has one empty line; a
    text whose lines all go becomes empty. An empty table gives no rows.
    """
    keyed = stored(nested(docs).withColumn("row", F.monotonically_increasing_id()), "lines-docs")
    dropped = repeated_lines(keyed, id_col, text_col, min_words)
    text = F.col(f"doc.{text_col}").cast("string")
    lines = _lines(text)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    left = F.array_join(F.transform(numbers, lambda n: F.get(lines, n)), "\n")
    joined = keyed.join(dropped, "row", "left")
    return joined.select(
        "doc",
        F.when(F.col("dropped").isNull(), text).otherwise(left).alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.coalesce(F.array_sort("dropped"), F.array().cast("array<int>")).alias("dropped"),
    )


# The same by brute force: the text of every piece is its key.
SQL = """
WITH line AS (
  SELECT doc_id, n - 1 AS n, line, len(regexp_extract_all(line, '[^ \\x09-\\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
        FROM documents)),
summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM line),
piece AS (
  SELECT a.doc_id, a.n AS s, min(b.n) AS t FROM summed a JOIN summed b
  ON a.doc_id = b.doc_id AND b.n >= a.n AND b.upto >= a.upto - a.words + 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.n) AS s, b.n AS t FROM summed a JOIN summed b
  ON a.doc_id = b.doc_id AND a.n <= b.n AND a.upto - a.words <= b.upto - 50 GROUP BY b.doc_id, b.n),
content AS (
  SELECT p.doc_id, p.s, p.t, string_agg(l.line, chr(10) ORDER BY l.n) AS lines
  FROM piece p JOIN line l ON l.doc_id = p.doc_id AND l.n BETWEEN p.s AND p.t GROUP BY ALL),
later AS (
  SELECT doc_id, s, t FROM
    (SELECT *, row_number() OVER (PARTITION BY lines ORDER BY doc_id, s) AS copy FROM content) WHERE copy > 1),
gone AS (SELECT DISTINCT l.doc_id, l.n FROM later p JOIN line l ON l.doc_id = p.doc_id AND l.n BETWEEN p.s AND p.t),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.n) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (g.n IS NULL), '') AS text
  FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.n = l.n GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(kept.text) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
