"""Near copies by SimHash: deletion variants of fingerprint segments, joined and verified.

Two 64-bit fingerprints that differ in at most two bits differ, in one of their two
32-bit halves, in at most one bit. Every half is indexed 32 times, each time with
another bit masked, so such two fingerprints share a key. Keys are joined by
equality and the pairs verified. A key wanted by many fingerprints is not joined
with itself: its fingerprints are linked through the 65 points within one bit of
each, since two of them are at most two bits apart exactly if they share such a
point.

Near copies among rows (``one_of_each``) are candidates if their fingerprints are
linked, or if they share a MinHash band of their shingles, which finds those whose
fingerprints are further apart. The shingles themselves verify all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import clear, hashed_words, mix, nested, recording, release, shingles, slices, stored
from bitloom.llm.components import components

# The seed of the shingle hash, and the links' greatest distance.
SEED = 42
RADIUS = 2
# Near copies among rows: the least shingle similarity, how many times BAND MinHash values a row
# has, and the bands that find them: so many, of so many of these values each.
SIMILARITY = 0.8
TABLES = 80
BAND = 5
BANDS, JOINT = 110, 13
# Bytes of text that are sketched at once.
SKETCHED_BYTES = 1_000_000
# Up to how many fingerprints of one key are joined with each other.
JOINED = 32
# Bits of the map of crowded keys; four megabytes.
MAP_BITS = 1 << 25
_HALF = (1 << 32) - 1


def fingerprint(text: str | None, k: int = 3) -> int:
    """SimHash of the ``k``-word shingles, repeats counted; signed; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < k:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(run), SEED) for run in zip(*(words[i:] for i in range(k)))]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        bits = np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    out = np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0]
    return int(out)


def fingerprints(text: Column, k: int = 3) -> Column:
    """``fingerprint`` as a column."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, k) for t in texts], dtype="int64")

    return of(text)


def _variants(fps: DataFrame) -> DataFrame:
    """(t, key, fp): each half with one bit masked; the key names half, bit and the rest."""
    keys = []
    for half in range(2):
        value = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(_HALF))
        for bit in range(32):
            rest = value.bitwiseAND(F.lit(_HALF ^ (1 << bit)))
            keys.append(F.lit((half * 32 + bit) << 32).bitwiseOR(rest))
    return fps.select("t", "fp", F.explode(F.array(*keys)).alias("key"))


def _variant_keys(fps: np.ndarray) -> np.ndarray:
    """The keys of ``_variants``, 64 for each fingerprint."""
    halves = np.stack([fps & np.uint64(_HALF), fps >> np.uint64(32)], axis=1)
    masks = np.uint64(_HALF) ^ (np.uint64(1) << np.arange(32, dtype=np.uint64))
    names = np.arange(64, dtype=np.uint64).reshape(2, 32) << np.uint64(32)
    return ((halves[:, :, None] & masks) | names).reshape(len(fps), 64)


def _key_bits(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) % np.uint64(MAP_BITS)).astype(np.int64)


def _key_map(keys: DataFrame) -> np.ndarray:
    """A bit for each ``key``, in a map of fixed size."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(_key_bits(batch.column(0).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["bit"])

    cells = keys.select("key").mapInArrow(bits, "bit long").groupBy(F.expr("bit div 64").alias("cell"))
    # At most MAP_BITS / 64 rows.
    table = cells.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[table.column("cell").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint8)


def _members(fps: DataFrame, keys: DataFrame) -> DataFrame:
    """(t, key, fp): the fingerprints of the ``keys`` (t, key), which are few beside all variants.

    A map of fixed size holds back most variants of other keys before the shuffle,
    and the join decides.
    """
    held = _key_map(keys)

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 65_536):
                part = batch.slice(at, 65_536)
                all_keys = _variant_keys(part.column(1).to_numpy().view(np.uint64))
                bits = _key_bits(all_keys)
                row, place = np.nonzero(held[bits // 8] >> (bits % 8).astype(np.uint8) & 1)
                take = pa.array(row)
                found = pa.array(all_keys[row, place].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), found, part.column(1).take(take)], ["t", "key", "fp"])

    return fps.select("t", "fp").mapInArrow(variants, "t int, key long, fp long").join(keys.select("t", "key", "n"), ["t", "key"])


def _points(fps: DataFrame) -> DataFrame:
    """(t, point, fp): the fingerprint itself and all that differ from it in one bit."""
    flips = [F.lit(0).cast("long")] + [F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b) for b in range(64)]
    return fps.select("t", "fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(f) for f in flips))).alias("point"))


def links(fps: DataFrame) -> DataFrame:
    """Edges (t, a, b) that join all distinct ``fp`` of a table ``t`` which chains of links connect.

    One aggregate finds the keys of two fingerprints with the fingerprints themselves.
    Larger keys are joined: every link between fingerprints of keys with at most
    ``JOINED`` is a row, in larger ones each point links its fingerprints to the
    least of them.
    """
    keys = _variants(fps).groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    # Written, so that the join shuffles both sides itself and can split a key of very many rows.
    shared = stored(keys.where("n > 1"), "simhash-shared")
    two = shared.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("t", "a", "b")
    members = stored(_members(fps, shared.where("n > 2")), "simhash-keys")
    small = members.where(F.col("n") <= JOINED).select("t", "key", "fp")
    a, b = small.alias("a"), small.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # Two fingerprints with one equal half meet at all 32 keys of it: one is enough.
    bit = F.shiftrightunsigned(F.col("a.key"), 32)
    within = F.when(bit < 32, differ.bitwiseAND(F.lit(_HALF))).otherwise(F.shiftrightunsigned(differ, 32))
    once = (within != 0) | (F.pmod(bit, F.lit(32)) == 0)
    verified = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= RADIUS) & once
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key"))
    pairs = a.join(b, same & verified).select("a.t", F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    points = _points(members.where(F.col("n") > JOINED).select("t", "fp").distinct())
    least = points.groupBy("t", "point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    least = stored(least.drop("n"), "simhash-points")
    stars = points.join(least, ["t", "point"]).where("fp > a").select("t", "a", F.col("fp").alias("b"))
    return two.unionAll(pairs).unionAll(stars).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """Per row: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id that links of at most two bits reach, the
    row's own included. A null text counts as empty; texts without words have
    fingerprint 0 and are linked like any other. Rows with a null id have a
    component like others, but give no id to it (null if all ids in it are null).
    Repeated rows stay repeated. Other columns are not carried. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), k).alias("fp"))
    rows = stored(rows, "simhash-fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    # A small table in a few tasks would make 64 rows of each fingerprint there.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.select(F.lit(0).alias("t"), "fp").repartition(parts, "fp")
    roots = components(links(dealt)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def _bands(values: int) -> np.ndarray:
    """Which MinHash values make each band: drawn anew for each, so bands share values."""
    rng = np.random.default_rng(SEED)
    return np.stack([np.sort(rng.choice(values, min(JOINT, values), replace=False)) for _ in range(BANDS)])


def _sketch(texts: pa.Array, k: int, tables: int) -> dict[str, list]:
    """Per text: its fingerprint, how many distinct shingles it has, a 128-bit digest of the set, and its band keys."""
    hashes, starts = shingles(*hashed_words(texts, bytes.lower), k)
    some = np.flatnonzero(np.diff(starts))
    sets = [np.unique(hashes[i:j]) for i, j in zip(starts[:-1], starts[1:])]
    digests = [xxhash.xxh3_128_intdigest(one.tobytes()) for one in sets]
    bands = _bands(tables * BAND)
    keys = np.zeros((len(sets), len(bands)), np.uint64)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        at = np.concatenate(([0], np.cumsum([len(sets[i]) for i in some[:-1]], dtype=np.int64))).astype(np.int64)
        steps = mix(np.arange(1, 2 * tables * BAND + 1, dtype=np.uint64)).reshape(-1, 2)
        least = np.stack([np.minimum.reduceat(flat * (factor | np.uint64(1)) + shift, at) for factor, shift in steps])
        for t, band in enumerate(bands):
            key = np.full(len(some), t, np.uint64)
            for value in least[band]:
                key = mix(key ^ value)
            keys[some, t] = key
    there = set(some.tolist())
    return {
        "fp": [fingerprint(text.as_py()) for text in texts],
        "size": [max(1, len(one)) for one in sets],
        "high": [(d >> 64) - (1 << 63) for d in digests],
        "low": [(d & (1 << 64) - 1) - (1 << 63) for d in digests],
        "keys": [row if i in there else row[:0] for i, row in enumerate(keys.view(np.int64))],
    }


def _sketches(text: Column, k: int, tables: int) -> Column:
    """``_sketch`` as a column; a text without words has no keys."""

    kinds = [("fp", pa.int64()), ("size", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("keys", pa.list_(pa.int64()))]

    @F.arrow_udf("fp long, size int, high long, low long, keys array<long>")
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts.cast(pa.large_string())], ["text"])
            parts = []
            for part in slices(iter([batch]), "text", SKETCHED_BYTES):
                made = _sketch(part.column(0), k, tables)
                parts.append(pa.StructArray.from_arrays([pa.array(made[name], kind) for name, kind in kinds], [name for name, _ in kinds]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(kinds))

    return each(text)


def _shingle_similarity(a: Column, b: Column, k: int) -> Column:
    """Jaccard similarity of the sets of ``k``-word shingles of two texts; 1 without words."""

    def runs(text: str) -> set:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}

    @F.arrow_udf("double")
    def each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                x, y = runs(x.as_py() or ""), runs(y.as_py() or "")
                out.append(len(x & y) / len(x | y))
            release()
            yield pa.array(out, pa.float64())

    return each(a, b)


def _alike(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` of rows whose texts are alike; each row of a pair is read once for it."""
    wanted = pairs.select(F.col("a").alias("row")).distinct()
    # Few rows are an ``a``: written, so that the joins can split those in very many pairs.
    held = stored(texts.join(wanted, "row", "left_semi").select(F.col("row").alias("a"), F.col("text").alias("left")), "simhash-held")
    met = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("right")), "b").join(held, "a")
    found = met.select("a", "b", _shingle_similarity(F.col("left"), F.col("right"), k).alias("similarity"))
    return stored(found.where(F.col("similarity") >= similarity).select("a", "b"), "simhash-alike")


def _others(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, stays): every row of each component of ``edges`` but the one with the smallest id, with that one."""
    roots = components(edges).withColumnRenamed("node", "row").join(rows, "row")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    stays = stored(roots.groupBy("root").agg(F.min(place).alias("first")).select("root", F.col("first.row").alias("stays")), "simhash-stays")
    return roots.join(stays, "root").where("row <> stays").select("row", "stays")


def _first_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every row of a key with the least row of it."""
    pairs = members.where(F.col("row") != F.col("first.row")).where(_sizes(F.col("first.size"), F.col("size"), similarity))
    return pairs.select(F.col("first.row").alias("a"), F.col("row").alias("b")).distinct()


def _linked_prints(left: DataFrame, similarity: float) -> DataFrame:
    """(a, b): rows with linked fingerprints, the least row of each fingerprint for it, and each row with that of its own."""
    first = F.min(F.struct("row", "size")).alias("first")
    prints = stored(left.groupBy("fp").agg(first, F.count("*").alias("n")), "simhash-prints")
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = links(prints.select(F.lit(0).alias("t"), "fp").repartition(parts, "fp")).select("a", "b")
    for side in "ab":
        edges = edges.join(prints.select(F.col("fp").alias(side), F.col("first").alias(f"first_{side}")), side)
    a, b = (F.col(f"first_{side}") for side in "ab")
    between = edges.where(_sizes(a["size"], b["size"], similarity)).select(a["row"].alias("a"), b["row"].alias("b"))
    held = left.select("row", "size", "fp").join(prints.where("n > 1").select("fp", "first"), "fp")
    inside = held.where(F.col("row") != F.col("first.row")).where(_sizes(F.col("first.size"), F.col("size"), similarity))
    return between.unionAll(inside.select(F.col("first.row").alias("a"), F.col("row").alias("b")))


def _sizes(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be as similar; the margin is for rounding."""
    return F.least(a, b) >= F.greatest(a, b) * (similarity - 1e-9)


def _open(members: DataFrame, linked: DataFrame, done: int) -> DataFrame:
    """The rows of keys in which some two, neither among the ``done`` asked ones, are in different groups."""
    roots = components(linked).select(F.col("node").alias("row"), "root")
    # The first row was compared with all, as were those that asked in the rounds before.
    left = members.where((F.col("n") > 2) & (F.col("place") * F.col("n") >= done) & (F.col("row") != F.col("first.row")))
    left = left.join(roots, "row", "left").withColumn("label", F.coalesce("root", "row")).drop("root")
    left = stored(left, "simhash-left")
    apart = left.groupBy("t", "key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    return stored(left.join(stored(apart.select("t", "key"), "simhash-apart"), ["t", "key"]), "simhash-open")


def _linked(members: DataFrame, texts: DataFrame, k: int, similarity: float, more: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) of alike rows that connect all rows which chains of alike rows of a key connect.

    Those of the pairs ``more`` that are alike are edges, too. The least row of a key is compared with all others. Then more and more rows
    of a key, drawn by a hash, are compared with all that are not yet in their
    group, until every two rows of a key are in one group or were compared.
    """
    spark = members.sparkSession
    with recording() as paths:
        pairs = _first_pairs(members, similarity)
        pairs = pairs if more is None else pairs.unionAll(more).distinct()
        linked = _alike(stored(pairs, "simhash-pairs"), texts, k, similarity)
    done, asked = 0, 4
    while True:
        # What a round worked with goes once its edges are written.
        clear(spark, [path for path in paths if "/simhash-alike-" not in path])
        with recording() as paths:
            left = _open(members, linked, done)
            if left.isEmpty():
                return linked
            a, b = left.where(F.col("place") * F.col("n") < asked).alias("a"), left.alias("b")
            same = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label"))
            later = (F.col("a.place") < F.col("b.place")) | ((F.col("a.place") == F.col("b.place")) & (F.col("a.row") < F.col("b.row")))
            pairs = a.join(b, same & later & _sizes(F.col("a.size"), F.col("b.size"), similarity))
            pairs = stored(pairs.select(F.col("a.row").alias("a"), F.col("b.row").alias("b")).distinct(), "simhash-pairs")
            linked = linked.unionAll(_alike(pairs, texts, k, similarity))
        done, asked = asked, asked * 4


def _keyed_rows(left: DataFrame, shared: DataFrame) -> DataFrame:
    """(row, size, t, key): the bands of rows that another row may share, by a map of fixed size."""
    held = _key_map(shared)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2)
            sizes = keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            bits = _key_bits(flat.view(np.uint64))
            some = np.flatnonzero(held[bits // 8] >> (bits % 8).astype(np.uint8) & 1)
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes)[some])
            # Rows with keys have one for each band.
            t = pa.array((some % BANDS).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), t, pa.array(flat[some])], ["row", "size", "t", "key"])

    return left.select("row", "size", "keys").mapInArrow(bands, "row long, size int, t int, key long")


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    similarity: float = SIMILARITY,
    tables: int = TABLES,
) -> DataFrame:
    """One row of each group of near copies, with all its columns: that with the smallest id.

    Null ids come last, and of equal ids the first in the order of reading stays.
    Two rows are near copies if their sets of ``k``-word shingles have a Jaccard
    similarity of at least ``similarity``; groups are chains of such pairs.
    Rows with equal sets are found by a digest. Others are candidates if their
    SimHash fingerprints are linked (two bits, as in ``near_copies``), or if they
    agree in all ``JOINT`` MinHash values of one of ``BANDS`` bands, drawn from
    ``tables`` times BAND values: 99 of 100 pairs at 0.8 do with 80 tables, 6 of 10 at
    0.7 and 1 of 10 at 0.6 (simulated). Candidates of one band are compared until all alike ones
    are connected, however many they are; many that are not alike cost the square of
    their number. A null text counts as empty; texts without words are copies of
    each other. An empty table gives no rows.
    """
    text = F.col(f"doc.{text_col}").cast("string")
    keyed = nested(docs).withColumn("sketch", _sketches(text, k, tables)).withColumn("row", F.monotonically_increasing_id())
    keyed = stored(keyed, "simhash-rows")
    texts, ids = keyed.select("row", text.alias("text")), keyed.select("row", F.col(f"doc.{id_col}").alias("id"))

    sets = keyed.select("row", "sketch.high", "sketch.low")
    firsts = stored(sets.groupBy("high", "low").agg(F.min("row").alias("a"), F.count("*").alias("n")).where("n > 1"), "simhash-equal")
    equal = sets.join(firsts, ["high", "low"]).where("row <> a").select("a", F.col("row").alias("b"))
    equal = stored(equal, "simhash-copies")

    left = keyed.select("row", "sketch.fp", "sketch.size", "sketch.keys").join(equal.select(F.col("b").alias("row")), "row", "left_anti")
    left = stored(left, "simhash-bands")
    bands = left.select("row", "size", F.posexplode("keys").alias("t", "key"))
    first = F.min(F.struct("row", "size")).alias("first")
    shared = stored(bands.groupBy("t", "key").agg(first, F.count("*").alias("n")).where("n > 1"), "simhash-shared")
    place = F.shiftrightunsigned(F.xxhash64("row"), 11) / F.lit(float(1 << 53))
    members = stored(_keyed_rows(left, shared).join(shared, ["t", "key"]).withColumn("place", place), "simhash-members")

    prints = stored(_linked_prints(left, similarity), "simhash-linked")
    linked = _linked(members, texts, k, similarity, prints)
    gone = _others(equal.unionAll(linked), ids).select("row")
    return keyed.join(gone, "row", "left_anti").select("doc.*")
