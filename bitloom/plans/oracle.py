"""SQL fragments shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from bitloom.functions import estimate

WORDS = r"regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}]+)', 1)"


def words(text: str) -> str:
    return WORDS.format(text)


def hash63(token: str) -> str:
    return f"((('0x' || substr(md5({token}), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT)::BIGINT)"


def token_bin(h: str, p: int) -> str:
    return f"(({h} >> {63 - p})::INT)"


def token_word(h: str, p: int) -> str:
    low = f"({h} & {(1 << (64 - p)) - 1})"
    return f"(CASE WHEN {low} = 0 THEN {1 << (64 - p)}::BIGINT ELSE {low} & (-{low}) END)"


def tokens(table: str, columns: str, text: str = "text") -> str:
    """SELECT of the distinct words of each row beside some columns."""
    return f"SELECT {columns}, unnest(list_distinct({words(text)})) AS token FROM {table}"


def sketch(source: str, set_id: str, p: int = 10, token: str = "token") -> str:
    """SELECT of sketch rows from rows with a token; ``source`` is a table or CTE name."""
    return f"""SELECT set_id, {token_bin('h', p)} AS bin, bit_or({token_word('h', p)}) AS word
      FROM (SELECT {set_id} AS set_id, {hash63(token)} AS h FROM {source} WHERE {token} IS NOT NULL)
      GROUP BY ALL"""


def doc_sketch(set_id: str, p: int = 10, name: str = "sk") -> str:
    """CTEs ``tok`` and ``sk`` for the documents' words."""
    return f"tok AS ({tokens('documents', set_id)}), {name} AS ({sketch('tok', set_id, p)})"


def rank(word: str) -> str:
    return f"(CASE WHEN {word} = 0 THEN 0 ELSE length(bin({word})) END)"


def raw(pow_sum: str, filled: str, p: int) -> str:
    m = float(1 << p)
    return f"({estimate.alpha(p) * m * m!r} / ({pow_sum} + ({m!r} - {filled})))"


def segments(p: int) -> str:
    """CTE ``seg(x1, x2, y1, y2)``: the straight pieces of the bias curve."""
    pts = estimate.bias_points(p)
    rows = [(-1e300, pts[0][0], pts[0][1], pts[0][1])]
    rows += [(a[0], b[0], a[1], b[1]) for a, b in zip(pts, pts[1:])]
    rows.append((pts[-1][0], 1e300, 0.0, 0.0))
    values = ",".join("(" + ",".join(f"{v!r}::DOUBLE" for v in r) + ")" for r in rows)
    return f"seg(x1, x2, y1, y2) AS (VALUES {values})"


def card_of(raw_column: str = "raw") -> str:
    """Estimate from a raw estimate, as a scalar subquery over ``seg``."""
    return (
        f"(SELECT round_even({raw_column} - (y1 + ({raw_column} - x1) / (x2 - x1) * (y2 - y1)), 0)::BIGINT "
        f"FROM seg WHERE {raw_column} > x1 AND {raw_column} <= x2)"
    )


def card_agg(word: str, p: int) -> str:
    """Raw estimate as an aggregate expression over rows with a register word."""
    s = f"sum(CASE WHEN {word} <> 0 THEN pow(2.0, -{rank(word)}) ELSE 0.0 END)"
    return raw(s, f"count(*) FILTER ({word} <> 0)", p)


CONTENT_ID = "coalesce(sha1(string_agg(bin || ':' || word, ',' ORDER BY bin) FILTER (word <> 0)), sha1(''))"

PAIR_OPS = {
    "a": "wa",
    "b": "wb",
    "union": "(wa | wb)",
    "intersect": "(wa & wb)",
    "xor": "xor(wa, wb)",
    "comp": "(wa & ~wb)",
    "comp_rev": "(wb & ~wa)",
}


def aligned(pairs: str = "prs", sk: str = "sk") -> str:
    """SELECT of both words of each pair in every register either side has."""
    return f"""SELECT set_a, set_b, bin,
        bit_or(CASE WHEN lft THEN word ELSE 0 END) AS wa,
        bit_or(CASE WHEN lft THEN 0 ELSE word END) AS wb
      FROM (SELECT set_a, set_b, bin, word, TRUE AS lft FROM {pairs} JOIN {sk} ON set_id = set_a
            UNION ALL
            SELECT set_a, set_b, bin, word, FALSE FROM {pairs} JOIN {sk} ON set_id = set_b)
      GROUP BY ALL"""


def pair_cards(p: int = 10, by: str = "set_a, set_b", al: str = "al") -> str:
    """CTEs ``pr`` (raw) and ``pc`` (estimates and bit counts) from an aligned CTE."""
    raws = ", ".join(
        f"{card_agg(w, p)} AS raw_{n}, sum(bit_count({w}))::BIGINT AS bits_{n}" for n, w in PAIR_OPS.items()
    )
    out = ", ".join(f"{card_of('raw_' + n)} AS card_{n}, bits_{n}" for n in PAIR_OPS)
    return (
        f"{segments(p)}, pr AS (SELECT {by}, {raws} FROM {al} GROUP BY {by}), "
        f"pc AS (SELECT {by}, {out} FROM pr)"
    )


ALL_PAIRS = (
    "prs AS (SELECT a.set_id AS set_a, b.set_id AS set_b FROM (SELECT DISTINCT set_id FROM sk) a "
    "JOIN (SELECT DISTINCT set_id FROM sk) b ON a.set_id < b.set_id)"
)
