"""Token hash and register coordinates as plain column expressions.

A token's 63-bit hash splits in two: the top ``p`` bits name the register
(``bin``), the lowest set bit of the rest is the single bit (``word``) that the
token contributes. Everything stays in code generation; nothing is a UDF.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_P, MAX_P, DEFAULT_P = 4, 18, 10
HASH_BITS = 63
_MASK = (1 << HASH_BITS) - 1


def check_p(p: int) -> int:
    """Return ``p`` if it is a supported precision, else raise."""
    if isinstance(p, bool) or not isinstance(p, int) or not MIN_P <= p <= MAX_P:
        raise ValueError(f"precision must be an integer in {MIN_P}..{MAX_P}, got {p!r}")
    return p


def _hash63(text: Column) -> Column:
    head = F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("bigint")
    # Never null, so that joins on the hash add no null check that hashes once more.
    return F.coalesce(head, F.lit(0)).bitwiseAND(F.lit(_MASK))


def hash_of(token: str | bytes) -> int:
    """``token_hash`` of one token, given as text or as its UTF-8 bytes."""
    held = token.encode() if isinstance(token, str) else token
    return int.from_bytes(md5(held, usedforsecurity=False).digest()[:8]) & _MASK


def token_hash(token: Column, seed: int = 0) -> Column:
    """Non-negative 63-bit hash; a seed other than 0 hashes the hash again.

    Missing tokens are to be left out beforehand.
    """
    first = _hash63(token)
    if seed == 0:
        return first
    return _hash63(F.concat(first.cast("string"), F.lit(f":{seed}")))


def bin_of(hashed: Column, p: int) -> Column:
    """0-based register number: the top ``p`` of the 63 hash bits."""
    return F.shiftrightunsigned(hashed, HASH_BITS - p).cast("int")


def word_of(hashed: Column, p: int) -> Column:
    """The one bit a hash sets: its lowest set bit below the register bits."""
    width = HASH_BITS + 1 - p
    low = hashed.bitwiseAND(F.lit((1 << width) - 1))
    return F.when(low == 0, F.lit(1 << width)).otherwise(low.bitwiseAND(-low))


def top_bit(word: Column) -> Column:
    """1-based position of the highest set bit; 0 for an empty register."""
    return F.when(word == 0, F.lit(0)).otherwise(F.length(F.bin(word)))


def _bit(word: Column, position: Column) -> Column:
    return F.call_function("shiftright", word, position).bitwiseAND(F.lit(1))


def set_bits(word: Column) -> Column:
    """0-based positions of the set bits, counted from the low end."""
    positions = F.sequence(F.lit(0), F.lit(HASH_BITS - 1))
    return F.filter(positions, lambda i: _bit(word, i) == 1)


def bit_indices(word: Column) -> Column:
    """1-based positions of the set bits, counted from the most significant one."""
    width = top_bit(word)
    return F.filter(
        F.sequence(F.lit(1), F.greatest(width, F.lit(1))),
        lambda i: _bit(word, width - i) == 1,
    )


def derived_id(kind: str, *args: Column) -> Column:
    """Id of a derived item from its arguments' ids only.

    Order-free for the symmetric kinds, ordered for the complement.
    """
    ids = F.array(*args)
    if kind != "comp":
        ids = F.array_sort(ids)
    return F.sha1(F.concat_ws(":", F.lit(kind), ids))
