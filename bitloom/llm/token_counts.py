"""Token counts and ids of whole texts with a public tokenizer's file.

Texts are split at ASCII white space, a safe boundary: the tokenizer's own pattern
never matches across it. Each distinct piece of a batch is encoded once, and pieces
stay known to the Python worker for its next batches, up to a bound.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import filled, slices, split_words

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
# How many pieces a Python worker remembers; it starts anew beyond them.
REMEMBERED = 400_000
# Bytes of text that are encoded at once: each distinct piece is looked up once for them.
ENCODED_BYTES = 3_000_000

# Letters that the tokenizer lower-cases one by one and never joins with a neighbour.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
# What can be cut off after such a letter: no special token and no contraction has it there.
_TAIL = b".,;:!?)"
_ENCODERS: dict[str, "Pieces"] = {}


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = (b for b in range(256) if b not in shown)
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Pieces:
    """Ids of pieces of text between white space, for one vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.letters = _byte_letters()

    def _plain(self, piece: bytes) -> bytes | None:
        """The ids of a piece of letters only, straight from the tokenizer's model."""
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            return None
        if not _LETTERS.fullmatch(text):
            return None
        spelled = text.lower().encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.whole.model.tokenize(spelled)], "<u4").tobytes()

    def _learn(self, pieces: list[bytes]) -> None:
        other = []
        for piece in pieces:
            ids = self._plain(piece)
            if ids is None:
                other.append(piece)
            else:
                self.known[piece] = ids
        if other:
            texts = [p.decode("utf-8", "replace") for p in other]
            for piece, e in zip(other, self.whole.encode_batch_fast(texts, add_special_tokens=False)):
                self.known[piece] = np.array(e.ids, "<u4").tobytes()

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        parts, new = [], set()
        for piece in pieces:
            core = piece.rstrip(_TAIL)
            # After an ASCII letter the rest of the piece is a token run of its own.
            cut = len(core) if core and core[-1:].isalpha() and len(core) < len(piece) else 0
            split = (piece[:cut], piece[cut:]) if cut else (piece,)
            parts.append(split)
            new.update(p for p in split if p not in self.known)
        self._learn(list(new))
        known = self.known
        return [known[s[0]] if len(s) == 1 else known[s[0]] + known[s[1]] for s in parts]


def pieces_of(path: str | None) -> Pieces:
    """The worker's encoder for a vocabulary file; null: the public 49k vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        _ENCODERS[path] = Pieces(path)
    return _ENCODERS[path]


def _coded(texts: pa.Array, encoder: Pieces) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    # Folding case would turn other spellings into special tokens, so it is left where one may be.
    special = pc.any(pc.match_substring(texts, "<|")).as_py()
    words, bounds = split_words(texts, fold=not special)
    ids = encoder.ids(words.dictionary.to_pylist())
    return words.indices.to_numpy(zero_copy_only=False), ids, bounds


def token_lengths(texts: pa.Array, encoder: Pieces) -> np.ndarray:
    """Number of tokens of each text."""
    codes, ids, bounds = _coded(filled(texts), encoder)
    sizes = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
    total = np.concatenate(([0], np.cumsum(sizes[codes]))) if len(codes) else np.zeros(1, np.int64)
    return np.diff(total[bounds])


def token_ids(texts: pa.Array, encoder: Pieces) -> list[np.ndarray]:
    """The token ids of each text."""
    codes, ids, bounds = _coded(filled(texts), encoder)
    sizes = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
    flat = np.frombuffer(b"".join(ids), "<u4")
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = codes[a:b]
        n = sizes[own]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(starts[own] - (ends - n), n)
        out.append(flat[at])
    return out


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None
) -> DataFrame:
    """Per row: its id, ``n_bytes``, ``n_tokens`` and whether they are over ``limit``.

    Whole texts are counted, as the tokenizers library gives them without added
    special tokens, truncation or padding; special strings inside a text are the
    special tokens they name. A null text counts as empty. Repeated rows and null
    ids stay; other columns are not carried. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces_of(path)
        for batch in slices(batches, "text", ENCODED_BYTES):
            texts = filled(batch.column(1))
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            n_tokens = pa.array(token_lengths(texts, encoder), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], ["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
