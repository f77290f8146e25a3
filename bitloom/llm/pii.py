"""Personal data in texts, plain and disguised, with spans in the source text.

Plain finds follow fixed patterns. For disguised ones a transducer rewrites the text
piece by piece (look-alike letters, invisible characters, other scripts' digits,
spelled digits, "at" and "dot") and keeps, for every character that it writes, the
span it was read from. The same patterns then run on the rewritten text, and finds
that hold a rewritten character are mapped back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import filled, slices

# The kinds in their order, and the patterns of plain finds.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't start inside a run of digits: it would have started at the run's first.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        name = text[free:at]
        start = free + len(name.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield "email", start, free
        at = text.find("@", free)


def plain(text: str) -> list[Span]:
    """Finds of the fixed patterns, leftmost and without overlap for each kind."""
    found = list(_emails(text)) if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


# Letters of other scripts that look like Latin ones, and what reads as them.
_ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρι",
        "ABESIJKMHOPCTYXaesijopcyxdhqw" + "ABEZHIKMNOPTYXovpi",
    )
)
_HYPHENS = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
# digits' names in English, German, Spanish and French.
_NAMES = {
    "0": "zero oh null cero zéro",
    "1": "one eins uno un",
    "2": "two zwei zwo dos deux",
    "3": "three drei tres trois",
    "4": "four vier cuatro quatre",
    "5": "five fünf cinco cinq",
    "6": "six sechs seis",
    "7": "seven sieben siete sept",
    "8": "eight acht ocho huit",
    "9": "nine neun nueve neuf",
}
_DIGIT_OF = {name: digit for digit, names in _NAMES.items() for name in names.split()}
_NAME = "(?:" + "|".join(sorted(_DIGIT_OF, key=len, reverse=True)) + ")"
_GAP = r"[\x20\t,;-]{1,3}"
_POINT = r"(?:dot|point|punto|punkt)"
_WORD_AT = r"(?:at|arroba)"
# Words before a spoken dot that make it ordinary prose.
_PROSE = r"(?:the|a|an|this|that|my|your|our|its|his|her|their)\b"

_ODD = re.compile("[\u00a0\u00ad\u0250-\U0010ffff]")
_SPELLED = re.compile(rf"(?i:(?<![^\W_])(?:plus{_GAP})?{_NAME}(?:{_GAP}(?:{_POINT}{_GAP})?{_NAME})+(?![^\W_]))")
_TOKEN = re.compile(r"[^\W\d_]+")
_BRACKET = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:(?P<at>(?i:{_WORD_AT})|@)|(?i:{_POINT})|\.)\s{{0,3}}[\])}}>]\s{{0,3}}")
_BARE = re.compile(
    rf"(?i:(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?P<at>\s{{1,3}}{_WORD_AT}\s{{1,3}}|@)"
    rf"(?!{_PROSE})[A-Za-z0-9-]{{1,63}}(?P<dots>(?:\s{{1,3}}{_POINT}\s{{1,3}}[A-Za-z0-9-]{{1,63}})*\s{{1,3}}{_POINT}\s{{1,3}}[A-Za-z]{{2,24}})(?![A-Za-z0-9-]))"
)
_POINTS, _ATS = {"dot", "point", "punto", "punkt"}, {"at", "arroba"}
_BARE_POINT = re.compile(rf"(?i:\s{{1,3}}{_POINT}\s{{1,3}})")


def _reads_as(c: str) -> str:
    """What a character outside Latin letters reads as; itself if nothing else."""
    if c in _ALIKE:
        return _ALIKE[c]
    if c in _HYPHENS:
        return "-"
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Nd":
        return str(unicodedata.digit(c))
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


class Rewritten:
    """A text, and for each of its characters the source span it stands for."""

    def __init__(self, text: str):
        self.text = text
        # Made with the first edit.
        self.start: list[int] = []
        self.end: list[int] = []
        self.changed: list[bool] = []

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace non-overlapping (start, end, text) spans, given in order."""
        if not edits:
            return
        if not self.start:
            n = len(self.text)
            self.start, self.end, self.changed = list(range(n)), list(range(1, n + 1)), [False] * n
        parts, start, end, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            changed += self.changed[at:a] + [True] * len(new)
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.start, self.end = start + self.start[at:], end + self.end[at:]
        self.changed = changed + self.changed[at:]


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Digits for a run of at least three names; gaps between them go."""
    words = list(_TOKEN.finditer(m[0]))
    if sum(w[0].lower() in _DIGIT_OF for w in words) < 3:
        return []
    edits, at = [], m.start()
    for w in words:
        name = w[0].lower()
        new = _DIGIT_OF.get(name) or ("+" if name == "plus" else ".")
        edits.append((at, m.start() + w.end(), new))
        at = m.start() + w.end()
    return edits


def rewrite(text: str) -> Rewritten | None:
    """The text with disguises undone; none if it has none."""
    # Brackets and letters may be look-alikes themselves, so characters come first.
    out = Rewritten(text)
    if not text.isascii() and _ODD.search(text):
        out.apply([(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _reads_as(m[0])) != m[0]])
    # Most texts have none of the words: the patterns need not run on them.
    words = set(out.text.lower().replace(",", " ").replace(";", " ").replace("-", " ").split())
    if not words.isdisjoint(_DIGIT_OF):
        out.apply([e for m in _SPELLED.finditer(out.text) for e in _spelled(m)])
    if any(c in out.text for c in "[({<"):
        out.apply([(*m.span(), "@" if m["at"] else ".") for m in _BRACKET.finditer(out.text)])
    if not words.isdisjoint(_POINTS) and ("@" in out.text or not words.isdisjoint(_ATS)):
        bare = []
        for m in _BARE.finditer(out.text):
            if m["at"] != "@":
                bare.append((*m.span("at"), "@"))
            bare += [(*p.span(), ".") for p in _BARE_POINT.finditer(out.text, *m.span("dots"))]
        out.apply(bare)
    return out if out.text != text else None


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, disguised) by start, then kind; code points, end exclusive."""
    text = text or ""
    found = {s: False for s in plain(text)}
    out = rewrite(text)
    if out is not None:
        for kind, a, b in plain(out.text):
            start, end = out.start[a], out.end[b - 1]
            # A span of another length holds characters that were left out.
            if end - start != b - a or any(out.changed[a:b]):
                found.setdefault((kind, start, end), True)
    ordered = sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [(*s, found[s]) for s in ordered]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``spans``, an array of (kind, start, end, disguised).

    Kinds are email, ip, card and phone. Whole texts are searched; a null text
    counts as empty and has no spans. Plain spans are those of the fixed patterns;
    disguised ones are found after rewriting and are added, never taken away. A
    span counts code points of the source text, end exclusive, and covers every
    disguise in it. Repeated rows stay; other columns are not carried; an empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in struct]
        for batch in slices(batches, "text"):
            found = [[dict(zip(names, s)) for s in spans(t.as_py())] for t in filled(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(struct))], ["id", "spans"])

    shape = "array<struct<kind:string,start:long,end:long,disguised:boolean>>"
    return rows.mapInArrow(find, f"id {kind}, spans {shape}").withColumnRenamed("id", id_col)
