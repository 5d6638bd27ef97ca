"""Personal data with disguises undone, in offsets of the original text.

Four kinds are found as written: e-mail addresses, IP addresses, payment cards and telephone
numbers.  Then a chain of transducers rewrites the text and carries, for each character written,
the span of source characters it came from:

1. look-alikes of ASCII characters (full width, Cyrillic and Greek letters, other digits, typographic
   dashes, dots and spaces, invisible characters) become what they look like;
2. runs of spelled digits ("four two one") become digits, joined where only spaces or hyphens are
   between them;
3. "at" and "dot" in brackets, or as words between two address parts, become ``@`` and ``.``.

The same patterns run on the rewritten text, and their matches are mapped back.  Spans found as
written always stay; a span of the rewritten text is added where it touches none of them and at
least one character of it was rewritten.

Defined cases: a null text is the empty text and has no spans; spans are code points with the end
exclusive; rows are independent of each other, so repeated rows give equal results; an empty table
gives no rows; other columns come back inside ``row``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.llm.common import batch_of, documents

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: Numbers with dots between; every match of ``IP`` is four neighbours of such a row.
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = int(d) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def valid(kind: str, found: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in found.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        digits = _digits(found)
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(_digits(found)) <= 15
    return True


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``EMAIL``, leftmost and non-overlapping, looked for around @ signs only."""
    out, floor = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        match = EMAIL.match(text, start) if start < at else None
        if match:
            out.append(match.span())
            floor = match.end()
        at = text.find("@", max(at + 1, floor))
    return out


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``IP``, leftmost and non-overlapping, in time linear in the text."""
    for row in DOTTED.finditer(text):
        parts = row[0].split(".")
        at = row.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k:k + 4])) + 3
            yield at, at + size
            at += size + 1


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind."""
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            if kind == "ip" and "." not in text or kind == "phone" and "+" not in text:
                continue
            found = _addresses(text) if kind == "ip" else (m.span() for m in pattern.finditer(text))
            out[kind] = [(start, end) for start, end in found if valid(kind, text[start:end])]
    return out


# ------------------------------------------------------------------------- transducers

#: Look-alikes that compatibility decomposition does not resolve.
LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "Ρ": "P", "Τ": "T",
    "ɡ": "g", "ı": "i", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "·": ".", "•": ".", "。": ".", "‧": ".",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
DOT_WORDS = ("dot", "point", "punkt", "punto")
AT_WORDS = ("at", "arroba")
_NAMES = "|".join(sorted((*DIGIT_WORDS, *DOT_WORDS, "plus"), key=len, reverse=True))
#: Digits, digit words and spelled dots in a row.
SPELLED = re.compile(rf"(?<!\w)(?:(?:{_NAMES}|[0-9]+)(?:[\x20,-]{{1,2}}|\n))+(?:{_NAMES}|[0-9]+)(?!\w)", re.IGNORECASE)
SPELLED_WORDS = frozenset((*DIGIT_WORDS, *DOT_WORDS))
WORD = re.compile(r"\w+")
_DOTS, _ATS = "|".join(DOT_WORDS), "|".join(AT_WORDS)
#: A sign in brackets, wherever it stands.
BRACKETED = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}({_ATS}|{_DOTS}|@|\.)\s{{0,3}}[\])}}>]\s{{0,3}}", re.IGNORECASE)
_PART = r"[A-Za-z0-9_%+-]+"
_DOT = rf"(?:\s{{1,3}}(?:{_DOTS})\s{{1,3}}|\.)"
#: The at sign of an address, as a word or with space around it, and the domain after it.
SPOKEN_DOMAIN = re.compile(rf"(?:\s{{1,3}}(?:{_ATS})\s{{1,3}}|\s{{0,3}}@\s{{0,3}}){_PART}(?:{_DOT}{_PART})+", re.IGNORECASE)
#: The local part before it; a mailbox name has 64 characters at most.
SPOKEN_LOCAL = re.compile(rf"(?<![\w.]){_PART}(?:{_DOT}{_PART}){{0,4}}\Z", re.IGNORECASE)
LOCAL_CHARACTERS = 100
SIGN = re.compile(rf"\s{{1,3}}({_ATS}|{_DOTS})\s{{1,3}}|\s{{0,3}}(@)\s{{0,3}}", re.IGNORECASE)
#: A spoken address has a spelled dot, a loose at sign, or a plain domain after the word "at".
SPOKEN_HINT = re.compile(rf"\s(?:{_DOTS})\s|\s@|@\s|\s(?:{_ATS})\s{{1,3}}{_PART}\.[A-Za-z0-9]", re.IGNORECASE)


class Mapped:
    """A text under rewriting: its characters and the source span of each."""

    def __init__(self, text: str, starts: list[int], ends: list[int], changed: bytearray) -> None:
        self.text, self.starts, self.ends, self.changed = text, starts, ends, changed

    @staticmethod
    def of(text: str) -> Mapped:
        return Mapped(text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text)))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Apply edits ``(start, end, new text)``, ascending and apart from each other."""
        if not edits:
            return self
        text, starts, ends, changed, at = [], [], [], bytearray(), 0
        for start, end, new in edits:
            text += [self.text[at:start], new]
            starts += self.starts[at:start] + [self.starts[start]] * len(new)
            ends += self.ends[at:start] + [self.ends[end - 1]] * len(new)
            changed += self.changed[at:start] + b"\x01" * len(new)
            at = end
        text.append(self.text[at:])
        return Mapped("".join(text), starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def _look(character: str) -> str:
    if character in LOOKS:
        return LOOKS[character]
    if character.isdigit() and not character.isascii():
        return str(unicodedata.digit(character))
    folded = unicodedata.normalize("NFKC", character)
    return folded if folded.isascii() else character


_LOOK_CACHE: dict[str, str] = {}


def fold_looks(mapped: Mapped) -> Mapped:
    if mapped.text.isascii():
        return mapped
    looks = {}
    for c in set(mapped.text):
        if not c.isascii():
            if c not in _LOOK_CACHE:
                _LOOK_CACHE[c] = _look(c)
            if _LOOK_CACHE[c] != c:
                looks[c] = _LOOK_CACHE[c]
    if not looks:
        return mapped
    found = re.compile("[" + "".join(map(re.escape, looks)) + "]")
    return mapped.rewritten([(m.start(), m.end(), looks[m[0]]) for m in found.finditer(mapped.text)])


def spell_digits(mapped: Mapped) -> Mapped:
    """Three spelled signs in a row, at least, and the digits beside them."""
    words = mapped.text.lower().replace(",", " ").replace("-", " ").split()
    if sum(map(SPELLED_WORDS.__contains__, words)) < 3:
        return mapped
    edits = []
    for match in SPELLED.finditer(mapped.text):
        found = [w[0].lower() for w in WORD.finditer(match[0])]
        if sum(w in SPELLED_WORDS for w in found) < 3:
            continue
        signs = "".join("+" if w == "plus" else "." if w in DOT_WORDS else DIGIT_WORDS.get(w, w) for w in found)
        edits.append((match.start(), match.end(), signs))
    return mapped.rewritten(edits)


def undo_signs(mapped: Mapped) -> Mapped:
    mapped = mapped.rewritten([
        (m.start(), m.end(), "@" if m[1].lower() in (*AT_WORDS, "@") else ".")
        for m in BRACKETED.finditer(mapped.text)])
    text = mapped.text
    if not SPOKEN_HINT.search(text):
        return mapped
    edits, floor = [], 0
    for domain in SPOKEN_DOMAIN.finditer(text):
        local = SPOKEN_LOCAL.search(text, max(floor, domain.start() - LOCAL_CHARACTERS), domain.start())
        if not local:
            continue
        signs = [
            (m.start(), m.end(), "@" if (m[1] or "@").lower() in (*AT_WORDS, "@") else ".")
            for m in SIGN.finditer(text, local.start(), domain.end())]
        signs = [e for e in signs if text[e[0]:e[1]] != e[2]]
        dotted = any(new == "." for _, _, new in signs)
        # "look at example.com" is no address; "j.doe at example.com" is
        if dotted or "@" in text[domain.start():domain.start() + 4] or re.search(r"[._%+0-9-]", local[0]):
            edits += signs
            floor = domain.end()
    return mapped.rewritten(edits)


def all_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """The base spans, and base and added ones together, by kind in the order of their starts."""
    base = plain_spans(text)
    whole = Mapped.of(text) if _disguised(text) else None
    mapped = whole and undo_signs(spell_digits(fold_looks(whole)))
    if mapped is whole:
        return base, base
    taken = sorted(span for spans in base.values() for span in spans)
    both = {}
    for kind, spans in plain_spans(mapped.text).items():
        added = []
        for start, end in spans:
            source = mapped.source(start, end)
            rewritten = any(mapped.changed[start:end]) or source[1] - source[0] != end - start
            if rewritten and not _touches(taken, source):
                added.append(source)
        both[kind] = sorted(base[kind] + added)
    return base, both


def _disguised(text: str) -> bool:
    """Whether any transducer could rewrite the text; nothing else is decided here."""
    if not text.isascii() and any(_look(c) != c if c not in _LOOK_CACHE else _LOOK_CACHE[c] != c
                                  for c in set(text) if not c.isascii()):
        return True
    if not SPELLED_WORDS.isdisjoint(text.lower().replace(",", " ").replace("-", " ").split()):
        return True
    return bool(BRACKETED.search(text) or SPOKEN_HINT.search(text))


def _touches(taken: list[tuple[int, int]], span: tuple[int, int]) -> bool:
    return any(start < span[1] and span[0] < end for start, end in taken)


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in KINDS for start, end in spans[kind])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 1000):
            part = batch.slice(k, 1000)
            found = [all_spans(text or "") for text in part.column(1).to_pylist()]
            yield batch_of(
                {"row": part.column(0)}
                | {f"n_{kind}": pa.array([len(base[kind]) for base, _ in found], pa.int64()) for kind in KINDS}
                | {"base": pa.array([joined(base) for base, _ in found]), "spans": pa.array([joined(s) for _, s in found])})


def spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Each row with its spans.

    Returns ``row`` (the columns ``keep``, or all), the number of base spans of each kind, ``base``
    (them) and ``spans`` (them and those found under a disguise), written ``kind:start:end``.
    """
    names = keep or tuple(docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_find, f"row {kind}, {counts}, base string, spans string")


def masked(text: str, mask: str = "[{kind}]") -> str:
    """The text with every span replaced by its kind."""
    _, found = all_spans(text)
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, both in found.items() for s, e in both):
        if start >= at:
            out += [text[at:start], mask.format(kind=kind)]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their spans."""
    found = spans(documents(spark, folder), keep=("doc_id",))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[f"n_{k}" for k in KINDS],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES = {"op6_personal_data": op6_personal_data}
ORACLE: dict = {}
