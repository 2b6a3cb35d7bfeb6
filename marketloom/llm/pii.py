"""Operator 1: personal data, also in disguise, with spans in the source text.

Base detection finds emails, IPs, cards and phones in the text as it is. A chain of transducers then rewrites disguised
places - characters that look like ASCII ones, spelled digits, "at" and "dot" - and keeps for every written character the
stretch of source it came from. What is detected in the rewritten text only is mapped back to source characters and added;
base spans stay.

Defined results: a null text is empty and has no spans; a null doc_id keeps its row; repeated rows are searched each; other
columns of the input stay in ``redact`` and are dropped by ``find``. Matching is linear in the text's length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import steps, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# -- base detection --------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match cannot begin inside a run of digits, so the run's start is the only place to try.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")


def emails(text: str) -> list[Span]:
    """Every at sign takes the longest local part after the last match, and the longest domain."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            end = domain.end()
            found.append(("email", begin, end))
        at = text.find("@", max(at + 1, end))
    return found


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _ip(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))


def _card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def _phone(found: str) -> bool:
    return 8 <= len(DIGITS.findall(found)) <= 15


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by kind, then start."""
    spans = emails(text)
    if DIGITS.search(text):
        for kind, pattern, right in (("ip", IP, _ip), ("card", CARD, _card), ("phone", PHONE, _phone)):
            spans += [(kind, *m.span()) for m in pattern.finditer(text) if right(m.group())]
    return spans


# -- transducers -----------------------------------------------------------------------

# Letters and marks of other scripts that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "А": "A", "В": "B", "с": "c", "С": "C", "е": "e", "Е": "E", "Н": "H", "і": "i", "І": "I", "ј": "j", "К": "K",
    "М": "M", "о": "o", "О": "O", "р": "p", "Р": "P", "ѕ": "s", "Т": "T", "у": "y", "х": "x", "Х": "X", "ԁ": "d", "һ": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "ο": "o", "Ρ": "P",
    "ρ": "p", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ı": "i", "ɡ": "g",
    "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
# Names of digits.
NUMBERS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8",
    "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8",
    "nueve": "9",
}


class Tape:
    """A text and, for each of its characters, the stretch of source it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.begin, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.written = [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches (in order, not overlapping); each new character stands for the whole stretch."""
        if not edits:
            return
        text, begin, end, written, at = [], [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            text.append(new)
            for own, part, value in ((begin, self.begin, None), (end, self.end, None), (written, self.written, True)):
                own += part[at:a]
                own += [(part[a] if own is begin else part[b - 1]) if value is None else True] * len(new)
            at = b
        text.append(self.text[at:])
        begin += self.begin[at:]
        end += self.end[at:]
        written += self.written[at:]
        self.text, self.begin, self.end, self.written = "".join(text), begin, end, written


def _plain(c: str) -> str:
    """What a character beyond Latin-1 looks like, or itself."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    wide = unicodedata.normalize("NFKC", c)
    if len(wide) == 1 and wide.isascii():
        return wide
    value = unicodedata.digit(c, None) if c.isdecimal() else None
    return c if value is None else str(value)


ODD = re.compile(r"[^\x00-\x9f\xa1-\xac\xae-\xff]")
_WORD = "|".join(sorted(NUMBERS, key=len, reverse=True))
_ITEM = rf"(?:\b(?:{_WORD})\b|[0-9])"
# Eight or more digits in a row, at least one of them spelled; single digits may stand between the words.
SPELLED = re.compile(rf"(?:\b(?:{_WORD})\b|(?<![0-9A-Za-z])[0-9])(?:[ ,.-]{{1,2}}{_ITEM}|(?<=[0-9])[0-9]){{3,}}(?![0-9A-Za-z])", re.I)
TOKEN = re.compile(rf"{_WORD}|[0-9]|[.]", re.I)
PLUS = re.compile(rf"\bplus[ -]+(?=[0-9]|(?:{_WORD})\b)", re.I)
AT = re.compile(r"[ ]?[\[({<]\s?(?:at|@)\s?[\])}>][ ]?", re.I)
DOT = re.compile(r"[ ]?[\[({<]\s?(?:dot|\.)\s?[\])}>][ ]?", re.I)
# Bracketed dots read " dot " by now. A local part is tried from its first word only: it would end at the same place from any other.
_NAME = r"(?<![A-Za-z0-9_%+.-])(?<! dot )[A-Za-z0-9_%+-]++(?:(?: dot |\.)[A-Za-z0-9_%+-]+)*+"
_HOST = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
# "a at b.c" is ordinary language, so a spoken at needs a spoken dot behind it; an at sign needs none.
SPOKEN = re.compile(rf"{_NAME}(?: at {_HOST}(?: dot {_HOST})++|@{_HOST}(?: dot {_HOST})*+)", re.I)
SPOKEN_WORD = re.compile(r" (?:at|dot) ", re.I)
SPOKEN_IP = re.compile(r"\b[0-9]{1,3}(?:(?: (?:dot|point) |\.)[0-9]{1,3}){3}\b", re.I)
# What the transducers need to begin, in lower case: the pre-test is made of these.
SIGNS = re.compile(r"dot |[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]|[0-9] point [0-9]")
LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
PAIR = re.compile(rf"\b(?:{_WORD})[ ,.-]{{1,2}}(?:[0-9]|(?:{_WORD})\b)|[0-9][ ,.-]{{1,2}}(?:{_WORD})\b")
NAMES = frozenset(NUMBERS)


def disguised(text: str) -> bool:
    """Whether a transducer could rewrite anything: true for every text that ``transduce`` changes."""
    if not text.isascii() and ODD.search(text):
        return True
    low = text.lower()
    if SIGNS.search(low) or ("plus" in low and PLUS.search(low)):
        return True
    return not NAMES.isdisjoint(LETTERS.findall(low)) and PAIR.search(low) is not None


def transduce(text: str) -> Tape:
    """Rewrite look-alikes, spelled digits and at/dot disguises, one transducer after the other."""
    tape = Tape(text)
    edits = []
    for m in re.finditer(f"[{INVISIBLE}]|{ODD.pattern}", tape.text):
        plain = "" if m.group() in INVISIBLE else _plain(m.group())
        if plain != m.group():
            edits.append((*m.span(), plain))
    tape.rewrite(edits)
    tape.rewrite([(m.start(), m.end(), "+") for m in PLUS.finditer(tape.text)])
    edits = []
    for m in SPELLED.finditer(tape.text):
        written = m.group()
        names = [t for t in TOKEN.findall(written) if t != "."]
        if all(t.isdigit() for t in names):
            continue
        for part in re.finditer(rf"(?:{_WORD}|[0-9])(?:[ ,-]{{1,2}}(?={_WORD}|[0-9]))?", written, re.I):
            name = re.match(rf"{_WORD}|[0-9]", part.group(), re.I).group().lower()
            edits.append((m.start() + part.start(), m.start() + part.end(), NUMBERS.get(name, name)))
    tape.rewrite(edits)
    tape.rewrite([(*m.span(), "@") for m in AT.finditer(tape.text)])
    tape.rewrite([(*m.span(), " dot ") for m in DOT.finditer(tape.text)])
    edits = []
    for m in SPOKEN.finditer(tape.text):
        for word in SPOKEN_WORD.finditer(m.group()):
            edits.append((m.start() + word.start(), m.start() + word.end(), "@" if word.group().strip().lower() == "at" else "."))
    tape.rewrite(edits)
    edits = []
    for m in SPOKEN_IP.finditer(tape.text):
        for word in re.finditer(r" (?:dot|point) ", m.group(), re.I):
            edits.append((m.start() + word.start(), m.start() + word.end(), "."))
    tape.rewrite(edits)
    tape.rewrite([(*m.span(), ".") for m in re.finditer(" dot ", tape.text) if all(tape.written[m.start() : m.end()])])
    return tape


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """Base spans and those found in the rewritten text that touch a rewritten character and no base span of their kind."""
    if not disguised(text):
        return base
    tape = transduce(text)
    added = []
    for kind, a, b in base_spans(tape.text):
        if True not in tape.written[a:b]:
            continue
        begin, end = tape.begin[a], tape.end[b - 1]
        if not any(k == kind and begin < y and x < end for k, x, y in base + added):
            added.append((kind, begin, end))
    return sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, all_spans(text, base)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every stretch of spans replaced by the name of the kind of its first span."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# -- operators -------------------------------------------------------------------------

FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, the digest of base spans, all spans, and how many the method added."""

    def scan(batches):
        for batch in batches:
            for part in steps(batch):
                rows = []
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    base, spans = spans_of(text)
                    kinds = [k for k, _, _ in base]
                    digest = hashlib.sha256(written(base).encode()).hexdigest()
                    rows.append((key, *(kinds.count(k) for k in KINDS), digest, written(spans), len(spans) - len(base)))
                names = [x.split()[0] for x in FOUND.split(", ")]
                types = [pa.string() if x.endswith("string") else pa.int64() for x in FOUND.split(", ")]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    keyed = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts_of(keyed, "doc_id").mapInArrow(scan, FOUND)


def _redact(texts):
    return texts.map(lambda t: t if t is None else redacted(t, spans_of(t)[1]))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data in their texts replaced; a null text stays null."""
    return docs.withColumn("text", F.pandas_udf(_redact, "string")(F.col("text").cast("string")))


def op1_pii(spark, folder: str) -> DataFrame:
    return find(spark.read.parquet(f"{folder}/documents.parquet"))
