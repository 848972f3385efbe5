"""Personal data in whole texts, with disguises undone and offsets kept.

Base detectors find e-mail and IP addresses, card and phone numbers as written. Then transducers
rewrite the text: look-alike letters and full-width forms to ASCII, invisible characters to
nothing, spelled digits to digits, at/dot disguises to their signs. Each rewrite keeps the source
span of every output character, so that what the same detectors find in the normalised text is
reported at its place in the source. One pass per text, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.llm.scratch import bounded_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Look-alike letters of other scripts, and invisible characters.
LOOKALIKES = dict(zip("АВЕКМНОРСТУХІЈЅаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABEKMHOPCTYXIJSaeopcyxijsdqwhABEZHIKMNOPTYXoav", strict=True))
LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {"。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", "　": " "}
INVISIBLE = "­​‌‍⁠﻿"
# Digits as words in the four languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_FOLD = str.maketrans(LOOKALIKES)
_STRANGE = frozenset(LOOKALIKES) | frozenset(INVISIBLE)
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_NUM = rf"(?<![^\W_]){_WORD}(?![^\W_])"
# A rewrite starts at the beginning of a run of spaces only, so long runs are read once.
_REWRITE = re.compile(
    rf"""(?P<gone>[{INVISIBLE}]+)
    |(?P<at>(?<!\s)\s*[\[({{<]\s*(?:at|@)\s*[\])}}>]\s*|(?<!\s)\s+@\s+|(?<!\s)\s+at\s+(?=[a-z0-9-]+(?:\s+dot\s+|\s*[\[({{<]\s*(?:dot|\.)\s*[\])}}>])))
    |(?P<dot>(?<!\s)\s*[\[({{<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}}>]\s*|(?<=[^\W_])\s+dot\s+(?=[^\W_]))
    |(?P<plus>(?<![^\W_])plus\s+(?={_WORD}|[0-9]))
    |(?P<num>{_NUM})(?:[\s-]+(?={_NUM}))?""",
    re.I | re.X,
)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of kind) of every base match, leftmost and without overlap in each kind."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((begin, m.end(), 0))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                found.append((*m.span(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((*m.span(), 2))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


def normalise(text: str) -> tuple[str, list[int], list[tuple[int, int, bool]]]:
    """The normalised text; where its parts begin; source span of each and if it is copied as it is."""
    folded = text.translate(_FOLD)
    out, begins, spans, at, n = [], [], [], 0, 0

    def put(s: str, a: int, b: int, copied: bool) -> None:
        nonlocal n
        if s:
            out.append(s)
            begins.append(n)
            spans.append((a, b, copied))
            n += len(s)

    for m in _REWRITE.finditer(folded):
        put(folded[at : m.start()], at, m.start(), True)
        kind = m.lastgroup
        put("" if kind == "gone" else "@" if kind == "at" else "." if kind == "dot" else "+" if kind == "plus" else DIGIT_WORDS[m["num"].lower()], *(m.span("num") if kind == "num" else m.span()), False)
        at = m.end()
    put(folded[at:], at, len(folded), True)
    return "".join(out), begins, spans


def _disguised(text: str) -> bool:
    """Whether ``normalise`` would change the text at all."""
    if not text.isascii() and not _STRANGE.isdisjoint(text):
        return True
    return bool(_REWRITE.search(text))


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that normalisation adds: not equal to or inside a base span of its kind."""
    base = detect(text)
    if not text or not _disguised(text):
        return base, []
    plain, begins, spans = normalise(text)
    added = set()
    for a, b, kind in detect(plain):
        i, j = bisect_right(begins, a) - 1, bisect_right(begins, b - 1) - 1
        start = spans[i][0] + (a - begins[i] if spans[i][2] else 0)
        end = spans[j][0] + (b - begins[j]) if spans[j][2] else spans[j][1]
        while end > start and text[end - 1].isspace():
            end -= 1
        while start < end and text[start].isspace():
            start += 1
        if not any(k == kind and s <= start and end <= e for s, e, k in base):
            added.add((start, end, kind))
    return base, sorted(added, key=lambda x: (x[0], x[2]))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (all spans), base_sha256, spans, n_added.

    Offsets are code points, ends exclusive. Null and empty texts have no spans (the hash is that of
    the empty string). Repeated rows get equal answers; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                base, added = find(text or "")
                spans = sorted(base + added, key=lambda x: (x[0], x[2]))
                kinds = [k for _, _, k in spans]
                for to, x in zip(cols, (*map(kinds.count, range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(added)), strict=True):
                    to.append(x)
            kinds_ = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds_, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str) -> str:
    """The text with every found span replaced by its kind in brackets; overlapping spans as one."""
    base, added = find(text)
    merged: list[list] = []
    for a, b, k in sorted(base + added):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    cuts = [0, *(x for a, b, _ in merged for x in (a, b)), len(text)]
    kept = [text[a:b] for a, b in pairwise(cuts)][::2]
    return "".join(x + y for x, y in zip(kept, [*(f"[{KINDS[k]}]" for _, _, k in merged), ""], strict=True))
