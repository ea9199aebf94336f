"""Personal data, also in disguise, with spans in the source text's characters.

Base detectors find e-mail addresses, IPv4 addresses, payment cards and phone
numbers as they stand. A text that shows a sign of disguise then runs through
transducers, each of which rewrites some of it and keeps, for every character
it puts out, the source characters it stands for: look-alike characters and
invisible ones, spelled-out digits, written-out "at" and "dot". The detectors
run again on the outcome, and spans that rest on rewritten characters are
mapped back and join the base spans. Base spans always stay.

Null and empty texts hold nothing. Spans never cross rows; rows that repeat
are scanned each, an empty table gives no rows. A span found in disguise that
overlaps a base span of its kind, or an earlier one in disguise, is dropped.
Very long texts are read whole; the detectors take time in proportion to a
text's length, whatever it holds. Extra columns, whatever their names, are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that fails at a run's first digit fails at its later ones, so a search may begin at run starts alone.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """What the contract's expression finds from left to right, looking only around each ``@``."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
        done = max(done, 0)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def ips(text: str) -> list[tuple[int, int]]:
    ok = lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    return [m.span() for m in _IP.finditer(text) if ok(m[0])]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


DETECTORS: dict[str, Callable[[str], list[tuple[int, int]]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Look-alikes, fixed values: what a character stands for.
_ALIKE = dict(zip("аеорсухіјѕԁһԛԝ", "aeopcyxijsdhqw", strict=True)) | dict(zip("АВЕКМНОРСТХІЈЅ", "ABEKMHOPCTXIJS", strict=True))
_ALIKE |= dict(zip("οαινρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaivpuABEZHIKMNOPTYX", strict=True))
_ALIKE |= {"﹫": "@", "․": ".", "。": ".", "｡": ".", "﹒": ".", "·": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "﹣": "-", "−": "-", "﹢": "+", " ": " ", " ": " ", " ": " ", " ": " "}
_ALIKE |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
for _zero in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
    _ALIKE |= {chr(_zero + i): chr(0x30 + i) for i in range(10)}
_ALIKE |= dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789", strict=True)) | dict(zip("₀₁₂₃₄₅₆₇₈₉", "0123456789", strict=True))
_ALIKE |= dict(zip("⓪①②③④⑤⑥⑦⑧⑨", "0123456789", strict=True))
_UNSEEN = "­​‌‍⁠﻿"
_ODD = re.compile("[" + re.escape("".join(_ALIKE)) + _UNSEEN + "]")
# Spelled digits in the languages of the corpus.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_SPELLED = rf"(?:{'|'.join(sorted(_DIGITS, key=len, reverse=True))})"
_REPEAT = r"(?:(?:double|triple)[\s-]+)?"
_LINK = r"(?:[\s,.;/-]{1,3}|\s+(?:dot|point|punkt|punto)\s+)"
_RUN = re.compile(rf"(?i)(?<!\w)(?:plus\s+|\+\s?)?{_REPEAT}(?:{_SPELLED}|[0-9]+)(?!\w)(?:{_LINK}{_REPEAT}(?:{_SPELLED}|[0-9]+)(?!\w)){{3,}}")
_RUN_SIGN = re.compile(rf"(?i)(?<!\w){_SPELLED}{_LINK}{_REPEAT}{_SPELLED}(?!\w)")
_ITEM = re.compile(rf"(?i)(?P<plus>plus\s+)|(?:(?P<rep>double|triple)[\s-]+)?(?P<word>{_SPELLED})(?!\w)|(?P<dot>\s+(?:dot|point|punkt|punto)\s+)|(?P<num>[0-9]+)|(?P<gap>[\s,;/-]+)|(?P<rest>.)")
_AT = r"(?:\s*[\[({<]\s*(?:at|ät|arobase|arroba|@)\s*[\])}>]\s*|\s+(?:at|ät|arobase|arroba|@)\s+|_(?:at|arobase|arroba)_|-(?:at|arobase|arroba)-|\s*@\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|point|punto)\s+|_(?:dot|punkt|point|punto)_|-(?:dot|punkt|point|punto)-)"
_BRACKET_AT = r"\s*[\[({<]\s*(?:at|ät|arobase|arroba|@)\s*[\])}>]\s*"
_NAME = r"[A-Za-z0-9_%+-]"
_MAIL = re.compile(
    rf"(?i)(?<![A-Za-z0-9._%+-])(?:{_NAME}{{1,64}}(?:(?:\.|{_DOT}){_NAME}{{1,64}}){{0,4}}?)"
    rf"(?:{_AT}[A-Za-z0-9-]{{1,63}}(?:(?:\.[A-Za-z0-9-]{{1,63}}){{0,3}}?{_DOT}[A-Za-z0-9-]{{1,63}})+|{_BRACKET_AT}[A-Za-z0-9-]{{1,63}}(?:(?:\.|{_DOT})[A-Za-z0-9-]{{1,63}})+)"
)
# Ends of addresses whose signs are written out as words; fixed values.
_TOP = frozenset("com net org edu gov mil int info biz io ai app dev co me tv de fr es it uk us ca au nz ie at ch be nl lu pt pl cz se no dk fi ru ua jp kr cn in br mx ar cl eu example test".split())
# Four numbers, at least one of the dots between them in disguise.
_NUMBER_DOT = r"(?:\s?[\[({<]\s?(?:dot|punkt|point|punto|\.)\s?[\])}>]\s?|\s+(?:dot|punkt|point|punto)\s+|_(?:dot|punkt|point|punto)_)"
_NUMBERS = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{_NUMBER_DOT})[0-9]{{1,3}}){{3}}(?![0-9])")
_NUMBER_ITEM = re.compile(_NUMBER_DOT, re.I)
_AT_ITEM, _DOT_ITEM = re.compile(_AT, re.I), re.compile(_DOT, re.I)
_MAIL_SIGN = re.compile(r"(?i)(?<![^\W_])(?:dot|punkt|point|punto)(?![^\W_])|[\[({<]\s*(?:at|ät|arobase|arroba|@|\.)\s*[\])}>]")


def undot_numbers(tape: "Tape") -> None:
    """Written-out or bracketed dots between the four numbers of an address become dots."""
    tape.rewrite([(*x.span(), ".") for m in _NUMBERS.finditer(tape.text) for x in _NUMBER_ITEM.finditer(tape.text, m.start(), m.end())])


class Tape:
    """A text with, for every character, the source span it stands for, and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.new = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put text in place of ascending, disjoint spans; each new character stands for its whole span."""
        if not edits:
            return
        text, start, end, new, done = [], [], [], [], 0
        for a, b, into in edits:
            for kept, out in ((self.start, start), (self.end, end), (self.new, new)):
                out.append(kept[done:a])
            text.append(self.text[done:a])
            text.append(into)
            n = len(into)
            start.append(np.full(n, self.start[a])), end.append(np.full(n, self.end[b - 1])), new.append(np.ones(n, bool))
            done = b
        text.append(self.text[done:])
        for kept, out in ((self.start, start), (self.end, end), (self.new, new)):
            out.append(kept[done:])
        self.text, self.start, self.end, self.new = "".join(text), np.concatenate(start), np.concatenate(end), np.concatenate(new)


def unmask_characters(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), _ALIKE.get(m[0], "")) for m in _ODD.finditer(tape.text)])


def unspell_digits(tape: Tape) -> None:
    """Runs of at least four spelled or plain digits, two of them spelled, become digits."""
    edits = []
    for m in _RUN.finditer(tape.text):
        if not _RUN_SIGN.search(m[0]):
            continue
        for x in _ITEM.finditer(tape.text, m.start(), m.end()):
            a, b = x.span()
            if x["plus"]:
                edits.append((a, b, "+"))
            elif x["word"]:
                edits.append((a, b, _DIGITS[x["word"].lower()] * {"double": 2, "triple": 3}.get((x["rep"] or "").lower(), 1)))
            elif x["dot"]:
                edits.append((a, b, "."))
            elif x["gap"]:
                edits.append((a, b, ""))
    tape.rewrite(edits)


def unword_addresses(tape: Tape) -> None:
    """Written-out "at" and "dot" become signs where the whole reads as an address."""
    edits = []
    for m in _MAIL.finditer(tape.text):
        at = list(_AT_ITEM.finditer(tape.text, m.start(), m.end()))
        signs = [(*x.span(), "@") for x in at[-1:]]
        signs += [(*x.span(), ".") for x in _DOT_ITEM.finditer(tape.text, m.start(), m.end()) if not any(x.start() < b and a < x.end() for a, b, _ in signs)]
        bare = all(tape.text[a:b].strip().isalpha() for a, b, _ in signs)  # words alone may be a sentence
        if bare and tape.text[max(b for _, b, _ in signs) : m.end()].lower() not in _TOP:
            continue
        edits += sorted(signs)
    tape.rewrite(edits)


def detect(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans that the method adds), each (kind, start, end)."""
    digits = any(c in text for c in "0123456789")
    base = []
    for kind in KINDS:
        if (kind == "email" and "@" in text) or (kind == "phone" and "+" in text) or (kind in ("ip", "card") and digits):
            base += [(kind, a, b) for a, b in DETECTORS[kind](text)]
    tape = Tape(text) if (odd := not text.isascii() and _ODD.search(text)) or _MAIL_SIGN.search(text) or _RUN_SIGN.search(text) else None
    added: list[tuple[str, int, int]] = []
    if tape is None:
        return base, added
    if odd:
        unmask_characters(tape)
    if _MAIL_SIGN.search(tape.text):
        undot_numbers(tape)
    if _RUN_SIGN.search(tape.text):
        unspell_digits(tape)
    if _MAIL_SIGN.search(tape.text):
        unword_addresses(tape)
    if not tape.new.any() and len(tape.text) == len(text):
        return base, added
    for kind in KINDS:
        taken = [(a, b) for k, a, b in base if k == kind]
        for a, b in DETECTORS[kind](tape.text):
            source = int(tape.start[a]), int(tape.end[b - 1])
            rewritten = tape.new[a:b].any() or source[1] - source[0] != b - a
            if rewritten and not any(s < source[1] and source[0] < e for s, e in taken):
                added.append((kind, *source))
                taken.append(source)
    return base, added


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


_COUNTS = tuple(f"n_{k}" for k in KINDS)


def _scan(batches):
    for batch in batches:
        rows = []
        for text in batch.column(1):
            base, added = detect(text.as_py() or "")
            rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + added), len(added), len(base) + len(added)))
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *_COUNTS, "base_sha256", "spans", "n_added", "n_spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base counts n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans for each row of ``docs``."""
    spec = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_sha256 string, spans string, n_added long, n_spans long"
    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _scan, spec)
