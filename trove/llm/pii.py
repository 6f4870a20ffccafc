"""Personal data: patterns propose spans, checksums confirm, context decides.

The base kinds (email, ip, card, phone) are reported whenever they pass their
check. The added kinds (iban, ssn, secret) start from a score for their form,
gain or lose by the words near them, and are reported from ``THRESHOLD`` on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.llm.words import keyed

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
THRESHOLD = 0.5
CONTEXT_CHARS = 40

# What may stand before the ``@``, and the whole of what must follow it.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP_PART = re.compile(r"0*[0-9]{1,3}")
# A run of digits is taken whole and tried once, from its first digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])"
)
_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])")
_DIGITS = re.compile(r"[0-9]")
# In account numbers letters count from ten.
_NUMBERS = {ord(c): str(int(c, 36)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
# Kind number, kind, pattern and the score of the form alone.
_ADDED = ((4, "iban", _IBAN, 0.8), (5, "ssn", _SSN, 0.4), (6, "secret", _SECRET, 0.8), (6, "secret", _HEX, 0.3))
# Words that make a kind more or less likely when they stand near.
_NEAR = {
    "iban": re.compile(r"(?i)\b(?:iban|bank|account|konto|compte|cuenta|transfer)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|taxpayer|insurance)\b"),
    "secret": re.compile(r"(?i)\b(?:key|token|secret|password|credential|api)\b"),
}
_AGAINST = re.compile(r"(?i)\b(?:isbn|order|invoice|example|sample|version|serial)\b")
_GAIN, _LOSS = 0.3, 0.35


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others, doubling every second."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = ord(c) - 48
        if i % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number leaves 1 when divided by 97."""
    return _iban_end(iban) == len(iban)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from left to right, each character read a bounded number of times.

    All of a local part's beginnings lead to the same ``@``, so an address begins
    where the local part does, or where the address before it ends.
    """
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        last = at + 1
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the four base kinds."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(_IP_PART.fullmatch(x) and int(x[-3:]) <= 255 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _digits(m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return found


def _valid(kind: str, text: str) -> bool:
    if kind == "ssn":
        area, group, serial = text.split("-")
        return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    return True


def _iban_end(text: str) -> int:
    """The length of the longest account number that starts ``text`` and ends with a word; 0 for none.

    The remainder by 97 is carried from word to word; the first four characters
    count last.
    """
    head = text[:4].translate(_NUMBERS)
    scale, first = 10 ** len(head), int(head)
    rest = found = at = 0
    size = 4
    for word in text[4:].split(" "):
        digits = word.translate(_NUMBERS)
        if digits:
            rest = (rest * 10 ** len(digits) + int(digits)) % 97
        size += len(word)
        at += len(word)
        if 15 <= size <= 34 and (rest * scale + first) % 97 == 1:
            found = at + 4
        at += 1
    return found


def added_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the added kinds whose score, with context, reaches the threshold."""
    found = []
    if not _DIGITS.search(text):
        return found
    for number, kind, pattern, form in _ADDED:
        at = 0
        while m := pattern.search(text, at):
            start, end = m.span()
            if kind == "iban":
                end = start + _iban_end(m[0])
                # Words that a number leaves over, or a match without one, may start the next.
                at = end if end > start else start + 2
            else:
                at = end
            if end == start or not _valid(kind, m[0]):
                continue
            near = text[max(0, start - CONTEXT_CHARS) : start]
            near += " " + text[end : end + CONTEXT_CHARS]
            score = form + _GAIN * bool(_NEAR[kind].search(near))
            score -= _LOSS * bool(_AGAINST.search(near))
            if score >= THRESHOLD:
                found.append((start, number, end))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end``, joined by commas, by start and then kind."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds and all spans of every row's whole text.

    Offsets are code points, ends are exclusive. ``base_spans`` has the four
    base kinds, ``spans`` all kinds. A null or empty text has none. Repeated
    rows are each reported, ids stay as they are (null too), other columns are
    not read, and an empty table gives no rows. Work grows with a text's length
    and no faster, whatever it holds.
    """
    schema = docs.select(F.col(id_col)).schema
    for kind in BASE_KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_spans", "string").add("spans", "string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, spans = [[], [], [], []], [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text)
                for kind in range(4):
                    counts[kind].append(sum(x[1] == kind for x in found))
                base.append(written(found))
                spans.append(written(found + added_spans(text)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in counts)]
                + [pa.array(base, pa.string()), pa.array(spans, pa.string())],
                schema.names,
            )

    return keyed(docs, text_col, F.col(id_col)).mapInArrow(scan, schema)


def redact(text: str, mark: str = "[{}]") -> str:
    """``text`` with every found span replaced by its kind; overlaps are merged."""
    out, at = [], 0
    for start, kind, stop in sorted(base_spans(text) + added_spans(text)):
        if start >= at:
            out += [text[at:start], mark.format(KINDS[kind])]
        at = max(at, stop)
    return "".join(out) + text[at:]

