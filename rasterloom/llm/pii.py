"""Personal data in texts: patterns propose, checksums confirm, context scores.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are reported whenever their
pattern matches and their validator agrees; nearby words only move their
score.  Extra kinds (``iban``, ``ssn``, ``short_card``, ``secret``) look more like
ordinary text, so they are kept only if their score, after the checksum and the
context words, reaches ``threshold``.  An IBAN ends at its country's length,
whatever stands after it.  A secret is a value of at least 16 characters given to
a name such as token or password; its check is the spread of its characters.

Defined results: a null or empty text has no spans; each row is handled on its
own, so repeated rows give repeated results and an empty table gives none;
columns other than the id and the text are not read.  All patterns are scanned
in time linear in the text, so one very long text is no danger.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from ._base import as_texts, map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "short_card", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can begin inside a run of digits only if it fails at the run's start too,
# so the look-behind changes no result; it keeps long runs from being rescanned.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_SECRET = re.compile(r"""(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key))["']?[ \t]{0,8}[:=][ \t]{0,8}["']?([A-Za-z0-9_+/.=-]{16,256})(?![A-Za-z0-9_+/.=-])""")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# The length of an IBAN in each country (ISO 13616 registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN_OF = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
# Words that raise the score of a kind when they stand near it.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "debit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "short_card": ("card", "visa", "amex", "mastercard", "credit", "debit"),
    "secret": ("token", "secret", "password", "key", "login", "auth"),
}
# Words that lower the score, as they announce some other number.
AGAINST = ("version", "order", "isbn", "invoice", "part", "serial", "build")
_WORD = re.compile(r"[a-z-]+")
WINDOW = 40
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "short_card": 0.4, "secret": 0.5}


def luhn(digits: str) -> bool:
    """Whether a string of ASCII digits has a valid Luhn check digit."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without blanks leaves the remainder 1 (ISO 7064)."""
    moved = iban[4:] + iban[:4]
    rest = 0
    for c in moved:
        rest = int(str(rest) + str(int(c, 36))) % 97
    return rest == 1


def _emails(text: str):
    """Leftmost non-overlapping matches of the e-mail pattern.

    The local part cannot hold an @, so each match ends its local part at one @:
    walking left from every @ visits each character once.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def _in_byte(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(map(_in_byte, m[0].split("."))):
            yield m.span()


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    """Spans of the length their country has, with a valid checksum."""
    done = 0
    for m in _IBAN.finditer(text):
        size = IBAN_LENGTHS.get(m[0][:2])
        whole = _IBAN_OF[size].match(text, m.start()) if size and m.start() >= done else None
        if whole and mod97(whole[0].replace(" ", "")):
            yield whole.span()
            done = whole.end()


def spread(value: str) -> float:
    """Bits a character, by how often each occurs in the value."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def _secrets(text: str):
    """Values given to secret names: letters and digits mixed, of some three bits a character."""
    for m in _SECRET.finditer(text):
        value = m[1]
        if spread(value) >= 2.8 and any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
            yield m.span(1)


def _overlaps(span, others) -> bool:
    return any(a < span[1] and span[0] < b for a, b in others)


def context_score(kind: str, text: str, start: int, end: int) -> float:
    """The prior of the kind, moved by words up to ``WINDOW`` characters away."""
    near = text[max(0, start - WINDOW):start] + " " + text[end:end + WINDOW]
    words = set(_WORD.findall(near.lower()))
    score = PRIOR[kind]
    if words.intersection(CONTEXT[kind]):
        score += 0.35
    if words.intersection(AGAINST):
        score -= 0.25
    return min(1.0, max(0.0, score))


def find_spans(text: str, threshold: float = 0.6) -> list[tuple[str, int, int, float]]:
    """All spans ``(kind, start, end, score)``, by kind as in ``KINDS``, then start."""
    spans: list[tuple[str, int, int, float]] = []
    has_digit = re.search("[0-9]", text) is not None
    if "@" in text:
        spans += [("email", a, b, context_score("email", text, a, b)) for a, b in _emails(text)]
    if not has_digit:
        return spans
    if "." in text:
        spans += [("ip", a, b, context_score("ip", text, a, b)) for a, b in _ips(text)]
    short = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            if len(digits) >= 16:
                spans.append(("card", *m.span(), context_score("card", text, *m.span())))
            else:
                short.append(m.span())
    if "+" in text:
        spans += [("phone", a, b, context_score("phone", text, a, b)) for a, b in _phones(text)]
    base = [(a, b) for _, a, b, _ in spans]
    more = [("iban", *span) for span in _ibans(text)]
    more += [("ssn", *m.span()) for m in _SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    more += [("short_card", a, b) for a, b in short]
    for kind, a, b in more:
        score = context_score(kind, text, a, b)
        if score >= threshold and not _overlaps((a, b), base):
            spans.append((kind, a, b, score))
    # a secret is longer than what of it may look like a number, and is told beside that
    scored = [("secret", a, b, context_score("secret", text, a, b)) for a, b in _secrets(text)]
    return spans + [x for x in scored if x[3] >= threshold]


def redact(text: str, spans) -> str:
    """The text with every span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, with_redacted: bool = False) -> DataFrame:
    """One row per input row: the id, its spans and, if asked for, the redacted text."""
    source = docs.select(docs[id_col], docs[text_col])
    id_type = dict(source.dtypes)[id_col]
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_texts(batch.column(1))
        found = [find_spans(t, threshold) for t in texts]
        rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans] for spans in found]
        columns = [batch.column(0), pa.array(rows, span_type)]
        names = [id_col, "spans"]
        if with_redacted:
            columns.append(pa.array([redact(t, s) for t, s in zip(texts, found)], pa.string()))
            names.append("redacted")
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {id_type}, spans {SPAN}" + (", redacted string" if with_redacted else "")
    return map_batches(source, run, schema)


def base_digest(spans) -> str:
    """The hash of the base spans as ``kind:start:end``, comma-joined."""
    said = ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans if k in BASE_KINDS)
    return hashlib.sha256(said.encode()).hexdigest()
