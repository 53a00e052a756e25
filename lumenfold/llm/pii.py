"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, batch, bounded_batches, pick, texts

#: Kinds in the order of the results; the first four are the base kinds, which no score removes.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "card_short")

#: Context words (lower case) looked for within CONTEXT_CHARS on either side of a span.
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security"),
    "card_short": ("card", "amex", "american express", "visa", "credit", "debit", "payment"),
}
CONTEXT_CHARS = 60
#: Score of a proposed span, what a passed checksum and a context word add, and what a span of an added kind needs.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.3, "phone": 0.5, "iban": 0.3, "ssn": 0.3, "card_short": 0.1}
CHECKSUM_BONUS, CONTEXT_BONUS, NEEDED = 0.5, 0.3, 0.6

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_GROUP = re.compile(r"[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_TAIL = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
_BORDER = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SIGN = re.compile(r"[0-9@]")


#: Characters of an IBAN by country. Of a country not listed, any length from 15 to 34 will do.
IBAN_LENGTHS = {
    k: n
    for n, ks in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for k in ks.split()
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(c if c.isdigit() else str(ord(c) - 55) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, domain. The local part is the whole run of its characters before an @, so each @ is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            reach = 64
            while True:
                low = max(free, at - reach)
                part = text[low:at]
                run = len(part) - len(part.rstrip(_LOCAL))
                if run < len(part) or low == free:
                    break
                reach *= 4
            if run:
                yield at - run, m.end()
                free = m.end()
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Dotted digit groups taken four by four from the left of each chain; a part over 255 drops its four."""
    for chain in _DOTTED.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *chain.span())]
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in four):
                yield four[0][0], four[3][1]


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    """Digits joined by single spaces or hyphens, with their digits alone."""
    for m in _DIGITS.finditer(text):
        yield m.start(), m.end(), m.group().replace(" ", "").replace("-", "")


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each country code with check digits: the country's length, else the longest one, that ends where no letter or digit follows and
    passes mod-97. A failed start is passed by alone: the next one may lie within what followed it."""
    free = 0
    for head in _IBAN_HEAD.finditer(text):
        a = head.start()
        if a < free or not (tail := _IBAN_TAIL.match(text, head.end())):
            continue
        fixed = IBAN_LENGTHS.get(text[a : a + 2])
        for end in reversed([m.start() for m in _BORDER.finditer(text, head.end(), tail.end() + 1) if m.start() <= tail.end()]):
            plain = text[a:end].replace(" ", "")
            if (len(plain) == fixed if fixed else len(plain) >= 15) and mod97(plain):
                yield a, end
                free = end
                break


def find_spans(text: str | None) -> list[Span]:
    """All spans by kind, then start. None and texts without a digit or an @ have none."""
    if not text or not _SIGN.search(text):
        return []
    found: list[tuple[str, int, int, bool]] = []
    if "@" in text:
        found += [("email", a, b, False) for a, b in _emails(text)]
    found += [("ip", a, b, False) for a, b in _ips(text)]
    runs = list(_runs(text))
    found += [("card", a, b, True) for a, b, d in runs if 16 <= len(d) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", m.start(), m.end(), False) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    found += [("iban", a, b, True) for a, b in _ibans(text)]
    found += [("ssn", m.start(), m.end(), False) for m in _SSN.finditer(text) if m.group()[:3] not in ("000", "666") and m.group()[0] != "9" and m.group()[4:6] != "00" and m.group()[7:] != "0000"]
    found += [("card_short", a, b, True) for a, b, d in runs if (len(d) == 15 and d[:2] in ("34", "37") or len(d) == 13 and d[0] == "4") and luhn(d)]
    spans = []
    for kind, a, b, checked in found:
        near = f"{text[max(0, a - CONTEXT_CHARS) : a]} {text[b : b + CONTEXT_CHARS]}".lower()
        score = min(1.0, PRIOR[kind] + CHECKSUM_BONUS * checked + CONTEXT_BONUS * any(w in near for w in CONTEXT[kind]))
        if kind in BASE_KINDS or score >= NEEDED - 1e-9:
            spans.append(Span(kind, a, b, score))
    spans.sort(key=lambda s: (KINDS.index(s.kind), s.start))
    return spans


def _joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SPANS = "doc_id long, spans array<struct<kind string, start int, end int, score double>>"


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and its spans (code points, end exclusive), by kind and start.

    A null or empty text has no spans; a null doc_id stays null; repeated rows give repeated rows; an empty table gives none.
    The work is one pass over each text in a map without shuffle."""
    schema = arrow_schema(SPANS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch([b.column(0), [[s._asdict() for s in find_spans(t)] for t in texts(b.column(1))]], schema)

    bounded_batches(docs.sparkSession)
    return pick(docs, doc_id="long", text="string").mapInArrow(scan, SPANS)


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def pii_digest(docs: DataFrame) -> DataFrame:
    """pii_spans() as counts of the base kinds, a digest of the base spans, and all spans and their scores as text."""
    schema = arrow_schema(DIGEST)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[Span(**s) for s in r] for r in b.column(1).to_pylist()]
            base = [[s for s in r if s.kind in BASE_KINDS] for r in rows]
            counts = [[sum(s.kind == k for s in r) for r in base] for k in BASE_KINDS]
            yield batch([b.column(0), *counts, [hashlib.sha256(_joined(r).encode()).hexdigest() for r in base], [_joined(r) for r in rows], [",".join(f"{s.score:.2f}" for s in r) for r in rows]], schema)

    return pii_spans(docs).mapInArrow(digest, DIGEST)
