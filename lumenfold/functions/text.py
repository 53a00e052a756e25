"""Functions of text that need Python: normalization, the C2PA text wrapper, SVG detection. Columns pass null for rows they need not see, so
that only the rest goes to Python."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SCALARS, WRAPPER_HEADER, WRAPPER_MAGIC
from ..session import bounded_batches

#: Version of the tables used for normalization, which is what findings report.
NORMALIZATION_VERSION = unicodedata.unidata_version


def _window(text: str, index: int) -> dict:
    shown = text[index : index + SCALARS]
    return {"at_end": index >= len(text), "scalars": [f"U+{ord(c):04X}" for c in shown], "truncated": len(text) > index + SCALARS}


def difference(text: str, form: str) -> dict | None:
    """None if the text is in the form; else digest, length and scalar count of its normalized text, and the first divergence as JSON."""
    if unicodedata.is_normalized(form, text):
        return None
    other = unicodedata.normalize(form, text)
    index = next((i for i, (a, b) in enumerate(zip(text, other, strict=False)) if a != b), min(len(text), len(other)))
    first = {"scalar_index": index, "original_byte_offset": len(text[:index].encode("utf-8", "surrogatepass")), "original": _window(text, index), "normalized": _window(other, index)}
    raw = other.encode("utf-8", "surrogatepass")
    return {"normalized_sha256": hashlib.sha256(raw).hexdigest(), "normalized_byte_length": len(raw), "normalized_scalar_count": len(other), "first_difference": json.dumps(first, separators=(",", ":"))}


_DIFFERENCE = "struct<normalized_sha256 string, normalized_byte_length long, normalized_scalar_count long, first_difference string, unassigned boolean>"


#: Scalars that may be unassigned: below U+0300 none is.
_BEYOND = re.compile("[^\0-\u02ff]")


def _differences(column: pd.Series, form: str) -> pd.DataFrame:
    rows = []
    for t in column:
        found = None if t is None else difference(t, form)
        row = dict.fromkeys(("normalized_sha256", "normalized_byte_length", "normalized_scalar_count", "first_difference")) | (found or {})
        row["unassigned"] = t is not None and any(unicodedata.category(c) == "Cn" and not (0xFDD0 <= ord(c) <= 0xFDEF or ord(c) & 0xFFFE == 0xFFFE) for c in set(_BEYOND.findall(t)))
        rows.append(row)
    out = pd.DataFrame(rows, columns=["normalized_sha256", "normalized_byte_length", "normalized_scalar_count", "first_difference", "unassigned"])
    return out.astype({"normalized_byte_length": "Int64", "normalized_scalar_count": "Int64"})


def _nfc_differences(column: pd.Series) -> pd.DataFrame:
    return _differences(column, "NFC")


def _nfkc_differences(column: pd.Series) -> pd.DataFrame:
    return _differences(column, "NFKC")


def _nfc(column: pd.Series) -> pd.Series:
    return column.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _udf(f, kind: str):
    bounded_batches()
    return F.pandas_udf(f, kind)


# Functions of columns are made when they are called: workers import this module without a session.
def nfc_difference(column: Column) -> Column:
    return _udf(_nfc_differences, _DIFFERENCE)(column)


def nfkc_difference(column: Column) -> Column:
    return _udf(_nfkc_differences, _DIFFERENCE)(column)


def nfc(column: Column) -> Column:
    return _udf(_nfc, "string")(column)


def _selector(c: str) -> int | None:
    n = ord(c)
    return n - 0xFE00 if 0xFE00 <= n <= 0xFE0F else n - 0xE0100 + 16 if 0xE0100 <= n <= 0xE01EF else None


_CANDIDATE = re.compile("﻿([︀-️\U000e0100-\U000e01ef]*)")


def wrappers(text: str) -> dict:
    """Candidates, valid wrappers, the first wrapper and the first error of a text, as JSON. A candidate is U+FEFF and a run of selectors that
    begins like the magic bytes; it is valid if version and run length are right; a second valid one is an error."""
    candidates = valid = 0
    error = first = None
    for m in _CANDIDATE.finditer(text):
        run = bytes(_selector(c) for c in m.group(1))
        head = run[: len(WRAPPER_MAGIC)]
        if not head or head != WRAPPER_MAGIC[: len(head)]:
            continue
        candidates += 1
        offset = len(text[: m.start()].encode())
        whole = len(run) >= WRAPPER_HEADER and run[8] == 1 and len(run) == WRAPPER_HEADER + int.from_bytes(run[9:13], "big")
        if not whole:
            error = error or {"code": "manifest.text.corruptedWrapper", "original_byte_offset": offset}
            continue
        valid += 1
        if valid > 1:
            error = error or {"code": "manifest.text.multipleWrappers", "original_byte_offset": offset}
        if first is None:
            size = len(m.group().encode())
            first = {
                "original_byte_offset": offset,
                "original_byte_length": size,
                "normalized_byte_offset": len(unicodedata.normalize("NFC", text[: m.start()]).encode()),
                "normalized_byte_length": size,
                "declared_manifest_length": int.from_bytes(run[9:13], "big"),
                "manifest_store_sha256": hashlib.sha256(run[WRAPPER_HEADER:]).hexdigest(),
            }
    dump = lambda x: None if x is None else json.dumps(x, separators=(",", ":"))
    return {"candidate_count": candidates, "wrapper_count": valid, "first_wrapper": dump(first), "first_error": dump(error)}


def _wrappers(column: pd.Series) -> pd.DataFrame:
    none = {"candidate_count": 0, "wrapper_count": 0, "first_wrapper": None, "first_error": None}
    return pd.DataFrame([none if t is None else wrappers(t) for t in column], columns=list(none))


def wrapper_scan(column: Column) -> Column:
    return _udf(_wrappers, "struct<candidate_count long, wrapper_count long, first_wrapper string, first_error string>")(column)


_XML_DECLARATION = re.compile(
    rb"""<\?xml[ \t\r\n]+version[ \t\r\n]*=[ \t\r\n]*(?:"1\.[0-9]+"|'1\.[0-9]+')"""
    rb"""(?:[ \t\r\n]+encoding[ \t\r\n]*=[ \t\r\n]*(?:"[A-Za-z][A-Za-z0-9._-]*"|'[A-Za-z][A-Za-z0-9._-]*'))?"""
    rb"""(?:[ \t\r\n]+standalone[ \t\r\n]*=[ \t\r\n]*(?:"(?:yes|no)"|'(?:yes|no)'))?[ \t\r\n]*\?>"""
)
_NAME = re.compile(r"[:A-Z_a-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff][-.:\w·̀-ͯ‿⁀]*")


def _doctype_end(raw: bytes, at: int) -> int | None:
    quote, depth = 0, 0
    for i in range(at, len(raw)):
        c = raw[i]
        if quote:
            quote = 0 if c == quote else quote
        elif c in b"\"'":
            quote = c
        elif c == ord("["):
            depth += 1
        elif c == ord("]"):
            depth -= 1
        elif c == ord(">") and depth <= 0:
            return i + 1
    return None


def is_svg(raw: bytes) -> bool:
    """Whether, after a mark, an XML declaration (first only), instructions, comments and a document type, an svg element opens."""
    at, first = (3 if raw.startswith(b"\xef\xbb\xbf") else 0), True
    while True:
        while at < len(raw) and raw[at] in b" \t\n\x0c\r":
            at += 1
        if first and re.match(rb"<\?xml[ \t\r\n]", raw[at : at + 6]):
            m = _XML_DECLARATION.match(raw, at)
            if not m:
                return False
            at = m.end()
        elif raw.startswith(b"<?", at):
            end = raw.find(b"?>", at)
            if end < 0:
                return False
            try:
                target = re.split(r"[ \t\r\n]", raw[at + 2 : end].decode(), maxsplit=1)[0]
            except UnicodeDecodeError:
                return False
            if not _NAME.fullmatch(target) or target.lower() == "xml":
                return False
            at = end + 2
        elif raw.startswith(b"<!--", at):
            end = raw.find(b"-->", at)
            if end < 0:
                return False
            at = end + 3
        elif raw.startswith(b"<!DOCTYPE", at):
            end = _doctype_end(raw, at)
            if end is None:
                return False
            at = end
        else:
            break
        first = False
    return raw.startswith(b"<svg", at) and len(raw) > at + 4 and raw[at + 4] in b" \t\n\x0c\r>/"


def _svgs(column: pd.Series) -> pd.Series:
    return pd.Series([x is not None and is_svg(bytes(x)) for x in column], dtype=bool)


def svg(column: Column) -> Column:
    return _udf(_svgs, "boolean")(column)
