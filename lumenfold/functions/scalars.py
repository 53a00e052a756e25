"""Native expressions over Unicode scalars of a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BIDI_CONTROL, DEFAULT_IGNORABLE, LOCATIONS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row. A column that a lambda refers to may be merged into it by the optimizer, and would then be
    computed again for every element; a lambda's own variable never is."""
    return F.transform(F.array(value), body)[0]


def character_class(ranges: Iterable[tuple[int, int]]) -> str:
    """A Java regular expression for one scalar in the ranges. Scalars below all of them fail at the look-ahead, one comparison; a class of many
    ranges takes one for each."""
    ranges = list(ranges)
    return rf"(?=[\x{{{min(a for a, _ in ranges):X}}}-\x{{10FFFF}}])[" + "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


DICP_CLASS = character_class(DEFAULT_IGNORABLE)
BIDI_CLASS = character_class((c, c) for c in BIDI_CONTROL)
#: Controls that would change how a report is displayed.
FORBIDDEN_CLASS = r"[\p{Cc}\x{61C}\x{200E}\x{200F}\x{2028}-\x{202E}\x{2066}-\x{2069}]"


def scalars(text: Column) -> Column:
    """The scalars of a text, one string each; none for an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def code_point(scalar: Column) -> Column:
    """U+ and at least four upper-case hexadecimal digits."""
    digits = F.hex(F.ascii(scalar))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def occurrences(text: Column, one: str) -> Column:
    return F.regexp_count(text, F.lit(one)).cast("long")


def _split(text: Column, one: str, most: int = -1) -> tuple[Column, Column]:
    """The pieces around the scalars of the class, the first `most` of them and the rest as one, and the scalars themselves."""
    return F.split(text, one, most), F.regexp_extract_all(text, F.lit(one), F.lit(0))


def locations(text: Column, one: str, most: int = LOCATIONS) -> Column:
    """The first `most` scalars of the class: code point, abbreviation (of bidi controls), byte and scalar offset. The text is cut at them once,
    and offsets are running sums of the pieces' lengths."""
    names = F.create_map(*[F.lit(v) for c, n in BIDI_CONTROL.items() for v in (f"U+{c:04X}", n)])
    kind = "array<struct<code_point:string,abbreviation:string,byte_offset:bigint,scalar_offset:bigint>>"

    def found(t: Column) -> Column:
        pieces, hits = _split(t, one, most + 1)
        around = F.zip_with(F.slice(hits, 1, most), F.slice(pieces, 1, most), lambda h, p: F.struct(h.alias("h"), F.octet_length(p).cast("long").alias("b"), F.char_length(p).cast("long").alias("s")))
        start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("s"), F.array().cast(kind).alias("out"))

        def step(at: Column, x: Column) -> Column:
            hit = F.struct(code_point(x["h"]).alias("code_point"), F.try_element_at(names, code_point(x["h"])).alias("abbreviation"), (at["b"] + x["b"]).alias("byte_offset"), (at["s"] + x["s"]).alias("scalar_offset"))
            return F.struct((at["b"] + x["b"] + F.octet_length(x["h"])).alias("b"), (at["s"] + x["s"] + 1).alias("s"), F.concat(at["out"], F.array(hit).cast(kind)).alias("out"))

        return F.aggregate(F.filter(around, lambda x: x["h"].isNotNull()), start, step, lambda at: at["out"])

    return F.when(text.rlike(one), let(text, found)).otherwise(F.array().cast(kind))


def human_safe(text: Column) -> Column:
    """Forbidden controls as \\u{hex}, everything else as it is."""

    def escaped(t: Column) -> Column:
        pieces, hits = _split(t, FORBIDDEN_CLASS)
        shown = F.transform(hits, lambda c: F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}")))
        return F.array_join(F.zip_with(pieces, shown, lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")

    return F.when(text.rlike(FORBIDDEN_CLASS), let(text, escaped)).otherwise(text)
