"""Closed decoding: JSON held against a schema that names every key, as native expressions over VARIANT.

A schema is made of the kinds below. problem() compiles it to one expression that gives the first thing wrong with a value, as `path: what`, or null:
a wrong type, a key that is missing or not known, a value outside its domain. Keys that appear twice in an object make it no JSON at all."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import let


@dataclass(frozen=True)
class Text:
    """A string; of one of `choices`, or matching `pattern` as a whole, where they are given."""

    choices: Sequence[str] = ()
    pattern: str | None = None
    nullable: bool = False


@dataclass(frozen=True)
class Whole:
    """An integer of 64 bits, at least `least` where it is given."""

    least: int | None = None
    nullable: bool = False


@dataclass(frozen=True)
class Truth:
    nullable: bool = False


@dataclass(frozen=True)
class Items:
    """An array of values of one kind."""

    of: Kind
    nullable: bool = False


@dataclass(frozen=True)
class Keys:
    """An object with exactly these keys; those named in `optional` may be missing."""

    of: dict[str, Kind]
    optional: frozenset[str] = field(default_factory=frozenset)
    nullable: bool = False


Kind = Text | Whole | Truth | Items | Keys


def _told(path: str, what: str) -> Column:
    return F.lit(f"{path or '$'}: {what}")


def _type(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def problem(value: Column, kind: Kind, path: str = "") -> Column:
    """The first problem of a VARIANT, null if it has none. A null VARIANT is not JSON."""
    checked = F.when(value.isNull(), _told(path, "not JSON"))
    if kind.nullable:
        checked = checked.when(F.is_variant_null(value), F.lit(None).cast("string"))
    return checked.otherwise(_of_kind(value, kind, path))


def _checker(kind: Kind, path: str) -> Callable[[Column], Column]:
    return lambda value: problem(value, kind, path)


def _of_kind(value: Column, kind: Kind, path: str) -> Column:
    if isinstance(kind, Text):
        text = F.try_variant_get(value, "$", "string")
        out = F.when(_type(value) != "STRING", _told(path, "not a string"))
        if kind.choices:
            out = out.when(~text.isin(*kind.choices), _told(path, "not a known value"))
        if kind.pattern:
            out = out.when(~text.rlike(f"\\A(?:{kind.pattern})\\z"), _told(path, "not of its form"))
        return out
    if isinstance(kind, Whole):
        out = F.when(_type(value) != "BIGINT", _told(path, "not an integer"))
        return out if kind.least is None else out.when(F.try_variant_get(value, "$", "long") < kind.least, _told(path, "too small"))
    if isinstance(kind, Truth):
        return F.when(_type(value) != "BOOLEAN", _told(path, "not a truth value"))
    if isinstance(kind, Items):
        inner = lambda a: F.get(F.filter(F.transform(a, lambda x: problem(x, kind.of, f"{path}[]")), lambda p: p.isNotNull()), F.lit(0))
        return F.when(_type(value) != "ARRAY", _told(path, "not an array")).otherwise(let(F.try_variant_get(value, "$", "array<variant>"), inner))
    known, needed = sorted(kind.of), sorted(set(kind.of) - kind.optional)

    def members(m: Column) -> Column:
        found = F.map_keys(m)
        out = F.when(F.size(F.array_except(found, F.array(*[F.lit(k) for k in known]))) > 0, _told(path, "unknown key"))
        out = out.when(F.size(F.array_except(F.array(*[F.lit(k) for k in needed]), found)) > 0, _told(path, "missing key"))
        each = []
        for k, inner in kind.of.items():
            one = let(F.try_element_at(m, F.lit(k)), _checker(inner, f"{path}.{k}" if path else k))
            each.append(F.when(F.array_contains(found, k), one) if k in kind.optional else one)
        return out.otherwise(F.coalesce(*each))

    return F.when(_type(value) != "OBJECT", _told(path, "not an object")).otherwise(let(F.try_variant_get(value, "$", "map<string,variant>"), members))
