"""UTF-8 and code point findings of artifacts in chunks, without putting an artifact together.

A chunk is summarized by itself: its leading continuation bytes (head), an incomplete scalar at its end (tail), whether what lies between is valid,
and the counts and first places found there (with a hash of the chunk, to tell a repeat from another content). Two neighbouring summaries make one of the same kind: the left one's tail and the right one's head
have to be one scalar. That is associative, so summaries may be folded in blocks, in any number of levels, in a batch or as they arrive, and the
result does not depend on where an artifact was cut. A summary is of bounded size, whatever the size of what it stands for."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..constants import BIDI_CONTROL, DEFAULT_IGNORABLE, LOCATIONS
from ..functions.scalars import BIDI_CLASS, DICP_CLASS, let, locations, occurrences
from ..session import bounded_batches

PLACES = "array<struct<code_point string, abbreviation string, byte_offset long, scalar_offset long>>"
SUMMARY = f"struct<first_seq long, last_seq long, chunks long, byte_length long, mark long, head binary, tail binary, solid boolean, valid boolean, scalars long, dicp_count long, dicp {PLACES}, bidi_count long, bidi {PLACES}>"
FINDINGS = f"chunks long, byte_length long, complete boolean, valid_utf8 boolean, scalar_count long, dicp_count long, dicp {PLACES}, bidi_count long, bidi {PLACES}"
COLUMNS = ("chunks", "byte_length", "complete", "valid_utf8", "scalar_count", "dicp_count", "dicp", "bidi_count", "bidi")
#: Summaries folded at once; as many levels as LEVELS says take them together before an artifact's last ones meet.
FAN_IN, LEVELS = 1024, 2
#: Blocks whose results are held as Python objects before they go back.
AT_ONCE = 64

#: The beginnings of scalars that more bytes can complete, in hexadecimal.
_PREFIX = "F0[9AB].(?:[89AB].)?|F[1-3](?:[89AB].){1,2}|F48.(?:[89AB].)?|E0[AB].|E[1-9A-CEF][89AB].|ED[89].|C[2-9A-F]|D.|E.|F[0-4]"
_DICP = frozenset(c for a, b in DEFAULT_IGNORABLE for c in range(a, b + 1))


def summary(seq: Column, content: Column) -> Column:
    """The summary of one chunk, as native expressions; a null chunk is an empty one."""

    def parts(c: Column) -> Column:
        bytes_ = c["bytes"]
        head = F.floor(F.length(F.regexp_extract(F.hex(F.substring(bytes_, 1, 4)), "^(?:[89AB].)*", 0)) / 2).cast("int")
        return let(head, lambda h: with_tail(c, h))

    def with_tail(c: Column, head: Column) -> Column:
        bytes_, n = c["bytes"], F.octet_length(c["bytes"])
        start = F.greatest(head + 1, n - 2)
        last = F.hex(F.substr(bytes_, start, F.lit(3)))
        tail = F.floor(F.length(F.regexp_extract(last, f"^(?:..){{0,2}}?({_PREFIX})$", 1)) / 2).cast("int")
        return let(tail, lambda t: let(F.substr(bytes_, head + 1, n - head - t), lambda body: made(c, head, t, body)))

    def made(c: Column, head: Column, tail: Column, body: Column) -> Column:
        bytes_, n = c["bytes"], F.octet_length(c["bytes"])
        valid = (head < 4) & F.call_function("is_valid_utf8", body)
        text = F.when(valid, body.cast("string")).otherwise(F.lit(""))

        def moved(places: Column) -> Column:  # from the body's beginning to the chunk's
            return F.transform(places, lambda p: F.struct(p["code_point"].alias("code_point"), p["abbreviation"].alias("abbreviation"), (p["byte_offset"] + head).alias("byte_offset"), p["scalar_offset"].alias("scalar_offset")))

        return let(text, lambda t: F.struct(
            c["seq"].alias("first_seq"), c["seq"].alias("last_seq"), F.lit(1).cast("long").alias("chunks"), n.cast("long").alias("byte_length"), F.xxhash64(bytes_).alias("mark"),
            F.substr(bytes_, F.lit(1), F.least(head, F.lit(3))).alias("head"), F.substr(bytes_, n - tail + 1, tail).alias("tail"), (n > head).alias("solid"), valid.alias("valid"), F.char_length(t).cast("long").alias("scalars"),
            occurrences(t, DICP_CLASS).alias("dicp_count"), moved(locations(t, DICP_CLASS)).alias("dicp"), occurrences(t, BIDI_CLASS).alias("bidi_count"), moved(locations(t, BIDI_CLASS)).alias("bidi"),
        ))

    return let(F.struct(seq.cast("long").alias("seq"), F.coalesce(content, F.unhex(F.lit(""))).alias("bytes")), parts)


def _place(scalar: str, byte_offset: int, scalar_offset: int) -> dict:
    return {"code_point": f"U+{ord(scalar):04X}", "abbreviation": BIDI_CONTROL.get(ord(scalar)), "byte_offset": byte_offset, "scalar_offset": scalar_offset}


def _completable(part: bytes) -> bool:
    """Whether more bytes can make the part one scalar."""
    try:
        part.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start == 0 and e.reason == "unexpected end of data"
    return False


def merged(left: dict, right: dict) -> dict:
    """The summary of two neighbouring stretches, the left one first."""
    out = {"first_seq": left["first_seq"], "last_seq": right["last_seq"], "chunks": left["chunks"] + right["chunks"], "byte_length": left["byte_length"] + right["byte_length"], "mark": 0}
    valid = left["valid"] and right["valid"]
    scalar, tail, head = "", right["tail"], left["head"]
    if not left["solid"]:
        head = left["head"] + right["head"]  # nothing but continuation bytes so far: at most three can complete a scalar
        valid, head = valid and len(head) <= 3, head[:3]
    else:
        joined = left["tail"] + right["head"]
        try:
            scalar = joined.decode("utf-8")
        except UnicodeDecodeError:
            if not right["solid"] and _completable(joined):
                tail = joined
            else:
                valid = False
    before = left["scalars"] + len(scalar)
    for name, known in (("dicp", _DICP), ("bidi", BIDI_CONTROL)):
        found = list(left[name])
        if scalar and ord(scalar) in known:
            found.append(_place(scalar, left["byte_length"] - len(left["tail"]), left["scalars"]))
        room = LOCATIONS - len(found)
        found += [p | {"byte_offset": p["byte_offset"] + left["byte_length"], "scalar_offset": p["scalar_offset"] + before} for p in right[name][: max(0, room)]]
        out[name] = found[:LOCATIONS]
        out[f"{name}_count"] = left[f"{name}_count"] + right[f"{name}_count"] + bool(scalar and ord(scalar) in known)
    return out | {"head": head, "tail": tail, "solid": left["solid"] or right["solid"], "valid": valid, "scalars": before + right["scalars"]}


def folded(summaries: Sequence[dict]) -> dict:
    """Summaries in any order, as one. Of chunks of one number, as a source that delivers at least once has them, the first counts; two that
    differ are an error."""
    ordered = sorted(summaries, key=lambda s: (s["first_seq"], s["last_seq"]))
    once = ordered[:1]
    for s in ordered[1:]:
        if s["first_seq"] > once[-1]["last_seq"]:
            once.append(s)
        elif s != once[-1]:
            raise ValueError(f"chunk {s['first_seq']} has two contents")
    return reduce(merged, once)


def findings(s: dict) -> dict:
    """What a whole artifact comes to. Findings are null where the bytes are not valid or chunks are missing; complete says which."""
    complete = s["first_seq"] == 0 and s["chunks"] == s["last_seq"] + 1
    valid = complete and bool(s["valid"] and not s["head"] and not s["tail"])
    known = lambda x: x if valid else None
    return {
        "chunks": s["chunks"], "byte_length": s["byte_length"], "complete": complete, "valid_utf8": valid if complete else None, "scalar_count": known(s["scalars"]),
        "dicp_count": known(s["dicp_count"]), "dicp": known(s["dicp"]), "bidi_count": known(s["bidi_count"]), "bidi": known(s["bidi"]),
    }


def plain(value):
    """A row, or what pandas makes of nested columns, as dicts, lists and bytes."""
    if isinstance(value, dict) or hasattr(value, "asDict"):
        return {k: plain(v) for k, v in (value if isinstance(value, dict) else value.asDict()).items()}
    if isinstance(value, bytes | bytearray | memoryview):
        return bytes(value)
    if isinstance(value, list | tuple) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return [plain(v) for v in value]
    return value.item() if hasattr(value, "item") else value


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (b.slice(low, AT_ONCE) for low in range(0, b.num_rows, AT_ONCE))


def _opened(column: pa.Array) -> list:
    """to_pylist(), by columns: of lists and structs, which are many here, it would make each value by itself."""
    if pa.types.is_list(column.type):
        items, ends = _opened(column.flatten()), np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()
        return [items[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    if pa.types.is_struct(column.type):
        names = [f.name for f in column.type]
        return [dict(zip(names, row, strict=True)) for row in zip(*map(_opened, column.flatten()), strict=True)]
    plain_numbers = column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_boolean(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if plain_numbers else column.to_pylist()


def inspected_chunks(chunks: DataFrame, key: str = "artifact_id") -> DataFrame:
    """From chunks (key, chunk_seq, bytes), in any order: one row an artifact, its key and FINDINGS.

    Chunks are summarized where they are read; what is exchanged are summaries, FAN_IN of them at a time, so an artifact of any number of chunks is
    the work of many tasks. An artifact without chunks has no row; null bytes are an empty chunk; a null number is an error."""

    kind = chunks.select(key).schema[0].dataType.simpleString()
    blocks_ddl, found_ddl = f"k {kind}, place long, s {SUMMARY}", f"k {kind}, {FINDINGS}"
    block_schema, found_schema = _arrow(blocks_ddl), _arrow(found_ddl)
    bounded_batches(chunks.sparkSession)

    # Of what Arrow holds, a few blocks at a time become Python objects, which are many times its size.
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                yield _batch([part.column(0), part.column(1), [folded(x) for x in _opened(part.column(2))]], block_schema)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                rows = [findings(folded(x)) for x in _opened(part.column(1))]
                yield _batch([part.column(0), *([r[c] for r in rows] for c in COLUMNS)], found_schema)

    numbered = F.coalesce(F.col("chunk_seq").cast("long"), F.raise_error(F.lit("chunks need a number")).cast("long"))
    level = chunks.select(F.col(key).alias("k"), numbered.alias("place"), summary(numbered, F.col("bytes")).alias("s"))
    for _ in range(LEVELS):
        blocks = level.groupBy("k", F.floor(F.col("place") / FAN_IN).cast("long").alias("place")).agg(F.collect_list("s").alias("all"))
        level = blocks.mapInArrow(fold, blocks_ddl)
    return level.groupBy("k").agg(F.collect_list("s").alias("all")).mapInArrow(finished, found_ddl).withColumnRenamed("k", key)
