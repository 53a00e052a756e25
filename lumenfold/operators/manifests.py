"""Manifests of runs: presence, agreement and identity; files against their recorded hashes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import canonical_sha256, typed_id
from ..sources.artifacts import display_name, from_files


def problems(manifest: Mapping[str, Any], required: Iterable[str], equal: Iterable[tuple[str, str]], ids: Mapping[str, tuple[str, Iterable[str]]]) -> list[str]:
    """What is wrong with a manifest, one row on the driver: missing fields, pairs of dotted fields that differ, and ids (field: kind and the
    fields it is made of) that are not what their fields give."""

    def at(path: str) -> Any:
        value: Any = manifest
        for part in path.split("."):
            value = value.get(part) if isinstance(value, Mapping) else None
        return value

    out = [f"missing: {f}" for f in required if at(f) is None]
    out += [f"differ: {a}, {b}" for a, b in equal if at(a) != at(b)]
    for field, (kind, parts) in ids.items():
        if at(field) != typed_id(kind, {p: at(p) for p in parts}):
            out.append(f"id: {field}")
    return out


def hashed_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, sha256, size) of all files below path."""
    return from_files(spark, path, glob).select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


def checksum_problems(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(name, problem) from expected (name, sha256) and files (path, sha256): missing, unexpected or other content, by file name."""
    found = files.select(display_name(F.col("path")).alias("name"), F.col("sha256").alias("found"))
    joined = expected.join(found, "name", "full_outer")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("sha256") != F.col("found"), "content")
    return joined.select("name", problem.alias("problem")).where("problem is not null")


def key_problems(records: DataFrame, column: str, allowed: Iterable[str], required: Iterable[str]) -> DataFrame:
    """Records (JSON objects as text) with keys that are not allowed, or without required ones."""
    keys = F.json_object_keys(column)
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))
    lacking = F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(keys, F.array().cast("array<string>")))
    return records.withColumns({"unknown_keys": extra, "missing_keys": lacking}).where(keys.isNull() | (F.size(extra) > 0) | (F.size(lacking) > 0))


def object_counts(records: DataFrame, kind: str) -> DataFrame:
    return records.groupBy(kind).agg(F.count("*").alias("objects"))


def config_sha256(config: Mapping[str, Any]) -> str:
    return canonical_sha256(dict(config))
