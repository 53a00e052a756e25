"""Licence texts of locked packages: the lock, an inventory in a Markdown table, texts in package archives and fallbacks, and their bundle."""

from __future__ import annotations

import io
import json
import tarfile
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json

#: Names of files that hold licence texts; after the word only a separator goes on.
TEXT_NAME = r"(?i)(?:licen[cs]e|copying|copyright|notice)(?:[-._].*)?|unlicense|authors"
_ROW = r"^\| \[([^\]]+)\]\(([^)]+)\) \| ([^|]+) \| ([^|]+) \| `([^`]*)` \| ([^|]+) \|$"


def lock(spark: SparkSession, text: str) -> DataFrame:
    """(name, version, source, checksum) of a lock's external packages; those of the workspace have neither source nor checksum. A package with
    one of them, a checksum of another form, or an identity met twice is an error."""
    rows = [(p.get("name"), p.get("version"), p.get("source"), p.get("checksum")) for p in tomllib.loads(text).get("package", [])]
    external = [r for r in rows if r[2] is not None or r[3] is not None]
    if any(not isinstance(x, str) for r in external for x in r) or any(len(r[3]) != 64 or set(r[3]) - set("0123456789abcdef") for r in external):
        raise ValueError("a locked package is incomplete")
    if len({r[:2] for r in external}) != len(external):
        raise ValueError("a locked package is met twice")
    return spark.createDataFrame(external, "name string, version string, source string, checksum string")


def inventory(lines: DataFrame, locked: DataFrame, url: str, labels: list[str], everywhere: str = "all four") -> DataFrame:
    """Packages of a Markdown table's rows (column `value`), joined to the lock: name, version, relationship, license, targets, source, checksum and
    `problem`. url is the address a package has to have, with {name} and {version}; labels are those of the targets."""
    part = lambda i: F.trim(F.regexp_extract("value", _ROW, i))
    rows = lines.where(F.col("value").rlike(_ROW)).select(part(1).alias("name"), part(2).alias("url"), part(3).alias("version"), part(4).alias("relationship"), part(5).alias("license"), part(6).alias("told"))
    every = F.array(*[F.lit(x) for x in labels])
    rows = rows.withColumn("targets", F.when(F.col("told") == everywhere, every).otherwise(F.transform(F.split("told", ","), lambda x: F.trim(x))))
    counts = rows.groupBy("name", "version").agg(F.count("*").alias("_n"))
    joined = rows.join(counts, ["name", "version"]).join(locked, ["name", "version"], "left")
    expected = F.replace(F.replace(F.lit(url), F.lit("{name}"), F.col("name")), F.lit("{version}"), F.col("version"))
    problem = F.when(F.col("_n") > 1, "duplicate").when(F.col("url") != expected, "url").when(F.col("checksum").isNull(), "not locked").when(F.size(F.array_except("targets", every)) > 0, "targets")
    return joined.withColumn("problem", problem).drop("_n", "url", "told")


FILES = "name string, version string, filename string, byte_length long, sha256 string, content binary, problem string"


def package_texts(packages: DataFrame, pattern: str = TEXT_NAME) -> DataFrame:
    """Licence files in package archives (name, version, content: a tar.gz): one row each in the order of folded names, `problem` for unsafe
    paths, another root, names that fold together and texts that are not UTF-8. A package is read in one task, a member at a time."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import re

        wanted = re.compile(pattern)
        for frame in frames:
            for name, version, raw in zip(frame["name"], frame["version"], frame["content"], strict=True):
                rows: list[tuple] = []
                with tarfile.open(fileobj=io.BytesIO(bytes(raw)), mode="r:gz") as archive:
                    for m in archive:
                        path = m.name.split("/")
                        if m.name.startswith("/") or ".." in path or path[0] != f"{name}-{version}":
                            rows.append((m.name, None, "unsafe or foreign path"))
                        elif len(path) > 1 and m.isfile() and wanted.fullmatch(path[-1]):
                            rows.append(("/".join(path[1:]), archive.extractfile(m).read(), None))
                out, folded = [], set()
                for filename, content, problem in sorted(rows, key=lambda r: (r[0].casefold(), r[0])):
                    if problem is None and filename.casefold() in folded:
                        problem = "names fold together"
                    folded.add(filename.casefold())
                    if problem is None:
                        try:
                            content.decode()
                        except UnicodeDecodeError:
                            problem = "not UTF-8"
                    out.append((name, version, filename, len(content or b""), hashlib.sha256(content or b"").hexdigest(), content, problem))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in FILES.split(", ")])

    return packages.select("name", "version", "content").mapInPandas(read, FILES)


def fallback_texts(manifest: DataFrame, contents: DataFrame) -> DataFrame:
    """From manifest rows (name, version, files: array of filename and sha256) and contents (path, content): each file with the content that has
    its digest, `problem` where none has."""
    files = manifest.select("name", "version", F.explode("files").alias("f")).select("name", "version", "f.filename", "f.sha256")
    held = contents.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    joined = files.join(held, "sha256", "left")
    return joined.withColumns({"byte_length": F.octet_length("content").cast("long"), "problem": F.when(F.col("content").isNull(), "no such text")})


def counts(files: DataFrame) -> DataFrame:
    """How many packages have texts, how many files there are, and how many different texts."""
    return files.agg(F.count_distinct("name", "version").alias("packages"), F.count("*").alias("mappings"), F.count_distinct("sha256").alias("texts"))


def bundle(files: DataFrame) -> DataFrame:
    """Lines (section, ordinal, value) of a bundle: a record for each file in the order of packages and names, then each different text once, in the
    order of digests. A range sort; nothing is gathered."""
    record = F.to_json(F.struct("byte_length", "filename", "name", "sha256", "version"))
    maps = files.select(F.lit(0).alias("section"), F.concat_ws("\0", "name", "version", F.lower("filename"), "filename").alias("key"), F.concat(F.lit("@file "), record).alias("value"))
    texts = files.dropDuplicates(["sha256"]).select(F.lit(1).alias("section"), F.col("sha256").alias("key"), F.concat(F.lit("@text "), F.to_json(F.struct("byte_length", "sha256")), F.lit("\n"), F.col("content").cast("string")).alias("value"))
    return maps.unionByName(texts).orderBy("section", "key")


def parsed_bundle(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A bundle's files and texts back; texts have `problem` where length or digest are not what is told."""
    maps = lines.where(F.col("value").startswith("@file ")).select(F.from_json(F.substring("value", 7, 1 << 30), "byte_length long, filename string, name string, sha256 string, version string").alias("r")).select("r.*")
    head = F.substring_index("value", "\n", 1)
    texts = lines.where(F.col("value").startswith("@text ")).select(F.from_json(F.substring(head, F.lit(7), F.length(head)), "byte_length long, sha256 string").alias("r"), F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)").alias("text")).select("r.*", "text")
    wrong = (F.octet_length("text") != F.col("byte_length")) | (F.sha2("text", 256) != F.col("sha256"))
    return maps, texts.withColumn("problem", F.when(wrong, "digest or length"))


def bundle_violations(lines: DataFrame, files: DataFrame) -> DataFrame:
    """What a bundle lacks or has beyond the reviewed files, and texts that are not what is told: (kind, name)."""
    maps, texts = parsed_bundle(lines)
    keys = ["name", "version", "filename", "sha256"]
    lacks = files.select(*keys).exceptAll(maps.select(*keys)).select(F.lit("missing").alias("kind"), "name")
    beyond = maps.select(*keys).exceptAll(files.select(*keys)).select(F.lit("unknown").alias("kind"), "name")
    without = maps.join(texts, "sha256", "left_anti").select(F.lit("no text").alias("kind"), "name")
    return lacks.unionByName(beyond).unionByName(without).unionByName(texts.where("problem is not null").select(F.lit("text").alias("kind"), F.col("sha256").alias("name")))


def manifest(files: DataFrame) -> str:
    """The list of a bundle's files (a checked-in, bounded set) as canonical JSON with a line feed."""
    found = counts(files).first()
    rows = [r.asDict() for r in files.select("name", "version", "filename", "byte_length", "sha256").orderBy("name", "version", F.lower("filename"), "filename").toLocalIterator()]
    return canonical_json({"files": rows, "mapping_count": found["mappings"], "package_count": found["packages"], "unique_text_count": found["texts"]}) + "\n"


def checked_manifest(text: str, files: DataFrame) -> bool:
    """Whether a stored manifest is that of the files."""
    return json.loads(text) == json.loads(manifest(files))
