"""Release archives as rows: members of zip and tar.gz files, whether their form is the normal one, and archives made from rows.

The normal form has a directory entry, then files in the order of their names, with fixed times, owners, modes and types and nothing else.
A tar is in it if packing its members anew gives the same bytes; a zip if each of its entries has the fields that packing would give."""

from __future__ import annotations

import gzip
import io
import stat
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first bytes of a gzip file in normal form (no name, no time, best compression, unknown system), and the time of zip entries.
GZIP_HEADER, ZIP_TIME = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x02\xff", (1980, 1, 1, 0, 0, 0)
PLAIN, PROGRAM = 0o644, 0o755
#: Bytes of a member's name and, together, of an archive's members; what is larger is not read.
MOST_NAME, MOST_BYTES = 512, 256 << 20

Member = tuple[str, bytes | None, int]  # the name, its bytes (None: a directory) and its mode


def _tar(members: list[Member]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as archive:
        for name, data, mode in members:
            info = tarfile.TarInfo(name)
            info.mode, info.type, info.size = mode, tarfile.DIRTYPE if data is None else tarfile.REGTYPE, len(data or b"")
            archive.addfile(info, io.BytesIO(data or b""))
    return out.getvalue()


def _entry(name: str, directory: bool, mode: int) -> zipfile.ZipInfo:
    info = zipfile.ZipInfo(name, ZIP_TIME)
    info.create_system, info.compress_type = 3, zipfile.ZIP_STORED if directory else zipfile.ZIP_DEFLATED
    info.external_attr = ((stat.S_IFDIR if directory else stat.S_IFREG) | mode) << 16 | (0x10 if directory else 0)
    return info


def packed(kind: str, root: str, files: dict[str, tuple[bytes, int]]) -> bytes:
    """An archive ("zip" or "tar.gz") in normal form of files (name below root: bytes, mode). The same files give the same bytes."""
    members: list[Member] = [(f"{root}/", None, PROGRAM), *((f"{root}/{n}", *files[n]) for n in sorted(files))]
    out = io.BytesIO()
    if kind == "tar.gz":
        with gzip.GzipFile(filename="", mode="wb", compresslevel=9, fileobj=out, mtime=0) as f:
            f.write(_tar(members))
    elif kind == "zip":
        with zipfile.ZipFile(out, "w", compresslevel=9) as archive:
            for name, data, mode in members:
                archive.writestr(_entry(name, data is None, mode), data or b"", compresslevel=9)
    else:
        raise ValueError(f"no such kind of archive: {kind!r}")
    return out.getvalue()


def _opened_tar(raw: bytes, most: int) -> tuple[list[Member], str | None]:
    inflate = zlib.decompressobj(-zlib.MAX_WBITS)
    if not raw.startswith(GZIP_HEADER):
        return [], "gzip header"
    tar = inflate.decompress(raw[len(GZIP_HEADER) :], most)
    if inflate.unconsumed_tail:
        return [], "too large"
    if not inflate.eof:
        return [], "truncated"
    if inflate.unused_data != struct.pack("<II", zlib.crc32(tar), len(tar) & 0xFFFFFFFF):
        return [], "gzip trailer"
    members: list[Member] = []
    with tarfile.open(fileobj=io.BytesIO(tar), mode="r:") as archive:
        for info in archive:
            if not (info.isdir() or info.isreg()):
                return members, f"type of {info.name}"
            members.append((info.name + "/" * info.isdir(), None if info.isdir() else archive.extractfile(info).read(), info.mode))
    return members, None if _tar(members) == tar else "not in normal form"


def _opened_zip(raw: bytes, most: int) -> tuple[list[Member], str | None]:
    members: list[Member] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        infos = archive.infolist()
        if sum(i.file_size for i in infos) > most:
            return [], "too large"
        fields = ("create_system", "compress_type", "external_attr", "date_time", "extra", "comment", "internal_attr", "flag_bits")
        problem = "comment" if archive.comment else None
        for i in infos:
            mode = stat.S_IMODE(i.external_attr >> 16)
            normal = _entry(i.filename, i.is_dir(), mode)
            if problem is None and any(getattr(i, f) != getattr(normal, f) for f in fields):
                problem = f"fields of {i.filename}"
            members.append((i.filename, None if i.is_dir() else archive.read(i), mode))
    return members, problem


def opened(name: str, raw: bytes, most: int = MOST_BYTES) -> tuple[list[Member], str | None]:
    """The members of an archive, and what is wrong with it: its form, names that leave its root or are too long, an order other than that of
    names after one directory, modes."""
    try:
        members, problem = (_opened_zip if name.endswith(".zip") else _opened_tar)(raw, most)
    except (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, UnicodeError, NotImplementedError, struct.error) as e:
        return [], f"unreadable: {e}"
    names = [m[0] for m in members]
    if problem is None and (not names or not names[0].endswith("/") or any(not n.startswith(names[0]) or ".." in n.split("/") or len(n.encode()) > MOST_NAME for n in names)):
        problem = "names"
    if problem is None and names[1:] != sorted(set(names[1:])):
        problem = "order"
    if problem is None and any(mode not in (PLAIN, PROGRAM) for _, _, mode in members):
        problem = "modes"
    return members, problem


MEMBERS = "path string, problem string, ordinal int, name string, mode int, size long, sha256 string, content binary"


def members(archives: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """A row for each member of archives (path, content); one of nulls for an archive that has none. An archive is opened in one task, and no
    more than `most` bytes of it are."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                found, problem = opened(path, bytes(content), most)
                rows = [(path, problem, i, n, m, len(c or b""), hashlib.sha256(c or b"").hexdigest(), c) for i, (n, c, m) in enumerate(found)]
                yield pd.DataFrame(rows or [(path, problem, None, None, None, None, None, None)], columns=[x.split()[0] for x in MEMBERS.split(", ")]).astype({"ordinal": "Int32", "mode": "Int32", "size": "Int64"})

    return archives.select("path", "content").mapInPandas(read, MEMBERS)


def built(files: DataFrame, kind: str = "tar.gz") -> DataFrame:
    """(path, content) of archives from files (archive, name, content, mode): one archive a group, whose files have to fit in memory."""

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if frame["name"].duplicated().any():
            raise ValueError(f"a name is met twice in {key[0]}")
        raw = packed(kind, key[0], {r.name_: (bytes(r.content), int(r.mode)) for r in frame.rename(columns={"name": "name_"}).itertuples()})
        return pd.DataFrame([(f"{key[0]}.{kind}", raw)], columns=["path", "content"])

    return files.select("archive", "name", "content", "mode").groupBy("archive").applyInPandas(pack, "path string, content binary")


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """Archives in a folder, in the order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{zip,tar.gz}").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("byte_length"), "content").orderBy("path")


def absolute_path(text: Column) -> Column:
    """Whether JSON text has a string, other than a key, that is an absolute path of either kind or holds one of a drive after a blank."""
    slash = r"(?:\\\\|/)"
    return text.rlike(rf'"(?:/|\\\\\\\\|[A-Za-z]:{slash}|(?:[^"\\]|\\.)*?(?:\s|\\[ntr])[A-Za-z]:{slash})(?:[^"\\]|\\.)*"(?!\s*:)')


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `problems`: the names of the rules that are not true of a row, in their order; a null counts as not true."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("problems", F.array_compact(F.array(*broken)))


def metadata_rules() -> dict[str, Column]:
    """What holds for the metadata of a package: a release has the tag of its version, anything else none; digests, commit and toolchain have
    their forms; no text in it is an absolute path."""
    c = F.col
    return {
        "mode": c("release_mode").isin("release", "candidate"),
        "tag": F.when(c("release_mode") == "release", c("release_tag") == F.concat(F.lit("v"), c("package_version"))).otherwise(c("release_tag").isNull()),
        "version": c("package_version").rlike(r"^\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?$"),
        "commit": c("source_commit").rlike("^[0-9a-f]{40}$"),
        "digest": c("binary_sha256").rlike("^[0-9a-f]{64}$"),
        "toolchain": c("toolchain").rlike(r"^\w+ \d+\.\d+\.\d+ \([0-9a-f]+ \d{4}-\d{2}-\d{2}\)$"),
        "paths": ~absolute_path(F.to_json(F.struct("*"))),
    }


def verified(found: DataFrame, expected: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of either side whose fields differ, or that the other lacks: `differing` names the fields, all of them for a missing row."""
    a, b = found.select(*keys, F.struct(*fields).alias("found")), expected.select(*keys, F.struct(*fields).alias("expected"))
    joined = a.join(b, keys, "full_outer")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"found.{f}").eqNullSafe(F.col(f"expected.{f}")) | F.col("found").isNull() | F.col("expected").isNull(), F.lit(f)) for f in fields]))
    return joined.withColumn("differing", differing).where(F.size("differing") > 0)


def packages_by_target(packages: DataFrame, targets: list[str]) -> DataFrame:
    """From packages (target, filename, sha256): one row a target in the given order, with `problem` where it has none, several, or is unknown."""
    known = packages.sparkSession.createDataFrame(list(enumerate(targets)), "ordinal int, target string")
    grouped = packages.groupBy("target").agg(F.count("*").alias("packages"), F.min("filename").alias("filename"), F.min("sha256").alias("sha256"))
    joined = known.join(grouped, "target", "full_outer")
    return joined.withColumn("problem", F.when(F.col("ordinal").isNull(), "unknown target").when(F.col("packages").isNull(), "missing").when(F.col("packages") > 1, "several"))
