"""Checkpoints of finished work: a folder of parts and one manifest, which alone says what counts.

A Python data source writes the parts: each task writes its entries, in the order of their keys, as canonical JSON lines to a file of its own name.
The commit then publishes one manifest, by a rename: the identity of the work, every part with its hash, number of entries and key range, in the
order of the parts, and a hash of all that. Until then, and if a task or the driver is lost, nothing has changed but that files no manifest names
lie about. Reading checks the identity, the manifest's hash and the parts' hashes."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.hashing import canonical_json

#: The version, what identifies the work, and what identifies an entry.
VERSION = "1.0.0"
IDENTITY = ("experiment_spec_id", "sample_set_sha256", "model_identity_sha256", "tokenizer_identity_sha256", "generation_config_sha256")
KEYS = ("task", "split", "sample_id", "kind")
MANIFEST = "manifest.json"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _read(path: str, name: str) -> bytes | None:
    from pyarrow import fs

    where, root = _files(path)
    if where.get_file_info(f"{root}/{name}").type != fs.FileType.File:
        return None
    with where.open_input_stream(f"{root}/{name}") as f:
        return f.read()


def _write(path: str, name: str, content: bytes) -> None:
    """Whole or not at all: another name first, then a rename."""
    where, root = _files(path)
    at, tmp = f"{root}/{name}", f"{root}/{name}.{uuid.uuid4().hex}.tmp"
    where.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(tmp) as f:
        f.write(content)
    where.move(tmp, at)


def _payload(manifest: Mapping) -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in manifest.items() if k != "payload_sha256"}).encode()).hexdigest()


def manifest(path: str, identity: Mapping[str, str]) -> dict | None:
    """The published manifest of this identity, None if there is none yet. One of another identity, with another version, or that is not what its
    hash says, is an error."""
    missing = [f for f in IDENTITY if not identity.get(f)]
    if missing:
        raise ValueError(f"checkpoint identity missing fields: {', '.join(missing)}")
    raw = _read(path, MANIFEST)
    if raw is None:
        return None
    try:
        found = json.loads(raw)
    except ValueError as e:
        raise ValueError("checkpoint manifest is not canonical JSON") from e
    if not isinstance(found, dict) or raw != (canonical_json(found) + "\n").encode():
        raise ValueError("checkpoint manifest bytes are not canonical")
    if found.get("schema_version") != VERSION:
        raise ValueError("unsupported checkpoint schema")
    for f in IDENTITY:
        if found.get(f) != identity[f]:
            raise ValueError(f"stale checkpoint identity mismatch: {f}")
    if found.get("payload_sha256") != _payload(found):
        raise ValueError("checkpoint payload checksum mismatch")
    return found


@dataclass
class _Part(WriterCommitMessage):
    file: str
    rows: int
    sha256: str
    first: list[str]
    last: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, identity: Mapping[str, str], before: str) -> None:
        self.path, self.identity, self.before = path, dict(identity), before

    def write(self, rows: Iterator) -> WriterCommitMessage:
        name, state, n, first, last = f"parts/{uuid.uuid4().hex}.jsonl", hashlib.sha256(), 0, [], []
        where, root = _files(self.path)
        where.create_dir(f"{root}/parts", recursive=True)
        with where.open_output_stream(f"{root}/{name}") as f:
            for row in rows:  # one entry at a time: a part may be of any size
                entry = json.loads(row["value"])
                key = [entry[k] for k in KEYS]
                if n and key <= last:
                    raise ValueError("entries of a part are not in order")
                line = (canonical_json(entry) + "\n").encode()
                f.write(line)
                state.update(line)
                first, last, n = first or key, key, n + 1
        return _Part(name, n, state.hexdigest(), first, last)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        now = manifest(self.path, self.identity)
        if (now or {}).get("payload_sha256", "") != self.before:
            raise ValueError("checkpoint has changed since it was read")
        parts = [*(now or {"parts": []})["parts"], *[vars(m) for m in messages if m is not None and m.rows]]
        parts.sort(key=lambda p: (p["first"], p["last"], p["file"]))
        made = {"schema_version": VERSION, **{f: self.identity[f] for f in IDENTITY}, "parts": parts}
        _write(self.path, MANIFEST, (canonical_json(made | {"payload_sha256": _payload(made)}) + "\n").encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = _files(self.path)
        for m in messages:
            if m is not None:
                try:
                    where.delete_file(f"{root}/{m.file}")
                except OSError:
                    pass  # no manifest names it


class CheckpointSource(DataSource):
    """Format `lumenfold_checkpoint`: path, the identity as JSON, and the hash of the manifest that was read (empty for none)."""

    @classmethod
    def name(cls) -> str:
        return "lumenfold_checkpoint"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], json.loads(self.options["identity"]), self.options.get("before", ""))


def entries(spark: SparkSession, path: str, identity: Mapping[str, str], schema: str) -> DataFrame:
    """The entries that count, of `schema` (which holds KEYS), in the order of their keys; none without a manifest. A part that is missing, or whose
    bytes are not those of the manifest, is an error; parts are looked at by the tasks that read them."""
    known = manifest(path, identity)
    if not known or not known["parts"]:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(p["file"], p["sha256"]) for p in known["parts"]], "file string, sha256 string")
    found = spark.read.format("binaryFile").load(f"{path}/parts").select(F.concat(F.lit("parts/"), F.element_at(F.split("path", "/"), -1)).alias("file"), "content")
    joined = listed.join(found, "file", "left")
    same = F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("checkpoint part checksum mismatch: "), F.col("file"))).cast("binary"))
    lines = joined.select(F.explode(F.split(F.rtrim(same.cast("string"), F.lit("\n")), "\n")).alias("value"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*").orderBy(*KEYS)


def append(path: str, identity: Mapping[str, str], fresh: DataFrame, parts: int | None = None) -> None:
    """Adds entries. One whose key is there already, or twice among the fresh ones, or has a null or empty part, is an error, and nothing is added.

    Fresh entries are ranged by key, so that parts follow one another; what was there is neither read as a whole nor written again."""
    spark, keys = fresh.sparkSession, list(KEYS)
    now = manifest(path, identity)
    known = entries(spark, path, identity, ", ".join(f"{k} string" for k in keys)) if now else None
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    marked = fresh.withColumn("_bad", F.when(~F.coalesce(whole, F.lit(False)), "checkpoint entry identity is incomplete"))
    twice = fresh.groupBy(*keys).count().where("count > 1").select(*keys)
    if known is not None:
        twice = twice.unionByName(fresh.select(*keys).join(known, keys, "left_semi")).distinct()
    wrong = marked.join(twice.withColumn("_again", F.lit("checkpoint entry already exists")), keys, "left").select(F.coalesce("_bad", "_again").alias("p")).where("p is not null").head(1)
    if wrong:
        raise ValueError(wrong[0]["p"])
    spark.dataSource.register(CheckpointSource)
    ranged = fresh.repartitionByRange(parts, *keys) if parts else fresh.repartitionByRange(*keys)
    lines = ranged.sortWithinPartitions(*keys).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.format("lumenfold_checkpoint").option("path", path).option("identity", json.dumps(dict(identity))).option("before", (now or {}).get("payload_sha256", "")).mode("append").save()


def loose(path: str, identity: Mapping[str, str]) -> Sequence[str]:
    """Parts that no manifest names: what interrupted writes have left. A listing, for whoever cleans up."""
    from pyarrow import fs

    where, root = _files(path)
    known = {p["file"] for p in (manifest(path, identity) or {"parts": []})["parts"]}
    found = where.get_file_info(fs.FileSelector(f"{root}/parts", allow_not_found=True))
    return sorted(n for n in (f"parts/{i.base_name}" for i in found if i.type == fs.FileType.File) if n not in known)
