"""Chunks of rows staged as files in the shared folder, and blobs that ask and answer questions about them.

An operator that looks at each text several times stages it once: a task cuts its rows into chunks of bounded size and writes each as a
file, under a name that holds the chunk's number. What a chunk asks of the corpus goes as one blob to each of a number of buckets; a bucket
sees the blobs of all chunks, and its answers go back by chunk. Neither side holds more than a chunk or a bucket in memory."""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A chunk is closed when its texts hold this share of spark.sql.files.maxPartitionBytes, within bounds: a worker needs up to 40 times a chunk's
#: bytes, and a session's partitions say nothing of its memory.
CHUNK_SHARE, LEAST_CHUNK, MOST_CHUNK = 4, 1 << 20, 4 << 20
#: Input bytes, of a compressed scan, that a bucket stands for.
BUCKET_BYTES = 8 << 20


def put(folder: str, name: str, raw: bytes) -> str:
    """A whole file or none: written under the attempt's own name, then moved. A repeated task writes the same bytes."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    context = TaskContext.get()
    part = f"{root}/.{name}.{context.taskAttemptId() if context else 0}"
    with where.open_output_stream(part) as out:
        out.write(raw)
    where.move(part, f"{root}/{name}")
    return f"{folder}/{name}"


def get(path: str) -> bytes:
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path)
    with where.open_input_stream(at) as f:
        return f.read()


def squeezed(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def spread(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def planes(values: np.ndarray) -> bytes:
    """Integers as their bytes, all lowest bytes first and so on: alike bytes lie together for the compressor."""
    values = np.ascontiguousarray(values)
    return squeezed(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()) if len(values) else b""


def unplanes(raw: bytes, kind) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(spread(raw), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def deltas(sorted_values: np.ndarray) -> bytes:
    """Ascending unsigned integers as their differences."""
    return planes(np.diff(sorted_values, prepend=sorted_values.dtype.type(0)))


def undeltas(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, np.uint64), dtype=np.uint64)


def slim(values: np.ndarray) -> bytes:
    """Integers of 0 and more as the planes of the smallest type that holds them, after its number of bytes."""
    if not len(values):
        return b""
    kind = np.min_scalar_type(int(values.max()))
    return bytes([kind.itemsize]) + planes(values.astype(kind))


def unslim(raw: bytes) -> np.ndarray:
    return unplanes(raw[1:], f"u{raw[0]}").astype(np.int64) if raw else np.zeros(0, np.int64)


def narrow(raw: bytes) -> np.ndarray:
    """What slim() was given, in the smallest type."""
    return unplanes(raw[1:], f"u{raw[0]}") if raw else np.zeros(0, np.uint8)


def joined(*blobs: bytes) -> bytes:
    return struct.pack(f"<{len(blobs) + 1}I", len(blobs), *map(len, blobs)) + b"".join(blobs)


def parts(raw: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", raw)
    sizes = struct.unpack_from(f"<{n}I", raw, 4)
    at, out = 4 * (n + 1), []
    for s in sizes:
        out.append(raw[at : at + s])
        at += s
    return out


class Chunk:
    """doc_ids (or None) and texts as bytes."""

    def __init__(self, ids: list[int | None], texts: list[bytes]) -> None:
        self.ids, self.texts = ids, texts

    def dump(self) -> bytes:
        head = pickle.dumps((self.ids, list(map(len, self.texts))), protocol=5)
        return joined(squeezed(head), squeezed(b"".join(self.texts), 3))

    @classmethod
    def load(cls, raw: bytes) -> Chunk:
        head, body = map(spread, parts(raw))
        ids, sizes = pickle.loads(head)
        ends = np.cumsum(sizes).tolist()
        return cls(ids, [body[e - s : e] for e, s in zip(ends, sizes, strict=True)])


def chunks(batches: Iterator, most: int) -> Iterator[tuple[int, Chunk]]:
    """Of batches (doc_id, text), numbered by partition and order: the partition of a task is the same when it is run again."""
    part, k = TaskContext.get().partitionId(), 0
    ids: list[int | None] = []
    texts: list[bytes] = []
    held = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            ids.append(i)
            texts.append(raw)
            held += len(raw) + 16
            if held >= most:
                yield part << 24 | k, Chunk(ids, texts)
                k, ids, texts, held = k + 1, [], [], 0
    if ids:
        yield part << 24 | k, Chunk(ids, texts)


def partition_bytes(df: DataFrame) -> int:
    raw = df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "134217728").lower().rstrip("b")
    return int(float(raw[:-1]) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[raw[-1]]) if raw[-1] in "kmg" else int(raw)


def chunk_bytes(df: DataFrame) -> int:
    return min(MOST_CHUNK, max(LEAST_CHUNK, partition_bytes(df) // CHUNK_SHARE))


def buckets_for(df: DataFrame) -> int:
    """How many buckets the scanned input wants, from the number and the configured size of its partitions."""
    return int(max(8, -(-df.rdd.getNumPartitions() * partition_bytes(df) // BUCKET_BYTES)))


def answered(manifest: DataFrame, answers: DataFrame) -> DataFrame:
    """(chunk, path, answers): each chunk with the blobs of all buckets for it, which together are smaller than the chunk. A chunk is a row of its
    own beside its answers, so that these are exchanged once."""
    none = F.lit(None)
    rows = manifest.select("chunk", "path", none.cast("int").alias("bucket"), none.cast("binary").alias("blob"))
    rows = rows.unionByName(answers.select("chunk", none.cast("string").alias("path"), "bucket", "blob")).repartition(max(1, manifest.count()), "chunk")
    blobs = F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "blob")))
    return rows.groupBy("chunk").agg(F.max("path").alias("path"), blobs.alias("answers")).select("chunk", "path", "answers")
