"""Chunked artifacts: the same result as the whole artifact, however it was cut and in whatever order chunks come."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.constants import BIDI_CONTROL, DEFAULT_IGNORABLE
from lumenfold.operators import incremental as I
from lumenfold.streaming import chunks as C

CONTENTS = [b"", b"ascii", "¢界\U0001f600".encode(), "A\u202eB\u200be\u0301\ufb03".encode(), b"\xff", bytes.fromhex("61E282"), bytes.fromhex("61F09F98FF7A"), b"\xffab", bytes.fromhex("61E228A162"), b"a" * 70_000 + "\u200be\u0301".encode()]
CONTENTS += ["\U000e0001x\u200b\u202e界".encode() * 90, bytes.fromhex("EDA080"), bytes.fromhex("C080"), bytes.fromhex("F4908080"), bytes.fromhex("E08080"), b"\x80\x80", "é".encode()[1:], b"ab" + "\U0001f600".encode()[:3], b"\x80" * 9]
SCHEMA = "artifact_id string, chunk_seq long, bytes binary, is_last boolean"


def cut(rng: random.Random, content: bytes, pieces: int) -> list[bytes]:
    cuts = sorted(rng.randint(0, len(content)) for _ in range(pieces - 1))
    return [content[a:b] for a, b in zip([0, *cuts], [*cuts, len(content)], strict=True)]


def whole(content: bytes) -> dict:
    """The findings, read off the whole content."""
    try:
        text = content.decode()
    except UnicodeDecodeError:
        return {"byte_length": len(content), "complete": True, "valid_utf8": False, "scalar_count": None, "dicp_count": None, "dicp": None, "bidi_count": None, "bidi": None}
    dicp = [(i, c) for i, c in enumerate(text) if any(a <= ord(c) <= b for a, b in DEFAULT_IGNORABLE)]
    bidi = [(i, c) for i, c in enumerate(text) if ord(c) in BIDI_CONTROL]
    places = lambda found: [{"code_point": f"U+{ord(c):04X}", "abbreviation": BIDI_CONTROL.get(ord(c)), "byte_offset": len(text[:i].encode()), "scalar_offset": i} for i, c in found[:256]]
    return {"byte_length": len(content), "complete": True, "valid_utf8": True, "scalar_count": len(text), "dicp_count": len(dicp), "dicp": places(dicp), "bidi_count": len(bidi), "bidi": places(bidi)}


def chunked(rng: random.Random, pieces: int) -> list[tuple]:
    return [(str(i), k, p, k == len(parts) - 1) for i, content in enumerate(CONTENTS) for parts in [cut(rng, content, pieces if len(content) < 60_000 else 4)] for k, p in enumerate(parts)]


def same(rows) -> None:
    found = {r["artifact_id"]: r.asDict(recursive=True) for r in rows}
    assert len(found) == len(CONTENTS)
    for i, content in enumerate(CONTENTS):
        want = whole(content)
        assert {k: found[str(i)][k] for k in want} == want, content[:20]


@pytest.mark.parametrize(("pieces", "fan_in"), [(1, 1024), (5, 1024), (40, 3), (9, 2)])
def test_batch_equals_whole(spark, monkeypatch, pieces, fan_in):
    monkeypatch.setattr(I, "FAN_IN", fan_in)
    rng = random.Random(pieces)
    rows = chunked(rng, pieces)
    rows += rows[:7]  # delivered twice
    rng.shuffle(rows)
    same(I.inspected_chunks(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())


def test_merging_is_associative(spark):
    rng = random.Random(8)
    content = bytes(rng.choice([0x61, 0x80, 0xBF, 0xC3, 0xE2, 0x8B, 0xF0, 0x9F, 0x98]) for _ in range(4000)) + "\u200b\u202e😀".encode() * 20
    parts = [content[i : i + 3] for i in range(0, len(content), 3)]
    made = [I.plain(r["s"]) for r in spark.createDataFrame(list(enumerate(parts)), "n long, b binary").select(I.summary(F.col("n"), F.col("b")).alias("s")).collect()]
    made.sort(key=lambda s: s["first_seq"])
    for _ in range(300):
        at = rng.randrange(len(made) - 2)
        a, b, c = made[at : at + 3]
        assert I.merged(I.merged(a, b), c) | {"head": b"", "tail": b""} == I.merged(a, I.merged(b, c)) | {"head": b"", "tail": b""} or not I.merged(I.merged(a, b), c)["valid"]
    while len(made) > 1:
        at = rng.randrange(len(made) - 1)
        made[at : at + 2] = [I.merged(made[at], made[at + 1])]
    want = whole(content)
    assert {k: I.findings(made[0])[k] for k in want} == want


def test_missing_and_contradicting_chunks(spark):
    rows = [("a", 0, b"x", False), ("a", 2, b"y", True), ("b", 1, b"z", True), ("c", 0, None, True)]
    found = {r["artifact_id"]: r for r in I.inspected_chunks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not found["a"]["complete"] and found["a"]["valid_utf8"] is None and not found["b"]["complete"]
    assert found["c"]["complete"] and found["c"]["valid_utf8"] and found["c"]["byte_length"] == 0
    assert I.inspected_chunks(spark.createDataFrame([], SCHEMA)).count() == 0
    for wrong in ([("a", 0, b"x", False), ("a", 0, b"y", True)], [("a", None, b"x", True)]):
        with pytest.raises(Exception, match="two contents|need a number"):
            I.inspected_chunks(spark.createDataFrame(wrong, SCHEMA)).collect()


def test_batches_to_python_are_bounded(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    for key in keys:
        spark.conf.unset(key)
    found = I.inspected_chunks(spark.createDataFrame(chunked(random.Random(1), 3), SCHEMA))
    assert int(spark.conf.get(keys[0])) <= 512 and int(spark.conf.get(keys[1])) <= 4 << 20
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    same(found.collect())


def test_columns_open_like_rows():
    rows = [[{"n": 1, "b": b"x", "p": [{"c": None, "o": 2}, {"c": "z", "o": 3}]}, {"n": None, "b": None, "p": []}], [], [{"n": 3, "b": b"", "p": [{"c": "y", "o": 4}]}]]
    column = pa.array(rows, pa.list_(pa.struct([("n", pa.int64()), ("b", pa.binary()), ("p", pa.list_(pa.struct([("c", pa.string()), ("o", pa.int64())])))])))
    assert I._opened(column) == rows and I._opened(column[1:]) == rows[1:] and I._opened(column[2:2]) == []


def run(spark, make, rows, tmp_path, batches: int = 3) -> list:
    third = len(rows) // batches + 1
    for k in range(batches):  # each file is a micro-batch
        spark.createDataFrame(rows[k * third : (k + 1) * third] + rows[:2], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = make(stream, None).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_stream_equals_whole(spark, tmp_path):
    rng = random.Random(4)
    rows = chunked(rng, 5)
    rng.shuffle(rows)
    same(run(spark, C.inspected_stream, rows, tmp_path))


def test_stream_with_hashes_equals_whole(spark, tmp_path):
    rng = random.Random(6)
    rows = chunked(rng, 4)
    rng.shuffle(rows)
    found = {r["artifact_id"]: r.asDict() for r in run(spark, C.identified_stream, rows, tmp_path)}
    assert found == {str(i): C.result(str(i), c) for i, c in enumerate(CONTENTS)}


def test_an_abandoned_artifact_has_a_row(spark, tmp_path):
    rows = [("whole", 0, b"ab", True), ("left", 0, b"abc", False), ("left", 2, b"d", True)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = C.inspected_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 1)
    query = stream.writeStream.format("memory").queryName("abandoned").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            found = {r["artifact_id"]: r for r in spark.table("abandoned").collect()}
            if len(found) == 2:
                break
    finally:
        query.stop()
    assert found["whole"]["complete"] and found["whole"]["scalar_count"] == 2
    assert found["left"]["complete"] is False and (found["left"]["chunks"], found["left"]["byte_length"], found["left"]["valid_utf8"]) == (1, 3, None)
