"""Checkpoints: append, repeat, stale identity, torn writes; ordered digests and grids."""

from __future__ import annotations

import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import samples
from lumenfold.sources import checkpoints as K

IDENTITY = {f: f"id-{i}" for i, f in enumerate(K.IDENTITY)}
SCHEMA = "task string, split string, sample_id string, kind string, tokens array<int>, score double"


def rows(spark, *ids: str):
    return spark.createDataFrame([("c4", "test", i, "clean", [1, len(i)], None if i == "b" else 0.5) for i in ids], SCHEMA)


def read(spark, path) -> list[str]:
    return [r["sample_id"] for r in K.entries(spark, path, IDENTITY, SCHEMA).collect()]


def test_appended_entries_are_read_in_order(spark, tmp_path):
    path = str(tmp_path / "c")
    assert read(spark, path) == []
    K.append(path, IDENTITY, rows(spark, "d", "b", "x", "a"), parts=3)
    K.append(path, IDENTITY, rows(spark, "c", "y"))
    assert read(spark, path) == ["a", "b", "c", "d", "x", "y"]
    assert K.entries(spark, path, IDENTITY, SCHEMA).where("sample_id = 'b'").first().asDict() == {"task": "c4", "split": "test", "sample_id": "b", "kind": "clean", "tokens": [1, 1], "score": None}
    known = K.manifest(path, IDENTITY)
    assert sum(p["rows"] for p in known["parts"]) == 6 and [p["first"] for p in known["parts"]] == sorted(p["first"] for p in known["parts"]) and K.loose(path, IDENTITY) == []
    K.append(path, IDENTITY, rows(spark).limit(0))
    assert read(spark, path) == ["a", "b", "c", "d", "x", "y"]


def test_repeats_and_incomplete_keys_add_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    K.append(path, IDENTITY, rows(spark, "a", "b"))
    for wrong in (rows(spark, "c", "a"), rows(spark, "c", "c")):
        with pytest.raises(ValueError, match="already exists"):
            K.append(path, IDENTITY, wrong)
    for bad in ("", None):
        with pytest.raises(ValueError, match="incomplete"):
            K.append(path, IDENTITY, rows(spark, "c").withColumn("kind", F.lit(bad).cast("string")))
    assert read(spark, path) == ["a", "b"]


def test_a_stale_identity_is_refused(spark, tmp_path):
    path = str(tmp_path / "c")
    K.append(path, IDENTITY, rows(spark, "a"))
    for f in K.IDENTITY:
        with pytest.raises(ValueError, match=f"mismatch: {f}"):
            K.entries(spark, path, IDENTITY | {f: "other"}, SCHEMA)
        with pytest.raises(ValueError, match="missing fields"):
            K.append(path, {k: v for k, v in IDENTITY.items() if k != f}, rows(spark, "b"))
    assert read(spark, path) == ["a"]


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    K.append(path, IDENTITY, rows(spark, "a"))
    broken = rows(spark, "b", "c", "z").withColumn("score", F.when(F.col("sample_id") == "z", F.raise_error(F.lit("lost")).cast("double")).otherwise(0.1))
    with pytest.raises(Exception, match="lost"):
        K.append(path, IDENTITY, broken, parts=2)
    assert read(spark, path) == ["a"]


def test_changed_bytes_and_other_writers_are_noticed(spark, tmp_path):
    path = str(tmp_path / "c")
    K.append(path, IDENTITY, rows(spark, "a", "b"), parts=1)
    writer = K._Writer(path, IDENTITY, K.manifest(path, IDENTITY)["payload_sha256"])
    K.append(path, IDENTITY, rows(spark, "c"))
    with pytest.raises(ValueError, match="changed since"):
        writer.commit([])
    part = tmp_path / "c" / K.manifest(path, IDENTITY)["parts"][0]["file"]
    good = part.read_bytes()
    part.write_bytes(good[:-5])
    with pytest.raises(Exception, match="checksum mismatch"):
        read(spark, path)
    part.write_bytes(good)
    assert read(spark, path) == ["a", "b", "c"]
    at = tmp_path / "c" / K.MANIFEST
    whole = at.read_bytes()
    for torn, told in ((whole[:-20], "canonical"), (whole + b" ", "canonical"), (whole.replace(b"test", b"tset", 1), "checksum")):
        at.write_bytes(torn)
        with pytest.raises(ValueError, match=told):
            K.manifest(path, IDENTITY)


def test_ordered_digests(spark):
    rng = random.Random(1)
    members = [(g, i, f"{g}-{i} \u00e9 \"") for g in ("a", None, "c") for i in range(rng.randint(1, 60))] + [("big", i, str(i)) for i in range(3000)]
    rng.shuffle(members)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    out = samples.ids_digest(spark.createDataFrame(members, "task string, ordinal long, sample_id string").repartition(4), ["task"]).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {g: [s for _, s in sorted((i, s) for g2, i, s in members if g2 == g)] for g in {m[0] for m in members}}
    assert {r["task"]: r["sample_ids_sha256"] for r in out} == {g: hashlib.sha256(json.dumps(v, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for g, v in groups.items()}
    with pytest.raises(Exception, match="unique"):
        samples.ids_digest(spark.createDataFrame([("a", 1, "x"), ("a", 2, "x")], "task string, ordinal long, sample_id string"), ["task"]).collect()


def test_grids_are_all_combinations_in_order(spark):
    lists = {"task": ["c4", "mbpp"], "length": [32, 64, 128], "strength": [0.1, 0.2]}
    found = samples.grid(spark, **lists).orderBy("cell").collect()
    assert [tuple(r)[1:] for r in found] == list(itertools.product(*lists.values())) and [r["cell"] for r in found] == list(range(12))
    assert samples.grid(spark, a=[], b=[1]).count() == 0
    entries = spark.createDataFrame([("c4", "x"), ("c4", "y")], "task string, sample_id string")
    out = samples.expanded(samples.grid(spark, **lists), entries, ["task"])
    assert out.where("task = 'c4'").count() == 12 and out.where("task = 'mbpp' and sample_id is null").count() == 6
