"""Sinks, manifests, schemes; and that the engine works without the training-data operators."""

from __future__ import annotations

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from lumenfold.functions.hashing import canonical_json, typed_id
from lumenfold.operators import inspect, manifests, report, schemes
from lumenfold.sources import artifacts as A
from lumenfold.sources import sinks

REPO = Path(__file__).resolve().parent.parent


def test_manifest_problems():
    good = {"a": 1, "b": {"c": 1}, "id": typed_id("run", {"a": 1})}
    ask = (["a", "b.c"], [("a", "b.c")], {"id": ("run", ["a"])})
    assert manifests.problems(good, *ask) == []
    assert manifests.problems(good | {"a": 2}, *ask) == ["differ: a, b.c", "id: id"]
    assert manifests.problems({"id": good["id"]}, *ask)[:2] == ["missing: a", "missing: b.c"]


def test_files_against_their_hashes(spark, tmp_path):
    for name in ("a.bin", "b.bin", "c.bin"):
        (tmp_path / name).write_bytes(name.encode())
    files = manifests.hashed_files(spark, str(tmp_path))
    import hashlib

    expected = spark.createDataFrame([("a.bin", hashlib.sha256(b"a.bin").hexdigest()), ("b.bin", "0"), ("d.bin", "1")], "name string, sha256 string")
    assert sorted(map(tuple, manifests.checksum_problems(expected, files).collect())) == [("b.bin", "content"), ("c.bin", "unexpected"), ("d.bin", "missing")]


def test_closed_records(spark):
    df = spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":1}',), ('{"a":1,"b":2,"c":3}',)], "j string")
    out = manifests.key_problems(df, "j", ["a", "b"], ["a", "b"]).collect()
    assert {(tuple(r["unknown_keys"]), tuple(r["missing_keys"])) for r in out} == {((), ("b",)), (("c",), ())}


def test_canonical_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 1e-05, "é", None), (1, 0.5, "a", 3)], "k int, x double, s string, n int")
    sinks.write_lines(sinks.canonical_lines(df, ["k"]), f"{tmp_path}/out")
    lines = [x for p in sorted(Path(f"{tmp_path}/out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"k":1,"n":3,"s":"a","x":0.5}', '{"k":2,"n":null,"s":"é","x":1e-05}'] == [canonical_json(json.loads(x)) for x in lines]
    back = A.json_lines(spark, f"{tmp_path}/out", "k int, x double, s string, n int")
    assert sorted(map(tuple, back.collect())) == [(1, 0.5, "a", 3), (2, 1e-05, "é", None)]


def test_explanations_fit_a_terminal(spark):
    rows = inspect.findings(spark.createDataFrame([("x", "x.txt", b"plain")], A.ARTIFACT))
    text = list(sinks.explained(report.traced(rows)))
    assert len(text) == 10 and all(len(line) <= 78 for t in text for line in t.splitlines())
    assert report.shown(rows).where("group = 'Provider'").count() == 1
    assert sinks.platform_result(spark.createDataFrame([("f", "1")], "fixture_id string, digest string"), "linux").endswith("\n")


def test_schemes(spark):
    with pytest.raises(ValueError):
        schemes.keyed_ngrams(schemes.DEMO_KEY)
    with pytest.raises(PermissionError):
        schemes.authority_for("reference.synthid_text", require_runnable=True)
    with pytest.raises(KeyError):
        schemes.authority_for("other")
    assert schemes.authorities(spark).count() == 3 and schemes.descriptors(spark).where("status <> 'UNEXECUTED'").count() == 0
    df = spark.createDataFrame([(list(range(400)),)], "t array<int>")
    one, two = (schemes.keyed_ngrams(k).score(df, "t").first() for k in (11, 12))
    assert one["scored_units"] == 397 and abs(one["green_count"] / 397 - 0.25) < 0.1 and one["green_count"] != two["green_count"]
    assert set(schemes.environment()) >= {"python", "pyspark"}


def test_dataset_rows(spark, tmp_path):
    (tmp_path / "rows.json").write_text(json.dumps({"rows": [{"row_idx": 3, "row": {"text": "x" * 3000, "question": "q", "answer": "a", "code": "c"}}]}))
    rows = A.dataset_rows(spark, f"{tmp_path}/rows.json")
    for task, sample in (("c4", "c4-validation-3"), ("gsm8k", "gsm8k-test-3"), ("mbpp", "mbpp-test-3")):
        found = A.samples(rows, task).first()
        assert found["sample_id"] == sample and (task != "c4" or found["prompt"].count("x") == 2000)
    with pytest.raises(ValueError):
        A.samples(rows, "other")


def test_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(REPO / "lumenfold", tmp_path / "lumenfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
