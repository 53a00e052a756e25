"""Closed decoding of JSON, and reports from outside with their traces."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lumenfold import constants as C
from lumenfold.operators import report
from lumenfold.operators.closed import Items, Keys, Text, Truth, Whole, problem

KIND = Keys({"v": Text(choices=("0.2",)), "n": Whole(least=0), "b": Truth(), "xs": Items(Keys({"k": Text(pattern="[a-f]+", nullable=True)})), "o": Text()}, optional=frozenset({"o"}))
CASES = {
    '{"v":"0.2","n":1,"b":true,"xs":[{"k":"abc"},{"k":null}]}': None,
    '{"v":"0.2","n":1,"b":true,"xs":[],"o":"x"}': None,
    '{"v":"0.3","n":1,"b":true,"xs":[]}': "v: not a known value",
    '{"v":null,"n":1,"b":true,"xs":[]}': "v: not a string",
    '{"v":"0.2","n":-1,"b":true,"xs":[]}': "n: too small",
    '{"v":"0.2","n":1.5,"b":true,"xs":[]}': "n: not an integer",
    '{"v":"0.2","n":"1","b":true,"xs":[]}': "n: not an integer",
    '{"v":"0.2","n":1,"b":1,"xs":[]}': "b: not a truth value",
    '{"v":"0.2","n":1,"b":true,"xs":{}}': "xs: not an array",
    '{"v":"0.2","n":1,"b":true,"xs":[{"k":"a"},{"k":"abz"}]}': "xs[].k: not of its form",
    '{"v":"0.2","n":1,"b":true,"xs":[{"k":"a","l":1}]}': "xs[]: unknown key",
    '{"v":"0.2","n":1,"b":true,"xs":[{}]}': "xs[]: missing key",
    '{"v":"0.2","n":1,"b":true,"xs":[3]}': "xs[]: not an object",
    '{"v":"0.2","n":1,"b":true}': "$: missing key",
    '{"v":"0.2","n":1,"b":true,"xs":[],"V":"0.2"}': "$: unknown key",
    '{"v":"0.2","v":"0.2","n":1,"b":true,"xs":[]}': "$: not JSON",
    '{"v":"0.2","n":1,"b":true,"xs":[],"o":null}': "o: not a string",
    "[]": "$: not an object",
    "nope": "$: not JSON",
    "": "$: not JSON",
}


def test_every_level_is_closed(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", problem(F.expr("try_parse_json(t)"), KIND).alias("p"))
    assert {r["t"]: r["p"] for r in df.collect()} == CASES
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def finding(status: str = "absent", mechanism: str = C.NFC, **changes) -> dict:
    told = dict(zip(report.TRACE_FIELDS, report.trace(mechanism, status)[2:], strict=True)) | changes
    return {"mechanism_id": mechanism, "mechanism_version": "1", "status": status, "evidence": [{"name": "n", "value": None}], "limitations": [], "trace": told}


def body(*findings, **changes) -> str:
    return json.dumps({"schema_version": "0.2", "artifact": {"byte_length": 3, "content_sha256": "a" * 64}, "findings": list(findings)} | changes)


def test_traces_of_imported_reports(spark):
    without = finding()
    del without["trace"]
    cases = {
        body(finding(), finding(mechanism=C.NFKC, status="present")): None,
        body(finding(mechanism="somebody.else")): None,
        body(): None,
        body(without): "keys",
        body(finding() | {"trace": None}): "type",
        body(finding(supports=["human_authorship"])): "trace",
        body(finding(does_not_support=[])): "trace",
        body(finding(verifier_available=False)): "trace",
        body(finding(configuration=None)): "trace",
        body(finding(mechanism=C.PROVIDER, status="unknown")): None,
        body(finding(mechanism=C.PROVIDER, status="present")): "provider_claim",
        body(finding(), finding()): "duplicate",
        body(finding(status="absent"), schema_version="0.1"): "unsupported schema version",
        body(finding(), extra=1): "keys",
        body(artifact={"byte_length": 1, "content_sha256": "A" * 64}): "digest",
        body(finding() | {"status": "maybe"}): "status",
    }
    rows = spark.createDataFrame([(t, "clash") for t in cases], "value string, status string")
    found = {r["value"]: r for r in report.imported(rows, need_traces=True, keep=["value"]).collect()}
    assert {t: r["problem"] for t, r in found.items()} == cases
    assert all((r["detail"] is None) == (r["problem"] is None) and (r["content_sha256"] is None) == (r["problem"] is not None or json.loads(t)["artifact"]["content_sha256"] != "a" * 64) for t, r in found.items())
    assert {r["problem"] for r in report.imported(spark.createDataFrame([(body(without),)], "value string")).collect()} == {None}


def test_written_traces_are_read_back(spark):
    rows = spark.createDataFrame([("a", 1, "b" * 64, m, "1", s, [], []) for m, s in ((C.NFC, "present"), (C.DICP, "absent"), ("other", "unknown"))], "artifact_id string, byte_length long, content_sha256 string, mechanism_id string, mechanism_version string, status string, evidence array<struct<name:string,value:string>>, limitations array<string>")
    written = report.reports(report.with_trace(rows))
    out = report.imported(written, "report", need_traces=True).collect()
    assert len(out) == 3 and all(r["problem"] is None and r["is_untrusted"] for r in out)
    text = written.first()["report"]
    assert report.semantic_digest(written).first()["semantic_sha256"] == __import__("hashlib").sha256(text.replace('"schema_version":"0.2"', '"schema_version":"0.1"', 1).encode()).hexdigest()
