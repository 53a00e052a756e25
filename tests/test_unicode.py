"""Scalars, findings and reports of artifacts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lumenfold import constants as C
from lumenfold.functions import scalars as S
from lumenfold.functions.text import difference, is_svg, wrappers
from lumenfold.operators import inspect, report
from lumenfold.sources import artifacts as A

DICP = {
    "": [], "ascii": [], "naïve café — Ελληνικά 中文 \U0001f600": [], "á o⃝": [], "​alpha": [(0, 0)], "a‌b": [(1, 1)], "a‍": [(1, 1)], "﻿": [(0, 0)],
    "❤️": [(3, 1)], "\U000e0100": [(0, 0)], "a​​b": [(1, 1), (4, 2)], "abc​": [(3, 3)], "é界​": [(5, 2)], "\U0001f600\U000e0100": [(4, 1)],
}
BIDI = {
    "العربية": [], "עברית": [], "a‍b": [], "؜alpha": [(0, 0)], "a‎b": [(1, 1)], "ab‏": [(2, 2)], "x‪‪": [(1, 1), (4, 2)], "é界‫": [(5, 2)],
    "\U0001f600‬": [(4, 1)], "abc‭": [(3, 3)], **{chr(c): [(0, 0)] for c in (0x202E, 0x2066, 0x2067, 0x2068, 0x2069)},
}
INVALID = ["FF", "80", "C0AF", "EDA080", "F4908080", "E280", "E2808BFF"]


@pytest.mark.parametrize(("vectors", "one"), [(DICP, S.DICP_CLASS), (BIDI, S.BIDI_CLASS)])
def test_locations(spark, vectors, one):
    df = spark.createDataFrame([(t,) for t in vectors], "t string")
    for r in df.select("t", S.locations(F.col("t"), one).alias("x"), S.occurrences(F.col("t"), one).alias("n")).collect():
        assert [(x["byte_offset"], x["scalar_offset"]) for x in r["x"]] == vectors[r["t"]]
        assert r["n"] == len(vectors[r["t"]])


def test_range_sizes():
    assert sum(b - a + 1 for a, b in C.DEFAULT_IGNORABLE) == 4174 and len(C.DEFAULT_IGNORABLE) == 27
    assert len(C.BIDI_CONTROL) == 12 and all(any(a <= c <= b for a, b in C.DEFAULT_IGNORABLE) for c in C.BIDI_CONTROL)


def artifacts(spark, contents: list[bytes], name: str = "x.txt"):
    return spark.createDataFrame([(str(i), name, c) for i, c in enumerate(contents)], A.ARTIFACT)


def by_mechanism(spark, content: bytes, name: str = "x.txt") -> dict:
    return {r["mechanism_id"]: r for r in inspect.findings(artifacts(spark, [content], name)).collect()}


def test_retained_locations(spark):
    for n in (256, 257):
        found = by_mechanism(spark, ("​" * n).encode())[C.DICP]
        values = {e["name"]: e["value"] for e in found["evidence"]}
        assert found["status"] == "present" and values["total_occurrence_count"] == str(n) and values["locations_truncated"] == str(n > 256).lower()
        assert len(json.loads(values["locations"])) == 256
    long = by_mechanism(spark, b"a" * 65535 + "​z".encode())[C.DICP]
    assert json.loads({e["name"]: e["value"] for e in long["evidence"]}["locations"]) == [{"code_point": "U+200B", "byte_offset": 65535, "scalar_offset": 65535}]


@pytest.mark.parametrize("raw", INVALID)
def test_invalid_bytes_are_never_absent(spark, raw):
    found = by_mechanism(spark, bytes.fromhex(raw))
    assert {m: found[m]["status"] for m in (C.BIDI, C.DICP, C.NFC, C.NFKC, C.WRAPPER)} == dict.fromkeys((C.BIDI, C.DICP, C.NFC, C.NFKC, C.WRAPPER), "invalid")
    assert found[C.PROVIDER]["status"] == "unknown"
    other = by_mechanism(spark, bytes.fromhex(raw), "x.bin")
    assert other[C.WRAPPER]["status"] == "unsupported" and other[C.PROVIDER]["status"] == "not_applicable"


NFC = {"e\u0301": "\u00e9", "\u0301\u0323": "\u0323\u0301", "\u1100\u1161\u11a8": "\uac01", "\u754ce\u0301": "\u754c\u00e9"}


@pytest.mark.parametrize(("text", "normal"), NFC.items())
def test_normalization(text, normal):
    import hashlib

    found = difference(text, "NFC")
    assert found["normalized_sha256"] == hashlib.sha256(normal.encode()).hexdigest() and found["normalized_scalar_count"] == len(normal)


def test_first_difference_json():
    assert difference("e\u0301", "NFC")["first_difference"] == '{"scalar_index":0,"original_byte_offset":0,"original":{"at_end":false,"scalars":["U+0065","U+0301"],"truncated":false},"normalized":{"at_end":false,"scalars":["U+00E9"],"truncated":false}}'
    first = json.loads(difference("\u754ce\u0301", "NFC")["first_difference"])
    assert (first["scalar_index"], first["original_byte_offset"]) == (1, 3)
    assert [json.loads(difference("e\u0301" + t, "NFC")["first_difference"])["original"]["truncated"] for t in ("abcdfg", "abcdfgh")] == [False, True]
    assert all(difference(t, "NFC") is None and difference(t, "NFKC") for t in ("\ufb03", "\uff21", "\u00b2", "\u2460", "\uff76\uff9e"))
    assert all(difference(t, f) is None for t in ("\u00e9", "\u2764\ufe0f") for f in ("NFC", "NFKC"))


def wrapper(payload: bytes, version: int = 1, declared: int | None = None) -> str:
    raw = C.WRAPPER_MAGIC + bytes([version]) + (len(payload) if declared is None else declared).to_bytes(4, "big") + payload
    return "﻿" + "".join(chr(0xFE00 + b) if b < 16 else chr(0xE0100 + b - 16) for b in raw)


def test_wrappers(spark):
    good = wrapper(b"payload")
    assert wrappers("text " + good)["wrapper_count"] == 1 and wrappers("text " + good)["first_error"] is None
    assert json.loads(wrappers("e\u0301 " + good)["first_wrapper"])["normalized_byte_offset"] == 3
    assert json.loads(wrappers(good + good)["first_error"])["code"] == "manifest.text.multipleWrappers"
    for bad in (wrapper(b"x", version=2), wrapper(b"x", declared=9), good[:6]):
        assert json.loads(wrappers("a" + bad)["first_error"]) == {"code": "manifest.text.corruptedWrapper", "original_byte_offset": 1}
    assert wrappers("﻿a")["candidate_count"] == 0 and wrappers("﻿︀")["candidate_count"] == 0
    found = by_mechanism(spark, ("t" + good).encode())
    assert found[C.WRAPPER]["status"] == "present" and all(found[m]["status"] == "unsupported" for m in C.C2PA[1:])
    assert by_mechanism(spark, b"plain")[C.STORE]["status"] == "not_applicable"
    assert by_mechanism(spark, C.PNG + b"rest", "x.png")[C.PROVIDER]["status"] == "not_applicable"


def test_svg():
    yes = [b"<svg>", b"\xef\xbb\xbf<svg/>", b'<?xml version="1.0"?>\n<svg a="b">', b"<!-- c --><svg >", b"<?style x?><svg>", b'<!DOCTYPE svg [ <!ENTITY a ">"> ]><svg>']
    no = [b"<svgx>", b"x<svg>", b"<?xml?><svg>", b"<!-- c <svg>", b' <?xml version="2.0"?><svg>', b"<?XML a?><svg>", b"<svg", b""]
    assert all(map(is_svg, yes)) and not any(map(is_svg, no))


def test_human_safe(spark):
    df = spark.createDataFrame([("a\tb‮c\x7f☃",), ("",), ("plain",)], "t string")
    assert [r[0] for r in df.select(S.human_safe(F.col("t"))).collect()] == ["a\\u{9}b\\u{202e}c\\u{7f}☃", "", "plain"]


def test_report_order_and_import(spark):
    rows = inspect.findings(artifacts(spark, ["a​b".encode(), b"\xff"]))
    assert report.violations(rows).count() == 0
    lines = report.reports(rows)
    for r in lines.collect():
        assert [f["mechanism_id"] for f in json.loads(r["report"])["findings"]] == [m for m in C.MECHANISMS if m != C.REFERENCE_DETECTOR]
    assert {r["problem"] for r in report.imported(lines, "report").collect()} == {None}
    good = json.loads(lines.first()["report"])
    bad = [good | {"schema_version": "9"}, good | {"extra": 1}, good | {"artifact": {"byte_length": 1, "content_sha256": "x" * 64}}]
    out = report.imported(spark.createDataFrame([(json.dumps(b),) for b in bad] + [("{",)], "value string"))
    assert sorted(r["problem"] for r in out.collect()) == ["digest", "keys", "not JSON", "unsupported schema version"]
    traces = report.ontology(spark)
    assert report.upgraded(traces).count() == 0
    forged = traces.where("status = 'present'").withColumn("supports", F.array(F.lit("human_authorship")))
    assert report.upgraded(forged).count() == forged.count()


def test_results_do_not_depend_on_partitions(spark):
    rows = [("a" * i + "\u200be\u0301").encode() for i in range(40)]
    one = sorted(map(str, report.reports(inspect.findings(artifacts(spark, rows).repartition(1))).collect()))
    assert one == sorted(map(str, report.reports(inspect.findings(artifacts(spark, rows).repartition(7))).collect()))


def test_files_and_property_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x​".encode())
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.TXT").write_bytes(b"\xff")
    found = A.with_identity(A.from_files(spark, str(tmp_path))).collect()
    assert {r["path"].split("/")[-1]: (r["byte_length"], r["textual"], r["valid_utf8"]) for r in found} == {"a.txt": (4, True, True), "b.TXT": (1, True, False)}
    (tmp_path / "p.ucd").write_text("# head\n00AD ; Default_Ignorable_Code_Point # one\n115F..1160 ; Default_Ignorable_Code_Point\n")
    assert [tuple(r) for r in A.property_file(spark, f"{tmp_path}/p.ucd").collect()] == [(0xAD, 0xAD, "Default_Ignorable_Code_Point"), (0x115F, 0x1160, "Default_Ignorable_Code_Point")]
    chunks = spark.createDataFrame([("a", 1, b"cd"), ("a", 0, b"ab")], "artifact_id string, chunk_seq long, bytes binary")
    assert bytes(A.from_chunks(chunks).first()["content"]) == b"abcd"


def test_text_functions_get_bounded_batches(spark):
    from lumenfold.functions import text as functions

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for make in (functions.nfc_difference, functions.nfkc_difference, functions.nfc, functions.wrapper_scan, functions.svg):
        spark.conf.unset(key)
        make(F.col("text"))
        assert int(spark.conf.get(key)) <= 512
