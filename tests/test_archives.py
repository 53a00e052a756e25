"""Release archives and licence bundles."""

from __future__ import annotations

import gzip
import hashlib
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import archives, licenses

FILES = {"b.txt": (b"bee", 0o644), "a": (b"program", 0o755)}


def tar_gz(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as archive:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.parametrize("kind", ["zip", "tar.gz"])
def test_archives_in_normal_form(kind):
    raw = archives.packed(kind, "r", FILES)
    assert raw == archives.packed(kind, "r", dict(reversed(FILES.items())))
    assert archives.opened(f"r.{kind}", raw) == ([("r/", None, 0o755), ("r/a", b"program", 0o755), ("r/b.txt", b"bee", 0o644)], None)
    assert archives.opened(f"r.{kind}", raw, most=4)[1] == "too large"
    assert archives.opened(f"r.{kind}", raw[:-30])[1] is not None


def test_other_forms_are_told():
    tar = gzip.decompress(archives.packed("tar.gz", "r", FILES))
    again = lambda t: gzip.compress(t, 9, mtime=0)
    header = lambda raw: archives.GZIP_HEADER + raw[10:]
    assert archives.opened("x.tar.gz", header(again(tar)))[1] is None
    assert archives.opened("x.tar.gz", header(again(tar)) + b"x")[1] == "gzip trailer"
    assert archives.opened("x.tar.gz", tar_gz({"r/a": b"1"}))[1] == "gzip header"
    timed = tar[:136] + b"00000000001\0" + tar[148:]
    assert archives.opened("x.tar.gz", header(again(timed)))[1] is not None
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("r/", "")
        z.writestr("r/a", "1")
    assert archives.opened("x.zip", out.getvalue())[1].startswith("fields")
    for names in (["r/", "r/b", "r/a"], ["r/", "r/../a"], ["r/", "q/a"], []):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(archives._entry(n, n.endswith("/"), 0o755 if n.endswith("/") else 0o644), b"")
        assert archives.opened("x.zip", out.getvalue())[1] in ("order", "names")


def test_archives_as_rows(spark, tmp_path):
    files = spark.createDataFrame([(a, n, bytearray(f"{a}{n}".encode()), 0o644) for a in ("one", "two") for n in ("x", "y")], "archive string, name string, content binary, mode int")
    for r in archives.built(files).collect():
        (tmp_path / r["path"]).write_bytes(bytes(r["content"]))
    (tmp_path / "other.txt").write_text("no archive")
    found = archives.discovered(spark, str(tmp_path))
    assert [r["path"] for r in found.collect()] == ["one.tar.gz", "two.tar.gz"]
    rows = archives.members(found).where("mode <> 493").collect()
    assert {(r["name"], r["sha256"]) for r in rows} == {(f"{a}/{n}", hashlib.sha256(f"{a}{n}".encode()).hexdigest()) for a in ("one", "two") for n in ("x", "y")}
    assert all(r["problem"] is None for r in rows)
    broken = spark.createDataFrame([("b.zip", bytearray(b"no"))], "path string, content binary")
    assert archives.members(broken).first()["problem"].startswith("unreadable")


def test_metadata_and_targets(spark):
    names = ["release_mode", "release_tag", "package_version", "source_commit", "binary_sha256", "toolchain"]
    good = ("release", "v1.2.3", "1.2.3", "a" * 40, "b" * 64, "rustc 1.80.0 (abc123 2024-07-21)")
    rows = [good, ("candidate", "v1.2.3", "1.2", "x", None, "C:\\tools"), ("candidate", None, *good[2:])]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    assert [r["problems"] for r in archives.checked(df, archives.metadata_rules()).collect()] == [[], ["tag", "version", "commit", "digest", "toolchain", "paths"], []]
    texts = ['{"a":["/usr"]}', '{"/usr":1}', '{"a":"C:\\\\x"}', '{"a":"see D:/x"}', '{"a":"\\\\\\\\host"}', '{"a":"b/c"}', '{"a":"x:y"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(archives.absolute_path(F.col("t"))).collect()] == [True, False, True, True, True, False, False]
    packages = spark.createDataFrame([("t1", "f1", "x"), ("t1", "f2", "y"), ("t9", "f3", "z")], "target string, filename string, sha256 string")
    assert {r["target"]: r["problem"] for r in archives.packages_by_target(packages, ["t1", "t2"]).collect()} == {"t1": "several", "t2": "missing", "t9": "unknown target"}
    a = spark.createDataFrame([("k", 1, "x"), ("l", 2, "y")], "name string, size int, sha256 string")
    b = spark.createDataFrame([("k", 1, "z"), ("m", 3, "y")], a.schema)
    assert {r["name"]: r["differing"] for r in archives.verified(a, b, ["name"], ["size", "sha256"]).collect()} == {"k": ["sha256"], "l": ["size", "sha256"], "m": ["size", "sha256"]}


def test_licences(spark):
    digest = "a" * 64
    text = f'[[package]]\nname = "own"\nversion = "1"\n[[package]]\nname = "p"\nversion = "2"\nsource = "s"\nchecksum = "{digest}"\n'
    locked = licenses.lock(spark, text)
    assert [tuple(r) for r in locked.collect()] == [("p", "2", "s", digest)]
    with pytest.raises(ValueError):
        licenses.lock(spark, text + f'[[package]]\nname = "p"\nversion = "2"\nsource = "s"\nchecksum = "{digest}"\n')
    table = ["| Package | Version |", "| [p](https://h/p/2) | 2 | direct | `MIT` | all four |", "| [q](https://h/q/3) | 3 | direct | `MIT` | l1, l9 |"]
    found = licenses.inventory(spark.createDataFrame([(x,) for x in table], "value string"), locked, "https://h/{name}/{version}", ["l1", "l2"]).orderBy("name").collect()
    assert [(r["name"], r["targets"], r["problem"]) for r in found] == [("p", ["l1", "l2"], None), ("q", ["l1", "l9"], "not locked")]
    raw = tar_gz({"p-2/LICENSE": b"one", "p-2/license": b"two", "p-2/src/x.rs": b"code", "q/LICENSE": b"x", "p-2/NOTICE": b"\xff", "p-2/d/COPYING": b"one"})
    files = licenses.package_texts(spark.createDataFrame([("p", "2", bytearray(raw))], "name string, version string, content binary"))
    assert [(r["filename"], r["problem"]) for r in files.collect()] == [("d/COPYING", None), ("LICENSE", None), ("license", "names fold together"), ("NOTICE", "not UTF-8"), ("q/LICENSE", "unsafe or foreign path")]
    good = files.where("problem is null")
    assert tuple(licenses.counts(good).first()) == (1, 2, 1)
    lines = licenses.bundle(good)
    assert [r["value"].split(" ")[0] for r in lines.collect()] == ["@file", "@file", "@text"]
    assert licenses.bundle_violations(lines, good).count() == 0
    changed = lines.withColumn("value", F.replace("value", F.lit("one"), F.lit("two")))
    assert [r["kind"] for r in licenses.bundle_violations(changed, good).collect()] == ["text"]
    assert licenses.bundle_violations(lines.where("section = 0"), good).count() == 2
    assert licenses.checked_manifest(licenses.manifest(good), good)
    wanted = spark.createDataFrame([("p", "2", [("L", hashlib.sha256(b"one").hexdigest()), ("M", "0")])], "name string, version string, files array<struct<filename:string,sha256:string>>")
    held = spark.createDataFrame([("x", bytearray(b"one")), ("y", bytearray(b"one"))], "path string, content binary")
    assert {r["filename"]: r["problem"] for r in licenses.fallback_texts(wanted, held).collect()} == {"L": None, "M": "no such text"}


def test_names_of_licence_texts():
    import re

    from lumenfold.operators.licenses import TEXT_NAME

    yes = ["LICENSE", "licence", "LICENSE-MIT", "License.txt", "COPYING", "copying.lesser", "COPYRIGHT", "NOTICE_a", "UNLICENSE", "AUTHORS"]
    no = ["licenses", "LICENSE2", "noticeboard.md", "UNLICENSE.txt", "my-LICENSE", "copyrights"]
    assert all(re.fullmatch(TEXT_NAME, n) for n in yes) and not any(re.fullmatch(TEXT_NAME, n) for n in no)
