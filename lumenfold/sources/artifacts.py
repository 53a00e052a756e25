"""Artifacts as rows (artifact_id, path, content): from text tables, files or chunks; and the other inputs, each with its own schema."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import JPEG, PNG

ARTIFACT = "artifact_id string, path string, content binary"


def from_text(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """Texts as artifacts named `kind/key.txt`; a null text has no content and is no artifact."""
    name = F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"), F.lit(".txt"))
    return df.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("artifact_id"), name.alias("path"), F.col(text).cast("binary").alias("content"))


def from_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Regular files below path, one row each; directories and special files are never listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("artifact_id"), "path", "content")


def from_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (artifact_id, chunk_seq, bytes) put together in order."""
    whole = chunks.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("chunk_seq", "bytes"))).alias("all"))
    hexed = F.array_join(F.transform("all", lambda x: F.hex(x["bytes"])), "")
    return whole.select("artifact_id", F.col("artifact_id").alias("path"), F.unhex(hexed).alias("content"))


def display_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def has_txt_extension(path: Column) -> Column:
    name = display_name(path)
    return F.lower(name).rlike(r".\.txt$")


def binary_format(content: Column) -> Column:
    """png or jpeg by their first bytes, else null."""
    return F.when(F.substring(content, 1, len(PNG)) == F.lit(PNG), "png").when(F.substring(content, 1, len(JPEG)) == F.lit(JPEG), "jpeg")


def with_identity(artifacts: DataFrame) -> DataFrame:
    """byte_length, content_sha256, valid_utf8, text (null where the bytes are not valid), format and whether the artifact is textual."""
    valid = F.expr("is_valid_utf8(content)")
    out = artifacts.withColumns({"byte_length": F.octet_length("content").cast("long"), "content_sha256": F.sha2("content", 256), "valid_utf8": valid, "format": binary_format(F.col("content"))})
    textual = F.col("format").isNull() & (F.col("valid_utf8") | has_txt_extension(F.col("path")))
    return out.withColumns({"text": F.when(F.col("valid_utf8") & F.col("format").isNull(), F.col("content").cast("string")), "textual": textual})


ROWS = "rows array<struct<row_idx long, row string>>"
#: The tasks, how their samples are named, and what goes before and after the text of a prompt.
TASKS = {
    "c4": ("c4-validation-", "Continue the following passage without commentary:\n\n", "\n\nContinuation:"),
    "gsm8k": ("gsm8k-test-", "Solve the problem. End with `#### <number>`.\n\nProblem: ", "\n\nSolution:"),
    "mbpp": ("mbpp-test-", "Write a Python function satisfying this task. Output code only.\n\nTask: ", "\n"),
}


def dataset_rows(spark: SparkSession, path: str) -> DataFrame:
    """{rows: [{row_idx, row}]} files: row_index, the row as JSON text, and its hash."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", ROWS).alias("v")).select(F.explode("v.rows").alias("r"))
    return raw.select(F.col("r.row_idx").alias("row_index"), F.col("r.row").alias("row"), F.sha2("r.row", 256).alias("row_sha256"))


def samples(rows: DataFrame, task: str) -> DataFrame:
    """sample_id, prompt, reference: texts to be continued are cut to 2,000 characters, problems without an id go by their index. A row without
    the field its prompt needs is an error."""
    if task not in TASKS:
        raise ValueError(f"no adapter for {task!r}")
    name, before, after = TASKS[task]
    get = lambda k: F.get_json_object("row", f"$.{k}")
    index = F.col("row_index").cast("string")
    missing = lambda k: F.raise_error(F.concat(F.lit(f"no {k} in row "), index)).cast("string")
    need = lambda k: F.coalesce(get(k), missing(k))
    body, identifier, reference = {
        "c4": lambda: (F.substring(need("text"), 1, 2000), index, F.lit(None).cast("string")),
        "gsm8k": lambda: (need("question"), index, need("answer")),
        "mbpp": lambda: (need("text"), F.coalesce(get("task_id"), index), F.coalesce(get("code"), F.lit(""))),
    }[task]()
    return rows.select(F.concat(F.lit(name), identifier).alias("sample_id"), F.concat(F.lit(before), body, F.lit(after)).alias("prompt"), reference.alias("reference"), "row_index", "row_sha256")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a closed schema, one a line; blank lines are skipped, anything else that does not fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def property_file(spark: SparkSession, path: str) -> DataFrame:
    """Unicode property files, `start[..end] ; Property # comment`, as (first, last, property)."""
    line = F.regexp_extract_all("value", F.lit(r"^\s*([0-9A-F]+)(?:\.\.([0-9A-F]+))?\s*;\s*(\w+)"), F.lit(0))
    lines = spark.read.text(path).where(F.size(line) > 0)
    part = lambda i: F.regexp_extract("value", r"^\s*([0-9A-F]+)(?:\.\.([0-9A-F]+))?\s*;\s*(\w+)", i)
    last = F.when(part(2) == "", part(1)).otherwise(part(2))
    return lines.select(F.conv(part(1), 16, 10).cast("int").alias("first"), F.conv(last, 16, 10).cast("int").alias("last"), part(3).alias("property"))


def normalization_file(spark: SparkSession, path: str) -> DataFrame:
    """Normalization test files: columns c1 to c5, as text."""
    text = lambda c: F.array_join(F.transform(F.split(F.trim(c), r"\s+"), lambda x: F.decode(F.unhex(F.lpad(x, 8, "0")), "UTF-32BE")), "")
    fields = F.split("value", ";")
    lines = spark.read.text(path).where(F.col("value").rlike(r"^[0-9A-F]"))
    return lines.select(*[text(fields[i]).alias(f"c{i + 1}") for i in range(5)])


def platform_results(spark: SparkSession, path: str, name: str = "determinism-platform.json") -> DataFrame:
    """Result files of all platforms below path, by name."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("multiLine", "true").json(path)


def document(path: str) -> dict:
    """A configuration or ledger, JSON or (by its name) YAML. YAML is read by PyYAML's safe loader where that is installed."""
    text = Path(path).read_text()
    if not path.lower().endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML needs PyYAML, which is not installed here") from e
    return yaml.safe_load(text)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A list of sources, JSON or YAML, with ids and expected artifact hashes; ids have to be present and unique."""
    entries = document(path)["sources"]
    ids = [e.get("id") for e in entries]
    if any(not isinstance(i, str) or not i for i in ids) or len(set(ids)) != len(ids):
        raise ValueError("every source needs a non-empty id of its own")
    return spark.createDataFrame([(e["id"], dict(e.get("artifact_sha256") or {})) for e in entries], "source_id string, artifact_sha256 map<string,string>")


def one_row(spark: SparkSession, config: Mapping[str, object]) -> DataFrame:
    """A configuration as a row to broadcast; every value as JSON text."""
    return spark.createDataFrame([{k: json.dumps(v, sort_keys=True) for k, v in config.items()}])
