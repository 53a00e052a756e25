"""Outputs: canonical JSON lines, reports as text, explanations for people."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json


def canonical_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """Each row as canonical JSON (sorted keys, Python's numbers, finite only), ranged by `order`. Column `value`."""
    whole = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def canonical(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["value"]].map(lambda t: canonical_json(json.loads(t)))

    keys = [f"_o{i}" for i in range(len(order))]
    return whole.orderBy(*keys).mapInPandas(canonical, "value string")


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files with a line feed after each line. Spark's commit protocol makes them appear as a whole or not at all."""
    lines.write.mode("errorifexists").text(path)


def write_reports(reports: DataFrame, path: str) -> None:
    write_lines(reports.select(F.col("report").alias("value")), path)


def platform_result(results: DataFrame, platform: str) -> str:
    """Results of one platform's fixtures (a bounded, checked-in set) as indented JSON in the order of fixture_id, with a line feed."""
    rows = [r.asDict() for r in results.orderBy("fixture_id").toLocalIterator()]
    return json.dumps({"platform": platform, "results": rows}, indent=2, sort_keys=True) + "\n"


def explained(traced: DataFrame, width: int = 78) -> Iterator[str]:
    """Findings with their traces as paragraphs of at most `width` columns, for a reader at a terminal. Rows come a partition at a time."""
    for r in traced.orderBy("artifact_id", "rank").toLocalIterator():
        supports = ", ".join(r["supports"] or []) or "nothing"
        never = ", ".join(r["does_not_support"] or [])
        text = f"{r['mechanism_id']} is {r['status']}. Observed: {r['observation']}, by {r['verifier']}. This supports {supports}. It does not support {never}."
        yield textwrap.fill(text, width, subsequent_indent="  ")
