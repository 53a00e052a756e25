"""Detector evidence: canonical records, and their recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import compare

TOLERANCE = 1e-12


def recorded(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Adds `evidence`, a struct of the statistic, score, units, p-value, threshold and decision, and `evaluation_id`, its hash."""
    fields = ["statistic_name", "score", "scored_units", "p_value", "threshold", "comparator", "decision", "decision_status", *(extra or [])]
    out = df.withColumn("evidence", F.struct(*fields))
    return out.withColumn("evaluation_id", F.concat(F.lit("evaluation-"), F.left(F.sha2(F.to_json("evidence", {"ignoreNullFields": "false"}), 256), F.lit(24))))


def rescored(records: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem) for each way in which a record differs from its recomputation (score, scored_units, p_value), its threshold or its
    decision. Scores and p-values may differ by TOLERANCE; a record without recomputation is a problem of its own."""
    again = recomputed.select(*keys, F.col("score").alias("_score"), F.col("scored_units").alias("_units"), F.col("p_value").alias("_p"))
    joined = records.join(again, keys, "left")
    close = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= TOLERANCE, F.col(a).isNull() & F.col(b).isNull())
    decision = compare(F.col("score"), F.col("threshold"), F.col("comparator"))
    checks = F.array(
        F.when(F.col("_score").isNull(), "missing"),
        F.when(F.col("_score").isNotNull() & ~close("score", "_score"), "score"),
        F.when(F.col("_units").isNotNull() & (F.col("scored_units") != F.col("_units")), "scored_units"),
        F.when(F.col("_score").isNotNull() & ~close("p_value", "_p"), "p_value"),
        F.when(~F.col("decision").eqNullSafe(decision), "decision"),
    )
    return joined.select(*keys, F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))
