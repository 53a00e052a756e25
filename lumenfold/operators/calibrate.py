"""Thresholds: conservative calibration, exact selection, decisions that may stay open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CONTEXT_FIELDS
from ..functions.statistics import next_up, with_sortable
from .order import finite, order_statistics

STRICT, INCLUSIVE = ">", ">="
UNITS = "scored_unit_count"


def compare(score: Column, threshold: Column, comparator: Column) -> Column:
    return F.when(comparator == STRICT, score > threshold).when(comparator == INCLUSIVE, score >= threshold)


def calibrated(scores: DataFrame, context: list[str], target_fpr: float, comparator: str, score: str = "score", sample: str | None = None) -> DataFrame:
    """From scores of negatives: a threshold a context, which at most floor(fpr * n) of them exceed.

    Strict: the score at that place from the top, which leaves itself and its ties out (the least one if the place is beyond the end).
    Inclusive: the one before it if its ties fit, else the next number above. One selected rank gives both that and the false positives: nothing is
    sorted, and no group passes through one task (see order.py). A score that is null, NaN or infinite is an error, as is a context without scored
    units. Contexts may hold nulls. With `sample`, the ids' column, calibration_sha256 tells which samples with which scores were used."""
    if not 0 < target_fpr < 1:
        raise ValueError("target_fpr must be between zero and one")
    if comparator not in (STRICT, INCLUSIVE):
        raise ValueError(f"unsupported comparator: {comparator}")
    value = F.col(score)
    if UNITS in context:
        value = F.when(F.col(UNITS) > 0, value).otherwise(F.raise_error(F.lit("a threshold cannot be calibrated without scored units")).cast("double"))
    allowed_of = lambda n: F.floor(F.lit(float(target_fpr)) * n).cast("long")
    from_top = (lambda n: allowed_of(n)) if comparator == STRICT else (lambda n: F.greatest(allowed_of(n) - 1, F.lit(0)))
    found = order_statistics(scores, context, value, lambda n: F.array(n - 1 - from_top(n)), "scores have to be finite numbers")
    n, allowed, pick = F.col("n"), allowed_of(F.col("n")), F.col("picks")[0]
    above = n - pick["below"] - pick["ties"]
    if comparator == STRICT:
        threshold, hits = pick["value"], above
    else:
        fits = (allowed > 0) & (n - pick["below"] <= allowed)
        threshold, hits = F.when(fits, pick["value"]).otherwise(next_up(pick["value"])), F.when(fits, n - pick["below"]).otherwise(above)
    hits = F.when(hits <= allowed, hits).otherwise(F.raise_error(F.lit("calibration exceeded its allowance")).cast("long"))
    out = found.select(*context, threshold.alias("threshold"), n.alias("negative_count"), allowed.alias("maximum_allowed_false_positives"), hits.alias("false_positive_count"))
    out = out.withColumns({
        "empirical_calibration_exceedance": F.col("false_positive_count") / F.col("negative_count"),
        "resolution_status": F.when(F.col("negative_count") * F.lit(float(target_fpr)) >= 1, "RESOLVED").otherwise("UNRESOLVED"),
        "comparator": F.lit(comparator),
        "target_fpr": F.lit(float(target_fpr)),
    })
    if sample is None:
        return out
    used = multiset_digest(scores, context, [sample, score], "calibration_sha256")
    return out.join(used.withColumnsRenamed({c: f"u_{c}" for c in context}), _same(context, "u_")).drop(*[f"u_{c}" for c in context])


def multiset_digest(df: DataFrame, by: list[str], columns: list[str], name: str) -> DataFrame:
    """A digest of each group's rows that does not depend on their order: SHA-256 of the rows' number and the sums of the eight words of each row's
    SHA-256. Sums are combined map side, so a group of any size is one row a task. Nulls differ from empty texts; doubles are taken bit by bit."""
    rows, parts = df, []
    for i, c in enumerate(columns):
        text = F.col(c).cast("string")
        if dict(df.dtypes)[c] in ("double", "float"):
            rows, text = with_sortable(rows, finite(c), f"_bits{i}"), F.col(f"_bits{i}").cast("string")
        parts.append(F.coalesce(F.concat(F.lit("="), F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    rows = rows.select(*by, F.sha2(F.concat(*parts), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"w{i}") for i in range(8)]
    summed = rows.groupBy(*by).agg(F.count("*").alias("n"), *words)
    return summed.select(*by, F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(8)]), 256).alias(name))


def _same(columns: list[str], prefix: str) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return on


def duplicates(thresholds: DataFrame, context: list[str]) -> DataFrame:
    """Contexts with more than one threshold: fatal to selection."""
    return thresholds.groupBy(*context).count().where("count > 1")


def selected(requests: DataFrame, thresholds: DataFrame, context: list[str] = list(CONTEXT_FIELDS), units: str = "scored_unit_count") -> DataFrame:  # noqa: B006
    """Requests with `status`, `reason` and the threshold of their exact context, if there is one. Nothing is interpolated: below the least
    calibrated support is UNSUPPORTED, anything else UNRESOLVED. Equality of contexts is null-safe. Two thresholds of a requested context are an
    error, even equal ones: which holds would be a matter of chance."""
    others = [c for c in context if c != units]
    right = thresholds.groupBy(*[F.col(c).alias(f"t_{c}") for c in context]).agg(F.count("*").alias("found"), F.max("threshold").alias("threshold"))
    support = thresholds.groupBy(*[F.col(c).alias(f"s_{c}") for c in others]).agg(F.min(units).alias("least"), F.max(units).alias("most"))
    joined = requests.join(right, _same(context, "t_"), "left").join(support, _same(others, "s_"), "left")
    one = F.when(F.col("found") > 1, F.raise_error(F.lit("duplicate threshold identities for one conditioning context")).cast("double")).otherwise(F.col("threshold"))
    joined = joined.withColumn("threshold", one).withColumn("found", F.col("threshold").isNotNull())
    status = F.when(F.col("found"), "SELECTED").when(F.col(units) < F.col("least"), "UNSUPPORTED").otherwise("UNRESOLVED")
    reason = (
        F.when(F.col("found"), "exact match")
        .when(F.col("least").isNull(), "no threshold for exact conditioning")
        .when(F.col(units) < F.col("least"), "observed evidence is below minimum calibrated support")
        .when(F.col(units) > F.col("most"), "observed evidence exceeds calibrated support")
        .otherwise("observed evidence length lies between exact calibrated lengths")
    )
    return joined.select(*[requests[c] for c in requests.columns], "threshold", status.alias("status"), reason.alias("reason"))


def decided(selected_: DataFrame, comparator: str, score: str = "score") -> DataFrame:
    """Adds decision (null while open) and decision_status."""
    decision = compare(F.col(score), F.col("threshold"), F.lit(comparator))
    status = F.when(decision, "DETECTED").when(~decision, "NOT_DETECTED").when(F.col("status") == "UNSUPPORTED", "UNSUPPORTED").otherwise("UNRESOLVED")
    return selected_.withColumns({"decision": decision, "decision_status": status})


def weakest_attaining(candidates: DataFrame, by: list[str], target_tpr: float) -> DataFrame:
    """From candidates (value, tpr, quality): the least value that attains the rate."""
    attains = F.when(F.col("tpr") >= target_tpr, F.struct("value", "tpr", "quality"))
    out = candidates.groupBy(*by).agg(F.count("value").alias("n"), F.min(attains).alias("selected"))
    return out.select(*by, F.when(F.col("n") == 0, "UNSUPPORTED").when(F.col("selected").isNull(), "UNATTAINABLE").otherwise("SUPPORTED").alias("status"), F.col("selected.value").alias("value"))


def context_violations(contexts: DataFrame) -> DataFrame:
    """Contexts that are not legal: an operation and its strength go together and only with operation conditioning; regimes are closed."""
    conditioned = F.col("threshold_semantics") == "operation_conditioned_threshold"
    pair = F.col("operation").isNotNull() & F.col("operation_strength").isNotNull()
    alone = F.col("operation").isNull() & F.col("operation_strength").isNull()
    problem = (
        F.when(~F.col("regime").isin("clean", "operation_conditioned", "window_search"), "regime")
        .when(~F.col("threshold_semantics").isin("fixed_clean_threshold", "operation_conditioned_threshold"), "threshold_semantics")
        .when(conditioned & ~pair, "operation missing")
        .when(~conditioned & ~alone, "operation not allowed")
        .when(F.col("scored_unit_count") < 0, "scored_unit_count")
        .when(~F.col("comparator").isin(STRICT, INCLUSIVE), "comparator")
    )
    return contexts.withColumn("problem", problem).where(F.col("problem").isNotNull())
