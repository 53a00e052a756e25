"""Grouped aggregates with exact intervals, frontiers, entropy, detector statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import GROUP_FIELDS
from ..functions.hashing import canonical_hash_of_json
from ..functions.scalars import let
from ..functions.statistics import from_sortable, interval, normal_tail
from .order import finite, quantiles
from .scan import placed, prefixes

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _side_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins two aggregates of one grouping; null keys are equal."""
    renamed = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return left.join(renamed, on, how).drop(*[f"r_{k}" for k in keys])


def _with_quantiles(out: DataFrame, rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds `name`_median and `name`_quantiles of the rows' values by the keys. Null values are none; without values both are null."""
    known = quantiles(rows.where(F.col(value).isNotNull()), keys, value, QUANTILES, f"{name}_quantiles").drop("n")
    return _side_join(out, known, keys).withColumn(f"{name}_median", F.col(f"{name}_quantiles")[QUANTILES.index(0.5)])


def with_interval(df: DataFrame, successes: str, trials: str, name: str) -> DataFrame:
    """Adds the struct `name` of exact bounds, worked out once for each distinct pair."""
    pairs = df.select(F.col(successes).alias("_k"), F.col(trials).alias("_n")).where("_n > 0").distinct()
    bounds = pairs.withColumn(name, interval(F.col("_k"), F.col("_n")))
    return df.join(bounds, (F.col(successes) == F.col("_k")) & (F.col(trials) == F.col("_n")), "left").drop("_k", "_n")


def aggregated(records: DataFrame, target_fpr: float, group: list[str] | None = None, intervals: bool = True) -> DataFrame:
    """Records (group fields, label, decision, decision_status, score, quality map, run_id, manifest_path, source_authority_ids) by group.

    A null decision is unresolved and never a negative; rates need both classes; the held-out rate is null while any negative is open."""
    keys = group or [c for c in GROUP_FIELDS if c in records.columns]
    positive, negative = F.col("label") == "watermarked", F.col("label") == "unwatermarked"
    known = F.col("decision").isNotNull()
    hit = F.col("decision")
    cells: dict[str, Column] = {
        "n": F.count("*"),
        "positive_n": F.count_if(positive & known),
        "negative_n": F.count_if(negative & known),
        "held_out_negative_n": F.count_if(negative),
        "unresolved_n": F.count_if(~known),
        "unresolved_negative_n": F.count_if(negative & ~known),
        "true_positives": F.count_if(positive & known & hit),
        "false_positives": F.count_if(negative & known & hit),
        "_all_unsupported": F.bool_and(F.when(negative & ~known, F.coalesce(F.col("decision_status") == "UNSUPPORTED", F.lit(False)))),
        "score_mean": F.avg("score"),
    }
    if "run_id" in records.columns:
        cells |= {"run_ids": F.array_sort(F.collect_set("run_id")), "manifest_paths": F.array_sort(F.collect_set("manifest_path"))}
    out = records.groupBy(*keys).agg(*[v.alias(k) for k, v in cells.items()])
    out = _with_quantiles(out, records, keys, "score", "score")
    if "source_authority_ids" in records.columns:
        ids = records.select(*keys, F.explode_outer("source_authority_ids").alias("id")).groupBy(*keys).agg(F.array_sort(F.collect_set("id")).alias("source_authority_ids"))
        out = _side_join(out, ids, keys)
    if "quality" in records.columns:
        q = records.select(*keys, F.explode(F.map_values("quality")).alias("q")).where("q is not null")
        out = _side_join(out, q.groupBy(*keys).agg(F.avg("q").alias("quality_mean")), keys)
        out = _with_quantiles(out, q, keys, "q", "quality")
    both = (F.col("positive_n") > 0) & (F.col("negative_n") > 0)
    closed = (F.col("negative_n") > 0) & (F.col("unresolved_negative_n") == 0)
    status = (
        F.when(F.col("held_out_negative_n") == 0, F.lit(None))
        .when((F.col("unresolved_negative_n") > 0) & F.col("_all_unsupported"), "UNSUPPORTED")
        .when((F.col("unresolved_negative_n") > 0) | (F.col("negative_n") * F.lit(float(target_fpr)) < 1), "UNRESOLVED")
        .otherwise("RESOLVED")
    )
    out = out.withColumns({
        "tpr": F.when(both, F.col("true_positives") / F.col("positive_n")),
        "fpr": F.when(both, F.col("false_positives") / F.col("negative_n")),
        "empirical_fpr": F.when(closed, F.col("false_positives") / F.col("negative_n")),
        "resolution_status": status,
    }).drop("_all_unsupported")
    if intervals:
        out = with_interval(out, "false_positives", "negative_n", "fpr_interval").withColumn("fpr_interval", F.when(closed, F.col("fpr_interval")))
        out = with_interval(out, "true_positives", "positive_n", "tpr_interval").withColumn("tpr_interval", F.when(both, F.col("tpr_interval")))
    return out


def with_id(aggregates: DataFrame, keys: list[str]) -> DataFrame:
    """Adds aggregate_id, a hash of the group as canonical JSON."""
    text = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    return aggregates.withColumn("aggregate_id", F.concat(F.lit("aggregate-"), F.left(canonical_hash_of_json(text), F.lit(24))))


def display_order(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys])


def subgroup_fpr(records: DataFrame, subgroup: str) -> DataFrame:
    """False positives of decided negatives by a subgroup; a missing one is UNSPECIFIED."""
    key = F.coalesce(F.col(subgroup).cast("string"), F.lit("UNSPECIFIED")).alias("subgroup")
    own = records.where((F.col("label") == "unwatermarked") & F.col("decision").isNotNull())
    out = own.groupBy(key).agg(F.count_if("decision").alias("false_positive_count"), F.count("*").alias("negative_count"))
    return out.withColumn("fpr", F.col("false_positive_count") / F.col("negative_count"))


def length_at_target(rates: DataFrame, by: list[str], target_tpr: float) -> DataFrame:
    """The least length that reaches the rate, null if none does."""
    return rates.groupBy(*by).agg(F.min(F.when(F.col("tpr") >= target_tpr, F.col("length"))).alias("length"))


def pareto_frontier(points: DataFrame, by: list[str]) -> DataFrame:
    """Points (damage, survival) that no point of at most their damage reaches in survival. Values outside [0, 1] are an error.

    Each damage is reduced to its best survival before the scan, which passes ranges of damages and not groups in order (see scan.py)."""
    fine = F.col("damage").between(0, 1) & F.col("survival").between(0, 1)
    checked = F.when(fine, F.col("survival")).otherwise(F.raise_error(F.lit("damage and survival are in [0, 1]")).cast("double"))
    keyed = placed(points.select(F.struct(*by).alias("_g"), F.col("damage").cast("double").alias("damage"), checked.alias("_v")), "damage", "_k")
    best = prefixes(keyed, "_g", "_k", "_v", "max").where(F.col("before").isNull() | (F.col("own") > F.col("before")))
    return best.select(*[F.col(f"_g.{c}").alias(c) for c in by], from_sortable(F.col("_k")).alias("damage"), F.col("own").alias("survival"))


def softmax(logits: Column) -> Column:
    """Stable: shifted by the maximum. Maximum and sum are computed once a row."""
    wide = F.transform(logits, lambda x: x.cast("double"))
    powers = let(wide, lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))))
    return let(powers, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda t: F.transform(e, lambda x: x / t)))


def with_probabilities(df: DataFrame, logits: str) -> DataFrame:
    return df.withColumn("probabilities", softmax(F.col(logits)))


def shannon(probabilities: Column) -> Column:
    """In nats; 0 log 0 is 0."""
    return -F.aggregate(probabilities, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def spike(probabilities: Column, z: float = math.tanh(1.0)) -> Column:
    if z < 0:
        raise ValueError("z must not be negative")
    return F.aggregate(probabilities, F.lit(0.0), lambda s, p: s + p / (1 + F.lit(z) * p))


def summarized(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median and quantiles; a value that is null or not finite is an error."""
    levels = (0.5, 0.05, 0.25, 0.75, 0.95)
    means = df.groupBy(*by).agg(F.avg(finite(value)).alias("mean"))
    out = _side_join(means, quantiles(df, by, value, levels, "_q").drop("n"), by)
    return out.withColumn("median", F.col("_q")[0]).withColumn("quantiles", F.slice("_q", 2, len(levels) - 1)).drop("_q")


def prefix_summary(df: DataFrame, steps: str, length: str, key: list[str]) -> DataFrame:
    """Entropies of the first `length` steps (array<struct<shannon, spike>>) of each row, summarized. A row's own steps are folded within the row."""
    def middle(field: str) -> Column:
        values = F.array_sort(F.transform("_s", lambda x: finite(x[field])))
        return let(values, lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)

    mean = lambda field: F.aggregate("_s", F.lit(0.0), lambda s, x: s + x[field]) / F.size("_s")
    rows = df.select(*key, F.slice(steps, F.lit(1), F.col(length)).alias("_s")).where(F.size("_s") > 0)
    return rows.select(*key, mean("shannon").alias("shannon_mean"), middle("shannon").alias("shannon_median"), mean("spike").alias("spike_mean"), middle("spike").alias("spike_median"))


def _grams(tokens: Column, width: int) -> Column:
    """n-grams as text, which sets and sorts handle by hash and order, unlike arrays of arrays."""

    def grams(t: Column) -> Column:
        at = F.when(F.size(t) >= width, F.sequence(F.lit(1), F.size(t) - width + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(t, i, width), " "))

    return let(tokens, grams)


def ngrams(tokens: Column, width: int) -> Column:
    """Distinct n-grams of a token array, in order of appearance."""
    return F.transform(F.array_distinct(_grams(tokens, width)), lambda g: F.split(g, " ").cast("array<int>"))


def ngram_z(df: DataFrame, tokens: str, green, width: int = 4, gamma: float = 0.25) -> DataFrame:
    """Adds scored_units, green_count, score and p_value of the unique n-gram statistic. green(ngram) is the scheme's own predicate. At most
    `width` tokens have no units: score 0, p 1."""
    units = F.when(F.size(tokens) > width, ngrams(F.col(tokens), width)).otherwise(F.array().cast("array<array<int>>"))
    counted = let(units, lambda u: F.struct(F.size(u).alias("n"), F.size(F.filter(u, green)).alias("g")))
    df = df.withColumn("_u", counted).withColumn("green_count", F.col("_u.g")).withColumn("scored_units", F.col("_u.n")).drop("_u")
    t = F.col("scored_units")
    z = F.when(t == 0, 0.0).otherwise((F.col("green_count") - gamma * t) / F.sqrt(t * F.lit(gamma * (1 - gamma))))
    df = df.withColumn("score", z)
    return df.withColumn("p_value", F.when(t == 0, 1.0).otherwise(normal_tail("score")))


def z_of_counts(green: Column, units: Column, gamma: float) -> Column:
    return (green - gamma * units) / F.sqrt(units * F.lit(gamma * (1 - gamma)))


def weighted_mean(values: Column, mask: Column, depth: int) -> Column:
    """Of g-values array<array<double>> (position, layer): weights fall linearly from 10 to 1 and have mean 1; masked positions do not count."""
    raw = [10 - 9 * i / (depth - 1) for i in range(depth)] if depth > 1 else [1.0]
    weights = F.array(*[F.lit(w * depth / sum(raw)) for w in raw])
    rows = F.zip_with(values, mask, lambda g, m: F.when(m, F.aggregate(F.zip_with(g, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0))
    count = F.size(F.filter(mask, lambda m: m))
    return F.when(count > 0, F.aggregate(rows, F.lit(0.0), lambda s, x: s + x) / (F.lit(float(depth)) * count))


def repetition_mask(tokens: Column, context: int, history: int | None = 1024) -> Column:
    """For each position from `context` on: whether its context of that many tokens was not seen at the last `history` positions. Contexts, as
    64-bit hashes, are sorted with their places once, so a repeat stands next to what it repeats; the places of repeats, sorted, cut the mask."""
    none = F.array().cast("array<boolean>")

    def masked(t: Column) -> Column:
        n = F.greatest(F.size(t) - context, F.lit(0))
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        placed = F.array_sort(F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get(t, i - 1 + k) for k in range(context)]).alias("g"), i.alias("i"))))

        def marked(z: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("struct<g:bigint,i:int>")), F.slice(z, 1, F.greatest(F.size(z) - 1, F.lit(0))))
            near = (lambda a, b: b["i"] - a["i"] <= history) if history else (lambda a, b: F.lit(True))
            repeats = F.zip_with(before, z, lambda a, b: F.when((a["g"] == b["g"]) & near(a, b), b["i"]))
            # runs of fresh positions between repeats, each run followed by one that is not
            cuts = F.concat(F.array(F.lit(0)), F.sort_array(F.array_compact(repeats)), F.array(F.size(z) + 1))
            runs = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a - 1), F.array(F.lit(False))))
            return F.slice(F.flatten(runs), 1, F.size(z))

        return F.when(n > 0, let(placed, marked)).otherwise(none)

    return F.when(tokens.isNull(), none).otherwise(let(tokens, masked))


def _nucleus(logits: np.ndarray, temperature: float, top_k: int, top_p: float) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that stay, likeliest first (ties by number), and their probabilities: the top k with ties, then, of these, the least head whose
    probability is over top p, at least the first. One sort and one running sum."""
    scaled = logits / temperature
    tokens = np.arange(len(scaled))
    if 0 < top_k < len(scaled):
        tokens = np.flatnonzero(scaled >= np.partition(scaled, -top_k)[-top_k])
    tokens = tokens[np.argsort(-scaled[tokens], kind="stable")]
    p = np.exp(scaled[tokens] - scaled[tokens[0]])
    p /= p.sum()
    if top_p < 1:
        n = 1 + int(np.searchsorted(np.cumsum(p[:-1]), top_p, side="right"))
        tokens, p = tokens[:n], p[:n] / p[:n].sum()
    return tokens, p


def _checked_filters(temperature: float, top_k: int | None, top_p: float | None) -> tuple[float, int, float]:
    top_k, top_p = top_k or 0, 1.0 if top_p is None else top_p
    if temperature <= 0 or top_k < 0 or not 0 < top_p <= 1:
        raise ValueError("invalid temperature, top_k, or top_p")
    return temperature, top_k, top_p


def _rows_of(logits: pd.Series):
    """Each row's logits as doubles, None for null; no logits, or one that is not a number or not finite, is an error."""
    for x in logits:
        if x is None:
            yield None
            continue
        values = np.asarray(x, dtype=float)
        if not len(values) or not np.isfinite(values).all():
            raise ValueError("logits have to be finite, and at least one")
        yield values


def filtered_probabilities(df: DataFrame, logits: str, temperature: float, top_k: int | None, top_p: float | None) -> DataFrame:
    """Adds `kept`, array<struct<token, p>>: what is drawn from at a temperature, the top k with ties, then the least head over top p of these."""
    known = _checked_filters(temperature, top_k, top_p)

    def kept(column: pd.Series) -> pd.Series:
        found = [None if x is None else _nucleus(x, *known) for x in _rows_of(column)]
        return pd.Series([None if f is None else [{"token": int(t), "p": float(p)} for t, p in zip(*f, strict=True)] for f in found])

    return df.withColumn("kept", F.pandas_udf(kept, "array<struct<token int, p double>>")(F.col(logits)))


def uniform(seed: int, *counter: Column) -> Column:
    """A number in [0, 1) of 52 bits that depends on the seed and the counter alone, so draws can be made in any order, and again."""
    text = F.concat_ws("\0", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in counter])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def drawn_tokens(df: DataFrame, logits: str, seed: int, counter: list[str], temperature: float = 0.8, top_k: int | None = 40, top_p: float | None = 0.95) -> DataFrame:
    """Adds `token`, `p` and `kept_n`: a token drawn from what the filters keep, by the inverse of its running sum at uniform(seed, counter); null
    where the logits are. The same row, seed and counter always give the same token."""
    known = _checked_filters(temperature, top_k, top_p)

    def draw(column: pd.Series, at: pd.Series) -> pd.DataFrame:
        out = []
        for x, u in zip(_rows_of(column), at, strict=True):
            if x is None:
                out.append((None, None, None))
                continue
            tokens, p = _nucleus(x, *known)
            i = min(int(np.searchsorted(np.cumsum(p), u, side="right")), len(p) - 1)
            out.append((int(tokens[i]), float(p[i]), len(p)))
        return pd.DataFrame(out, columns=["token", "p", "kept_n"]).astype({"token": "Int32", "kept_n": "Int32", "p": float})

    made = F.pandas_udf(draw, "struct<token int, p double, kept_n int>")(F.col(logits), uniform(seed, *[F.col(c) for c in counter]))
    return df.withColumn("_d", made).select("*", "_d.token", "_d.p", "_d.kept_n").drop("_d")
