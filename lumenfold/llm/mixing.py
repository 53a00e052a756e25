"""Mixing sources to target weights: iterative proportional fitting rakes token weights to marginals, then documents are sampled by
calibrated probabilities. DataFrame functions only.

Cells are the combinations of source, language and topic that occur. Raking multiplies the cells' weights until the sums by source, by
language and by topic are the targets. A cell's documents are then kept with a probability in proportion to its weight over its tokens."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_rows

MARGINS = ("source", "lang", "topic")
#: Targets not given are the corpus shares to this power, scaled to 1: 1 keeps the mix, 0 makes all categories alike.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.8}
#: Share of all tokens that the sample aims at, and the seed of the draws.
KEPT_SHARE, SEED = 0.7, 11
SWEEPS, TOLERANCE = 30, 1e-4
#: A table of cells up to this many rows is broadcast to the documents; beyond that they are joined by shuffle.
BROADCAST_CELLS = 200_000
NONE = "(none)"


def n_tokens(text: Column) -> Column:
    """A native estimate: words, or a quarter of the characters if that is more; 0 for an empty text."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(F.char_length(text) == 0, 0).otherwise(F.greatest(words, F.ceil(F.char_length(text) / 4))).cast("long")


def topic(text: Column) -> Column:
    """A coarse native topic, by form: the shares of markup, digits and lines tell tables and code, records and lists from prose."""
    size = F.greatest(F.char_length(text), F.lit(1))
    marks = F.regexp_count(text, F.lit(r"[|{}<>=;#$%&*]"))
    digits = F.regexp_count(text, F.lit(r"[0-9]"))
    lines = F.regexp_count(text, F.lit(r"\n")) + 1
    return (
        F.when(marks > 0.02 * size, "tables and markup")
        .when(digits > 0.02 * size, "records")
        .when(size < 60 * lines, "lists")
        .when(size >= 8000, "long prose")
        .when(size < 400, "short prose")
        .otherwise("prose")
    )


def _with_cells(plain: DataFrame, text: Column, lang: Column, source: Column, doc_id: Column, own_topic: Column | None) -> DataFrame:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    about = topic(whole) if own_topic is None else F.coalesce(own_topic.cast("string"), F.lit(NONE))
    return plain.withColumns({"source_": F.coalesce(source.cast("string"), F.lit(NONE)), "lang_": F.coalesce(lang.cast("string"), F.lit(NONE)), "topic_": about, "tokens_": n_tokens(whole), "id_": doc_id.cast("long")})


def targets_of(cells: DataFrame, margin: str, given: Mapping[str, float] | None) -> DataFrame:
    """(margin, target): the given targets, else tempered shares; scaled to 1 over the categories that occur. A category without a given
    target keeps none of the weight; a given target above zero for a category without tokens cannot be met, and is an error."""
    found = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens"))
    if given is None:
        found = found.withColumn("raw", F.pow(F.col("tokens").cast("double"), F.lit(TEMPER[margin])))
    else:
        if any(not 0 <= float(v) < float("inf") for v in given.values()):
            raise ValueError(f"targets of {margin} have to be numbers of zero or more")
        wanted = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in given.items()], f"{margin} string, raw double")
        absent = wanted.where("raw > 0").join(found.where("tokens > 0"), margin, "left_anti").select(margin).head(10)
        if absent:
            raise ValueError(f"no tokens for targets of {margin}: {', '.join(sorted(r[0] for r in absent))}")
        found = found.join(wanted, margin, "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    total = found.agg(F.coalesce(F.sum("raw"), F.lit(0.0)).alias("total")).first()["total"]
    return found.select(margin, (F.col("raw") / F.lit(max(total, 1e-300))).alias("target"))


def raked(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, tokens) with `weight`, which sum to 1 and by each margin to its targets, as far as those agree.

    Each step is an aggregate by one margin, pre-aggregated before the shuffle, joined back to the cells; lineage is cut after each sweep.
    The fit ends when no margin is off by more than the tolerance. Given targets that are not met after `sweeps` (they contradict each other, or the
    cells that occur) are an error; tempered shares, which are an aim, are met as nearly as that."""
    cells = cut(cells, "cells")
    goals = {m: cut(targets_of(cells, m, (targets or {}).get(m)), "targets") for m in MARGINS}
    total = cells.agg(F.sum("tokens").alias("n")).first()["n"] or 1
    worst = 0.0
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for _ in range(sweeps):
        for margin in MARGINS:
            sums = now.groupBy(margin).agg(F.sum("weight").alias("sum")).join(goals[margin], margin)
            factor = F.when(F.col("sum") > 0, F.col("target") / F.col("sum")).otherwise(0.0)
            sums = sums.select(margin, factor.alias("factor"), F.abs(F.col("target") - F.col("sum")).alias(f"off_{margin}"))
            now = now.join(sums, margin).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        # One written table and one look at it for each sweep.
        swept = cut(now.select(*MARGINS, "tokens", "weight", F.greatest(*[f"off_{m}" for m in MARGINS]).alias("off")), "cells")
        worst = swept.agg(F.max("off").alias("off")).first()["off"] or 0.0
        now = swept.drop("off")
        if worst <= tolerance:
            return now
    if targets:
        raise ValueError(f"targets are not met after {sweeps} sweeps: a margin is off by {worst:.4f}")
    return now


def calibrated(cells: DataFrame, kept_share: float = KEPT_SHARE) -> DataFrame:
    """raked() cells with `probability` and `ratio` = weight over share of tokens. Probabilities are min(1, scale * ratio); the scale is raised
    until the expected tokens are kept_share of all, so that what cells lose at 1 goes to the others in proportion."""
    cells = cells.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0)))
    total = cells.agg(F.sum("tokens").alias("n"), F.max("ratio").alias("top")).first()
    goal = kept_share * float(total["n"] or 0)
    low, high = 0.0, 1.0 / max(total["top"] or 1.0, 1e-300)

    def tokens_at(scales: list[float]) -> list[float]:
        """Expected tokens at several scales, in one pass over the cells."""
        row = cells.agg(*[F.sum(F.least(F.lit(1.0), F.col("ratio") * F.lit(s)) * F.col("tokens")).alias(f"n{i}") for i, s in enumerate(scales)]).first()
        return [float(x or 0.0) for x in row]

    rising = [high * 4.0**k for k in range(40)]
    reached = [n >= goal * (1 - 1e-9) for n in tokens_at(rising)]
    k = reached.index(True) if True in reached else len(rising) - 1
    low, high = rising[k - 1] if k else 0.0, rising[k]
    for _ in range(5):
        steps = [low + (high - low) * i / 32 for i in range(1, 33)]
        k = next((i for i, n in enumerate(tokens_at(steps)) if n >= goal * (1 - 1e-9)), 31)
        low, high = steps[k - 1] if k else low, steps[k]
    scale = high
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * F.lit(scale)))


def _drawn(docs: DataFrame, targets, kept_share: float, seed: int, topics: str | None) -> tuple[DataFrame, list[str]]:
    """The rows of docs with their cell's weight and probability and their draw, under plain names, and docs' own names."""
    plain, (text, lang, source, doc_id, *about), own = whole_rows(docs, "text", "lang", "source", "doc_id", *([topics] if topics else []))
    rows = _with_cells(plain, text, lang, source, doc_id, about[0] if about else None)
    cells = rows.groupBy(*[F.col(f"{m}_").alias(m) for m in MARGINS]).agg(F.sum("tokens_").alias("tokens"))
    cells = cut(calibrated(raked(cells, targets), kept_share).select(*[F.col(m).alias(f"{m}_") for m in MARGINS], "weight", "probability"), "cells")
    side = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id_"), 11) / F.lit(float(1 << 53))
    return rows.join(side, [f"{m}_" for m in MARGINS]).withColumn("draw", draw), own


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, kept_share: float = KEPT_SHARE, seed: int = SEED, topics: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, n_tokens, weight (of its cell), probability, draw and sampled.

    A null source or language is the category "(none)"; a null or empty text has no tokens, so it adds no weight, and is sampled like the rest
    of its cell. The draw is a hash of the id and the seed: repeated rows fall alike, and the sample does not depend on the partitioning; rows
    of null id share a draw. An empty table gives none. `topics` names a column of topics, for one that is better than topic(); a null one is "(none)"."""
    rows, _ = _drawn(docs, targets, kept_share, seed, topics)
    return rows.select(F.col("id_").alias("doc_id"), *[F.col(f"{m}_").alias(m) for m in MARGINS], F.col("tokens_").alias("n_tokens"), "weight", "probability", "draw", (F.col("draw") < F.col("probability")).alias("sampled"))


def sampled(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, kept_share: float = KEPT_SHARE, seed: int = SEED, topics: str | None = None) -> DataFrame:
    """The rows of docs that mix() samples, all columns."""
    rows, own = _drawn(docs, targets, kept_share, seed, topics)
    return rows.where(F.col("draw") < F.col("probability")).select(*[f"_{i}" for i in range(len(own))]).toDF(*own)
