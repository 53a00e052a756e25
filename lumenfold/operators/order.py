"""Exact order statistics of groups of any size, by radix selection.

Values become 64-bit integers that sort as they do. A histogram of the highest 16 bits tells in which bin a rank lies, one of the next 16 bits within
that bin goes on, and after four passes the value is known with the number of values below it and of its ties. No pass sorts, ranks or collects
values: a group sends counts by bin, at most 65,536 of them, however many values it has. Rows of equal values are counted once, map side first, and
the histograms of all passes are added up from those counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import from_sortable, with_sortable

#: Bits that a pass settles.
DIGIT = 16


def finite(value: str | Column, message: str = "values have to be finite") -> Column:
    """The value as a double; null, NaN and infinities are an error wherever it is used."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v).otherwise(F.raise_error(F.lit(message)).cast("double"))


def _found(bins: Column, rank: Column) -> Column:
    """Of bins array<struct<digit, k>> in order: the one that holds the rank, and the number of values in those before it."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("digit"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("ties"))

    def step(s: Column, b: Column) -> Column:
        end = s["seen"] + b["k"]
        here = s["digit"].isNull() & (rank < end)
        return F.struct(end.alias("seen"), F.when(here, b["digit"]).otherwise(s["digit"]).alias("digit"), F.when(here, s["seen"]).otherwise(s["below"]).alias("below"), F.when(here, b["k"]).otherwise(s["ties"]).alias("ties"))

    return F.aggregate(bins, start, step)


def order_statistics(df: DataFrame, by: Sequence[str], value: str | Column, ranks: Callable[[Column], Column], message: str = "values have to be finite") -> DataFrame:
    """One row a group (`by`, nulls are values): its `n`, and `picks`, array<struct<rank, value, below, ties>> in the order of `ranks(n)`, an array of
    ranks from 0, the least, to n - 1; ranks outside are moved to the nearer end. Values have to be finite."""
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    keyed = with_sortable(df.select(group.alias("g"), (F.col(value) if isinstance(value, str) else value).alias("v")), finite("v", message), "digit")
    levels = [keyed.groupBy("g", "digit").agg(F.count("*").alias("k"))]
    for _ in range(64 // DIGIT - 1):
        levels.append(levels[-1].groupBy("g", F.shiftright("digit", DIGIT).alias("digit")).agg(F.sum("k").alias("k")))
    bins = F.array_sort(F.collect_list(F.struct("digit", "k"))).alias("bins")
    first = levels.pop().groupBy("g").agg(F.sum("k").alias("n"), bins)
    state = first.select("g", "n", "bins", F.posexplode(ranks(F.col("n"))).alias("place", "asked")).withColumn("rank", F.greatest(F.lit(0), F.least(F.col("asked"), F.col("n") - 1)).cast("long"))
    state = state.select("g", "n", "place", "rank", F.lit(0).cast("long").alias("below"), _found(F.col("bins"), F.col("rank")).alias("f"))
    known = ["g", "n", "place", "rank", "below", "prefix", "ties"]
    flat = lambda: state.select("g", "n", "place", "rank", (F.col("below") + F.col("f.below")).alias("below"), F.col("f.digit").alias("prefix"), F.col("f.ties").alias("ties"))
    for level in reversed(levels):
        within = level.select("g", F.shiftright("digit", DIGIT).alias("prefix"), "digit", "k")
        state = flat().join(within, ["g", "prefix"]).groupBy(*known).agg(bins).select(*known, _found(F.col("bins"), F.col("rank") - F.col("below")).alias("f"))
    state = flat()
    picked = F.struct("place", "rank", from_sortable(F.col("prefix")).alias("value"), "below", "ties")
    out = state.groupBy("g").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(picked)).alias("picks"))
    return out.select(*[F.col(f"g.{c}").alias(c) for c in by], "n", F.transform("picks", lambda p: F.struct(p["rank"].alias("rank"), p["value"].alias("value"), p["below"].alias("below"), p["ties"].alias("ties"))).alias("picks"))


def quantiles(df: DataFrame, by: Sequence[str], value: str | Column, levels: Sequence[float], name: str = "quantiles") -> DataFrame:
    """`by`, `n` and `name`, the exact quantiles of the levels: between the two nearest ranks, in proportion."""
    at = [F.lit(float(q)) * (F.col("n") - 1) for q in levels]
    asked = lambda n: F.array(*[x for q in levels for x in (F.floor(F.lit(float(q)) * (n - 1)), F.ceil(F.lit(float(q)) * (n - 1)))])
    found = order_statistics(df, by, value, asked)
    between = []
    for i, place in enumerate(at):
        low, high = F.col("picks")[2 * i]["value"], F.col("picks")[2 * i + 1]["value"]
        part = place - F.floor(place)
        between.append(F.when(part == 0, low).otherwise(low * (1 - part) + high * part))
    return found.select(*by, "n", F.array(*between).alias(name))
