"""Prefix scans of groups of any size: for each place in an order, the aggregate of all that comes before it.

Places are 64-bit integers, cut into ranges by their digits: 2^16 places, 2^32, 2^48. Each range's own aggregate comes from those within it; within a
range at most 65,536 siblings are passed in order, and each takes what came before its range along. So no window holds a group, or the whole table,
and, unlike ranges from a sample, the same places always make the same ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import with_sortable

DIGIT, DEPTH = 16, 3


def placed(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with a column of numbers as places; a null has none, which is an error."""
    known = F.coalesce(F.col(order), F.raise_error(F.lit("places must not be null")).cast(df.schema[order].dataType))
    if dict(df.dtypes)[order] in ("double", "float"):
        return with_sortable(df, known.cast("double"), name)
    return df.withColumn(name, known.cast("long"))


def prefixes(df: DataFrame, group: str, key: str, value: str | Column, op: str = "sum") -> DataFrame:
    """group, key, `own`, the aggregate (sum or max) of value at a key, and `before`, that of all lesser keys of the group; null if there are none."""
    aggregate, both = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "max": (F.max, F.greatest)}[op]
    levels = [df.select(F.col(group).alias("g"), F.col(key).alias("k0"), (F.col(value) if isinstance(value, str) else value).alias("v")).groupBy("g", "k0").agg(aggregate("v").alias("v"))]
    for i in range(DEPTH):
        levels.append(levels[i].groupBy("g", F.shiftright(f"k{i}", DIGIT).alias(f"k{i + 1}")).agg(aggregate("v").alias("v")))
    earlier = lambda *by, order: aggregate("v").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    known = levels[DEPTH].withColumn("before", earlier("g", order=f"k{DEPTH}"))
    for i in reversed(range(DEPTH)):
        up = f"k{i + 1}"
        here = levels[i].withColumn(up, F.shiftright(f"k{i}", DIGIT)).withColumn("near", earlier("g", up, order=f"k{i}"))
        known = here.join(known.select("g", up, "before"), ["g", up]).select("g", f"k{i}", "v", both(F.col("before"), F.col("near")).alias("before"))
    return known.select(F.col("g").alias(group), F.col("k0").alias(key), F.col("v").alias("own"), "before")


def running_before(df: DataFrame, by: Sequence[str], order: str, value: Column, op: str, name: str) -> DataFrame:
    """df with `name`, the aggregate of value over the rows of the same `by` (nulls are values) with a lesser order."""
    keyed = placed(df.withColumn("_g", F.struct(*by) if by else F.struct(F.lit(0).alias("all"))).withColumn("_v", value), order, "_k")
    known = prefixes(keyed, "_g", "_k", "_v", op).select("_g", "_k", F.col("before").alias(name))
    return keyed.join(known, ["_g", "_k"]).drop("_g", "_k", "_v")
