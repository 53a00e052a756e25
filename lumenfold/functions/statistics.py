"""Exact binomial intervals, the normal tail, and doubles as sortable integers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import let

#: Nodes of the quadrature, steps of the iteration, and the width integrated over, in standard deviations.
NODES, STEPS, WIDTH = 64, 24, 14.0


def _stirling_error(n: Column) -> Column:
    """ln n! less Stirling's formula: from factorials for small n, else its series."""
    exact = [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)]
    m = n * n
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - (F.lit(1 / 1680) - F.lit(1 / 1188) / m) / m) / m) / m) / n
    return F.when(n < 16, F.get(F.array(*[F.lit(x) for x in exact]), n.cast("int") - 1)).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, by a series where both are close and the terms would cancel."""
    v = (x - mean) / (x + mean)
    w = v * v
    total = F.lit(0.0)
    for j in range(9, 0, -1):
        total = (total + F.lit(1.0 / (2 * j + 1))) * w
    return F.when(F.abs(v) < 0.1, (x - mean) * v + 2 * x * v * total).otherwise(x * F.log(x / mean) + mean - x)


def _log_binomial(k: Column, n: Column, p: Column) -> Column:
    """ln of the probability of k of n, 0 < k < n, by its saddle point: exact for large n too, as nothing large cancels."""
    rest = n - k
    return (
        _stirling_error(n) - _stirling_error(k) - _stirling_error(rest) - _deviance(k, n * p) - _deviance(rest, n * (1 - p))
        + 0.5 * (F.log(n) - F.log(k) - F.log(rest)) - 0.5 * math.log(2 * math.pi)
    )


def _beta_quantile(k: Column, n: Column, half: float) -> Column:
    """x at which I_x(k, n - k + 1) = half, for 0 < k < n: the p at which k or more of n have that probability.

    I_x is the density at x times the integral of the density's ratio to it from below, a Gauss-Legendre sum over as far as the ratio counts (for
    fewer than 2 * NODES trials it is exact, as the density is a polynomial). ln I is concave in ln x, so Newton's steps from anywhere come from
    below after the first, and need no bracket."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    grid = F.array(*[F.struct(F.lit(float((1 - t) / 2)).alias("at"), F.lit(float(w / 2)).alias("w")) for t, w in zip(nodes, weights, strict=True)])
    a, b = k - 1, n - k

    def step(x: Column, _: Column) -> Column:
        reach = F.least(x, F.lit(WIDTH) * F.sqrt(x * (1 - x) / n))
        ratio = lambda d: F.exp(F.when(a == 0, 0.0).otherwise(a * F.log1p(-d / x)) + b * F.log1p(d / (1 - x)))
        integral = let(reach, lambda r: r * F.aggregate(grid, F.lit(0.0), lambda s, g: s + g["w"] * ratio(r * g["at"])))
        log_tail = lambda j: F.log(k) - F.log(x) + _log_binomial(k, n, x) + F.log(j)
        return let(integral, lambda j: x * F.exp((F.lit(math.log(half)) - log_tail(j)) * j / x))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), k / (n + 1), step)


def interval(successes: Column, trials: Column, level: float = 0.95) -> Column:
    """Struct of the bounds (lower, upper) of the exact equal-tailed interval: at each the observed tail has probability (1 - level) / 2. Null
    without trials or where either is null; successes outside [0, trials] are an error. Native expressions, of the same cost for any counts."""
    if not 0 < level < 1:
        raise ValueError("the level has to be between zero and one")
    half = (1 - level) / 2

    def bounds(c: Column) -> Column:
        k, n = c["k"], c["n"]
        edge = F.pow(F.lit(half), 1 / n)
        fine = (k >= 0) & (k <= n)
        lower = F.when(k == 0, 0.0).when(k == n, edge).otherwise(_beta_quantile(k, n, half))
        upper = F.when(k == n, 1.0).when(k == 0, -F.expm1(F.lit(math.log(half)) / n)).otherwise(1 - _beta_quantile(n - k, n, half))
        checked = F.when(fine, lower).otherwise(F.raise_error(F.lit("0 <= successes <= trials is required")).cast("double"))
        return F.struct(checked.alias("lower"), upper.alias("upper"))

    counts = F.struct(successes.cast("double").alias("k"), trials.cast("double").alias("n"))
    return F.when(successes.isNotNull() & (trials > 0), let(counts, bounds))


def _tails(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else 0.5 * math.erfc(x / math.sqrt(2))).astype(float)


def normal_tail(z: Column) -> Column:
    """P(Z > z)."""
    return F.pandas_udf(_tails, "double")(z)


def with_sortable(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with a long that sorts as a finite double does: the bits of its magnitude as IEEE 754 has them, with its sign. Both zeros are 0,
    and so is a null.

    Done in steps, each a column: as one expression the value would be written out some hundred times."""
    v, size, scaled, moved, guess, part = (F.col(f"_s{i}") for i in range(6))
    own, tiny = df.columns, size < F.lit(2.0**-500)
    # powers of two are exact, so scaling is; the logarithm may be off by one next to a power of two
    out = df.withColumn("_s0", value).withColumn("_s1", F.abs(v))
    out = out.withColumn("_s2", F.when(tiny, size * 2.0**600).otherwise(size)).withColumn("_s3", F.when(tiny, 600).otherwise(0))
    out = out.withColumn("_s4", F.floor(F.log2(scaled))).withColumn("_s5", scaled * F.pow(F.lit(2.0), -guess.cast("double")))
    exponent = F.when(part < 1, guess - 1).when(part >= 2, guess + 1).otherwise(guess) - moved
    fraction = F.when(part < 1, part * 2).when(part >= 2, part / 2).otherwise(part) - 1
    normal = (exponent + 1023) * F.lit(1 << 52) + (fraction * float(1 << 52)).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size < F.lit(2.0**-1022), (scaled * 2.0**474).cast("long")).otherwise(normal)
    out = out.withColumn("_s6", bits)
    signed = F.when(v < 0, -F.col("_s6")).otherwise(F.col("_s6"))
    return out.select(*own, F.coalesce(signed, F.lit(0).cast("long")).alias(name))  # never null, so that joins by it add no filters, and plans can be shared


def from_sortable(key: Column) -> Column:
    """The double of with_sortable()."""
    magnitude = F.abs(key)
    exponent, fraction = F.shiftright(magnitude, 52), magnitude.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    # 2^1023 is the largest power; the smallest is made in two steps
    normal = (F.lit(1.0) + fraction / float(1 << 52)) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    size = F.when(exponent == 0, fraction * 2.0**-537 * 2.0**-537).otherwise(normal)
    return F.when(key < 0, -size).otherwise(size)


def next_up(value: Column) -> Column:
    """The next double above."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("nextUp"), value).cast("double")
