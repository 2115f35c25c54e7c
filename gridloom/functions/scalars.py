"""Scalar functions: bounded logits, log densities, hexadecimal numbers, symmetric matrices, clamping."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logit(x: Column, lower: float = 0.0, upper: float = 1.0) -> Column:
    return -F.ln((F.lit(upper) - x) / (x - F.lit(lower)))


def logistic(x: Column, lower: float = 0.0, upper: float = 1.0) -> Column:
    return F.lit(lower) + F.lit(upper - lower) / (1 + F.exp(-x))


def log_jacobian(old: Column, new: Column, lower: float, upper: float) -> Column:
    """What the bounded logit adds to the log acceptance of a proposal."""
    part = lambda x: -F.ln(F.lit(upper) - x) - F.ln(x - F.lit(lower))
    return part(old) - part(new)


def logits(x: Column, bounds: Sequence[tuple[float, float]]) -> Column:
    """logit() of each element of an array by its own bounds."""
    return F.array(*[logit(F.get(x, F.lit(k)), lo, hi) for k, (lo, hi) in enumerate(bounds)])


def logistics(x: Column, bounds: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[logistic(F.get(x, F.lit(k)), lo, hi) for k, (lo, hi) in enumerate(bounds)])


def lognormal_proposal(old: Column, new: Column) -> Column:
    """What a random walk on the log scale adds to the log acceptance."""
    return F.ln(new) - F.ln(old)


def prior_log_ratio(old: Column, new: Column, priors: Sequence[tuple[float, float]]) -> Column:
    """Of arrays of parameters with inverse gamma priors, each element by its own."""
    each = [invgamma_logdens(F.get(new, F.lit(k)), a, b) - invgamma_logdens(F.get(old, F.lit(k)), a, b) for k, (a, b) in enumerate(priors)]
    return sum(each, F.lit(0.0))


def accepted(log_ratio: Column, u: Column) -> Column:
    """Whether a proposal of this log acceptance is taken at the uniform number u."""
    return F.exp(log_ratio) > u


def asymmetry(entries: DataFrame, i: str = "i", j: str = "j", v: str = "v") -> DataFrame:
    """One row: the sum of the absolute differences between each entry under the diagonal and its mirror image (0 where there is none)."""
    lower = entries.where(F.col(i) > F.col(j)).select(F.col(i).alias("a"), F.col(j).alias("b"), F.col(v).alias("x"))
    upper = entries.where(F.col(i) < F.col(j)).select(F.col(j).alias("a"), F.col(i).alias("b"), F.col(v).alias("y"))
    apart = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return lower.join(upper, ["a", "b"], "full").agg(F.coalesce(F.sum(apart), F.lit(0.0)).alias("asymmetry"))


def multiset_except(a: Column, b: Column) -> Column:
    """The elements of a sorted array without as many of each as another holds."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    each = F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(F.lit(0), count(a, x) - count(b, x))))
    return F.array_sort(F.flatten(each))


def gamma_logdens(x: Column, a: float, b: float) -> Column:
    return F.lit(a * math.log(b) - math.lgamma(a)) + F.lit(a - 1) * F.ln(x) - F.lit(b) * x


def invgamma_logdens(x: Column, a: float, b: float) -> Column:
    return F.lit(a * math.log(b) - math.lgamma(a)) - F.lit(a + 1) * F.ln(x) - F.lit(b) / x


def beta_logdens(x: Column, a: float, b: float) -> Column:
    """Without its constant."""
    return F.lit(a - 1) * F.ln(x) + F.lit(b - 1) * F.ln(1 - x)


def lognormal_logdens(x: Column, mean: float, sd: float) -> Column:
    return F.lit(-0.5 * math.log(2 * math.pi) - math.log(sd)) - F.ln(x) - (F.ln(x) - F.lit(mean)) * (F.ln(x) - F.lit(mean)) / F.lit(2 * sd * sd)


def gaussian_logdens(residual: Column, variance: Column) -> Column:
    return F.lit(-0.5 * math.log(2 * math.pi)) - 0.5 * F.ln(variance) - 0.5 * residual * residual / variance


def clamp(x: Column, lower: float, upper: float, margin: float = 1e-10) -> tuple[Column, Column]:
    """x within the bounds, and whether it was out of them."""
    inside = F.when(x < lower, F.lit(lower + margin)).when(x > upper, F.lit(upper - margin)).otherwise(x)
    return inside, (x < lower) | (x > upper)


def hex_to_int(text: Column) -> Column:
    """The 32-bit number a text begins with: an optional sign, an optional 0x, hexadecimal digits; 0 without any, and the nearest limit beyond 32 bits."""
    plain = F.ltrim(F.coalesce(text, F.lit("")))
    digits = F.regexp_extract(plain, r"^[+-]?(?:0[xX])?0*([0-9A-Fa-f]*)", 1)
    size = F.when(F.length(digits) > 15, F.lit(1 << 60)).when(digits == "", F.lit(0)).otherwise(F.conv(digits, 16, 10).cast("bigint"))
    signed = F.when(plain.startswith("-"), -size).otherwise(size)
    return F.greatest(F.lit(-(1 << 31)), F.least(F.lit((1 << 31) - 1), signed)).cast("int")


def symmetric_entries(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """keep, i, j, value (from 1) of the symmetric matrix of zero diagonal whose lower triangle, column by column, is the array vector."""
    side = ((1 + F.sqrt(1 + 8 * F.size(vector))) / 2).cast("int")
    cells = F.flatten(F.transform(F.sequence(F.lit(1), side), lambda j: F.transform(F.sequence(F.lit(1), side), lambda i: F.struct(i.alias("i"), j.alias("j")))))
    lo, hi = F.least("c.i", "c.j"), F.greatest("c.i", "c.j")
    place = (lo - 1) * F.col("p") - F.expr("(least(c.i, c.j) * (least(c.i, c.j) - 1)) div 2") + hi - lo
    rows = df.select(*keep, vector, side.alias("p"), F.explode(cells).alias("c"))
    value = F.when(F.col("c.i") == F.col("c.j"), F.lit(0.0)).otherwise(F.try_element_at(F.col(vector), place.cast("int")).cast("double"))
    return rows.select(*keep, F.col("c.i").alias("i"), F.col("c.j").alias("j"), value.alias("value"))


def inverse_deviation(var: Column) -> Column:
    """The diagonal of the factor of a diagonal precision: one over the standard deviation; null where there is no variance left."""
    return F.when(var > 0, 1 / F.sqrt(var))
