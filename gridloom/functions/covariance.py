"""Covariance families as column expressions of lags: h in space, u in time, v between outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.kernels import Family


def _decay(x: Column, c: float) -> Column:
    return F.exp(-F.lit(float(c)) * x)


def _growth(x: Column, a: float, b: float) -> Column:
    """(1 + a x) to the power b / 2."""
    return F.exp(F.lit(0.5 * b) * F.log1p(F.lit(float(a)) * x))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def exponential(h: Column, s2: float, phi: float) -> Column:
    return F.lit(float(s2)) * _decay(h, phi)


def matern(h: Column, s2: float, phi: float, twonu: int) -> Column:
    """Smoothness twonu / 2 for twonu of 1, 3 or 5; at lag 0 the variance, with 1e-6 on it where twonu is 3."""
    t = F.lit(float(phi)) * h
    shape = {1: F.lit(1.0), 3: 1 + t, 5: 1 + t + t * t / 3}.get(twonu, F.lit(0.0))
    return F.when(h == 0, F.lit(s2 + (1e-6 if twonu == 3 else 0.0))).otherwise(F.lit(float(s2)) * F.exp(-t) * shape)


def space_time(h: Column, u: Column, s2: float, a: float, b: float, c: float) -> Column:
    """Non-separable covariance in space and time of one outcome."""
    g = _growth(u, a, b)
    return F.lit(float(s2)) / (g * g) * _decay(h / g, c)


def space_time_two(h: Column, u: Column, v: Column, s2: float, a: float, b: float, c: float) -> Column:
    """Of two outcomes, at latent distance v."""
    w = F.sqrt(v + 1)
    g = _growth(u / w, a, b)
    return F.lit(float(s2)) / (g * g) * _decay(h / g, c) / w


def space_time_many(h: Column, u: Column, v: Column, s2: float, a2: float, b2: float, a1: float, b1: float, c: float) -> Column:
    w = _growth(v, a2, b2)
    g = _growth(u / w, a1, b1)
    return F.lit(float(s2)) / (g * g) * _decay(h / g, c) / w


def space_two(h: Column, v: Column, s2: float, c: float) -> Column:
    return F.lit(float(s2)) / (v + 1) * _decay(h / F.sqrt(v + 1), c)


def space_many(h: Column, v: Column, s2: float, a: float, b: float, c: float) -> Column:
    g = _growth(v, a, b)
    return F.lit(float(s2)) / (g * g) * _decay(h / g, c)


def core(h: Column, v: Column, q: int, params: list[float]) -> Column:
    """The spatial core of unit variance for q outcomes; params: c, or a, b, c where q is over 2."""
    if q > 2:
        return space_many(h, v, 1.0, *params)
    return space_two(h, v, 1.0, params[-1]) if q == 2 else exponential(h, 1.0, params[-1])


def cross_outcome(h: Column, v: Column, a1_i: Column, a1_j: Column, a2_i: Column, phi_i: Column, q: int, params: list[float]) -> Column:
    """Between outcomes i and j: a shared core, and a part of each outcome's own where they are the same."""
    own = a1_i * a1_i * core(h, F.lit(0.0), q, params) + a2_i * a2_i * F.exp(-phi_i * h)
    return F.when(v == 0, own).otherwise(a1_i * a1_j * core(h, v, q, params))


def ard(deltas: list[Column], scales: list[float], s2: float) -> Column:
    """Squared exponential with a scale for each input; 1e-3 on it where the inputs are equal."""
    d = sum((F.lit(float(k)) * x * x for x, k in zip(deltas, scales, strict=True)), F.lit(0.0))
    return F.lit(float(s2)) * F.exp(-d) + F.when(d == 0, F.lit(1e-3)).otherwise(F.lit(0.0))


def with_nugget(c: Column, same: Column, nugget: float) -> Column:
    """A covariance with a nugget where the sites are the same."""
    return c + F.when(same, F.lit(float(nugget))).otherwise(F.lit(0.0))


def unpack(params: Column, dims: int, q: int, several_outcomes: bool = False) -> dict[str, Column]:
    """The named parts of an array of parameters, by the kernels' order: the family's own and the latent distances."""
    names = Family(dims, q, several=several_outcomes).names()
    return {n: F.get(params, F.lit(k)) for k, n in enumerate(names)}


def component_pairs(pairs: DataFrame, latent: Sequence[Sequence[float]]) -> DataFrame:
    """pairs with r, s (components from 0) and v, their latent distance: every row for each pair of components, by distance."""
    at = sorted((float(v), r, s) for r, row in enumerate(latent) for s, v in enumerate(row))
    return pairs.select("*", F.inline(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(s).alias("s"), F.lit(v).alias("v")) for v, r, s in at])))


def model(kind: int, dims: int, q: int, h: Column, u: Column, v: Column, deltas: list[Column], params: list[float], twonu: int = 1) -> Column:
    """Kind 0: the families of space and time; 1: the squared exponential with a scale for each input (params: variance, scales)."""
    return ard(deltas, params[1:], params[0]) if kind else covariance(dims, q, h, u, v, params, twonu)


def covariance(dims: int, q: int, h: Column, u: Column, v: Column, params: list[float], twonu: int = 1) -> Column:
    """The family for this many coordinates and outcomes; params as in the functions above, the variance first."""
    if dims == 2:
        if q < 2:
            return matern(h, params[0], params[1], twonu)
        return space_two(h, v, *params) if q == 2 else space_many(h, v, *params)
    if q < 2:
        return space_time(h, u, *params)
    return space_time_two(h, u, v, *params) if q == 2 else space_time_many(h, u, v, *params)


def parameter_count(dims: int, q: int, several_outcomes: bool = False) -> int:
    """Covariance parameters without the variance, latent distances between outcomes included."""
    if several_outcomes:
        return 3 * q + (3 if q > 2 else 1) + q * (q - 1) // 2
    base = (1 if q <= 2 else 3) if dims == 2 else (3 if q <= 2 else 5)
    return base + q * (q - 1) // 2
