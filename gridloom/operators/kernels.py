"""Dense pieces of the mesh Gaussian process, for one block at a time: covariances, conditionals, draws.

A point is a place and a component. With several coefficient processes each site has one point for each of q components, and y is the sum of
z times w over them; with several outcomes a site has one point, of its own outcome.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Gaps:
    """What covariances between points depend on beside theta: distances in space and in time (in the plane: none), components."""

    h: np.ndarray
    u: np.ndarray | None
    ca: np.ndarray
    cb: np.ndarray


@dataclass(frozen=True)
class Family:
    """A covariance family: dims coordinates (two of space, then time), q processes or outcomes; smoothness twonu / 2 where q is 1 in the plane.

    theta holds the variance (none with several outcomes), the family's own parameters as in functions.covariance, then the q (q - 1) / 2 latent
    distances between components, column by column. Several outcomes: q loadings on the shared core, q own scales, q own decays, the core's.
    """

    dims: int = 2
    q: int = 1
    twonu: int = 1
    several: bool = False

    @property
    def per_site(self) -> int:
        return 1 if self.several else self.q

    def names(self) -> list[str]:
        core = ["a", "b", "c"] if self.q > 2 else ["c"]
        if self.several:
            own = [f"{n}{k}" for n in ("shared", "own", "decay") for k in range(1, self.q + 1)] + core
        elif self.dims == 2:
            own = ["sigmasq", *(["phi"] if self.q == 1 else core)]
        else:
            own = ["sigmasq", *(["a", "b", "c"] if self.q < 3 else ["a2", "b2", "a1", "b1", "c"])]
        return own + [f"d{i}_{j}" for j in range(1, self.q + 1) for i in range(j + 1, self.q + 1)]

    def unpack(self, theta: Sequence[float]) -> tuple[list[float], np.ndarray]:
        """The family's parameters and the matrix of latent distances."""
        pairs = self.q * (self.q - 1) // 2
        latent = np.zeros((self.q, self.q))
        if not pairs:
            return list(theta), latent
        latent[np.triu_indices(self.q, 1)] = theta[len(theta) - pairs :]  # row by row of the upper is column by column of the lower triangle
        return list(theta[: len(theta) - pairs]), latent + latent.T

    def matrix(self, gaps: Gaps, theta: Sequence[float]) -> np.ndarray:
        """Covariances between points."""
        p, latent = self.unpack(theta)
        h, u, ca, cb = gaps.h, gaps.u, gaps.ca, gaps.cb
        if self.dims == 2 and self.q == 1 and not self.several:
            t = p[1] * h
            shape = 1 + t + t * t / 3 if self.twonu == 5 else 1 + t if self.twonu == 3 else 1.0
            return p[0] * (np.exp(-t) * shape + (1e-6 / p[0] * (h == 0) if self.twonu == 3 else 0))
        v = latent[np.ix_(ca, cb)]
        grow = lambda x, a, b: np.exp(0.5 * b * np.log1p(a * x))
        if self.several:
            q = self.q
            shared, own, decay, rest = np.array(p[:q]), np.array(p[q : 2 * q]), np.array(p[2 * q : 3 * q]), p[3 * q :]
            g = grow(v, *rest[:2]) if q > 2 else np.sqrt(v + 1)
            k = shared[ca][:, None] * shared[cb][None, :] * np.exp(-rest[-1] * h / g) / (g * g)
            return k + (ca[:, None] == cb[None, :]) * own[ca][:, None] ** 2 * np.exp(-decay[ca][:, None] * h)
        if self.dims == 2:
            g = grow(v, *p[1:3]) if self.q > 2 else np.sqrt(v + 1)
            return p[0] / (g * g) * np.exp(-p[-1] * h / g)
        w = np.sqrt(v + 1) if self.q == 2 else grow(v, *p[1:3]) if self.q > 2 else np.ones_like(v)
        g = grow(u / w, *p[-3:-1])
        return p[0] / (g * g) * np.exp(-p[-1] * h / g) / w


class Block:
    """The points of some sites: ix, at (sites x dims), component (of each site, with several outcomes)."""

    def __init__(self, family: Family, ix: np.ndarray, at: np.ndarray, component: np.ndarray):
        self.ix, self.sites = ix, len(ix)
        n = family.per_site
        self.at = np.repeat(at.reshape(len(ix), family.dims), n, axis=0)
        self.component = component.astype(int) if family.several else np.tile(np.arange(n), len(ix))

    def __len__(self) -> int:
        return len(self.component)


def joined(blocks: Sequence[Block], family: Family) -> Block:
    out = Block(family, np.zeros(0, int), np.zeros((0, family.dims)), np.zeros(0, int))
    for k in ("ix", "at", "component"):
        setattr(out, k, np.concatenate([getattr(out, k), *(getattr(b, k) for b in blocks)]))
    out.sites = sum(b.sites for b in blocks)
    return out


def between(family: Family, a: Block, b: Block) -> Gaps:
    x, y = (a.at[:, None, k] - b.at[None, :, k] for k in (0, 1))
    h = np.sqrt(x * x + y * y)
    return Gaps(h, np.abs(a.at[:, None, 2] - b.at[None, :, 2]) if family.dims == 3 else None, a.component, b.component)


def covariance(family: Family, a: Block, b: Block, theta: Sequence[float]) -> np.ndarray:
    return family.matrix(between(family, a, b), theta)


def gaps_of(family: Family, own: Block, parents: Block) -> tuple[Gaps, Gaps, Gaps]:
    """Within own points, from them to the parents', and within these."""
    return between(family, own, own), between(family, own, parents), between(family, parents, parents)


def conditional(family: Family, gaps: tuple[Gaps, Gaps, Gaps], theta: Sequence[float]) -> tuple[np.ndarray, np.ndarray, float]:
    """H, the inverse of R's Cholesky factor, and the sum of its diagonal's logs: own points given the parents' are N(H w_parents, R)."""
    own, across, parents = gaps
    k = family.matrix(own, theta)
    if across.h.shape[1]:
        cross = family.matrix(across, theta)
        h = np.linalg.solve(family.matrix(parents, theta), cross.T).T
        k = k - h @ cross.T
    else:
        h = np.zeros(across.h.shape)
    half = np.linalg.inv(np.linalg.cholesky(k))
    return h, half, float(np.log(np.diag(half)).sum())


def blanket_terms(own: tuple, children: Sequence[tuple[tuple, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The precision of a block given all others, and what its parents' points, then each child's and its parents', add to the shift.

    own: the block's conditional(); children: that of each child, and which of its parents' points are the block's.
    """
    h, half, _ = own
    precision = half.T @ half
    maps = [precision @ h]
    for (h, half, _), mine in children:
        whole = half @ h
        a = whole[:, mine]
        precision = precision + a.T @ a
        maps.append(a.T @ np.hstack([half, np.where(mine, 0.0, -whole)]))
    return precision, maps


def observe(precision: np.ndarray, shift: np.ndarray, z: np.ndarray, e: np.ndarray, tausq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """precision and shift with the sites' observations: e (nan: none) of z times the site's points, with noise tausq. Blocks of one size may be stacked."""
    sites, q = z.shape[-2:]
    weight = np.where(np.isfinite(e), 1 / tausq, 0.0)
    place = np.arange(sites * q).reshape(sites, q)
    precision = precision.copy()
    precision[..., place[:, :, None], place[:, None, :]] += z[..., :, None] * z[..., None, :] * weight[..., None, None]
    return precision, shift + (z * (np.where(np.isfinite(e), e, 0.0) * weight)[..., None]).reshape(shift.shape)


def draw(precision: np.ndarray, shift: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """From N(precision^-1 shift, precision^-1), by standard normal noise (zeros: the mean)."""
    half = np.linalg.cholesky(precision)
    return np.linalg.solve(half.swapaxes(-1, -2), np.linalg.solve(half, shift[..., None]) + noise[..., None])[..., 0]


#: Fixed values of SplitMix64 (Steele, Lea and Flood, 2014): its step, and its finalizer's factors.
_STEP, _FACTORS = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FACTORS[0]
    x = (x ^ (x >> np.uint64(27))) * _FACTORS[1]
    return x ^ (x >> np.uint64(31))


def normals(seed: Sequence[int], block: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Noise of the points at some places of their blocks in one step (seed, iteration) of a chain: the same wherever, and however many together, it is drawn.

    Two uniform numbers by SplitMix64 of (seed, iteration, block, place), and Box and Muller's transform.
    """
    with np.errstate(over="ignore"):
        key = _hashed(np.array([(int(seed[0]) << 32) + int(seed[1])], np.uint64) + _STEP)
        key = _hashed(key + np.asarray(block).astype(np.uint64) * _STEP)
        count = key + (2 * np.asarray(place) + 1).astype(np.uint64) * _STEP
        u, v = ((_hashed(x) >> np.uint64(11)) * 2.0**-53 for x in (count, count + _STEP))
    return np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)
