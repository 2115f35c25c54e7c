"""Chains of Gibbs and Metropolis steps over the mesh, whatever holds the sites.

iterate() makes the draws of one chain from the steps of an engine: gaussian.SparkEngine, whose sites are a table and whose steps are jobs, or
MemoryEngine here, for a table of at most MOST_SITES sites, of which a task holds one chain. Both draw the same numbers from the same seed, so
a chain does not depend on where it runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd

from .kernels import Block, Family, Gaps, blanket_terms, conditional, draw, gaps_of, joined, normals, observe

#: Sites of a table that a task may hold whole.
MOST_SITES = 20_000
#: Coordinates that agree within this are the same for congruent blocks.
TOLERANCE = 1e-4
#: Distances that an engine keeps rather than find them again for each theta: 32 MB.
HELD = 4_000_000


@dataclass
class Ram:
    """Robust adaptive Metropolis (Vihola, 2012): the proposal's shape moves so that the share of accepted steps nears target."""

    half: np.ndarray
    target: float = 0.234
    power: float = 0.5
    after: int = 100
    tried: int = 0
    accepted: int = 0

    def step(self, z: np.ndarray) -> np.ndarray:
        return self.half @ z

    def learn(self, z: np.ndarray, chance: float, taken: bool, theta: np.ndarray) -> None:
        self.tried += 1
        self.accepted += taken
        if self.tried <= self.after:
            return
        rate = min(1.0, len(z) * (self.tried - self.after) ** -(self.power + 1e-6))
        turn = np.eye(len(z)) + rate * (min(1.0, chance) - self.target) * np.outer(z, z) / (z @ z)
        self.half = np.linalg.cholesky(self.half @ turn @ self.half.T)


@dataclass
class Haario:
    """Adaptive Metropolis (Haario and others, 2001): after a while the proposal is the draws' own covariance, scaled towards the target."""

    half: np.ndarray
    target: float = 0.234
    after: int = 500
    tried: int = 0
    accepted: int = 0
    scale: float = 1.0
    total: np.ndarray | None = None
    squares: np.ndarray | None = None

    def step(self, z: np.ndarray) -> np.ndarray:
        return self.half @ z

    def learn(self, z: np.ndarray, chance: float, taken: bool, theta: np.ndarray) -> None:
        self.tried += 1
        self.accepted += taken
        self.total = theta + (0 if self.total is None else self.total)
        self.squares = np.outer(theta, theta) + (0 if self.squares is None else self.squares)
        self.scale = float(np.clip(self.scale + self.tried**-0.01 * (self.accepted / self.tried - self.target), np.exp(-5), np.exp(2)))
        if self.tried > self.after:
            mean = self.total / self.tried
            self.half = np.linalg.cholesky(self.scale * (self.squares / self.tried - np.outer(mean, mean) + 1e-6 * np.eye(len(theta))))


@dataclass
class State:
    theta: list[float]
    tausq: list[float]
    beta: list[list[float]] = field(default_factory=list)  # of each outcome
    proposal: Ram | Haario | None = None
    iteration: int = 0


@dataclass(frozen=True)
class Settings:
    """bounds: of every parameter of theta. outcomes have their own noise and coefficients; one, unless the family has several."""

    family: Family = field(default_factory=Family)
    bounds: tuple[tuple[float, float], ...] = ((1e-3, 1e3), (0.1, 30.0))
    keep: int = 10
    burn: int = 0
    thin: int = 1
    seed: int = 1
    sigmasq: tuple[float, float] = (3.0, 3.0)
    tausq: tuple[float, float] = (2.01, 1.0)
    beta_precision: float = 0.01
    adapt: bool = True

    @property
    def outcomes(self) -> int:
        return self.family.q if self.family.several else 1

    def start(self, p: int) -> State:
        theta = [1.0 if n == "sigmasq" else (lo + hi) / 2 if hi < 2 else max(lo, min(1.0, hi)) for n, (lo, hi) in zip(self.family.names(), self.bounds, strict=True)]
        return State(theta, [0.1] * self.outcomes, [[0.0] * p for _ in range(self.outcomes)])


def _logit(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.log(x - lo) - np.log(hi - x)


def propose(state: State, settings: Settings, moved: np.ndarray, z: np.ndarray) -> tuple[list[float], float]:
    """A random walk on the logit scale between the bounds, of the moved parameters, and what it adds to the log acceptance."""
    lo, hi = np.array(settings.bounds).T[:, moved]
    old = np.array(state.theta)[moved]
    new = lo + (hi - lo) / (1 + np.exp(-(_logit(old, lo, hi) + state.proposal.step(z))))
    new = np.clip(new, lo + 1e-10, hi - 1e-10)
    jacobian = (np.log(new - lo) + np.log(hi - new) - np.log(old - lo) - np.log(hi - old)).sum()
    theta = np.array(state.theta)
    theta[moved] = new
    return theta.tolist(), float(jacobian)


def iterate(engine, settings: Settings, state: State | None = None, stop: int | None = None) -> Iterator[tuple[int, State]]:
    """draw, state of each draw that is kept: process, covariance, coefficients, variance, noise in turn. stop: iterations to run at most.

    The engine has sites, points, p, with sweep, predict, logliks, quad, beta_sums and rss; see MemoryEngine. Each iteration has its own
    random numbers, so a stored state goes on as if it had never stopped.
    """
    family = settings.family
    state = state or settings.start(engine.p)
    moved = np.array([k for k, n in enumerate(family.names()) if n != "sigmasq"])
    state.proposal = state.proposal or Ram(0.3 * np.eye(len(moved)))
    last = settings.burn + settings.thin * settings.keep
    while state.iteration < min(last, stop or last):
        it = state.iteration
        rng = np.random.default_rng([settings.seed, it])
        saved = it >= settings.burn and (it - settings.burn) % settings.thin == settings.thin - 1
        engine.sweep(state, (settings.seed, it))
        if saved:
            engine.predict(state, (settings.seed, it))
        z, u = rng.normal(size=len(moved)), rng.uniform()
        theta, jacobian = propose(state, settings, moved, z)
        now, then = engine.logliks(state, [state.theta, theta])
        chance = 0.0 if now is None or then is None else float(np.exp(min(0.0, then - now + jacobian)))
        taken = u < chance
        if taken:
            state.theta = theta
        if settings.adapt:
            state.proposal.learn(z, chance, taken, np.array(state.theta)[moved])
        else:
            state.proposal.tried += 1
            state.proposal.accepted += taken
        if engine.p:
            for k, (xx, xy) in enumerate(engine.beta_sums(state)):
                cov = np.linalg.inv(xx / state.tausq[k] + np.eye(engine.p) * settings.beta_precision)
                state.beta[k] = (cov @ xy / state.tausq[k] + np.linalg.cholesky(cov) @ rng.normal(size=engine.p)).tolist()
        if not family.several:
            quad = engine.quad(state)  # at unit variance: a new variance rescales all factors
            state.theta = [float(1 / rng.gamma(settings.sigmasq[0] + engine.points / 2, 1 / (settings.sigmasq[1] + quad / 2))), *state.theta[1:]]
        state.tausq = [float(1 / rng.gamma(settings.tausq[0] + n / 2, 1 / (settings.tausq[1] + rss / 2))) for n, rss in engine.rss(state)]
        state.iteration += 1
        if saved:
            yield (it - settings.burn) // settings.thin, state


def split_scale(theta: Sequence[float], family: Family) -> tuple[float, tuple[float, ...]]:
    """The variance, and the parameters at unit variance: a small term on the diagonal apart, all factors scale with it."""
    return (1.0, tuple(theta)) if family.several else (theta[0], (1.0, *theta[1:]))


class MemoryEngine:
    """All sites in memory. Congruent blocks (alike up to a shift, with all that they depend on) share one set of factors for each theta."""

    def __init__(self, sites: pd.DataFrame, edges: pd.DataFrame, colors: pd.DataFrame, family: Family):
        if len(sites) > MOST_SITES:
            raise ValueError(f"{len(sites)} sites: at most {MOST_SITES} in one task")
        sites = sites.sort_values(["block", "ix"], ignore_index=True)
        self.family, self.sites, self.ix = family, len(sites), sites["ix"].to_numpy()
        at = np.array(sites["at"].tolist(), float)
        component = sites["component"].to_numpy()
        self.x = np.array(sites["x"].tolist(), float).reshape(len(sites), -1)
        self.z = np.array(sites["z"].tolist(), float).reshape(len(sites), -1)
        self.y = sites["y"].to_numpy(float)
        self.p, self.n = self.x.shape[1], family.per_site
        self.outcome = component if family.several else np.zeros(len(sites), int)
        self.w = np.array(sites["w"].tolist(), float).ravel()
        place = {b: g.index.to_numpy() for b, g in sites.groupby("block")}
        self.rows = place
        self.blocks = {b: Block(family, self.ix[r], at[r], component[r]) for b, r in place.items()}
        self.span = {b: slice(r[0] * self.n, (r[-1] + 1) * self.n) for b, r in place.items()}
        self.parents = {b: [] for b in place} | {c: g.sort_values("slot")["parent"].tolist() for c, g in edges.groupby("child")}
        color = dict(zip(colors["block"], colors["color"], strict=True))
        seen = {b: np.isfinite(self.y[r]).any() for b, r in place.items()}
        self.observed = sorted((b for b in place if seen[b]), key=lambda b: (color[b], b))
        self.alone = sorted(b for b in place if not seen[b])
        self.children = {b: [] for b in place}
        for c in self.observed:
            for b in self.parents[c]:
                self.children[b].append(c)
        self.points = sum(len(self.blocks[b]) for b in self.observed)
        self.key, shapes = {}, {}
        for b in place:
            self.key[b] = shapes.setdefault(self._shape(b, [b, *self.parents[b]]), b)
        wide, self.wide = {}, {}
        for b in self.observed:
            around = [b, *self.parents[b], *(x for c in self.children[b] for x in (c, *self.parents[c]))]
            marks = tuple(x == b for x in around)
            self.wide[b] = wide.setdefault((self._shape(b, around), marks), b)
        at_points = lambda blocks: np.concatenate([np.arange(self.span[x].start, self.span[x].stop) for x in blocks]) if blocks else np.zeros(0, int)
        self.own = {b: at_points([b]) for b in place}
        self.near = {b: at_points([*self.parents[b], *(x for c in self.children[b] for x in (c, *self.parents[c]))]) for b in self.observed}
        # blocks of one colour and size are drawn together, blocks of one shape are summed together
        sizes, alike = {}, {}
        for b in self.observed:
            sizes.setdefault((color[b], len(place[b])), []).append(b)
            alike.setdefault(self.key[b], []).append(b)
        self.groups = [(g, np.stack([self.own[b] for b in g]), np.stack([place[b] for b in g])) for g in sizes.values()]
        self.alike = {k: (np.stack([self.own[b] for b in g]), np.stack([at_points(self.parents[b]) for b in g])) for k, g in alike.items()}
        # a point's block, and its place there
        self.of = np.concatenate([np.full(len(self.own[b]), b) for b in sorted(place)])
        self.place = np.concatenate([np.arange(len(self.own[b])) for b in sorted(place)])
        self.held: dict[int, tuple[Gaps, Gaps, Gaps]] = {}
        self.room = HELD
        self.factors: dict[tuple, dict] = {}
        self.sums: dict[tuple, float] = {}  # of the present w, by theta

    def _shape(self, b: int, around: Sequence[int]) -> tuple:
        """What blocks of equal factors have in common: places relative to the block's first, and components."""
        whole = [self.blocks[x] for x in around]
        apart = np.concatenate([x.at for x in whole]) - self.blocks[b].at[0]
        return tuple(map(len, whole)), np.round(apart / TOLERANCE).astype(np.int64).tobytes(), np.concatenate([x.component for x in whole]).tobytes()

    def hits(self) -> float:
        """The share of blocks that use another's factors, in percent."""
        return 100 - 100 * len(set(self.key.values())) / len(self.key)

    def _gaps(self, b: int) -> tuple[Gaps, Gaps, Gaps]:
        if b in self.held:
            return self.held[b]
        found = gaps_of(self.family, self.blocks[b], joined([self.blocks[x] for x in self.parents[b]], self.family))
        size = sum(g.h.size for g in found) * (1 if self.family.dims == 2 else 2)
        if size <= self.room:
            self.room -= size
            self.held[b] = found
        return found

    def _at(self, theta: Sequence[float]) -> dict:
        """Factors by representative, at unit variance; those of the last two values of theta are kept."""
        unit = split_scale(theta, self.family)[1]
        if unit not in self.factors:
            made = {}
            for b in self.key.values():
                if b not in made:
                    made[b] = conditional(self.family, self._gaps(b), unit)
            while len(self.factors) > 1:
                self.factors.pop(next(iter(self.factors)))
            self.factors[unit] = {"own": made, "wide": {}, "stacked": {}}
        return self.factors[unit]

    def _terms(self, b: int, found: dict) -> tuple:
        rep = self.wide[b]
        if rep not in found["wide"]:
            children = []
            for c in self.children[rep]:
                mine = np.concatenate([np.full(len(self.blocks[x]), x == rep) for x in self.parents[c]])
                children.append((found["own"][self.key[c]], mine))
            precision, maps = blanket_terms(found["own"][self.key[rep]], children)
            found["wide"][rep] = precision, np.hstack(maps)
        return found["wide"][rep]

    def _w(self, blocks: Sequence[int]) -> np.ndarray:
        return np.concatenate([self.w[self.span[x]] for x in blocks]) if blocks else np.zeros(0)

    def residual(self, state: State) -> np.ndarray:
        return self.y - (self.x * np.array(state.beta)[self.outcome]).sum(axis=1) if self.p else self.y

    def sweep(self, state: State, seed: Sequence[int], noise: bool = True) -> None:
        """A draw of the process at all observed blocks, colour by colour."""
        self.sums.clear()
        scale, found = split_scale(state.theta, self.family)[0], self._at(state.theta)
        e, tausq = self.residual(state), np.array(state.tausq)[self.outcome]
        z = self._noise(seed, noise)
        for k, (blocks, own, rows) in enumerate(self.groups):
            if k not in found["stacked"]:
                terms = [self._terms(b, found) for b in blocks]
                found["stacked"][k] = np.stack([p for p, _ in terms]), [m for _, m in terms]
            precision, maps = found["stacked"][k]
            shift = np.stack([m @ self.w[self.near[b]] for b, m in zip(blocks, maps, strict=True)]) / scale
            precision, shift = observe(precision / scale, shift, self.z[rows], e[rows], tausq[rows])
            self.w[own] = draw(precision, shift, z[own])

    def _noise(self, seed: Sequence[int], noise: bool) -> np.ndarray:
        """A number for each point, zeros without noise."""
        return normals(seed, self.of, self.place) if noise else np.zeros(len(self.w))

    def predict(self, state: State, seed: Sequence[int], noise: bool = True) -> None:
        """A draw at blocks without observations, given their parents."""
        scale, found = split_scale(state.theta, self.family)[0], self._at(state.theta)
        z = self._noise(seed, noise) if self.alone else None
        for b in self.alone:
            h, half, _ = found["own"][self.key[b]]
            self.w[self.span[b]] = h @ self._w(self.parents[b]) + np.sqrt(scale) * np.linalg.solve(half, z[self.own[b]])

    def _quads(self, theta: Sequence[float]) -> float:
        found, unit, total = self._at(theta), split_scale(theta, self.family)[1], 0.0
        if unit in self.sums:
            return self.sums[unit]
        for key, (own, parents) in self.alike.items():
            h, half, _ = found["own"][key]
            e = (self.w[own] - self.w[parents] @ h.T) @ half.T
            total += float((e * e).sum())
        self.sums[unit] = total
        return total

    def logliks(self, state: State, thetas: Sequence[Sequence[float]]) -> list[float | None]:
        """The log density of the process for each theta; None where a factorization fails."""
        out = []
        for theta in thetas:
            scale = split_scale(theta, self.family)[0]
            try:
                found = self._at(theta)
            except np.linalg.LinAlgError:
                out.append(None)
                continue
            logs = sum(found["own"][self.key[b]][2] for b in self.observed)
            out.append(float(logs - self.points / 2 * np.log(2 * np.pi * scale) - self._quads(theta) / (2 * scale)))
        return out

    def quad(self, state: State) -> float:
        return self._quads(state.theta)

    def fitted(self) -> np.ndarray:
        return (self.z * self.w.reshape(self.sites, self.n)).sum(axis=1)

    def beta_sums(self, state: State) -> list[tuple[np.ndarray, np.ndarray]]:
        """X'X and X'(y - z w) of each outcome."""
        rest, seen = self.y - self.fitted(), np.isfinite(self.y)
        each = [seen & (self.outcome == k) for k in range(len(state.tausq))]
        return [(self.x[m].T @ self.x[m], self.x[m].T @ rest[m]) for m in each]

    def rss(self, state: State) -> list[tuple[int, float]]:
        e = self.residual(state) - self.fitted()
        each = [np.isfinite(e) & (self.outcome == k) for k in range(len(state.tausq))]
        return [(int(m.sum()), float(e[m] @ e[m])) for m in each]

    def collapsed(self, theta: Sequence[float], tausq: float, beta: Sequence[float] = ()) -> float | None:
        """The log density of the observed y with the process integrated out, from the mesh's precision."""
        scale, unit = split_scale(theta, self.family)
        try:
            found = self._at(theta)
            q = np.zeros((len(self.w), len(self.w)))
            for b in self.observed:
                h, half, _ = found["own"][self.key[b]]
                at = np.concatenate([np.arange(self.span[x].start, self.span[x].stop) for x in [b, *self.parents[b]]])
                a = half @ np.hstack([np.eye(len(h)), -h])
                q[np.ix_(at, at)] += a.T @ a / scale
            used = np.concatenate([np.arange(self.span[b].start, self.span[b].stop) for b in self.observed])
            q = q[np.ix_(used, used)]
            rows = np.concatenate([self.rows[b] for b in self.observed])
            e = (self.y - (self.x @ np.array(beta) if len(beta) else 0))[rows]
            seen = int(np.isfinite(e).sum())
            more, shift = observe(q, np.zeros(len(q)), self.z[rows], e, np.full(len(rows), tausq))
            lower = np.linalg.cholesky(more)
            half = np.linalg.solve(lower, shift)
            rest = np.where(np.isfinite(e), e, 0.0)
            return float(np.log(np.diag(np.linalg.cholesky(q))).sum() - np.log(np.diag(lower)).sum() - seen / 2 * np.log(2 * np.pi * tausq) - rest @ rest / (2 * tausq) + half @ half / 2)
        except np.linalg.LinAlgError:
            return None


def iterate_collapsed(engine, settings: Settings, state: State | None = None) -> Iterator[tuple[int, State]]:
    """Draws of the covariance and the noise alone, with the process integrated out; bounds end with those of the noise.

    engine: what has collapsed(theta, tausq), MemoryEngine or fronts.Dissection.
    """
    state = state or settings.start(0)
    tuned = replace(settings, bounds=(*settings.bounds[: len(state.theta)], (1e-4, 10.0)))
    joint = State([*state.theta, state.tausq[0]], state.tausq, proposal=state.proposal or Ram(0.3 * np.eye(len(state.theta) + 1)))
    every, now = np.arange(len(joint.theta)), None
    for it in range(settings.burn + settings.thin * settings.keep):
        rng = np.random.default_rng([settings.seed, it])
        z, u = rng.normal(size=len(every)), rng.uniform()
        theta, jacobian = propose(joint, tuned, every, z)
        now = engine.collapsed(joint.theta[:-1], joint.theta[-1]) if now is None else now
        then = engine.collapsed(theta[:-1], theta[-1])
        prior = lambda t: -(settings.sigmasq[0] + 1) * np.log(t[0]) - settings.sigmasq[1] / t[0] - (settings.tausq[0] + 1) * np.log(t[-1]) - settings.tausq[1] / t[-1]
        chance = 0.0 if now is None or then is None else float(np.exp(min(0.0, then - now + jacobian + prior(theta) - prior(joint.theta))))
        if u < chance:
            joint.theta, now = theta, then
        joint.proposal.learn(z, chance, u < chance, np.array(joint.theta))
        if it >= settings.burn and (it - settings.burn) % settings.thin == settings.thin - 1:
            yield (it - settings.burn) // settings.thin, State(joint.theta[:-1], [joint.theta[-1]], proposal=joint.proposal, iteration=it + 1)
