"""The sparse precision of the mesh process, factored by nested dissection: the process integrated out, and its posterior, at any number of sites.

The blocks are cut in halves again and again. What lies in one half and touches the other is a separator; without it the halves have nothing to do
with one another. So the blocks form a tree of nodes, separators above the parts that they separate, and each node's front, a dense matrix
over its own points and those of its ancestors that it touches, can be eliminated once all fronts below it are: a grouped job for each depth
of the tree. What a front leaves to its ancestors are rows of a table, a few of its points each, added to the front of the deepest of them. No task holds
more than the lower triangle of one front, which is eliminated in place; the largest has about as many points as a few lines of blocks across the sites, so
memory grows with the number of sites, not its square, and what passes between tasks comes and goes in pieces of a few megabytes.

The determinant and the quadratic form need only this way up. The way down, from the root to the parts, solves for the posterior mean and finds
the entries of the inverse within each front (Takahashi's recursion), of which the diagonal is the posterior variance.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gaussian import PLANE, _Group, _observed, standard
from .kernels import Family, observe
from .sampler import Settings, iterate_collapsed
from .tables import cut, release, shuffles

#: Blocks of a part that is not cut further.
LEAF = 8
#: Points of a part of the tree that one task eliminates; in the plane its largest front has about 6 * sqrt(points * points of a block) points.
WITHIN = 8192
#: Points that are eliminated at once.
PANEL = 256
#: Numbers of a matrix in one row of a table, about.
NUMBERS = 1 << 20


def touching(edges: DataFrame) -> DataFrame:
    """block, member: blocks that the precision couples: children with parents, and parents of one child; edges of observed children."""
    up = edges.select(F.col("child").alias("block"), F.col("parent").alias("member"))
    both = edges.select("child", F.col("parent").alias("block")).join(edges.select("child", F.col("parent").alias("member")), "child")
    return up.union(edges.select(F.col("parent").alias("block"), F.col("child").alias("member"))).union(both.where("block <> member").select("block", "member")).distinct()


def dissected(places: DataFrame, near: DataFrame, leaf: int = LEAF) -> DataFrame:
    """block, node of each block of places (block, var1, var2: its place): the root is node 1, the halves of node h without it are 2 h and 2 h + 1.

    A part is halved at its median along its longer side (blocks at one place: by number). Its separator are the blocks of the first half that
    touch the second, whatever the graph, so that parts without a common ancestor never touch. All parts of a depth are cut in one round.
    """
    open_ = cut(places.select("block", "var1", "var2", F.lit(1).cast("long").alias("node")), "parts")
    near = cut(near, "touching")
    done = None
    while not open_.isEmpty():
        spread = lambda c: F.max(c) - F.min(c)
        wide = F.when((spread("var1") == 0) & (spread("var2") == 0), 0).when(spread("var1") >= spread("var2"), 1).otherwise(2)
        middle = [F.percentile_approx(c, 0.5).cast("double").alias(f"m{k}") for k, c in enumerate(("block", "var1", "var2"))]
        top = [F.max(c).cast("double").alias(f"t{k}") for k, c in enumerate(("block", "var1", "var2"))]
        cuts = open_.groupBy("node").agg(F.count("*").alias("n"), wide.alias("axis"), *middle, *top)
        of = lambda k: F.when(F.col("axis") == 0, F.col(k[0])).when(F.col("axis") == 1, F.col(k[1])).otherwise(F.col(k[2]))
        at, m, t = of(("block", "var1", "var2")).cast("double"), of(("m0", "m1", "m2")), of(("t0", "t1", "t2"))
        side = F.when(F.when(m < t, at <= m).otherwise(at < m), 0).otherwise(1)
        sided = cut(open_.join(cuts, "node").select("block", "var1", "var2", "node", (F.col("n") <= leaf).alias("last"), side.alias("side")), "sides")
        split = sided.where("not last")
        other = split.where("side = 1").select(F.col("block").alias("member"), F.col("node").alias("of"))
        first = split.where("side = 0").join(near, "block").join(other, "member").where("node = of").select("block").distinct().withColumn("between", F.lit(True))
        marked = cut(sided.join(first, "block", "left").withColumn("ends", F.col("last") | F.coalesce("between", F.lit(False))), "marked")
        found = marked.where("ends").select("block", "node")
        done = found if done is None else done.union(found)
        open_ = marked.where("not ends").select("block", "var1", "var2", (F.col("node") * 2 + F.col("side")).alias("node"))
    return done


def homes(nodes: DataFrame, within: int) -> DataFrame:
    """block, node, home, whole of nodes (block, node, points): home is the highest node above or at node whose part of the tree has at most so many
    points, all of which one task can hold (whole); where even node's own part has more, home is node itself, and not whole."""
    own = nodes.groupBy("node").agg(F.sum("points").alias("points"))
    above = F.expr("explode(transform(sequence(0, length(bin(node)) - 1), k -> shiftright(node, k)))").alias("above")
    lines = own.select("node", "points", above)
    small = lines.groupBy("above").agg(F.sum("points").alias("total")).where(F.col("total") <= within).select("above")
    found = lines.join(small, "above").groupBy("node").agg(F.min("above").alias("home"))
    return nodes.select("block", "node").join(found, "node", "left").select("block", "node", F.coalesce("home", "node").alias("home"), F.col("home").isNotNull().alias("whole"))


def _pack(matrix: np.ndarray) -> bytes:
    """The lower triangle of a symmetric matrix, row by row."""
    return np.concatenate([np.zeros(0), *(matrix[i, : i + 1] for i in range(len(matrix)))]).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    flat, out, at = np.frombuffer(data), np.empty((n, n)), 0
    for i in range(n):
        out[i, : i + 1] = out[: i + 1, i] = flat[at : at + i + 1]
        at += i + 1
    return out


def _places(blocks: Sequence[int], sizes: Sequence[int], of: Sequence[int], of_sizes: Sequence[int]) -> np.ndarray:
    """Where the points of blocks lie among those of other blocks, which hold them."""
    start = dict(zip(of, np.cumsum([0, *of_sizes]).tolist(), strict=False))
    return np.concatenate([np.zeros(0, np.int64), *(np.arange(start[b], start[b] + n) for b, n in zip(blocks, sizes, strict=True))])


class _Lower:
    """The lower triangle of a symmetric matrix of n points, by panels of rows, none of which lies across the first k. What panels hold above the diagonal is void."""

    def __init__(self, n: int, k: int = 0):
        self.starts = [*range(0, k, PANEL), *range(k, n, PANEL), n]
        self.panels = [np.zeros((b - a, b)) for a, b in pairwise(self.starts)]

    def _met(self, rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The panels that hold some rows (in order), and which of them."""
        i = 0
        while i < len(rows):
            p = bisect_right(self.starts, int(rows[i])) - 1
            j = i + int(np.searchsorted(rows[i:], self.starts[p + 1]))
            yield p, i, j
            i = j

    def add(self, rows: np.ndarray, first: int, at: np.ndarray) -> None:
        """Adds some rows, from first on, of the lower triangle of other points, which lie at at, in the same order."""
        for p, i, j in self._met(at[first : first + len(rows)]):
            self.panels[p][np.ix_(at[first + i : first + j] - self.starts[p], at[: first + j])] += rows[i:j, : first + j]

    def take(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The entries of some rows and columns (in order), as far as they lie in the triangle."""
        out = np.zeros((len(rows), len(columns)))
        for p, i, j in self._met(rows):
            n = int(np.searchsorted(columns, self.starts[p + 1]))
            out[i:j, :n] = self.panels[p][np.ix_(rows[i:j] - self.starts[p], columns[:n])]
        return out

    def times(self, other: np.ndarray) -> np.ndarray:
        """The symmetric matrix times another."""
        out = np.zeros(other.shape)
        for (a, b), panel in zip(pairwise(self.starts), self.panels, strict=True):
            square = np.tril(panel[:, a:])
            out[a:b] += panel[:, :a] @ other[:a] + (square + np.tril(square, -1).T) @ other[a:b]
            out[:a] += panel[:, :a].T @ other[a:b]
        return out

    def behind(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """The triangle of the points behind the first k: some rows and the first one's place among them."""
        for (a, b), panel in zip(pairwise(self.starts), self.panels, strict=True):
            if a >= k:
                for i, j in pairwise(_steps(b - a, b - k)):
                    yield a - k + i, panel[i:j, k : a + j]


def _steps(n: int, width: int) -> list[int]:
    """Where n rows of this width are cut."""
    return [*range(0, n, max(1, NUMBERS // max(width, 1))), n]


class _Piece(NamedTuple):
    """What some blocks (by node, the deepest first, then by number) add to the precision and to the shift; nodes: each block's."""

    blocks: list[int]
    nodes: list[int]
    sizes: list[int]
    matrix: np.ndarray
    shift: np.ndarray


class _Front:
    """The front of node h over some blocks (in the order of a piece's), its own first: once eliminated, its factors, what it leaves to its ancestors, and its term."""

    def __init__(self, h: int, blocks: Sequence[int], nodes: Sequence[int], sizes: Sequence[int]):
        m = sum(n == h for n in nodes)
        self.h, self.own, self.own_sizes = h, list(blocks[:m]), list(sizes[:m])
        self.blocks, self.nodes, self.sizes = list(blocks[m:]), list(nodes[m:]), list(sizes[m:])
        self.k = sum(self.own_sizes)
        self.lower, self.shift, self.term = _Lower(self.k + sum(self.sizes), self.k), np.zeros(self.k + sum(self.sizes)), 0.0

    def at(self, blocks: Sequence[int], sizes: Sequence[int]) -> np.ndarray:
        return _places(blocks, sizes, [*self.own, *self.blocks], [*self.own_sizes, *self.sizes])

    def add(self, blocks: Sequence[int], sizes: Sequence[int], rows: Iterable[tuple[int, np.ndarray]], shift: np.ndarray) -> None:
        at = self.at(blocks, sizes)
        for first, some in rows:
            self.lower.add(some, first, at)
        self.shift[at[: len(shift)]] += shift

    def eliminate(self) -> None:
        """In place: the first k columns become the factor's, shift its solution and what is left of it."""
        starts, panels, v = self.lower.starts, self.lower.panels, self.shift
        for q, (a, b) in enumerate(pairwise(starts)):
            if a >= self.k:
                break
            panels[q][:, a:b] = lower = np.linalg.cholesky(panels[q][:, a:b])
            half = np.linalg.inv(lower)
            v[a:b] = half @ v[a:b]
            across = np.concatenate([np.zeros((0, b - a)), *(p[:, a:b] @ half.T for p in panels[q + 1 :])])
            v[b:] -= across @ v[a:b]
            for (c, d), p in zip(pairwise(starts[q + 1 :]), panels[q + 1 :], strict=True):
                p[:, a:b] = across[c - b : d - b]
                p[:, b:] -= across[c - b : d - b] @ across[: d - b].T
            self.term += float(v[a:b] @ v[a:b] / 2 - np.log(np.diag(lower)).sum())

    def left(self) -> Iterator[tuple[int, np.ndarray]]:
        return self.lower.behind(self.k)

    def factor(self) -> Iterator[tuple[int, np.ndarray]]:
        """The rows of the first k columns, some at a time."""
        for (a, b), p in zip(pairwise(self.lower.starts), self.lower.panels, strict=True):
            for i, j in pairwise(_steps(b - a, self.k)):
                rows = np.zeros((j - i, self.k))
                rows[:, : min(b, self.k)] = p[i:j, : min(b, self.k)]
                yield a + i, rows


class _Inverse:
    """The entries of the inverse, and the mean, over a front's points, of k of its own: from its factor's columns (which are overwritten), its solution, and
    those over what it leaves."""

    def __init__(self, factor: np.ndarray, y: np.ndarray, known: _Lower, mean: np.ndarray):
        self.k = k = factor.shape[1]
        half, across = np.linalg.inv(factor[:k]), factor[k:]
        self.known, self.mean = known, np.concatenate([half.T @ (y - across.T @ mean), mean])
        for i, j in pairwise(_steps(len(across), k)):
            across[i:j] = across[i:j] @ half
        self.side = -known.times(across)
        self.own = half.T @ half
        self.own -= across.T @ self.side

    def part(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The lower triangle over some of the points, a few rows at a time."""
        m = int(np.searchsorted(at, self.k))
        for i, j in pairwise(_steps(len(at), len(at))):
            out, o = np.zeros((j - i, j)), min(max(m - i, 0), j - i)
            out[:o, : min(j, m)] = self.own[np.ix_(at[i : i + o], at[: min(j, m)])]
            rest = at[i + o : j] - self.k
            out[o:, : min(j, m)] = self.side[np.ix_(rest, at[: min(j, m)])]
            out[o:, m:] = self.known.take(rest, at[m:j] - self.k)
            yield i, out


def _below(node: int, home: int) -> bool:
    return node >> max(node.bit_length() - home.bit_length(), 0) == home


def _climb(home: int, pieces: Iterable[_Piece], keep: bool) -> tuple[dict[int, _Front], list[_Front], float]:
    """The fronts of a home's nodes, from the deepest up (if they are kept: their factors); those that leave something to nodes above; their terms."""
    waiting: dict[int, list] = {}
    for p in pieces:
        waiting.setdefault(max(p.nodes), []).append(p)  # all on one line of the tree, so the greatest number is the deepest
    fronts, left, terms = {}, [], 0.0
    while waiting:
        h = max(waiting)
        parts = waiting.pop(h)
        known = {b: (-n, b, s) for p in parts for b, n, s in zip(p.blocks, p.nodes, p.sizes, strict=True)}
        order = sorted(known.values())
        front = _Front(h, [b for _, b, _ in order], [-n for n, _, _ in order], [s for _, _, s in order])
        while parts:
            p = parts.pop()
            if isinstance(p, _Front):
                front.add(p.blocks, p.sizes, p.left(), p.shift[p.k :])
                if keep:
                    p.lower.panels = [q[:, : p.k].copy() for q in p.lower.panels]
            else:
                front.add(p.blocks, p.sizes, [(0, p.matrix)], p.shift)
        front.eliminate()
        terms += front.term
        if front.blocks and _below(up := max(front.nodes), home):
            waiting.setdefault(up, []).append(front)
        elif front.blocks:
            left.append(front)
        if keep:
            fronts[h] = front
    return fronts, left, terms


#: kind 0: rows of what was made is left to node, or sums; 1: rows of its factor, and its solution; 2: what its part asks of node; 3: rows of the inverse
_ROW = "at long, kind int, node long, made long, blocks array<int>, nodes array<long>, sizes array<int>, first int, matrix binary, shift binary, terms double, ok boolean"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _rows(at: int, kind: int, node: int, made: int, blocks: list[int], nodes: list[int], sizes: list[int], parts: Iterable[tuple[int, np.ndarray]], shift: np.ndarray) -> Iterator[tuple]:
    """A row for each part; the first has the shift."""
    for first, some in parts:
        yield at, kind, node, made, blocks, nodes, sizes, first, some.tobytes(), b"" if first else shift.tobytes(), 0.0, True


def _left(at: int, f: _Front) -> Iterator[tuple]:
    return _rows(at, 0, max(f.nodes), f.h, f.blocks, f.nodes, f.sizes, f.left(), f.shift[f.k :])


def _sums(at: int, terms: float, ok: bool) -> tuple:
    return at, 0, 0, 0, [], [], [], 0, b"", b"", terms, ok


def _frames(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    """Tables of rows, of about NUMBERS numbers each."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[8])
        if size >= 8 * NUMBERS:
            yield pd.DataFrame(held, columns=_NAMES)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=_NAMES)


def _numbers(r) -> np.ndarray:
    """The matrix of a row: as wide as its last row is long."""
    flat, first = np.frombuffer(r.matrix), int(r.first)
    return flat.reshape(-1, first + round(((first * first + 4 * len(flat)) ** 0.5 - first) / 2)) if len(flat) else np.zeros((0, first))


def _ints(x) -> list[int]:
    return [int(v) for v in x]


class Dissection:
    """Sites whose blocks are dissected once, for any number of values of the parameters.

    sites: as for gaussian.standard(); edges: those of mesh_of(). Only blocks with observations take part. places (block, var1, var2): where the
    blocks lie for the cuts, by default the middle of their sites. A task eliminates parts of the tree of up to within points in memory.
    """

    def __init__(self, sites: DataFrame, edges: DataFrame, family: Family = PLANE, x: Sequence[str] = (), leaf: int = LEAF, places: DataFrame | None = None, within: int = WITHIN):
        self.family, self.x = family, list(x)
        rows = standard(sites, family, x)
        seen = cut(_observed(rows), "observed")
        self.edges = cut(edges.join(seen.withColumnRenamed("block", "child"), "child", "left_semi"), "edges")
        rows = cut(rows.join(seen, "block", "left_semi"), "sites")
        middle = rows.groupBy("block").agg(F.avg(F.get("at", F.lit(0))).alias("var1"), F.avg(F.get("at", F.lit(1))).alias("var2"))
        places = middle if places is None else places.join(seen, "block", "left_semi")
        nodes = cut(dissected(places, touching(self.edges), leaf), "nodes")
        self.depth = int(nodes.agg(F.max("node")).head()[0] or 0).bit_length()
        points = rows.groupBy("block").agg((F.count("*") * family.per_site).alias("points"))
        nodes = cut(homes(nodes.join(points, "block"), within), "homes")
        top = nodes.agg(F.max(F.when(F.col("whole"), F.shiftright("home", 1)).otherwise(F.col("home")))).head()[0]
        #: depths of the tree above what single tasks eliminate
        self.levels = int(top or 0).bit_length()
        self.rows, self.nodes = cut(rows.join(nodes.select("block", "node"), "block"), "sites"), nodes
        # a block's term goes to the deepest node of the block and its parents
        own = nodes.select(F.col("block").alias("target"), "block")
        cliques = own.union(self.edges.select(F.col("child").alias("target"), F.col("parent").alias("block"))).distinct().join(nodes, "block")
        deepest = cliques.groupBy("target").agg(F.max(F.struct("node", "home", "whole")).alias("d")).select("target", "d.home", "d.whole")
        held = cliques.select("target", "block").join(deepest, "target").groupBy("home", "whole", "block").agg(F.max(F.col("target") == F.col("block")).alias("target"))
        of = self.edges.groupBy("child").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "parent"))), lambda r: r["parent"]).alias("parents"))
        #: the sites of each home: of its targets, and of their parents
        self.held = cut(held.join(self.rows, "block").join(of.withColumnRenamed("child", "block"), "block", "left"), "homes")
        self.tasks = max(shuffles(rows.sparkSession), nodes.select("home").distinct().count())
        # a node's front has the blocks, at it or above, of the terms that go to it or below it
        lowest = cliques.groupBy("target").agg(F.max("node").alias("low")).join(cliques.select("target", "block", "node"), "target").select("low", "block", "node").distinct()
        line = F.expr("explode(transform(sequence(0, length(bin(low)) - length(bin(node))), k -> shiftright(low, k)))").alias("at")
        each = lowest.select(line, "block", "node").where(F.col("at") < (1 << self.levels)).distinct().join(points, "block")
        listed = F.sort_array(F.collect_list(F.struct((-F.col("node")).alias("up"), "block", F.col("points").cast("int").alias("points"))))
        #: at, front: the blocks of the fronts above what single tasks eliminate
        self.fronts = cut(each.groupBy("at").agg(listed.alias("front")), "fronts")

    def _pieces(self, theta: Sequence[float], tausq: Sequence[float], beta: Sequence[Sequence[float]]):
        """A function that finds what each target among a home's rows adds to the precision, over its points and its parents', and to the shift, over
        its own; and their terms."""
        theta, taus, family = tuple(map(float, theta)), np.array(tausq, float), self.family
        fixed = np.array(beta, float) if len(beta) and len(beta[0]) else None

        def made(rows: pd.DataFrame) -> tuple[list[_Piece], float]:
            group, out, terms = _Group(rows, family), [], 0.0
            for target in (b for b, g in group.rows.items() if g["target"].iloc[0]):
                own, clique = group.rows[target], [target, *group.parents(target)]
                nodes, sizes = [int(group.rows[b]["node"].iloc[0]) for b in clique], [len(group.blocks[b]) for b in clique]
                outcome = own["component"].to_numpy() if family.several else np.zeros(len(own), int)
                e = own["y"].to_numpy(float)
                if fixed is not None:
                    e = e - (np.array(own["x"].tolist(), float) * fixed[outcome]).sum(axis=1)
                rest, noise = e[np.isfinite(e)], taus[outcome][np.isfinite(e)]
                h, half, logs = group.conditional(target, theta)
                a = half @ np.hstack([np.eye(len(h)), -h])
                whole, n = a.T @ a, len(h)
                whole[:n, :n], v = observe(whole[:n, :n], np.zeros(n), np.array(own["z"].tolist(), float).reshape(len(own), -1), e, taus[outcome])
                terms += logs + float(-0.5 * np.log(2 * np.pi * noise).sum() - 0.5 * (rest * rest / noise).sum())
                order = sorted(range(len(clique)), key=lambda i: (-nodes[i], clique[i]))
                ends = np.cumsum([0, *sizes])
                at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in order])
                v = np.concatenate([v, np.zeros(len(whole) - n)])
                out.append(_Piece([int(clique[i]) for i in order], [nodes[i] for i in order], [sizes[i] for i in order], whole[np.ix_(at, at)], v[at]))
            return out, terms

        return made

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """rows dealt by home: a home is few bytes, but much work."""
        return rows.repartition(self.tasks, "home")

    def _up(self, theta: Sequence[float], tausq: Sequence[float], beta: Sequence[Sequence[float]], keep: bool) -> tuple[list[DataFrame], float | None]:
        """Tables of what homes and the nodes above leave (with their factors, if they are kept), and the log density of the observed values.

        Rows pass up the tree one depth at a time, each once, until their deepest node (node) takes them in; so one plan holds all depths.
        """
        pieces = self._pieces(theta, tausq, beta)

        def start(rows: pd.DataFrame) -> pd.DataFrame:
            home, whole = int(rows["home"].iloc[0]), bool(rows["whole"].iloc[0])
            to = home >> 1 if whole else home
            try:
                found, terms = pieces(rows)
                if whole:
                    _, left, more = _climb(home, found, False)
                    out = [*(r for f in left for r in _left(to, f)), _sums(to, terms + more, True)]
                else:
                    out = [r for p in found for r in _rows(to, 0, max(p.nodes), home, p.blocks, p.nodes, p.sizes, [(0, p.matrix)], p.shift)] + [_sums(to, terms, True)]
            except np.linalg.LinAlgError:
                out = [_sums(to, 0.0, False)]
            return pd.DataFrame(out, columns=_NAMES)

        def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            front, terms, ok, h = None, 0.0, True, 0
            for rows in frames:
                for r in rows.itertuples(index=False):
                    h, terms, ok = int(r.at), terms + float(r.terms), ok and bool(r.ok)
                    if r.node == h and ok:
                        if front is None:
                            front = _Front(h, [int(b["block"]) for b in r.front], [-int(b["up"]) for b in r.front], [int(b["points"]) for b in r.front])
                        front.add(_ints(r.blocks), _ints(r.sizes), [(int(r.first), _numbers(r))], np.frombuffer(r.shift))
                    elif r.node > 0 and ok:
                        yield pd.DataFrame([(h >> 1, *r[1 : len(_NAMES)])], columns=_NAMES)
            if front is not None and ok:
                try:
                    front.eliminate()
                    terms += front.term
                    if front.blocks:
                        yield from _frames(_left(h >> 1, front))
                    if keep:
                        nodes = [h] * len(front.own) + front.nodes
                        yield from _frames(_rows(0, 1, h, h, front.own + front.blocks, nodes, front.own_sizes + front.sizes, front.factor(), front.shift[: front.k]))
                except np.linalg.LinAlgError:
                    ok = False
            yield pd.DataFrame([_sums(h >> 1, terms, ok)], columns=_NAMES)

        base = cut(self._dealt(self.held).groupBy("home").applyInPandas(start, _ROW), "pieces", large=True)
        told = base.where("at = 0") if not self.levels else None
        tables, above = [base], None
        for depth in range(self.levels, 0, -1):
            here = base.where((F.col("at") >= 1 << (depth - 1)) & (F.col("at") < 1 << depth))
            here = here if above is None else here.union(above)
            made = here.join(F.broadcast(self.fronts), "at", "left").groupBy("at").applyInPandas(step, _ROW)
            if keep:
                made = cut(made, "fronts", large=True)
                tables.append(made)
            above = made.where("kind = 0")
        if told is None:
            told = above.union(base.where("at = 0"))
        value = told.agg(F.sum("terms").alias("terms"), F.min("ok").alias("ok")).head()
        if not keep:
            release(base)
        return tables, value["terms"] if value["ok"] else None

    def collapsed(self, theta: Sequence[float], tausq: float | Sequence[float], beta: Sequence = ()) -> float | None:
        """The log density of the observed y with the process integrated out; None where a factorization fails."""
        if not self.depth:
            return 0.0
        return self._up(theta, self._taus(tausq), self._betas(beta), keep=False)[1]

    def _taus(self, tausq: float | Sequence[float]) -> list[float]:
        return [float(tausq)] * (self.family.q if self.family.several else 1) if isinstance(tausq, (int, float)) else list(tausq)

    def _betas(self, beta: Sequence) -> Sequence[Sequence[float]]:
        return beta if len(beta) and isinstance(beta[0], (list, tuple)) else [list(beta)] * (self.family.q if self.family.several else 1)

    def posterior(self, theta: Sequence[float], tausq: float | Sequence[float], beta: Sequence = ()) -> DataFrame:
        """ix, mean, var: arrays of the posterior mean and variance of the process at each site of the observed blocks, a number for each of its points."""
        kind = self.rows.schema["ix"].dataType.simpleString()
        empty = self.rows.sparkSession.createDataFrame([], f"ix {kind}, mean array<double>, var array<double>")
        if not self.depth:
            return empty
        taus, betas = self._taus(tausq), self._betas(beta)
        tables, value = self._up(theta, taus, betas, keep=True)
        if value is None:
            raise np.linalg.LinAlgError("the precision is not positive definite")
        base, levels, pieces = tables[0], tables[1:], self._pieces(theta, taus, betas)
        asked = base.where("kind = 0 and node > 0 and made <> node and first = 0")
        for k, f in enumerate(levels):
            depth = self.levels - k  # what only passes comes from below
            asked = asked.union(f.where("kind = 0 and node > 0 and first = 0").where((F.col("made") >= 1 << (depth - 1)) & (F.col("made") < 1 << depth)))
        none = F.lit(None).cast("binary")
        asked = cut(asked.withColumns({"kind": F.lit(2), "matrix": none, "shift": none}), "asked")

        def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows for those below, and one of node 0 with the means and variances of the front's own blocks."""
            own, factor, y, known, mean, asks = None, None, None, _Lower(0), np.zeros(0), []
            for rows in frames:
                for r in rows.itertuples(index=False):
                    if r.kind == 1:
                        if own is None:
                            blocks, sizes, own = _ints(r.blocks), _ints(r.sizes), [b for b, n in zip(r.blocks, r.nodes, strict=True) if n == r.made]
                            factor = np.zeros((sum(sizes), sum(sizes[: len(own)])))
                        some = np.frombuffer(r.matrix).reshape(-1, factor.shape[1])
                        factor[r.first : r.first + len(some)] = some
                        y = y if r.first else np.frombuffer(r.shift)
                    elif r.kind == 2:
                        asks.append((int(r.made), _ints(r.blocks), _ints(r.nodes), _ints(r.sizes)))
                    else:
                        n = sum(_ints(r.sizes))
                        known = known if known.panels else _Lower(n)
                        known.add(_numbers(r), int(r.first), np.arange(n))
                        mean = mean if r.first else np.frombuffer(r.shift)
            if own is None:
                return
            found = _Inverse(factor, y, known, mean)
            del factor
            for child, of, nodes, points in asks:
                at = _places(of, points, blocks, sizes)
                yield from _frames(_rows(0, 3, child, child, of, nodes, points, found.part(at), found.mean[at]))
            var, means = np.diag(found.own).tobytes(), found.mean[: found.k].tobytes()
            yield pd.DataFrame([(0, 3, 0, 0, own, [], sizes[: len(own)], 0, var, means, 0.0, True)], columns=_NAMES)

        found: list[DataFrame] = []
        for depth in range(1, self.levels + 1):
            at = lambda c: (F.col(c) >= 1 << (depth - 1)) & (F.col(c) < 1 << depth)  # noqa: E731, B023
            here = levels[self.levels - depth].where("kind = 1").union(asked.where(at("node")))
            for f in found:
                here = here.union(f.where(at("node")))
            found.append(cut(here.groupBy("node").applyInPandas(spread, _ROW), "inverse", large=True))

        def settle(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            """The means and variances of a home's blocks: its fronts once more, and down through them."""
            if not len(rows):
                return pd.DataFrame([], columns=["block", "mean", "var"])
            home, out = int(rows["home"].iloc[0]), []
            sent = {}
            for r in told.itertuples(index=False):
                n = sum(_ints(r.sizes))
                lower, mean = sent.get(int(r.node)) or (_Lower(n), None)
                lower.add(_numbers(r), int(r.first), np.arange(n))
                sent[int(r.node)] = lower, mean if r.first else np.frombuffer(r.shift)
            kept, _, _ = _climb(home, pieces(rows)[0], True)
            below: dict[int, list[int]] = {}
            for h, f in kept.items():
                below.setdefault(max(f.nodes, default=0), []).append(h)
            todo = [h for up, hs in below.items() if not _below(up, home) for h in hs]
            while todo:  # depth first, so few inverses are held at once
                h = todo.pop()
                f = kept.pop(h)
                inverse = _Inverse(np.concatenate([rows for _, rows in f.factor()]), f.shift[: f.k], *(sent.pop(h) if f.blocks else (_Lower(0), np.zeros(0))))
                at, var = 0, np.diag(inverse.own)
                for b, s in zip(f.own, f.own_sizes, strict=True):
                    out.append((b, inverse.mean[at : at + s].tolist(), var[at : at + s].tolist()))
                    at += s
                for child in below.get(h, ()):
                    to = f.at(kept[child].blocks, kept[child].sizes)
                    lower = _Lower(len(to))
                    for first, some in inverse.part(to):
                        lower.add(some, first, np.arange(len(to)))
                    sent[child] = lower, inverse.mean[to]
                    todo.append(child)
            return pd.DataFrame(out, columns=["block", "mean", "var"])

        def told(frames):
            for rows in frames:
                out = []
                for r in rows.itertuples():
                    mean, var, at = np.frombuffer(r.shift), np.frombuffer(r.matrix), 0
                    for b, s in zip(r.blocks, r.sizes, strict=True):
                        out.append((b, mean[at : at + s].tolist(), var[at : at + s].tolist()))
                        at += s
                yield pd.DataFrame(out, columns=["block", "mean", "var"])

        made = "block int, mean array<double>, var array<double>"
        whole = self.held.where("whole")
        # what a home's nodes asked for goes to the home
        home_of = self.rows.sparkSession.createDataFrame([], f"{_ROW}, home long") if not found else None
        for f in found:
            sent = f.where("node > 0").join(F.broadcast(self.nodes.where("whole").select("node", "home").distinct()), "node")
            home_of = sent if home_of is None else home_of.unionByName(sent)
        values = self._dealt(whole).groupBy("home").cogroup(self._dealt(home_of).groupBy("home")).applyInPandas(settle, made)
        for f in found:
            values = values.union(f.where("node = 0").mapInPandas(told, made))
        of = self.rows.groupBy("block").agg(F.array_sort(F.collect_list("ix")).alias("sites"))  # a block's sites, a bounded number
        q = self.family.per_site
        each = of.join(values, "block").select(F.posexplode("sites").alias("k", "ix"), "mean", "var")
        part = lambda c: F.slice(c, F.col("k") * q + 1, F.lit(q)).alias(c)
        return each.select("ix", part("mean"), part("var"))


def fit_collapsed(sites: DataFrame, edges: DataFrame, settings: Settings, leaf: int = LEAF) -> DataFrame:
    """draw, name, value: draws of the covariance and the noise, the process integrated out; one collapsed likelihood an iteration, at any number of sites."""
    engine, rows = Dissection(sites, edges, settings.family, leaf=leaf), []
    for k, state in iterate_collapsed(engine, settings):
        rows += [(k, name, float(v)) for name, v in [*zip(settings.family.names(), state.theta, strict=True), ("tausq", state.tausq[0])]]
    return sites.sparkSession.createDataFrame(rows, "draw int, name string, value double")
