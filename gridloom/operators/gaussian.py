"""Gaussian processes on the mesh: block likelihoods, Gibbs and Metropolis steps, kriging, as Spark jobs over blocks.

sites: ix, var1, var2 (and var3), block, and y (null: to be predicted), w (a number, or an array of one for each process), z (array, one for
each process; without it ones), comp (the outcome, from 0, with several). A block's process given its parents is Gaussian, so the likelihood
is a sum over blocks, and blocks of one colour can be drawn at once. A block's task gets its own rows and those of the blocks it depends on,
never more; the sums over blocks or rows are aggregates, and only p x p matrices and counts reach the driver. A factorization that fails is
data (ok is false), not an error.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from . import mesh, sampler
from .neighbors import nearest_site
from .kernels import Block, Family, blanket_terms, conditional, covariance, draw, gaps_of, joined, normals, observe
from .sampler import Settings, State
from .tables import cut, release, scratch, shuffles
from .tessellation import block_counts, is_observed

PLANE = Family()
#: New sites of a block that are predicted at once.
SLICE = 1024
#: Blocks that an engine's task takes together, at most about.
PART = 128
#: Rows of a task that predicts many small blocks, about.
DEALT = 4096


def standard(sites: DataFrame, family: Family = PLANE, x: Sequence[str] = ()) -> DataFrame:
    """ix, block, at, component, x, z, y, w of sites, in arrays."""
    names, one = sites.columns, F.lit(1.0)
    listed = lambda c: F.col(c).cast("array<double>") if isinstance(sites.schema[c].dataType, ArrayType) else F.array(F.col(c).cast("double"))
    n = family.per_site
    return sites.select(
        "ix",
        "block",
        F.array(*[F.col(f"var{k}").cast("double") for k in range(1, family.dims + 1)]).alias("at"),
        (F.col("comp") if family.several else F.lit(0)).cast("int").alias("component"),
        (F.array(*[F.col(c).cast("double") for c in x]) if x else F.array().cast("array<double>")).alias("x"),
        (listed("z") if "z" in names else F.array(*[one] * n)).alias("z"),
        (F.when(is_observed(F.col("y")), F.col("y").cast("double")) if "y" in names else F.lit(None).cast("double")).alias("y"),
        (listed("w") if "w" in names else F.array(*[F.lit(0.0)] * n)).alias("w"),
    )


def _observed(sites: DataFrame) -> DataFrame:
    """The blocks with observations."""
    return sites.where("y is not null").select("block").distinct()


def with_relatives(sites: DataFrame, edges: DataFrame, targets: DataFrame | None = None, children: bool = False) -> DataFrame:
    """target, then the sites' rows, of each target block (default: all), its parents, and with children its children and their other parents;
    and parents (array) of the row's block."""
    of = edges.groupBy("child").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "parent"))), lambda x: x["parent"]).alias("parents"))
    own = sites.select("block").distinct() if targets is None else targets.select("block")
    pairs = own.select(F.col("block").alias("target"), "block").union(edges.select(F.col("child").alias("target"), F.col("parent").alias("block")))
    if children:
        down = edges.select(F.col("parent").alias("target"), F.col("child").alias("block"))
        beside = edges.select(F.col("parent").alias("target"), "child").join(edges.select("child", F.col("parent").alias("block")), "child").select("target", "block")
        pairs = pairs.union(down).union(beside)
    rows = sites.join(of.withColumnRenamed("child", "block"), "block", "left")
    wanted = pairs.distinct().join(own.select(F.col("block").alias("target")), "target", "left_semi")
    return wanted.join(rows, "block")


class _Group:
    """The blocks among a group's rows."""

    def __init__(self, rows: pd.DataFrame, family: Family):
        self.family, self.rows = family, {b: g for b, g in rows.sort_values(["block", "ix"]).groupby("block")}
        self.blocks = {b: Block(family, g["ix"].to_numpy(), np.array(g["at"].tolist(), float), g["component"].to_numpy()) for b, g in self.rows.items()}

    def parents(self, b: int) -> list[int]:
        listed = self.rows[b]["parents"].iloc[0]
        return [p for p in (listed if listed is not None else ()) if p in self.blocks]

    def conditional(self, b: int, theta: Sequence[float]) -> tuple:
        return conditional(self.family, gaps_of(self.family, self.blocks[b], joined([self.blocks[p] for p in self.parents(b)], self.family)), theta)

    def w(self, blocks: Sequence[int], name: str = "w") -> np.ndarray:
        return np.concatenate([np.array(self.rows[b][name].tolist(), float).ravel() for b in blocks]) if blocks else np.zeros(0)


def block_logliks(sites: DataFrame, edges: DataFrame, thetas: Sequence[Sequence[float]], family: Family = PLANE, targets: DataFrame | None = None) -> DataFrame:
    """theta, block, n, logdet, quad, ok: parts of each block's log density of w for each theta."""
    thetas = [tuple(map(float, t)) for t in thetas]

    def parts(rows: pd.DataFrame) -> pd.DataFrame:
        target, group, out = int(rows["target"].iloc[0]), _Group(rows, family), []
        for k, theta in enumerate(thetas):
            try:
                h, half, logs = group.conditional(target, theta)
                e = half @ (group.w([target]) - h @ group.w(group.parents(target)))
                out.append((k, target, len(e), logs, float(e @ e), True))
            except np.linalg.LinAlgError:
                out.append((k, target, len(group.blocks[target]), 0.0, 0.0, False))
        return pd.DataFrame(out, columns=["theta", "block", "n", "logdet", "quad", "ok"])

    needed = with_relatives(standard(sites, family) if "at" not in sites.columns else sites, edges, targets)
    return needed.groupBy("target").applyInPandas(parts, "theta int, block int, n int, logdet double, quad double, ok boolean")


def loglik(parts: DataFrame) -> DataFrame:
    """theta, loglik (null where a block's factorization failed)."""
    each = F.col("logdet") - 0.5 * F.col("quad") - 0.5 * np.log(2 * np.pi) * F.col("n")
    return parts.groupBy("theta").agg(F.when(F.min("ok"), F.sum(each)).alias("loglik"))


def draw_blocks(sites: DataFrame, edges: DataFrame, blocks: DataFrame, theta: Sequence[float], tausq: float | Sequence[float], seed: Sequence[int], noise: bool = True, family: Family = PLANE) -> DataFrame:
    """ix, w: a draw (or without noise the mean) of the process of the given blocks, given all others and e, the rest y - x beta (null: unseen).

    sites: those of standard() with e; edges whose children have observations.
    """
    seed, theta = tuple(map(int, seed)), tuple(map(float, theta))
    taus = np.array([tausq] if isinstance(tausq, (int, float)) else list(tausq), float)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        target, group = int(rows["target"].iloc[0]), _Group(rows, family)
        children = []
        for c in group.blocks:
            if c != target and target in group.parents(c):
                mine = np.concatenate([np.full(len(group.blocks[p]), p == target) for p in group.parents(c)])
                children.append((c, group.conditional(c, theta), mine))
        precision, maps = blanket_terms(group.conditional(target, theta), [x[1:] for x in children])
        shift = maps[0] @ group.w(group.parents(target))
        for m, (c, _, _) in zip(maps[1:], children, strict=True):
            shift = shift + m @ group.w([c, *group.parents(c)])
        own = group.rows[target]
        at = taus[own["component"].to_numpy()] if family.several else np.full(len(own), taus[0])
        precision, shift = observe(precision, shift, np.array(own["z"].tolist(), float).reshape(len(own), -1), own["e"].to_numpy(float), at)
        w = draw(precision, shift, normals(seed, target, np.arange(len(shift))) if noise else np.zeros(len(shift)))
        return pd.DataFrame({"ix": own["ix"], "w": list(w.reshape(len(own), -1))})

    needed = with_relatives(sites.drop("x", "y"), edges, blocks, children=True)
    return needed.groupBy("target").applyInPandas(one, f"ix {sites.schema['ix'].dataType.simpleString()}, w array<double>")


def draw_alone(sites: DataFrame, edges: DataFrame, blocks: DataFrame, theta: Sequence[float], seed: Sequence[int], noise: bool = True, family: Family = PLANE) -> DataFrame:
    """ix, w: a draw (or the mean) of the process of blocks without observations, given their parents'."""
    seed, theta = tuple(map(int, seed)), tuple(map(float, theta))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        target, group = int(rows["target"].iloc[0]), _Group(rows, family)
        h, half, _ = group.conditional(target, theta)
        z = normals(seed, target, np.arange(len(h))) if noise else np.zeros(len(h))
        w = h @ group.w(group.parents(target)) + np.linalg.solve(half, z)
        return pd.DataFrame({"ix": group.rows[target]["ix"], "w": list(w.reshape(group.blocks[target].sites, -1))})

    needed = with_relatives(sites.drop("x", "y", "z"), edges, blocks)
    return needed.groupBy("target").applyInPandas(one, f"ix {sites.schema['ix'].dataType.simpleString()}, w array<double>")


def _with_w(sites: DataFrame, new: DataFrame) -> DataFrame:
    """sites with the new w where there is one, cut from its lineage."""
    return cut(sites.withColumnRenamed("w", "_w").join(new, "ix", "left").withColumn("w", F.coalesce("w", "_w")).drop("_w"), "sites")


def sweep(sites: DataFrame, edges: DataFrame, colors: DataFrame, theta: Sequence[float], tausq: float | Sequence[float], seed: Sequence[int], noise: bool = True, family: Family = PLANE) -> DataFrame:
    """sites with w drawn anew (see draw_blocks), colour by colour, each given what the earlier ones drew; cut from its lineage after each."""
    before = None
    for color in [r["color"] for r in colors.select("color").distinct().orderBy("color").toLocalIterator()]:
        sites = _with_w(sites, draw_blocks(sites, edges, colors.where(F.col("color") == color), theta, tausq, seed, noise, family))
        if before is not None:
            release(before)
        before = sites
    return sites


def gibbs_means(sites: DataFrame, edges: DataFrame, colors: DataFrame, theta: Sequence[float], tausq: float, family: Family = PLANE) -> DataFrame:
    """ix, w: one sweep of conditional means over all blocks with observations; the others keep their w."""
    engine, state = SparkEngine(sites, edges, colors, family), State(list(theta), [tausq])
    engine.sweep(state, (0, 0), noise=False)
    return engine.values(state).select("ix", "w")


def beta_posterior(df: DataFrame, x: Sequence[str], rest: str, tausq: float, precision: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the coefficients of x given rest = y - w, from one aggregate over rows where rest is not null."""
    p = len(x)
    d = lambda c: F.col(c).cast("double")
    seen = df.where(F.col(rest).isNotNull())
    sums = seen.agg(*[F.sum(d(a) * d(b)).alias(f"m{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)], *[F.sum(d(a) * d(rest)).alias(f"v{i}") for i, a in enumerate(x)]).head()
    xx = np.array([[sums[f"m{i}_{j}"] or 0.0 for j in range(p)] for i in range(p)])
    xy = np.array([sums[f"v{i}"] or 0.0 for i in range(p)])
    cov = np.linalg.inv(xx / tausq + np.eye(p) * precision)
    return cov @ (xy / tausq), cov


def _dot(a: str, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _packed(family: Family, rows: DataFrame, latent: bool = False) -> DataFrame:
    """color, block, shape, held, points, data: what a block's task needs beside the process, as one binary value; shape: equal for congruent blocks, whose factors take held bytes."""

    def pack(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                at, comp = np.array(r.at, float).reshape(len(r.ix), -1), np.array(r.comp, int)
                near, lo, hi, up = {}, 0, 0, 0
                for b, c, n, m in zip(r.near_block, r.near_color, r.near_n, r.near_m, strict=True):
                    places = np.array(r.near_at[lo * at.shape[1] : (lo + n) * at.shape[1]], float).reshape(n, -1)
                    near[int(b)] = (int(c), [int(x) for x in r.near_parents[up : up + m]], places, np.array(r.near_comp[lo : lo + n], int))
                    lo, up = lo + n, up + m
                parents = [int(x) for x in r.parents]
                known = {**{b: v[2:] for b, v in near.items()}, int(r.block): (at, comp)}
                key = _shape(int(r.block), parents, known)
                keys = {b: _shape(b, v[1], known) for b, v in near.items() if int(r.block) in v[1]}
                n, m = len(at) * family.per_site, sum(len(known[p][0]) for p in parents) * family.per_site
                rows = len(r.y) if latent else len(at)
                held = {"data": (np.array(r.data_at, float).reshape(rows, at.shape[1]), np.array(r.data_comp, int)) if latent else None, "ix": list(r.data_ix if latent else r.ix), "at": at, "comp": comp, "x": np.array(r.x, float).reshape(rows, -1 if rows else 0), "z": np.array(r.z, float).reshape(rows, family.per_site), "y": np.array(r.y, float)}
                held |= {"color": int(r.color), "out": [(int(b), int(c)) for b, c in zip(r.out_block, r.out_color, strict=True)], "parents": parents, "near": near, "shape": key, "shapes": keys}
                out.append((int(r.color), int(r.block), key, 8 * n * (n + m), n, pickle.dumps(held)))
            yield pd.DataFrame(out, columns=["color", "block", "shape", "held", "points", "data"])

    return rows.mapInPandas(pack, "color int, block int, shape binary, held long, points long, data binary")


def _shape(block: int, parents: Sequence[int], known: dict) -> bytes:
    """What blocks of equal factors have in common: places relative to the block's first, sizes and components."""
    whole = [known[b] for b in [block, *parents]]
    apart = np.round((np.concatenate([at for at, _ in whole]) - whole[0][0][0]) / sampler.TOLERANCE).astype(np.int64)
    sizes, comp = np.array([len(at) for at, _ in whole], np.int64), np.concatenate([c for _, c in whole]).astype(np.int64)
    return hashlib.sha256(b"".join([sizes.tobytes(), apart.tobytes(), comp.tobytes()])).digest()


class SparkEngine:
    """The sites as a table of blocks; each step of a chain is a job over blocks. See sampler.MemoryEngine for what the steps do.

    What never changes (coordinates of a block and of all that it depends on, observations) is one row a block in a table that is bucketed and
    sorted by parts of about PART blocks, so no step shuffles it, and a step sends tasks a part at a time. The state is a table of messages: each block's values, a row for each block that depends on them.
    A sweep goes through the colours in one job: a colour's tasks read the messages to them, draw, and send new messages to those of the later
    colours; only messages are shuffled, and the state is written once, at the end. One more job finds all sums of an iteration.

    Where congruent blocks are many, the factors of each shape are made once for each theta, at unit variance (a new variance only rescales them),
    and broadcast if they take at most FACTORS bytes; otherwise a block's task makes its own.
    """

    #: Bytes of factors that are broadcast.
    FACTORS = 64 << 20

    def __init__(self, sites: DataFrame, edges: DataFrame, colors: DataFrame, family: Family, x: Sequence[str] = (), data: DataFrame | None = None):
        """data: rows with y, x and coordinates of their own, and the block of the sites that they follow from: the process lives on the sites, and a
        row of data has its conditional distribution given those of its block (see latent_mesh). Without data, the sites have y themselves."""
        self.family, self.p, self.spark, self.latent = family, len(x), sites.sparkSession, data is not None
        rows = standard(sites, family, () if self.latent else x)
        told = standard(data, family, x) if self.latent else rows
        self.kind = told.schema["ix"].dataType.simpleString()
        of = lambda c: F.transform("s", lambda r: r[c])
        listed = F.array_sort(F.collect_list(F.struct("ix", "at", "component", "x", "z", F.coalesce("y", F.lit(float("nan"))).alias("y"), "w")))  # the sites of a block
        whole = rows.groupBy("block").agg(listed.alias("s"), F.count("y").alias("n_obs")).select("block", "n_obs", of("ix").alias("ix"), *[F.flatten(of(c)).alias(c) for c in ("at", "x", "z", "w")], of("component").alias("comp"), of("y").alias("y"))
        self.own = ["x", "z", "y"]
        if self.latent:
            parts = told.groupBy("block").agg(listed.alias("s"), F.count("y").alias("n_obs")).select("block", "n_obs", of("ix").alias("data_ix"), F.flatten(of("at")).alias("data_at"), of("component").alias("data_comp"), F.flatten(of("x")).alias("x"), F.flatten(of("z")).alias("z"), of("y").alias("y"))
            self.own += ["data_ix", "data_at", "data_comp"]
            whole = whole.drop("n_obs", "x", "z", "y").join(parts, "block", "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
            whole = whole.withColumns({c: F.coalesce(c, F.array().cast(parts.schema[c].dataType)) for c in self.own})
        seen = whole.where("n_obs > 0").select("block")
        real = edges.join(seen.withColumnRenamed("block", "child"), "child", "left_semi").select("child", "parent", "slot")
        up = edges.groupBy("child").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "parent"))), lambda r: r["parent"]).alias("parents"))
        none = F.array().cast("array<int>")
        blocks = whole.join(up.withColumnRenamed("child", "block"), "block", "left").withColumn("parents", F.coalesce("parents", none))
        own = colors.join(seen, "block", "left_semi").select(F.col("block").alias("of"), "color")
        blocks = cut(blocks.join(own, F.col("block") == F.col("of"), "left").withColumn("color", F.coalesce("color", F.lit(-1))).drop("of"), "blocks")
        pairs = edges.select(F.col("child").alias("target"), F.col("parent").alias("member")).union(real.select("parent", "child"))
        beside = real.select(F.col("parent").alias("target"), "child").join(real.select("child", F.col("parent").alias("member")), "child").select("target", "member")
        pairs = cut(pairs.union(beside).where("target <> member").distinct(), "pairs")
        part = F.struct(F.col("block").alias("member"), "color", "at", "comp", "parents")
        near = pairs.join(blocks.select(F.col("block").alias("member"), part.alias("m")), "member").groupBy("target").agg(F.array_sort(F.collect_list("m")).alias("m"))
        out = pairs.join(blocks.select(F.col("block").alias("target"), "color"), "target").groupBy("member").agg(F.array_sort(F.collect_list(F.struct(F.col("target").alias("block"), "color"))).alias("out"))
        each = lambda f: F.coalesce(F.transform("m", f), none)
        flat = lambda c: F.coalesce(F.flatten(F.transform("m", lambda r: r[c])), F.array())
        sent = lambda c: F.coalesce(F.transform("out", lambda r: r[c]), none).alias(f"out_{c}")
        told = blocks.join(near, F.col("block") == F.col("target"), "left").join(out, F.col("block") == out["member"], "left").select(
            "block", "color", "ix", "at", "comp", *self.own, "parents", each(lambda r: r["member"]).alias("near_block"), each(lambda r: r["color"]).alias("near_color"), each(lambda r: F.size(r["comp"])).alias("near_n"),
            each(lambda r: F.size(r["parents"])).alias("near_m"), flat("at").alias("near_at"), flat("comp").alias("near_comp"), flat("parents").alias("near_parents"), sent("block"), sent("color"),
        )
        self.name = f"gridloom_{uuid.uuid4().hex}"
        buckets = shuffles(self.spark)
        self.parts = max(4 * buckets, blocks.count() // PART)
        _packed(family, told, self.latent).withColumn("part", self._part("block")).repartition(buckets, "part").write.partitionBy("color").bucketBy(buckets, "part").sortBy("part").option("path", scratch(self.spark, "static")).format("parquet").saveAsTable(self.name)
        self.static = self.spark.table(self.name)
        by_color = {r["color"]: r for r in self.static.groupBy("color").agg(F.count("*").alias("n"), F.sum("points").alias("points")).collect()}
        self.colors, self.any_alone = sorted(c for c in by_color if c >= 0), -1 in by_color
        self.blocks, self.points = sum(r["n"] for r in by_color.values()), sum(by_color[c]["points"] for c in self.colors)
        shapes = self.static.groupBy("shape").agg(F.first("held").alias("held")).agg(F.count("*").alias("n"), F.sum("held").alias("bytes")).head()
        self.shapes = shapes["n"]
        self.shared = 2 * self.shapes <= self.blocks and (shapes["bytes"] or 0) <= self.FACTORS
        both = pairs.union(blocks.select(F.col("block").alias("target"), F.col("block").alias("member")))
        color_of = blocks.select(F.col("block").alias("target"), F.col("color").alias("tcolor"))
        values = blocks.select(F.col("block").alias("member"), F.col("color").alias("mcolor"), "w")
        self.state = cut(both.join(values, "member").join(color_of, "target").select("tcolor", "target", "mcolor", "member", "w"), "state")
        self.factors: dict[tuple, object] = {}
        self.sums: dict | None = None
        release(blocks, pairs)

    def _factors(self, unit: tuple[float, ...]):
        """The factors of every shape at unit variance, broadcast, or None where each task makes its own."""
        if not self.shared:
            return None
        if unit not in self.factors:
            family = self.family

            def make(frames):
                for f in frames:
                    for r in f.itertuples():
                        yield pd.DataFrame([(r.shape, pickle.dumps(_own_factor(family, pickle.loads(r.data), unit)))], columns=["shape", "made"])

            one = self.static.groupBy("shape").agg(F.min("block").alias("block"))
            made = self.static.join(one.select("block"), "block", "left_semi").select("shape", "data").mapInPandas(make, "shape binary, made binary").collect()
            while len(self.factors) > 2:
                self.factors.pop(next(iter(self.factors))).unpersist()
            self.factors[unit] = self.spark.sparkContext.broadcast({bytes(r["shape"]): pickle.loads(r["made"]) for r in made})
        return self.factors[unit]

    def _part(self, block: str) -> Column:
        return F.pmod(F.xxhash64(block), F.lit(self.parts)).cast("int").alias("part")

    def _to(self, which: Column, table: DataFrame):
        return table.where(which).select(self._part("target"), F.col("target").alias("block"), "member", "w").groupBy("part")

    def sweep(self, state: State, seed: Sequence[int], noise: bool = True) -> None:
        family, seed = self.family, tuple(map(int, seed))
        scale, unit = sampler.split_scale(state.theta, family)
        theta, taus, beta, held = tuple(state.theta), np.array(state.tausq, float), np.array(state.beta, float), self._factors(unit)

        def one(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(own):
                target, d = int(key[0]), pickle.loads(own["data"].iloc[0])
                w = _values(told)
                factor = (lambda b, make: held.value[d["shape"] if b == target else d["shapes"][b]]) if held else (lambda b, make: make())
                parts = _blocks_of(family, target, d)
                parents = {target: d["parents"], **{b: v[1] for b, v in d["near"].items()}}
                made = lambda b: conditional(family, gaps_of(family, parts[b], joined([parts[p] for p in parents[b]], family)), unit)
                children = [b for b in d["near"] if target in parents[b]]
                masks = [np.concatenate([np.full(len(parts[p]), p == target) for p in parents[c]]) for c in children]
                precision, maps = blanket_terms(factor(target, lambda: made(target)), [(factor(c, lambda c=c: made(c)), m) for c, m in zip(children, masks, strict=True)])
                join = lambda bs: np.concatenate([w[b] for b in bs]) if bs else np.zeros(0)
                shift = maps[0] @ join(d["parents"])
                for m, c in zip(maps[1:], children, strict=True):
                    shift = shift + m @ join([c, *parents[c]])
                outcome = _outcomes(family, d)
                e = d["y"] - (d["x"] * beta[outcome]).sum(axis=1) if d["x"].shape[1] else d["y"]
                if d["data"]:
                    h, left = _projection(family, d, theta)
                    weight = np.where(np.isfinite(e), 1 / (taus[outcome] + left), 0.0)
                    precision, shift = precision / scale + h.T @ (weight[:, None] * h), shift / scale + h.T @ (weight * np.nan_to_num(e))
                else:
                    precision, shift = observe(precision / scale, shift / scale, d["z"], e, taus[outcome])
                new = draw(precision, shift, normals(seed, target, np.arange(len(shift))) if noise else np.zeros(len(shift)))
                out = [(c, b, d["color"], target, new) for b, c in [(target, d["color"]), *d["out"]]]
            return pd.DataFrame(out, columns=["tcolor", "target", "mcolor", "member", "w"])

        schema = "tcolor int, target int, mcolor int, member int, w array<double>"
        drawn: dict[int, DataFrame] = {}
        for color in self.colors:
            told = self.state.where(~F.col("mcolor").isin(list(drawn)))
            for piece in drawn.values():
                told = told.union(piece)
            found = self.static.where(F.col("color") == color).select("part", "block", "data").groupBy("part").cogroup(self._to(F.col("tcolor") == color, told)).applyInPandas(_each(one, schema), schema)
            drawn[color] = found.persist(StorageLevel.DISK_ONLY)
        whole = self.state.where(F.col("mcolor") < 0)
        for piece in drawn.values():
            whole = whole.union(piece)
        after = cut(whole, "state")
        for piece in drawn.values():
            piece.unpersist()
        release(self.state)
        self.state, self.sums = after, None

    def predict(self, state: State, seed: Sequence[int], noise: bool = True) -> None:
        """A draw at blocks without observations; nothing depends on it but what is returned."""
        if not self.any_alone:
            return
        family, seed = self.family, tuple(map(int, seed))
        scale, unit = sampler.split_scale(state.theta, family)
        held = self._factors(unit)

        def one(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(own):
                target, d = int(key[0]), pickle.loads(own["data"].iloc[0])
                w = _values(told)
                h, half, _ = held.value[d["shape"]] if held else _own_factor(family, d, unit)
                z = normals(seed, target, np.arange(len(h))) if noise else np.zeros(len(h))
                known = np.concatenate([w[b] for b in d["parents"]]) if d["parents"] else np.zeros(0)
                out = [(-1, target, -1, target, h @ known + np.sqrt(scale) * np.linalg.solve(half, z))]
            return pd.DataFrame(out, columns=["tcolor", "target", "mcolor", "member", "w"])

        schema = "tcolor int, target int, mcolor int, member int, w array<double>"
        found = self.static.where("color < 0").select("part", "block", "data").groupBy("part").cogroup(self._to(F.col("tcolor") < 0, self.state)).applyInPandas(_each(one, schema), schema)
        after = cut(self.state.where("mcolor >= 0").union(found), "state")
        release(self.state)
        self.state = after

    def _sums(self, state: State, thetas: Sequence[Sequence[float]]) -> dict:
        """All sums of an iteration in one job, for each theta: of the process's density, of the data's where it depends on theta, and by outcome those of
        the rest y - z w and of x (weighted, where rows of data have a variance of their own)."""
        family, p = self.family, self.p
        thetas = list(dict.fromkeys(tuple(map(float, t)) for t in thetas))
        units = [sampler.split_scale(t, family)[1] for t in thetas]
        taus, beta = np.array(state.tausq, float), np.array(state.beta, float)
        held = []
        for u in units:
            try:
                held.append(self._factors(u))
            except Exception as e:  # a factor that can't be made is data
                if "LinAlgError" not in str(e):
                    raise
                held.append("fails")
        outcomes = family.q if family.several else 1
        names = [f"{n}_{k}" for k in range(len(thetas)) for n in ("ok", "logs", "quad", "told")]
        names += [f"{n}_{o}_{k}" for k in range(len(thetas)) for o in range(outcomes) for n in ("n", "rr", *(f"v{i}" for i in range(p)), *(f"m{i}_{j}" for i in range(p) for j in range(p)))]

        def one(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame([], columns=names)
            target, d = int(key[0]), pickle.loads(own["data"].iloc[0])
            w, row, tail = _values(told), [], []
            known = np.concatenate([w[b] for b in d["parents"]]) if d["parents"] else np.zeros(0)
            outcome, plain = _outcomes(family, d), np.ones(len(d["y"]))
            rest, weight = (np.zeros(0), plain) if d["data"] else (d["y"] - (d["z"] * w[target].reshape(d["z"].shape)).sum(axis=1), plain)
            for theta, u, f in zip(thetas, units, held, strict=True):
                fine, logs, quad, dense = 1.0, 0.0, 0.0, 0.0
                try:
                    if isinstance(f, str):
                        raise np.linalg.LinAlgError
                    h, half, logs = f.value[d["shape"]] if f else _own_factor(family, d, u)
                    e = half @ (w[target] - h @ known)
                    quad = float(e @ e)
                    if d["data"]:
                        h, left = _projection(family, d, theta)
                        rest, var = d["y"] - h @ w[target], taus[outcome] + left
                        fixed = (d["x"] * beta[outcome]).sum(axis=1) if p else 0.0
                        weight, m = taus[outcome] / var, np.isfinite(rest)
                        dense = float(-0.5 * (np.log(2 * np.pi * var) + (rest - fixed) ** 2 / var)[m].sum())
                except np.linalg.LinAlgError:
                    fine, logs, quad, dense = 0.0, 0.0, 0.0, 0.0
                    rest = np.full(len(d["y"]), np.nan) if d["data"] else rest
                row += [fine, logs, quad, dense]
                for o in range(outcomes):
                    m = np.isfinite(rest) & (outcome == o)
                    x, r, v = d["x"][m], rest[m], weight[m]
                    tail += [float(m.sum()), float(r @ r), *(x.T @ (v * r)), *(x.T @ (v[:, None] * x)).ravel()]
            return pd.DataFrame([row + tail], columns=names)

        schema = ", ".join(f"{n} double" for n in names)
        found = self.static.where("color >= 0").select("part", "block", "data").groupBy("part").cogroup(self._to((F.col("tcolor") >= 0), self.state)).applyInPandas(_each(one, schema), schema)
        total = found.agg(*[(F.min if n.startswith("ok") else F.sum)(n).alias(n) for n in names]).head()
        out = {}
        for k, theta in enumerate(thetas):
            by = []
            for o in range(outcomes):
                at = lambda n: total[f"{n}_{o}_{k}"] or 0.0  # noqa: B023, E731
                by.append((int(at("n")), at("rr"), np.array([at(f"v{i}") for i in range(p)]), np.array([[at(f"m{i}_{j}") for j in range(p)] for i in range(p)]).reshape(p, p)))
            out[theta] = {"ok": total[f"ok_{k}"] != 0, **{n: total[f"{n}_{k}"] or 0.0 for n in ("logs", "quad", "told")}, "outcomes": by}
        return out

    def _at(self, state: State, thetas: Sequence[Sequence[float]]) -> list[dict]:
        """The sums for each theta: those of the present process are kept until the next sweep; without data of their own they depend on the unit parameters alone."""
        key = (lambda t: tuple(map(float, t))) if self.latent else (lambda t: sampler.split_scale(t, self.family)[1])
        held = self.sums or {}
        if any(key(t) not in held for t in thetas):
            held = held | {key(t): v for t, v in self._sums(state, thetas).items()}
            self.sums = held
        return [held[key(t)] for t in thetas]

    def logliks(self, state: State, thetas: Sequence[Sequence[float]]) -> list[float | None]:
        out = []
        for t, got in zip(thetas, self._at(state, thetas), strict=True):
            scale = sampler.split_scale(t, self.family)[0]
            out.append(got["logs"] - self.points / 2 * float(np.log(2 * np.pi * scale)) - got["quad"] / (2 * scale) + got["told"] if got["ok"] else None)
        return out

    def quad(self, state: State) -> float:
        return self._at(state, [state.theta])[0]["quad"]

    def beta_sums(self, state: State) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(xx, xr) for _, _, xr, xx in self._at(state, [state.theta])[0]["outcomes"]]

    def rss(self, state: State) -> list[tuple[int, float]]:
        """Rows and the sum of squares of y - x beta - z w by outcome; with data of their own, of what the process's means leave (its weights are one where p is 0)."""
        out = []
        for (n, rr, xr, xx), beta in zip(self._at(state, [state.theta])[0]["outcomes"], state.beta, strict=True):
            b = np.array(beta, float)
            out.append((n, float(rr - 2 * b @ xr + b @ xx @ b)))
        return out

    def values(self, state: State) -> DataFrame:
        """ix, component, w, mean (x beta + z w) of all sites, or of all rows of data, whose w is their mean given the process."""
        family, theta, beta = self.family, tuple(state.theta), np.array(state.beta, float)

        def one(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            d = pickle.loads(own["data"].iloc[0])
            w, outcome = _values(told)[int(key[0])], _outcomes(family, d)
            mean = (d["x"] * beta[outcome]).sum(axis=1) if d["x"].shape[1] else np.zeros(len(d["y"]))
            if d["data"]:
                found = _projection(family, d, theta)[0] @ w
                return pd.DataFrame({"ix": d["ix"], "component": d["data"][1], "w": pd.Series([[v] for v in found.tolist()], dtype=object), "mean": mean + found})
            w = w.reshape(d["z"].shape)
            return pd.DataFrame({"ix": d["ix"], "component": d["comp"], "w": list(w), "mean": mean + (d["z"] * w).sum(axis=1)})

        mine = self._to(F.col("target") == F.col("member"), self.state)
        schema = f"ix {self.kind}, component int, w array<double>, mean double"
        return self.static.select("part", "block", "data").groupBy("part").cogroup(mine).applyInPandas(_each(one, schema), schema)

    def sites_values(self, sites: DataFrame) -> DataFrame:
        """ix, w: the process at each of the sites."""
        n = self.family.per_site
        listed = sites.groupBy("block").agg(F.array_sort(F.collect_list("ix")).alias("listed"))  # the sites of a block
        each = listed.join(self.process(), "block").select(F.posexplode("listed").alias("k", "ix"), "w")
        return each.select("ix", F.slice("w", F.col("k") * n + 1, F.lit(n)).alias("w"))

    def process(self) -> DataFrame:
        """block, w: the process at the points of each block, its sites in the order of ix."""
        return self.state.where("target = member").select(F.col("target").alias("block"), "w")

    def close(self) -> None:
        """Drops the tables."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        release(self.state)


def _each(one, schema: str):
    """one, of a block's row and the messages to it, over the blocks of a part: to send a part takes about as long as to send a block."""
    names = [c.split()[0] for c in schema.split(", ")]

    def many(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = dict(iter(told.sort_values(["block", "member"]).groupby("block"))) | {None: told.iloc[:0]}
        found = [one((b,), own.iloc[k : k + 1], told.get(b, told[None])) for k, b in enumerate(own["block"])]
        found = [f for f in found if len(f)]
        return pd.concat(found) if found else pd.DataFrame([], columns=names)

    return many


def _values(told: pd.DataFrame) -> dict[int, np.ndarray]:
    return {int(b): np.asarray(w, float) for b, w in zip(told["member"], told["w"], strict=True)}


def _blocks_of(family: Family, target: int, d: dict) -> dict[int, Block]:
    place = lambda at, comp: Block(family, np.arange(len(at)), at, comp)
    return {target: place(d["at"], d["comp"]), **{b: place(at, comp) for b, (_, _, at, comp) in d["near"].items()}}


def _outcomes(family: Family, d: dict) -> np.ndarray:
    """The outcome of each row with a y."""
    comp = d["data"][1] if d["data"] else d["comp"]
    return comp if family.several else np.zeros(len(comp), int)


def row_weights(family: Family, rows: Block, z: np.ndarray, known: Block, theta: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's sum of z times its points, given the known points: weights over these, and the variance that is left."""
    n, (count, points) = family.per_site, (len(z), len(known))
    if not count:
        return np.zeros((0, points)), np.zeros(0)
    cross = covariance(family, rows, known, theta)
    h = np.linalg.solve(covariance(family, known, known, theta), cross.T).T.reshape(count, n, points)
    # a site's points have the same covariances wherever it is
    kinds, of = np.unique(rows.component.reshape(count, n), axis=0, return_inverse=True)
    alone = [Block(family, np.zeros(1, int), rows.at[:1], k) for k in kinds]
    prior = np.stack([covariance(family, b, b, theta) for b in alone])[of.ravel()]
    left = np.einsum("ri,rij,rj->r", z, prior - np.einsum("rip,rjp->rij", h, cross.reshape(h.shape)), z)
    return np.einsum("ri,rip->rp", z, h), np.maximum(0.0, left)


def _projection(family: Family, d: dict, theta: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of data: its mean, a row of weights over the block's points, and the variance that these leave."""
    at, comp = d["data"]
    return row_weights(family, Block(family, np.arange(len(at)), at, comp), d["z"], Block(family, np.arange(len(d["at"])), d["at"], d["comp"]), theta)


def _own_factor(family: Family, d: dict, unit: Sequence[float]) -> tuple[np.ndarray, np.ndarray, float]:
    parts = _blocks_of(family, -1, d)
    return conditional(family, gaps_of(family, parts[-1], joined([parts[p] for p in d["parents"]], family)), unit)


def normal_of(*key: Column) -> Column:
    """A standard normal number that follows from the key alone."""
    unit = lambda salt: (F.shiftrightunsigned(F.xxhash64(F.lit(salt), *key), 11) + 0.5) / F.lit(float(1 << 53))
    return F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * np.pi * unit(2))


def _named(settings: Settings, state: State, x: Sequence[str]) -> list[tuple[str, float]]:
    tag = lambda name, k: name if settings.outcomes == 1 else f"{name}_{k + 1}"
    out = list(zip(settings.family.names(), state.theta, strict=True))
    out += [(tag("tausq", k), t) for k, t in enumerate(state.tausq)]
    return out + [(tag(f"beta_{c}", k), b) for k, row in enumerate(state.beta) for c, b in zip(x, row, strict=True)]


def fit(sites: DataFrame, edges: DataFrame, colors: DataFrame, settings: Settings, x: Sequence[str] = (), state: State | None = None, stop: int | None = None, path: str | None = None, data: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, State]:
    """draws of parameters (draw, name, value), of the process (draw, ix, w, yhat), the last table of the sites, and the last state.

    The state of the process is a table, written after each sweep; a lost executor only repeats the blocks it had. Draws are written as they
    are made, each in a folder of its own under path (by default in the shared folder), and count once a record of them is written: a fit
    that failed and runs again writes its draws anew, and none is there twice (see stored_draws). data: see SparkEngine. With the returned table and state a fit goes on where it stopped.
    """
    spark, engine = sites.sparkSession, SparkEngine(sites, edges, colors, settings.family, x, data)
    state = state or settings.start(len(x))
    path, parameters = path or scratch(spark, "draws"), []
    for k, now in sampler.iterate(engine, settings, state, stop):
        named = [(k, name, float(v)) for name, v in _named(settings, now, x)]
        parameters += named
        taus = F.array(*[F.lit(float(t)) for t in now.tausq])
        tau = F.get(taus, F.col("component") if settings.family.several else F.lit(0))
        noise = normal_of(F.lit(settings.seed), F.lit(now.iteration), F.col("ix")) * F.sqrt(tau)
        commit_draw(path, k, engine.values(now).select(F.lit(k).alias("draw"), "ix", "w", (F.col("mean") + noise).alias("yhat")), named)
    draws = stored_draws(spark, path, f"draw int, ix {engine.kind}, w array<double>, yhat double")
    last = sites.drop("w").join(cut(engine.sites_values(sites), "last"), "ix", "left")
    engine.close()
    return spark.createDataFrame(parameters, "draw int, name string, value double"), draws, last, state


def commit_draw(path: str, k: int, rows: DataFrame, named: Sequence[tuple]) -> None:
    """Write draw k: its rows in a folder of their own, in place of any that a failed run left there, and then the record that makes them count."""
    rows.write.mode("overwrite").parquet(f"{path}/draw={k}")
    rows.sparkSession.createDataFrame(list(named), "draw int, name string, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/committed={k}")


def committed(spark: SparkSession, path: str) -> list[int]:
    """The draws under path whose record is whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith("committed=")]
    whole = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in whole)


def stored_draws(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The draws under path that are committed; what a failed run left is not read."""
    kept = committed(spark, path)
    return spark.read.schema(schema).parquet(*[f"{path}/draw={k}" for k in kept]) if kept else spark.createDataFrame([], schema)


def fit_chains(sites: DataFrame, edges: DataFrame, colors: DataFrame, settings: Settings, x: Sequence[str] = (), chains: int = 1, collapsed: bool = False) -> tuple[DataFrame, DataFrame]:
    """parameters (chain, draw, name, value) and process (chain, draw, ix, w, yhat) of several chains over a small table, one task for each.

    For tables of at most sampler.MOST_SITES sites, a bound that is checked: a chain's iterations are then loops over blocks in memory instead of
    jobs. Chain k draws what fit() draws with the seed settings.seed + k. collapsed: the process is integrated out, and not returned.
    """
    n = sites.count()
    if n > sampler.MOST_SITES:
        raise ValueError(f"{n} sites: fit_chains takes at most {sampler.MOST_SITES}, fit() any number")
    family, spark, names = settings.family, sites.sparkSession, tuple(x)
    each = lambda: spark.range(chains).select(F.col("id").cast("int").alias("chain"))
    rows = each().crossJoin(F.broadcast(standard(sites, family, x)))
    graph = each().crossJoin(F.broadcast(edges.select(F.col("child"), "parent", "slot", F.lit(0).alias("color")).union(colors.select(F.col("block").alias("child"), F.lit(None).cast("int"), F.lit(None).cast("int"), "color"))))
    kind = sites.schema["ix"].dataType.simpleString()

    def run(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        from dataclasses import replace

        mine = replace(settings, seed=settings.seed + int(key[0]))
        lines = near[near["parent"].notna()].astype({"parent": int, "slot": int})
        engine = sampler.MemoryEngine(own, lines, near[near["parent"].isna()].rename(columns={"child": "block"}), family)
        out = []
        for k, state in sampler.iterate_collapsed(engine, mine) if collapsed else sampler.iterate(engine, mine):
            values = [float(v) for _, v in _named(mine, state, names)]
            if collapsed:
                out.append((int(key[0]), k, values, [], [], []))
                continue
            fitted = engine.fitted() + (engine.x * np.array(state.beta)[engine.outcome]).sum(axis=1)
            noise = np.random.default_rng([mine.seed, state.iteration, 1]).normal(size=engine.sites) * np.sqrt(np.array(state.tausq)[engine.outcome])
            out.append((int(key[0]), k, values, engine.ix.tolist(), engine.w.tolist(), (fitted + noise).tolist()))
        return pd.DataFrame(out, columns=["chain", "draw", "values", "ix", "w", "yhat"])

    made = rows.groupBy("chain").cogroup(graph.groupBy("chain")).applyInPandas(run, f"chain int, draw int, values array<double>, ix array<{kind}>, w array<double>, yhat array<double>")
    made = cut(made, "chains")
    listed = F.array(*[F.lit(n) for n, _ in _named(settings, settings.start(len(x)), x)])
    parameters = made.select("chain", "draw", F.explode(F.arrays_zip(listed.alias("name"), F.col("values").alias("value"))).alias("p")).select("chain", "draw", "p.name", "p.value")
    q = family.per_site
    process = made.select("chain", "draw", "w", "yhat", F.posexplode("ix").alias("at", "ix"))
    process = process.select("chain", "draw", "ix", F.slice("w", F.col("at") * q + 1, F.lit(q)).alias("w"), F.get("yhat", F.col("at")).alias("yhat"))
    return parameters, process


def predict(new: DataFrame, sites: DataFrame, edges: DataFrame, thetas: Sequence[Sequence[float]], family: Family = PLANE, tausq: Sequence[float] | None = None, seed: int = 1) -> DataFrame:
    """ix, draw, mean, var, and with tausq (of each draw) y, at new sites (ix, coordinates, block: that of the nearest site; comp, z).

    Kriging from the block's and its parents' rows. sites have w_draws, an array of the process's draws in the order of thetas: numbers, or
    arrays of one for each process. mean and var are of the sum of z times the process; factors are used again while theta stays. y adds noise.
    """
    thetas = [tuple(map(float, t)) for t in thetas]

    def krige(key: tuple, points: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """A bucket's targets, one after another, as slices of whole columns: a frame of its own would take longer than a small target's factors."""
        out = []
        if len(points) and len(rows):
            points, rows = points.sort_values(["target", "ix"]), rows.sort_values(["target", "of", "ix"])
            w = np.array([[np.ravel(d) for d in r] for r in rows["w_draws"]], float)  # sites x draws x processes
            columns = lambda f: (f["ix"].to_numpy(), np.array(f["at"].tolist(), float), f["component"].to_numpy())
            make = lambda c, some: Block(family, *(v[some] for v in c))
            z, mine, theirs = np.array(points["z"].tolist(), float).reshape(len(points), -1), columns(points), columns(rows)
            own, of = points["target"].to_numpy(), rows["target"].to_numpy()
            for target in np.intersect1d(own, of):
                near = slice(*np.searchsorted(of, [target, target + 1]))
                first, last = np.searchsorted(own, [target, target + 1])
                known = make(theirs, near)
                for lo in range(first, last, SLICE):
                    some, done = slice(lo, min(lo + SLICE, last)), None
                    for k, theta in enumerate(thetas):
                        if done is None or done[0] != theta:
                            done = (theta, *row_weights(family, make(mine, some), z[some], known, theta))
                        out.append((mine[0][some], np.full(some.stop - lo, k), done[1] @ w[near, k].ravel(), done[2]))
        found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 4
        return pd.DataFrame(dict(zip(("ix", "draw", "mean", "var"), found, strict=True)))

    flat = standard(sites, family).drop("w").join(sites.select("ix", "w_draws"), "ix")
    near = with_relatives(flat, edges).drop("parents").withColumnRenamed("block", "of")
    left = cut(standard(new, family).select(F.col("block").alias("target"), "ix", "at", "component", "z"), "new")
    tasks = max(shuffles(new.sparkSession), (left.count() + sites.count()) // DEALT)
    dealt = lambda f: f.withColumn("bucket", F.pmod(F.xxhash64("target"), F.lit(4 * tasks)).cast("int")).repartition(tasks, "bucket").groupBy("bucket")
    found = dealt(left).cogroup(dealt(near)).applyInPandas(krige, f"ix {new.schema['ix'].dataType.simpleString()}, draw int, mean double, var double")
    if tausq is None:
        return found
    tau = F.get(F.array(*[F.lit(float(t)) for t in tausq]), F.col("draw"))
    return found.withColumn("y", F.col("mean") + F.sqrt(F.col("var") + tau) * normal_of(F.lit(seed), F.col("draw"), F.col("ix")))


def precision_entries(sites: DataFrame, edges: DataFrame, theta: Sequence[float], family: Family = PLANE) -> DataFrame:
    """i, j, v: the sparse precision of the process over all sites, by ix; with several processes also r, s, the components from 0."""
    theta = tuple(map(float, theta))

    def entries(rows: pd.DataFrame) -> pd.DataFrame:
        target, group = int(rows["target"].iloc[0]), _Group(rows, family)
        h, half, _ = group.conditional(target, theta)
        a = half @ np.hstack([np.eye(len(h)), -h])
        blocks = [group.blocks[b] for b in [target, *group.parents(target)]]
        ids = np.repeat(np.concatenate([b.ix for b in blocks]), family.per_site)
        comp = np.concatenate([b.component for b in blocks])
        q, n = a.T @ a, len(ids)
        return pd.DataFrame({"i": np.repeat(ids, n), "j": np.tile(ids, n), "r": np.repeat(comp, n), "s": np.tile(comp, n), "v": q.ravel()})

    needed = with_relatives(standard(sites, family).select("ix", "block", "at", "component"), edges)
    kind = sites.schema["ix"].dataType.simpleString()
    found = needed.groupBy("target").applyInPandas(entries, f"i {kind}, j {kind}, r int, s int, v double").groupBy("i", "j", "r", "s").agg(F.sum("v").alias("v"))
    return found if family.q > 1 else found.drop("r", "s")


def multivariate_normal(spark: SparkSession, n: int, mean: Sequence[float], cov: Sequence[Sequence[float]], seed: int = 1) -> DataFrame:
    """draw, k, value: n draws, made on the executors."""
    lower = np.linalg.cholesky(np.asarray(cov, float))
    mu = np.asarray(mean, float)

    def make(frames):
        for f in frames:
            z = np.array([np.random.default_rng((seed, int(i))).normal(size=len(mu)) for i in f["id"]]).reshape(len(f), len(mu))
            x = mu + z @ lower.T
            yield pd.DataFrame({"draw": np.repeat(f["id"].to_numpy(), len(mu)), "k": np.tile(np.arange(1, len(mu) + 1), len(f)), "value": x.ravel()})

    return spark.range(n).mapInPandas(make, "draw long, k int, value double")


def simulated(sites: DataFrame, theta: Sequence[float], tausq: float, seed: int = 1, family: Family = PLANE, most: int = 4_000) -> DataFrame:
    """sites with w, a draw of the dense process, and y = w + noise; for at most so many sites, which one task holds."""
    if (n := sites.count()) > most:
        raise ValueError(f"{n} sites: at most {most} are simulated densely")
    theta = tuple(map(float, theta))

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ix")
        block = Block(family, rows["ix"].to_numpy(), np.array(rows["at"].tolist(), float), np.zeros(len(rows), int))
        lower = np.linalg.cholesky(covariance(family, block, block, theta) + 1e-9 * np.eye(len(block)))
        rng = np.random.default_rng(seed)
        w = lower @ rng.normal(size=len(block))
        return pd.DataFrame({"ix": rows["ix"], "w": w, "y": w + np.sqrt(tausq) * rng.normal(size=len(block))})

    made = standard(sites.withColumn("block", F.lit(0)), family).select("ix", "block", "at").groupBy("block").applyInPandas(make, f"ix {sites.schema['ix'].dataType.simpleString()}, w double, y double")
    return sites.drop("w", "y").join(made, "ix")


def save_fit(path: str, spark: SparkSession, sites: DataFrame, parameters: DataFrame, draws: DataFrame, settings: Settings, state: State) -> None:
    """A bundle from which load_fit() goes on: sites with their w, draws so far, settings and state, in one folder."""
    import json
    from dataclasses import asdict

    adaptive = type(state.proposal).__name__ if state.proposal else ""
    plain = lambda o: o.tolist() if isinstance(o, np.ndarray) else o
    texts = [json.dumps({k: v for k, v in asdict(settings).items()}), json.dumps(asdict(state), default=plain), adaptive]
    sites.write.mode("overwrite").parquet(f"{path}/sites")
    parameters.write.mode("overwrite").parquet(f"{path}/parameters")
    draws.write.mode("overwrite").parquet(f"{path}/draws")
    spark.createDataFrame([tuple(texts)], "settings string, state string, proposal string").write.mode("overwrite").parquet(f"{path}/state")


def load_fit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, Settings, State]:
    """sites, parameters, draws, settings and state of a bundle."""
    import json

    row = spark.read.parquet(f"{path}/state").head()
    known, held = json.loads(row["settings"]), json.loads(row["state"])
    family = Family(**known.pop("family"))
    settings = Settings(family=family, **{k: tuple(map(tuple, v)) if k == "bounds" else tuple(v) if isinstance(v, list) else v for k, v in known.items()})
    proposal = held.pop("proposal")
    if proposal:
        arrays = {k: np.array(v) if isinstance(v, list) else v for k, v in proposal.items()}
        proposal = getattr(sampler, row["proposal"])(**arrays)
    return spark.read.parquet(f"{path}/sites"), spark.read.parquet(f"{path}/parameters"), spark.read.parquet(f"{path}/draws"), settings, State(proposal=proposal, **held)


def latent_mesh(grid: DataFrame, data: DataFrame, dims: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """data with the block of its nearest site of grid (blocked, ix, coordinates), and edges, colors of the blocks: observed are those that data with y falls in."""
    near = nearest_site(data, grid, keep=["block"]).select("ix", "block")
    placed = cut(data.drop("block").join(near, "ix"), "data")
    seen = placed.where(is_observed(F.col("y"))).groupBy("block").agg(F.count("*").alias("n"))
    counted = block_counts(grid.drop("y").withColumn("y", F.lit(None).cast("double")), dims).drop("n_obs", "share_obs")
    blocks = cut(counted.join(seen, "block", "left").select(*counted.columns, F.coalesce("n", F.lit(0)).alias("n_obs")), "blocks")
    edges = cut(mesh.mesh_edges(blocks, dims), "edges")
    return placed, edges, mesh.greedy_colors(mesh.blanket(edges, blocks), blocks)


def mesh_of(blocked: DataFrame, dims: int = 2, all_observed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """blocks, edges, colors of blocked sites; blocks without observations are predicted from others, unless all count as observed."""
    blocks = cut(block_counts(blocked, dims))
    if all_observed:
        blocks = blocks.withColumn("n_obs", F.greatest("n_obs", F.lit(1)))
    edges = cut(mesh.mesh_edges(blocks, dims))
    return blocks, edges, mesh.greedy_colors(mesh.blanket(edges, blocks), blocks)
