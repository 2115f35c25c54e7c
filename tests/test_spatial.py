"""The spatial operators: SQL on the small tables, hand-made cases, dense matrices."""

import math
import os
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from gridloom.functions import covariance as cov
from gridloom.functions import scalars as sc
from gridloom.operators import fronts, gaussian, mesh, neighbors, sampler, summaries
from gridloom.operators import tessellation as tess
from gridloom.operators.kernels import Block, Family, covariance, observe
from gridloom.operators.sampler import Settings, State
from gridloom.operators.tables import cut
from gridloom.plans import extra
from gridloom.plans import queries as Q
from gridloom.sources import sites
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SQL = list(Q.ORACLE_SQL)


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    got = sorted((tuple(r) for r in Q.QUERIES[name](spark, SF).select(*names).collect()), key=repr)
    assert [tuple(float(v) if isinstance(v, (int, float)) else v for v in r) for r in got] == [tuple(float(v) if isinstance(v, (int, float)) else v for v in r) for r in want]


def test_thresholds_by_hand(spark):
    rows = spark.createDataFrame([(float(i), v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0, 2.0, 3.0, 4.0, 4.0, 9.0, 9.0])], "var1 double, var2 double")
    found = tess.collect_thresholds(tess.order_statistics(rows, ["var1", "var2"], (5, 2)), 2)
    assert found == [[2.0, 4.0, 6.0, 8.0], [3.0]]
    one = rows.limit(4).select("var2")
    assert tess.collect_thresholds(tess.order_statistics(one, ["var2"], (2,)), 1) == [[1.0]]


def test_block_ids_follow_strings(spark):
    levels = spark.createDataFrame([(k, 1) for k in range(1, 12)], "l1 int, l2 int")
    got = {r["l1"]: r["block"] for r in tess.with_blocks(levels, 2).collect()}
    assert (got[1], got[10], got[11], got[2], got[9]) == (1, 2, 3, 4, 11)
    assert {r["l1"]: r["block"] for r in tess.with_blocks(levels, 2, padded=True).collect()}[10] == 10


def test_quantiles_by_hand(spark):
    rows = spark.range(10).select(F.lit(1).alias("ix"), F.col("id").cast("double").alias("value"))
    assert summaries.draw_quantiles(rows, (0.95,)).head()["quantile"] == 8.0
    rows = spark.range(100).select(F.lit(1).alias("ix"), F.col("id").cast("double").alias("value"))
    assert summaries.draw_quantiles(rows, (0.05,)).head()["quantile"] == 3.5


def test_mesh_by_hand(spark):
    blocks = spark.createDataFrame([(1, 1, 1, 5), (2, 1, 2, 5), (1, 2, 3, 5), (2, 2, 4, 5)], "l1 int, l2 int, block int, n_obs int")
    edges = mesh.mesh_edges(blocks, 2)
    assert {tuple(r) for r in edges.collect()} == {(2, 1, 1), (3, 1, 0), (4, 2, 0), (4, 3, 1)}
    members = mesh.blanket(edges, blocks)
    assert {r["member"] for r in members.where("block = 2").collect()} == {1, 3, 4}
    assert mesh.color_conflicts(mesh.greedy_colors(members, blocks), members).count() == 0
    grid = spark.createDataFrame([(a, b, 3 * b + a + 1, 0 if a == b == 1 else 1) for a in range(3) for b in range(3)], "l1 int, l2 int, block int, n_obs int")
    alone = {(r["parent"], r["slot"]) for r in mesh.mesh_edges(grid, 2).where("child = 5").collect()}
    assert alone == {(2, 0), (8, 1), (4, 2), (6, 3)}


def test_scalars(spark):
    rows = spark.createDataFrame([("0x1F",), ("-1",), ("FFFFFFFF",), ("",), (None,), ("zz",)], "t string")
    assert [r[0] for r in rows.select(sc.hex_to_int(F.col("t"))).collect()] == [31, -1, 2147483647, 0, 0, 0]
    cells = sc.symmetric_entries(spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>"), "v", []).collect()
    m = np.zeros((3, 3))
    for r in cells:
        m[r["i"] - 1, r["j"] - 1] = r["value"]
    assert m.tolist() == [[0, 1, 2], [1, 0, 3], [2, 3, 0]]
    got = spark.range(1).select(*[cov.matern(F.lit(0.5), 2.0, 3.0, k) for k in (1, 3, 5)]).head()
    e = 2 * np.exp(-1.5)
    assert np.allclose(got, [e, e * 2.5, e * (1 + 1.5 + 0.75)])


def blocked_sites(spark, parts):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.uniform(size=2)), float(rng.normal())) for i in range(40)]
    df = spark.createDataFrame(rows, "ix long, var1 double, var2 double, w double").withColumn("y", F.when(F.col("ix") % 5 != 0, F.col("w")))
    return tess.tessellate(df, ["var1", "var2"], parts), rows


def whole(df, family):
    rows = df.orderBy("ix").collect()
    return Block(family, np.array([r["ix"] for r in rows]), np.array([r["at"] for r in rows]), np.array([r["component"] for r in rows])), rows


FAMILIES = [
    (Family(), (1.5, 2.0)),
    (Family(twonu=3), (1.5, 2.0)),
    (Family(twonu=5), (1.5, 4.0)),
    (Family(q=2), (1.5, 2.0, 0.7)),
    (Family(q=3), (1.5, 0.8, 0.5, 2.0, 0.3, 0.6, 0.9)),
    (Family(dims=3), (1.5, 0.8, 0.5, 2.0)),
    (Family(dims=3, q=2), (1.5, 0.8, 0.5, 2.0, 0.4)),
    (Family(dims=3, q=3), (1.5, 0.4, 0.6, 0.8, 0.5, 2.0, 0.3, 0.6, 0.9)),
    (Family(q=2, several=True), (0.9, 0.8, 0.5, 0.6, 2.0, 3.0, 1.5, 0.7)),
    (Family(q=3, several=True), (0.9, 0.8, 0.7, 0.5, 0.6, 0.4, 2.0, 3.0, 4.0, 0.8, 0.5, 1.5, 0.3, 0.6, 0.9)),
]


@pytest.mark.parametrize("family, theta", FAMILIES)
def test_families_are_the_column_expressions(spark, family, theta):
    """The kernels' matrices against the covariances as columns, pair by pair."""
    rng = np.random.default_rng(1)
    at, comp = rng.uniform(size=(5, family.dims)), rng.integers(0, family.q, 5)
    block = Block(family, np.arange(5), at, comp)
    k = covariance(family, block, block, theta)
    params, latent = family.unpack(theta)
    n = len(block)
    rows = [(i, j, float(np.linalg.norm(block.at[i, :2] - block.at[j, :2])), float(abs(block.at[i, -1] - block.at[j, -1])), float(latent[block.component[i], block.component[j]]), int(block.component[i]), int(block.component[j])) for i in range(n) for j in range(n)]
    p = spark.createDataFrame(rows, "i int, j int, h double, u double, v double, ci int, cj int")
    if family.several:
        q = family.q
        of = lambda a, c: F.get(F.array(*[F.lit(float(x)) for x in params[a * q : a * q + q]]), F.col(c))
        c = cov.cross_outcome(p["h"], p["v"], of(0, "ci"), of(0, "cj"), of(1, "ci"), of(2, "ci"), q, params[3 * q :])
    else:
        c = cov.covariance(family.dims, family.q, p["h"], p["u"], p["v"], params, family.twonu)
    got = np.zeros((n, n))
    for r in p.select("i", "j", c.alias("c")).collect():
        got[r["i"], r["j"]] = r["c"]
    assert np.allclose(got, k, atol=1e-12)
    assert np.linalg.eigvalsh(k).min() > -1e-9
    assert len(family.names()) == len(theta)


def sites_of(spark, family, parts, n=36, empty=(), seed=0):
    """Blocked sites of a family with w, z and y, those in blocks empty without y."""
    rng = np.random.default_rng(seed)
    q = family.per_site
    rows = []
    for i in range(n):
        at = [float(v) for v in rng.uniform(size=3)]
        rows.append((i, *at, [float(v) for v in rng.normal(size=q)], [float(v) for v in rng.normal(size=q)], float(rng.normal()), int(rng.integers(0, family.q)), float(rng.normal())))
    df = spark.createDataFrame(rows, "ix long, var1 double, var2 double, var3 double, w array<double>, z array<double>, y double, comp int, x1 double")
    axes = [f"var{k}" for k in range(1, family.dims + 1)]
    blocked = tess.tessellate(df, axes, parts)
    return blocked.withColumn("y", F.when(~F.col("block").isin(list(empty)) & (F.col("ix") % 5 != 0), F.col("y"))).cache()


@pytest.mark.parametrize("family, theta", [FAMILIES[1], FAMILIES[3], FAMILIES[6], FAMILIES[8]])
def test_one_block_is_the_dense_density(spark, family, theta):
    df = sites_of(spark, family, (1,) * family.dims)
    _, edges, _ = gaussian.mesh_of(df, family.dims)
    block, rows = whole(gaussian.standard(df, family), family)
    w, k = np.concatenate([r["w"] for r in rows]), covariance(family, block, block, theta)
    want = -0.5 * (np.linalg.slogdet(k)[1] + w @ np.linalg.solve(k, w) + len(w) * np.log(2 * np.pi))
    assert np.isclose(gaussian.loglik(gaussian.block_logliks(df, edges, [theta], family)).head()["loglik"], want)


def dense_precision(spark, df, edges, theta, family):
    """Over all points, by the rows' order."""
    q, n = family.per_site, df.count()
    out = np.zeros((n * q, n * q))
    for r in gaussian.precision_entries(df, edges, theta, family).collect():
        a, b = (r["r"], r["s"]) if family.q > 1 and not family.several else (0, 0)
        out[r["i"] * q + a, r["j"] * q + b] += r["v"]
    return out


@pytest.mark.parametrize("family, theta", [FAMILIES[0], FAMILIES[3], FAMILIES[5], FAMILIES[8]])
def test_block_draws_are_the_dense_conditional(spark, family, theta):
    """Means of each block given all others, on Spark and in memory, follow from the mesh's own precision matrix."""
    df = sites_of(spark, family, (2, 2) if family.dims == 2 else (2, 2, 1))
    _, edges, colors = gaussian.mesh_of(df, family.dims)
    p = dense_precision(spark, df, edges, theta, family)
    rows = gaussian.standard(df, family).orderBy("ix").collect()
    q, n = family.per_site, len(rows)
    design = np.zeros((n, n * q))
    for i, r in enumerate(rows):
        design[i, i * q : i * q + q] = r["z"]
    taus = [0.1, 0.3][: family.q if family.several else 1]
    weight = np.array([0.0 if r["y"] is None else 1 / taus[r["component"]] for r in rows])
    y, w = np.array([r["y"] or 0.0 for r in rows]), np.concatenate([r["w"] for r in rows])
    block, color = np.repeat([r["block"] for r in rows], q), {r["block"]: r["color"] for r in colors.collect()}
    a = p + design.T @ (weight[:, None] * design)
    for b in sorted(set(block), key=lambda b: (color[b], b)):
        mine = block == b
        w[mine] = np.linalg.solve(a[np.ix_(mine, mine)], (design.T @ (weight * y))[mine] - a[np.ix_(mine, ~mine)] @ w[~mine])
    got = {r["ix"]: r["w"] for r in gaussian.sweep(gaussian.standard(df, family).withColumn("e", F.col("y")), edges, colors, theta, taus, (1, 0), noise=False, family=family).collect()}
    assert np.allclose(np.concatenate([got[i] for i in range(n)]), w)
    memory = engine_of(df, edges, colors, family)
    memory.sweep(State(list(theta), taus), (1, 0), noise=False)
    order = {ix: k for k, ix in enumerate(memory.ix)}
    assert np.allclose(np.concatenate([memory.w[order[i] * q : order[i] * q + q] for i in range(n)]), w)
    jobs = gaussian.SparkEngine(df, edges, colors, family)
    state = State(list(theta), taus)
    jobs.sweep(state, (1, 0), noise=False)
    got = {r["ix"]: r["w"] for r in jobs.values(state).collect()}
    assert np.allclose(np.concatenate([got[i] for i in range(n)]), w)
    memory.sums.clear()
    assert np.allclose(jobs.logliks(state, [theta]), memory.logliks(state, [theta])) and np.allclose(jobs.rss(State(list(theta), taus, [[]] * len(taus))), memory.rss(state))
    jobs.close()


def engine_of(df, edges, colors, family, x=()):
    return sampler.MemoryEngine(gaussian.standard(df, family, x).toPandas(), edges.toPandas(), colors.toPandas(), family)


@pytest.mark.parametrize("family, theta", [FAMILIES[0], FAMILIES[3]])
def test_collapsed_is_the_dense_density(spark, family, theta):
    df = sites_of(spark, family, (1, 1))
    _, edges, colors = gaussian.mesh_of(df)
    block, rows = whole(gaussian.standard(df, family), family)
    design = np.zeros((len(rows), len(block)))
    for i, r in enumerate(rows):
        design[i, i * family.q : (i + 1) * family.q] = r["z"]
    seen = np.array([r["y"] is not None for r in rows])
    y = np.array([r["y"] or 0.0 for r in rows])[seen]
    v = (design @ covariance(family, block, block, theta) @ design.T)[np.ix_(seen, seen)] + 0.2 * np.eye(seen.sum())
    want = -0.5 * (np.linalg.slogdet(v)[1] + y @ np.linalg.solve(v, y) + len(y) * np.log(2 * np.pi))
    assert np.isclose(engine_of(df, edges, colors, family).collapsed(theta, 0.2), want)


def test_congruent_blocks_share_factors(spark):
    """On a regular grid most blocks use another's factors, and draws are the same as without sharing."""
    grid = sites.grid(spark, (12, 12)).withColumn("y", F.sin(F.col("ix").cast("double")))
    df = tess.tessellate(grid, ["var1", "var2"], (4, 4))
    _, edges, colors = gaussian.mesh_of(df)
    one, two = engine_of(df, edges, colors, Family()), engine_of(df, edges, colors, Family())
    assert one.hits() > 70
    two.key, two.wide = {b: b for b in two.key}, {b: b for b in two.wide}
    for engine in (one, two):
        engine.sweep(State([1.3, 4.0], [0.1]), (1, 2))
    assert np.allclose(one.w, two.w, atol=1e-8)
    assert np.allclose(one.logliks(None, [(1.3, 4.0)]), two.logliks(None, [(1.3, 4.0)]))


def test_blocks_without_observations_are_predicted(spark):
    family, theta = Family(), (1.2, 3.0)
    df = sites_of(spark, family, (2, 2), empty=(4,))
    blocks, edges, colors = gaussian.mesh_of(df)
    assert blocks.where("n_obs = 0").count() == 1
    alone = blocks.where("n_obs = 0").select("block")
    rows = gaussian.standard(df, family)
    got = {r["ix"]: r["w"][0] for r in gaussian.draw_alone(rows, edges, alone, theta, (1, 0), noise=False, family=family).collect()}
    up = [r["parent"] for r in edges.where("child = 4").collect()]
    own, near = rows.where("block = 4"), rows.where(F.col("block").isin(up))
    (a, mine), (b, known) = whole(own, family), whole(near, family)
    want = covariance(family, a, b, theta) @ np.linalg.solve(covariance(family, b, b, theta), [r["w"][0] for r in known])
    assert np.allclose([got[r["ix"]] for r in mine], want)
    memory = engine_of(df, edges, colors, family)
    memory.predict(State(list(theta), [0.1]), (1, 0), noise=False)
    order = {ix: k for k, ix in enumerate(memory.ix)}
    assert np.allclose([memory.w[order[r["ix"]]] for r in mine], want)


@pytest.mark.parametrize("family", [Family(), Family(q=2, several=True)])
def test_chains_on_spark_and_in_tasks_are_equal(spark, family):
    """The same seed gives the same draws, blocks without observations, coefficients and adaptation included; a stored fit goes on alike."""
    df = sites_of(spark, family, (2, 2), empty=(4,)).drop("z")
    _, edges, colors = gaussian.mesh_of(df)
    bounds = ((1e-3, 1e3), (0.1, 30.0)) if not family.several else ((0.1, 3.0),) * 4 + ((0.1, 30.0),) * 3 + ((0.01, 2.0),)
    settings = Settings(family=family, bounds=bounds, keep=2, burn=1, thin=2 if family.several else 1, seed=5)
    parameters, draws, last, state = gaussian.fit(df, edges, colors, settings, x=["x1"])
    one, process = gaussian.fit_chains(df, edges, colors, settings, x=["x1"], chains=1)
    a, b = ({(r["draw"], r["name"]): r["value"] for r in t.collect()} for t in (parameters, one))
    assert set(a) == set(b) and all(np.isclose(a[k], b[k]) for k in a)
    a, b = ({(r["draw"], r["ix"]): r["w"] for r in t.collect()} for t in (draws, process))
    assert set(a) == set(b) and all(np.allclose(a[k], b[k]) for k in a)
    if not family.several:
        path = gaussian.scratch(spark, "bundle")
        some, few, table, at = gaussian.fit(df, edges, colors, settings, x=["x1"], stop=2)
        gaussian.save_fit(path, spark, table, some, few, settings, at)
        table, some, few, again, at = gaussian.load_fit(spark, path)
        assert again == settings and at.iteration == 2
        rest = gaussian.fit(table, edges, colors, again, x=["x1"], state=at)[0]
        joined = {(r["draw"], r["name"]): r["value"] for r in some.union(rest).collect()}
        want = {(r["draw"], r["name"]): r["value"] for r in parameters.collect()}
        assert set(joined) == set(want) and all(np.isclose(joined[k], want[k]) for k in want)


def test_chain_recovers_what_was_simulated(spark):
    """Means of a longer chain near the dense posterior's: the process at its sites, for known parameters."""
    family, theta = Family(), (1.0, 5.0)
    df = gaussian.simulated(sites.grid(spark, (14, 14)), theta, 0.05, seed=2)
    df = tess.tessellate(df, ["var1", "var2"], (2, 2)).cache()
    _, edges, colors = gaussian.mesh_of(df)
    engine = engine_of(df, edges, colors, family)
    total = np.zeros(engine.sites)
    for it in range(400):
        engine.sweep(State(list(theta), [0.05]), (9, it))
        total += engine.w
    p = dense_precision(spark, df.withColumn("ix", F.col("ix") - 1), edges, theta, family)
    rows = {r["ix"]: r["y"] for r in df.collect()}
    y = np.array([rows[i + 1] for i in range(196)])
    want = np.linalg.solve(p + np.eye(196) / 0.05, y / 0.05)
    assert np.abs(total / 400 - want[engine.ix - 1]).max() < 0.08
    values = [(s.theta[0], s.theta[1], s.tausq[0]) for _, s in sampler.iterate(engine_of(df, edges, colors, family), Settings(keep=300, burn=300))]
    means = np.mean(values, axis=0)
    assert 0.4 < means[0] < 3 and 1.5 < means[1] < 15 and 0.02 < means[2] < 0.3
    dense = [s.theta for _, s in sampler.iterate_collapsed(engine, Settings(keep=5, burn=5))]
    assert np.isfinite(dense).all()


@pytest.mark.parametrize("kind", [sampler.Ram, sampler.Haario])
def test_proposals_adapt_to_the_target(kind):
    """Random walks on a narrow, correlated normal density: the share of accepted steps nears the target."""
    rng = np.random.default_rng(0)
    p = np.linalg.inv(np.array([[1.0, 0.9], [0.9, 1.0]]) * 1e-3)
    walk, x, recent = kind(np.eye(2)), np.zeros(2), []
    for _ in range(6000):
        z = rng.normal(size=2)
        new = x + walk.step(z)
        chance = float(np.exp(min(0.0, (x @ p @ x - new @ p @ new) / 2)))
        taken = rng.uniform() < chance
        x = new if taken else x
        walk.learn(z, chance, taken, x)
        recent.append(taken)
    assert 0.1 < np.mean(recent[-2000:]) < 0.6


def test_failed_factorization_is_data(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0, 1, 1.0), (1, 0.0, 0.0, 1, 2.0)], "ix long, var1 double, var2 double, block int, w double")
    parts = gaussian.block_logliks(rows, spark.createDataFrame([], "child int, parent int, slot int"), [(1.0, 1.0)])
    assert gaussian.loglik(parts).head()["loglik"] is None


@pytest.mark.parametrize("family, theta", [FAMILIES[0], FAMILIES[3], FAMILIES[8]])
def test_prediction_is_dense_kriging(spark, family, theta):
    df = sites_of(spark, family, (2, 2))
    _, edges, _ = gaussian.mesh_of(df)
    known = df.where("ix % 6 <> 0").withColumn("w_draws", F.array("w", F.transform("w", lambda x: x * 2)))
    new = df.where("ix % 6 = 0")
    got = {(r["ix"], r["draw"]): r for r in gaussian.predict(new, known, edges, [theta, theta], family, tausq=[0.1, 0.2]).collect()}
    near = {}
    for r in edges.collect():
        near.setdefault(r["child"], []).append(r["parent"])
    for row in gaussian.standard(new, family).collect():
        one, _ = whole(gaussian.standard(new, family).where(F.col("ix") == row["ix"]), family)
        others, rows = whole(gaussian.standard(known, family).where(F.col("block").isin([row["block"], *near.get(row["block"], [])])), family)
        w, cross = np.concatenate([r["w"] for r in rows]), covariance(family, one, others, theta)
        h, z = cross @ np.linalg.inv(covariance(family, others, others, theta)), np.array(row["z"])
        for draw in (0, 1):
            r = got[row["ix"], draw]
            assert np.isclose(r["mean"], z @ h @ w * (draw + 1)) and np.isclose(r["var"], z @ (covariance(family, one, one, theta) - h @ cross.T) @ z) and r["y"] != r["mean"]


def test_rows_at_one_place_far_away_or_nowhere(spark):
    """Dense places, rows far from all others, and rows whose coordinates are null or not finite."""
    ref = spark.createDataFrame([(i, 0.0, 0.0) for i in range(200)] + [(200 + i, 1e-6 * i, 1e-6) for i in range(50)] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 1.0, 1.0)], "ix long, var1 double, var2 double")
    new = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 0.0), (4, 1e6, 1e6), (5, float("inf"), 0.0), (6, 0.4, 0.4), (7, 1e300, 0.0)], "ix long, var1 double, var2 double")
    assert {r["ix"]: r["near"] for r in neighbors.nearest_site(new, ref).collect()} == {1: 0, 2: None, 3: None, 4: 902, 5: None, 6: 249, 7: 902}
    assert [r["near"] for r in neighbors.nearest_site(new, ref.where("var1 is null")).collect()] == [None] * 7


def test_congruence_is_a_tolerance(spark):
    """Blocks that differ by less than the tolerance share a representative, on whatever side of a rounding step they lie."""
    rows = []
    for block, off in ((1, 0.0), (2, 0.00004), (3, 0.00006), (4, 0.01)):
        rows += [(block * 10 + k, block + 0.3 * k + off * k, 2.0 * block + 0.1 * k, block) for k in range(3)]
    df = spark.createDataFrame(rows, "ix long, var1 double, var2 double, block int")
    got = {r["block"]: r["representative"] for r in mesh.congruence_keys(df, ["var1", "var2"]).collect()}
    assert got[1] == got[2] == 1 and got[4] == 4


def test_draws_are_stored(spark):
    draws = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.7)], "draw int, ix long, value double")
    path = gaussian.scratch(spark, "draws")
    sites.write_draws(draws, path)
    assert sorted(map(tuple, sites.read_sites(spark, path).collect())) == [(0, 1, 0.5), (1, 1, 0.7)]


def test_nearest_site_far_and_tied(spark):
    ref = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0)], "ix long, var1 double, var2 double")
    new = spark.createDataFrame([(10, 0.5, 0.0), (11, 50.0, 50.0), (12, -3.0, 0.1)], "ix long, var1 double, var2 double")
    assert {r["ix"]: r["near"] for r in neighbors.nearest_site(new, ref).collect()} == {10: 1, 11: 2, 12: 1}
    assert [r["near"] for r in neighbors.nearest_site(new, ref.limit(0)).collect()] == [None] * 3


def test_grid(spark):
    got = sites.grid(spark, (3, 2)).orderBy("ix").collect()
    assert [r["ix"] for r in got] == [1, 2, 3, 4, 5, 6] and got[0]["var1"] == 0.25 and np.isclose(got[5]["var2"], 2 / 3)


def test_nearest_site_is_brute_force(spark):
    """Places, scales and distances of all kinds: clusters, ties, squares that overflow or vanish, new sites far from everything."""
    from fractions import Fraction

    rng = np.random.default_rng(5)
    sets = [
        (rng.normal(size=(1500, 2)), rng.normal(size=(300, 2)) * 2),
        (np.concatenate([rng.normal(size=(900, 2)) * 1e-9, rng.normal(size=(900, 2)) * 1e-9 + 5, [[1e6, 1e6]]]), np.concatenate([rng.normal(size=(100, 2)) * 1e-9, rng.uniform(0, 5, (100, 2)), [[1e9, -1e9], [1e18, 3e18], [-1e300, 1e280]]])),
        (np.array([[0.0, 0.0], [1e200, 0.0], [0.0, 1e200], [1.7e308, -1.7e308]]), np.array([[9e199, 0.0], [4e199, 4e199], [-1.7e308, 1.7e308], [1.7e308, 0.0]])),
        (rng.integers(0, 40, (1200, 2)) * 1e-170, rng.integers(0, 80, (200, 2)) * 0.5e-170),
        (rng.integers(0, 12, (100, 2)) * 1.0, rng.integers(0, 24, (150, 2)) * 0.5),
    ]
    for ref, new in sets:
        known = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(ref)], "ix long, var1 double, var2 double")
        asked = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(new)], "ix long, var1 double, var2 double")
        exact = [(Fraction(float(a)), Fraction(float(b))) for a, b in ref]
        for r in neighbors.nearest_site(asked, known).collect():
            a, b = Fraction(float(new[r["ix"]][0])), Fraction(float(new[r["ix"]][1]))
            h = np.hypot((ref[:, 0] - float(a)) * 2.0**-6 if abs(a) < 1e300 else ref[:, 0] * 2.0**-6 - float(a) * 2.0**-6, ref[:, 1] * 2.0**-6 - float(b) * 2.0**-6)
            close = np.flatnonzero(h <= h.min() * (1 + 1e-12))
            squares = {int(k): (exact[k][0] - a) ** 2 + (exact[k][1] - b) ** 2 for k in close}
            best = min(squares.values())
            assert squares[r["near"]] <= best * (1 + Fraction(1, 1 << 49)), (r, ref[r["near"]])
            if squares[r["near"]] == best:
                assert r["near"] == min(k for k, v in squares.items() if v == best)
    assert [neighbors.depth(n) for n in (1, 32, 33, 1024, 1025, 10**9)] == [1, 1, 2, 2, 3, 6]


def first_fit(near, order):
    colors = {}
    for b in order:
        taken = {colors[m] for m in near.get(b, ()) if m in colors}
        colors[b] = next(c for c in range(len(taken) + 1) if c not in taken)
    return colors


@pytest.mark.parametrize("tile", [3, 50, 1 << 16])
def test_first_fit_in_rounds_is_first_fit_in_order(spark, tile):
    rng = np.random.default_rng(tile)
    pairs = {(int(a), int(b)) for a, b in rng.integers(1, 151, (500, 2)) if a != b}
    pairs |= {(b, a) for a, b in pairs}
    blocks = spark.createDataFrame([(b, int(b % 7 > 0)) for b in range(1, 151)], "block int, n_obs int")
    seen = [b for b in range(1, 151) if b % 7]
    members = spark.createDataFrame([p for p in pairs if p[0] % 7 and p[1] % 7], "block int, member int")
    near = {}
    for a, b in pairs:
        if a % 7 and b % 7:
            near.setdefault(a, []).append(b)
    want = first_fit(near, seen)
    got = {r["block"]: r["color"] for r in mesh.greedy_colors(members, blocks, tile).collect()}
    assert {b: got[b] for b in seen} == want
    assert {got[b] for b in range(1, 151) if not b % 7} == {max(want.values()) + 1}
    waits = spark.createDataFrame([(b, [m for m in near.get(b, []) if m < b]) for b in seen], "block int, waiting array<int>")
    assert mesh.settle(waits, "first_fit", tile)._gridloom_rounds <= -(-151 // tile)


def test_first_fit_of_many_blocks_takes_few_rounds(spark):
    """A grid of 250 x 160 blocks, each next to eight others: 40,000 blocks in 10 tiles."""
    side, rows = 250, 160
    grid = spark.range(side * rows).select((F.col("id") + 1).cast("int").alias("block"), (F.col("id") % side).alias("i"), F.expr("id div 250").alias("j"))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-1, 0), (-1, -1), (0, -1), (1, -1))])).alias("s")
    before = grid.select("block", "i", "j", step).where(f"i + s.a between 0 and {side - 1} and j + s.b >= 0")
    waits = before.groupBy("block").agg(F.collect_list((F.col("block") + F.col("s.a") + side * F.col("s.b")).cast("int")).alias("waiting"))
    waits = grid.select("block").join(waits, "block", "left").select("block", F.coalesce("waiting", F.array().cast("array<int>")).alias("waiting"))
    found = mesh.settle(waits, "first_fit", 4096)
    assert found._gridloom_rounds <= 10
    near = {j * side + i + 1: [(j + b) * side + i + a + 1 for a, b in ((-1, 0), (-1, -1), (0, -1), (1, -1)) if 0 <= i + a < side and j + b >= 0] for j in range(rows) for i in range(side)}
    assert dict(map(tuple, found.collect())) == first_fit(near, range(1, side * rows + 1))


def test_blocks_in_a_circle_are_an_error(spark):
    with pytest.raises(ValueError, match="circle"):
        mesh.settle(spark.createDataFrame([(1, [2]), (2, [1]), (3, [])], "block int, waiting array<int>"), "longest")


def test_groups_move_behind_their_parents(spark):
    edges = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 1, 0), (5, 4, 0)], "child int, parent int, slot int")
    colors = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)], "block int, color int")
    for tile in (1, 2, 100):
        assert dict(map(tuple, mesh.colors_apart(edges, colors, tile).collect())) == {1: 0, 2: 2, 3: 4, 4: 1, 5: 3}


def test_thresholds_of_many_intervals(spark):
    """A thousand intervals an axis are exact, with ties, nulls and NaN, and take no more expressions than two."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=20_000), np.round(rng.normal(size=20_000), 2)
    rows = [(float(x), float(y)) for x, y in zip(a, b, strict=True)] + [(None, float("nan"))] * 100
    df = spark.createDataFrame(rows, "var1 double, var2 double")
    found = {(r["axis"], r["i"]): r["threshold"] for r in tess.order_statistics(df, ["var1", "var2"], (1000, 1000)).collect()}
    for axis, x in ((1, np.sort(a)), (2, np.sort(b))):
        assert [found[axis, i] for i in range(1, 1000)] == [x[i * 20_000 // 1000] for i in range(1, 1000)]
    thresholds = tess.collect_thresholds(spark.createDataFrame([(k[0], t) for k, t in found.items()], "axis int, threshold double"), 2)
    levelled = tess.with_levels(df, ["var1", "var2"], thresholds)
    got = levelled.collect()
    assert all(r["l1"] == 1 + np.searchsorted(thresholds[0], r["var1"], "right") and r["l2"] == 1 + np.searchsorted(thresholds[1], r["var2"], "right") for r in got[:20_000])
    assert {(r["l1"], r["l2"]) for r in got[20_000:]} == {(None, 1000)}
    nodes = lambda t: levelled.sparkSession._jvm.PythonSQLUtils.explainString(tess.with_levels(df, ["var1", "var2"], t)._jdf.queryExecution(), "simple").count("lambdafunction")
    assert nodes(thresholds) == nodes([[0.0], [0.0]])
    assert tess.order_statistics(df.limit(0), ["var1", "var2"], (5, 5)).count() == 0


@pytest.mark.parametrize("many", [1_000_000, 2000, 50])
def test_quantiles_are_selected(spark, many):
    """Keys of one draw and of many, ties, nulls and NaN; with a low limit, keys are cut in buckets again and again."""
    rng = np.random.default_rng(6)
    values = {1: [5.0], 2: list(rng.normal(size=3000)), 3: [1.0] * 900 + [2.0] * 100, 4: list(np.round(rng.normal(size=1500), 1)), 5: [float("inf"), -3.0], None: list(rng.normal(size=400))}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [(2, None), (2, float("nan")), (6, None)]
    df = spark.createDataFrame(rows, "ix long, value double").repartition(5)
    probs = (0.0, 0.025, 0.3, 0.5, 0.95, 1.0)
    for linear in (False, True):
        got = {(r["ix"], r["prob"]): r["quantile"] for r in summaries.draw_quantiles(df, probs, linear=linear, many=many).collect()}
        assert len(got) == 6 * len(probs)
        for k, vs in values.items():
            x, n = sorted(vs), len(vs)
            for q in probs:
                if linear:
                    at = q * (n - 1)
                    lo, hi, w = int(at), min(int(at) + 1, n - 1), at - int(at)
                else:
                    r = q * n
                    begin = max(r - 1, 0.0)
                    lo, hi = (int(begin), min(int(begin) + 1, n - 1)) if r >= n / 2 else (max(math.ceil(begin) - 1, 0), math.ceil(begin))
                    w = 0.5 + (r - math.floor(r + 0.5))
                want = (1 - w) * x[lo] + w * x[hi]
                assert np.isclose(got[k, q], want) or (np.isnan(want) and np.isnan(got[k, q])), (k, q, linear)


def test_quantiles_gather_no_lists(spark):
    plan = summaries.draw_quantiles(spark.range(100).select(F.lit(1).alias("ix"), F.col("id").cast("double").alias("value")), (0.5,))._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_factors_are_made_once_for_each_shape(spark, monkeypatch):
    """On a lattice the engine of jobs makes as many factors as shapes for each theta, and draws what it draws without sharing."""
    grid = sites.grid(spark, (12, 12)).withColumn("y", F.sin(F.col("ix").cast("double")))
    df = cut(tess.tessellate(grid, ["var1", "var2"], (4, 4)))
    _, edges, colors = gaussian.mesh_of(df)
    shared = gaussian.SparkEngine(df, edges, colors, Family())
    monkeypatch.setattr(gaussian.SparkEngine, "FACTORS", 0)
    own = gaussian.SparkEngine(df, edges, colors, Family())
    assert shared.shared and not own.shared and shared.blocks == 16 and shared.shapes == 4
    state = State([1.3, 4.0], [0.1])
    for engine in (shared, own):
        engine.sweep(state, (1, 2))
    assert [len(f.value) for f in shared.factors.values()] == [4] and not own.factors
    state.theta[0] = 2.0  # another variance: the same factors
    shared.sweep(state, (1, 3))
    own.sweep(state, (1, 3))
    assert len(shared.factors) == 1
    a, b = ({r["ix"]: r["w"][0] for r in e.values(state).collect()} for e in (shared, own))
    assert set(a) == set(b) and all(np.isclose(a[k], b[k], atol=1e-8) for k in a)
    assert np.allclose(shared.logliks(state, [(2.0, 4.0), (1.0, 3.0)]), own.logliks(state, [(2.0, 4.0), (1.0, 3.0)]))
    assert len(shared.factors) == 2


def test_a_sweep_shuffles_messages_only(spark):
    """The blocks' data is read from its buckets as it lies; only the messages between blocks are shuffled."""
    df = sites_of(spark, Family(), (3, 3))
    _, edges, colors = gaussian.mesh_of(df)
    engine = gaussian.SparkEngine(df, edges, colors, Family())
    plan = engine.values(State([1.0, 3.0], [0.1]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_failed_fit_writes_no_draw_twice(spark, monkeypatch):
    """A fit that fails between a draw's rows and its record, run again: every draw is there once, with the values of a fit that never failed."""
    df = sites_of(spark, Family(), (2, 2), empty=(4,)).drop("z")
    _, edges, colors = gaussian.mesh_of(df)
    settings = Settings(keep=3, seed=5)
    whole = gaussian.fit(df, edges, colors, settings)[1]
    want = {(r["draw"], r["ix"]): r["w"] for r in whole.collect()}
    path, schema = gaussian.scratch(spark, "draws"), "draw int, ix long, w array<double>, yhat double"
    keep = gaussian.commit_draw

    def fails(where, k, rows, named):
        if k == 1:
            rows.limit(5).write.mode("overwrite").parquet(f"{where}/draw={k}")
            raise RuntimeError("lost")
        keep(where, k, rows, named)

    monkeypatch.setattr(gaussian, "commit_draw", fails)
    with pytest.raises(RuntimeError, match="lost"):
        gaussian.fit(df, edges, colors, settings, path=path)
    assert gaussian.committed(spark, path) == [0]
    assert {r["draw"] for r in gaussian.stored_draws(spark, path, schema).collect()} == {0}
    monkeypatch.setattr(gaussian, "commit_draw", keep)
    again = gaussian.fit(df, edges, colors, settings, path=path)[1].collect()
    assert gaussian.committed(spark, path) == [0, 1, 2] and len(again) == len(want)
    assert all(np.allclose(r["w"], want[r["draw"], r["ix"]]) for r in again)


def test_pairs_of_a_block_are_dealt_to_tasks(spark):
    """Each pair of a block once, and no task holds all pairs of one."""
    rows = spark.createDataFrame([(i, i % 7 // 6, float(i), 0.0, 1) for i in range(700)], "ix long, block int, var1 double, var2 double, mv_id int")
    found = Q._paired(rows, 100).select("i", "j", F.spark_partition_id().alias("task")).collect()
    want = [(i, j) for i in range(700) for j in range(i, 700) if i % 7 // 6 == j % 7 // 6]
    assert sorted((r["i"], r["j"]) for r in found) == want
    tasks = Counter(r["task"] for r in found)
    assert len(tasks) > 10 and max(tasks.values()) < len(want) / 4


def test_pairs_are_turned_and_lie_in_the_order_of_their_values(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(2, 1500)) * 0.05
    sites = spark.createDataFrame([(k, 1, float(x[k]), float(y[k]), k % 3 + 1) for k in range(1500)], "ix long, block int, var1 double, var2 double, mv_id long")
    pairs = Q._paired(sites, 1000)
    for r in pairs.where("(i * 7 + j) % 97 = 0").collect():
        i, j = r["i"], r["j"]
        assert i <= j and (r["mi"], r["mj"]) == (i % 3 + 1, j % 3 + 1) and (r["d1"], r["d2"]) == (x[i] - x[j], y[i] - y[j])
    # files of pairs hold runs of equal values as one; dealt as they were joined they take about 9 bytes a pair
    found = Q.lined_up(pairs.select("i", "j", Q.six_of(F.exp(-1.5 * F.col("h"))).alias("c")), "c")
    assert "Sort [c" in found._jdf.queryExecution().toString()
    found.write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 7 * found.count()


def near_sites(spark, n=1500):
    x, y = np.random.default_rng(5).normal(size=(2, n)) * 0.05
    return spark.createDataFrame([(k, 1, float(x[k]), float(y[k]), k % 3 + 1) for k in range(n)], "ix long, block int, var1 double, var2 double, mv_id long")


def written(df, path):
    df.write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet")) / df.count()


def test_pairs_of_components_are_whole_and_not_sorted(spark):
    """Every pair of sites once for each pair of components, equal ids in both orders; four times as many rows as pairs are not sorted to lie well in files."""
    rows = spark.createDataFrame([(i // 2 if i < 20 else i, i % 2, float(i % 17), float(i % 13), 1) for i in range(300)], "ix long, block int, var1 double, var2 double, mv_id int")
    all_ = rows.collect()
    want = Counter((a["ix"], b["ix"], r, s) for a in all_ for b in all_ if a["block"] == b["block"] and a["ix"] <= b["ix"] for r in (0, 1) for s in (0, 1))
    got = Q._component_pairs(rows, 60, [[0.0, 0.8], [0.8, 0.0]]).select("i", "j", "r", "s", "v").collect()
    assert Counter((r["i"], r["j"], r["r"], r["s"]) for r in got) == want and all(r["v"] == 0.8 * (r["r"] != r["s"]) for r in got)
    same = spark.createDataFrame([(k // 3, 1, float(k), float(-k), 1) for k in range(150)], "ix long, block int, var1 double, var2 double, mv_id int")
    found = Counter((r["i"], r["j"]) for r in Q._component_pairs(same, 30, [[0.0]]).select("i", "j").collect())
    assert found == Counter((a // 3, b // 3) for a in range(150) for b in range(150) if a // 3 <= b // 3)
    assert "Sort [" not in extra.cov_matrix_q2(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_further_values_of_pairs_take_little(spark, tmp_path):
    """Two values a pair: the second has few different ones for long where the nearest pairs come first."""
    p = Q._paired(near_sites(spark), 2048)
    of = lambda kind, params: Q.six_of(cov.model(kind, 2, 1, p["h"], F.lit(0.0), p["v"], [p["d1"], p["d2"]], params))
    found = Q.lined_up(p.select("i", "j", of(0, [2.0, 1.5]).alias("c0"), of(1, [2.0, 1.5, 3.0]).alias("c1")), F.desc("c0"))
    new, old = written(found, tmp_path / "new"), written(found.sortWithinPartitions("c0", "c1"), tmp_path / "old")
    assert new < 0.95 * old, (new, old)
    assert "DESC" in extra.cov_models(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_values_of_pairs_are_rounded_as_before(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 0.25, 1.2345675, 0.0000004, 0.9999996, 2.000001, float("nan"), None)], "v double")
    for r in rows.select("v", Q.six(F.col("v")).alias("a"), Q.six_of(F.col("v")).alias("b")).collect():
        assert r["a"] == r["b"] or (r["v"] != r["v"] and r["b"] != r["b"])


def test_small_blocks_are_predicted_by_several_tasks(spark):
    """Few bytes, but much work: adaptive plans would leave them to one task."""
    rng = np.random.default_rng(8)
    x, y, w = rng.normal(size=(3, 400))
    known = spark.createDataFrame([(k, float(x[k]), float(y[k]), k // 2, [float(w[k]), float(-w[k])]) for k in range(400)], "ix long, var1 double, var2 double, block int, w_draws array<double>")
    new = spark.createDataFrame([(k, float(x[k]) + 0.1, float(y[k]), k // 2) for k in range(0, 400, 3)], "ix long, var1 double, var2 double, block int")
    edges = spark.createDataFrame([(b, b - 1, 0) for b in range(1, 200, 2)], "child int, parent int, slot int")
    found = gaussian.predict(new, known, edges, [(2.0, 1.5), (2.0, 1.5)]).select("*", F.spark_partition_id().alias("task")).collect()
    assert len(found) == 2 * 134 and len({r["task"] for r in found}) > 3
    cov = lambda a, b: 2.0 * np.exp(-1.5 * np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]))
    for r in found:
        b = r["ix"] // 2
        near = [2 * b, 2 * b + 1] + ([2 * b - 2, 2 * b - 1] if b % 2 else [])
        at, own = np.array([x[near], y[near]]).T, np.array([[x[r["ix"]] + 0.1, y[r["ix"]]]])
        h = np.linalg.solve(cov(at, at), cov(at, own))[:, 0]
        assert np.isclose(r["mean"], h @ w[near] * (1 - 2 * r["draw"]), atol=1e-9) and np.isclose(r["var"], 2.0 - h @ cov(at, own)[:, 0], atol=1e-9)


def test_places_stay_dealt_down_the_tree(spark):
    rows = spark.createDataFrame([(k, k % 41 / 41, k % 43 / 43) for k in range(1500)], "ix long, var1 double, var2 double")
    found = neighbors.nearest_site(rows.where("ix % 3 = 0"), rows.where("ix % 3 <> 0"))
    assert found.count() == 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = plan.index("REPARTITION_BY_NUM")
    assert "Window" in plan[:dealt] and "Window" not in plan[dealt : plan.index("Union", dealt) if "Union" in plan[dealt:] else None]


def test_homes_of_a_dissection_are_dealt_by_name(spark):
    """Few bytes, but much work: adaptive plans would leave them to few tasks."""
    rows = spark.createDataFrame([(k, k + 1, float(k), 0.0, (k % 7) / 7) for k in range(120)], "ix long, block int, var1 double, var2 double, y double")
    edges = rows.where("block > 1").select(F.col("block").alias("child"), (F.col("block") - 1).alias("parent"), F.lit(0).alias("slot"))
    whole = fronts.Dissection(rows, edges, leaf=8, within=32)
    assert whole.tasks >= 4
    found = whole.posterior((1.5, 2.0), 0.1)
    assert found.count() == 120 and found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2


def test_engine_takes_blocks_a_part_at_a_time():
    """Each block of a part with its own messages alone, in whatever order they come; messages to blocks that are elsewhere are left."""
    own = pd.DataFrame({"block": [4, 9, 2], "data": [b"4", b"9", b"2"]})
    told = pd.DataFrame({"block": [2, 4, 7, 2], "member": [5, 1, 1, 3], "w": [[2.5], [4.1], [7.1], [2.3]]})
    seen = []

    def one(key, row, messages):
        seen.append((key[0], list(row["data"]), list(messages["member"])))
        return pd.DataFrame({"a": [key[0]] * len(messages), "b": [w[0] for w in messages["w"]]})

    found = gaussian._each(one, "a int, b double")((0,), own, told)
    assert seen == [(4, [b"4"], [1]), (9, [b"9"], []), (2, [b"2"], [3, 5])]
    assert found.to_numpy().tolist() == [[4, 4.1], [2, 2.3], [2, 2.5]]
    assert list(gaussian._each(one, "a int, b double")((0,), own.iloc[:0], told).columns) == ["a", "b"]


def test_values_are_made_distinct_before_they_are_dealt(spark):
    plan = extra.values_left(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftAnti") :]
    assert join.count("Aggregate") == 1  # below the join, the right side; the left side's is above it


def fronts_cases(spark):
    family = Family()
    yield family, (0.5, 4.0), (8, 7), "y_full"
    yield Family(q=2), (0.05, 2.0, 0.5), (5, 5), F.array("y_full", "x2")


def test_fronts_are_the_dense_matrices(spark):
    """The collapsed density, posterior means and variances by nested dissection, with a corner of blocks unseen, at several sizes of parts."""
    rows = sites.sites_2d(spark, SF)
    for family, theta, grid, w in fronts_cases(spark):
        df = tess.tessellate(rows, ["var1", "var2"], grid).withColumn("w", F.col(w) if isinstance(w, str) else w)
        df = df.withColumn("y", F.when(~((F.col("l1") >= 4) & (F.col("l2") >= 4)), F.col("y")))
        df = cut(df.withColumn("z", F.array(F.lit(1.0), F.col("x2"))) if family.q == 2 else df)
        _, edges, colors = gaussian.mesh_of(df)
        memory = engine_of(df, edges, colors, family, ["x2"])
        want, found = memory.collapsed(theta, 0.1, [0.3]), memory._at(theta)
        scale, n = sampler.split_scale(theta, family)[0], family.per_site
        p = np.zeros((len(memory.w),) * 2)
        for b in memory.observed:
            h, half, _ = found["own"][memory.key[b]]
            at = np.concatenate([np.arange(memory.span[x].start, memory.span[x].stop) for x in [b, *memory.parents[b]]])
            a = half @ np.hstack([np.eye(len(h)), -h])
            p[np.ix_(at, at)] += a.T @ a / scale
        used = np.concatenate([memory.own[b] for b in memory.observed])
        seen = np.concatenate([memory.rows[b] for b in memory.observed])
        whole, shift = observe(p[np.ix_(used, used)], np.zeros(len(used)), memory.z[seen], (memory.y - memory.x[:, 0] * 0.3)[seen], np.full(len(seen), 0.1))
        inverse = np.linalg.inv(whole)
        mean = inverse @ shift
        for leaf in (2, 100):
            parts = fronts.Dissection(df, edges, family, ["x2"], leaf=leaf)
            assert np.isclose(parts.collapsed(theta, 0.1, [0.3]), want, rtol=0, atol=1e-8) and (parts.depth > 1) == (leaf == 2)
            got = {r["ix"]: r for r in parts.posterior(theta, 0.1, [0.3]).collect()}
            assert set(got) == {memory.ix[r] for r in seen}
            for k, r in enumerate(seen):
                assert np.allclose(got[memory.ix[r]]["mean"], mean[k * n : k * n + n]) and np.allclose(got[memory.ix[r]]["var"], np.diag(inverse)[k * n : k * n + n])
    assert parts.collapsed((-1.0, 2.0, 0.5), 0.1, [0.3]) is None


def test_tasks_eliminate_whole_parts_of_the_tree(spark):
    """However much of the tree a task takes, results agree; and it takes all that fits, so that only what is left of it is shuffled."""
    df = tess.tessellate(sites.sites_2d(spark, SF), ["var1", "var2"], (8, 7)).withColumn("w", F.col("y_full"))
    df = cut(df.withColumn("y", F.when(~((F.col("l1") >= 4) & (F.col("l2") >= 4)), F.col("y"))))
    _, edges, _ = gaussian.mesh_of(df)
    found, levels = [], []
    for within in (1, 60, 150, 10**6):
        parts = fronts.Dissection(df, edges, leaf=2, within=within)
        levels.append(parts.levels)
        rows = {r["ix"]: (r["mean"][0], r["var"][0]) for r in parts.posterior((0.5, 4.0), 0.1).collect()}
        found.append((parts.collapsed((0.5, 4.0), 0.1), sorted(rows), [rows[k] for k in sorted(rows)]))
        home = parts.nodes.groupBy("home").agg(F.min("whole").alias("whole"), F.min("node").alias("least")).collect()
        assert all(r["least"] >= r["home"] if r["whole"] else r["least"] == r["home"] for r in home)
    assert levels == sorted(levels, reverse=True) and levels[0] == parts.depth and levels[-1] == 0 and levels[1] > levels[2] > 0
    for value, ix, of in found[1:]:
        assert np.isclose(value, found[0][0], rtol=0, atol=1e-8) and ix == found[0][1] and np.allclose(of, found[0][2])
    m = np.arange(25.0).reshape(5, 5)
    assert (fronts._unpack(fronts._pack(m + m.T), 5) == m + m.T).all()


def test_dissection_parts_never_touch(spark):
    rng = np.random.default_rng(8)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 120, (200, 2)) if a != b}
    near = spark.createDataFrame([q for a, b in pairs for q in ((a, b), (b, a))], "block int, member int")
    places = spark.createDataFrame([(b, float(b % 4 > 1), 0.0 if b < 60 else float(rng.normal())) for b in range(120)], "block int, var1 double, var2 double")
    node = dict(map(tuple, fronts.dissected(places, near, leaf=3).collect()))
    assert set(node) == set(range(120))
    above = lambda a, b: a <= b and b >> (b.bit_length() - a.bit_length()) == a
    assert all(above(*sorted((node[a], node[b]), key=lambda h: (h.bit_length(), h))) for a, b in pairs)


def test_collapsed_fit_draws_what_a_task_draws(spark):
    df = sites_of(spark, Family(), (2, 2))
    _, edges, colors = gaussian.mesh_of(df)
    settings = Settings(keep=2, burn=1, seed=3)
    got = {(r["draw"], r["name"]): r["value"] for r in fronts.fit_collapsed(df, edges, settings).collect()}
    for k, state in sampler.iterate_collapsed(engine_of(df, edges, colors, Family()), settings):
        assert np.allclose([got[k, "sigmasq"], got[k, "phi"], got[k, "tausq"]], [*state.theta, state.tausq[0]])


def test_a_latent_grid_is_the_dense_model(spark):
    """Three outcomes on a grid of sites, data elsewhere: likelihood, sweep and the data's means follow from dense matrices."""
    family = Family(q=3, several=True)
    theta = (0.9, 0.8, 0.7, 0.5, 0.6, 0.4, 2.0, 3.0, 2.5, 0.6, 0.5, 2.0, 0.3, 0.6, 0.9)
    rng, taus, beta = np.random.default_rng(12), [0.1, 0.2, 0.3], [[0.3], [-0.2], [0.5]]
    places = [(i, j, c) for i in range(6) for j in range(6) for c in range(3)]
    grid = spark.createDataFrame([(k, i / 6, j / 6, c, float(rng.normal())) for k, (i, j, c) in enumerate(places)], "ix long, var1 double, var2 double, comp int, w double")
    rows = [(k, float(rng.uniform(0, 0.8)), float(rng.uniform(0, 0.8)), int(rng.integers(3)), float(rng.normal()), None if k % 7 == 0 else float(rng.normal())) for k in range(70)]
    rows = [r for r in rows if not (r[1] > 0.55 and r[2] > 0.55)]  # a block without data
    data = spark.createDataFrame(rows, "ix long, var1 double, var2 double, comp int, x1 double, y double")
    blocked = cut(tess.tessellate(grid, ["var1", "var2"], (3, 3)))
    placed, edges, colors = gaussian.latent_mesh(blocked, data)
    engine = gaussian.SparkEngine(blocked, edges, colors, family, ["x1"], data=placed)
    assert engine.any_alone and len(engine.colors) > 1
    state = State(list(theta), taus, beta)
    g = {r["ix"]: r for r in gaussian.standard(blocked, family).collect()}
    d = [r for r in gaussian.standard(placed, family, ["x1"]).orderBy("ix").collect()]
    part = lambda rs: Block(family, np.array([r["ix"] for r in rs]), np.array([r["at"] for r in rs]).reshape(len(rs), 2), np.array([r["component"] for r in rs]))
    by = {}
    for r in sorted(g.values(), key=lambda r: r["ix"]):
        by.setdefault(r["block"], []).append(r)
    h, left = np.zeros((len(d), len(g))), np.zeros(len(d))
    for k, r in enumerate(d):
        own = by[r["block"]]
        cross, one = covariance(family, part([r]), part(own), theta), part([r])
        weights = cross @ np.linalg.inv(covariance(family, part(own), part(own), theta))
        h[k, [x["ix"] for x in own]] = weights[0]
        left[k] = (covariance(family, one, one, theta) - weights @ cross.T)[0, 0]
    seen = np.array([r["y"] is not None for r in d])
    e = np.array([r["y"] - r["x"][0] * beta[r["component"]][0] if r["y"] is not None else 0.0 for r in d])
    var = np.array([taus[r["component"]] for r in d]) + left
    real = edges.join(engine.static.where("color >= 0").select(F.col("block").alias("child")), "child", "left_semi")
    observed = {r["block"] for r in engine.static.where("color >= 0").collect()}
    some = blocked.where(F.col("block").isin(list(observed)))
    q = np.zeros((len(g), len(g)))
    for r in gaussian.precision_entries(some, real, theta, family).collect():
        q[r["i"], r["j"]] += r["v"]
    w = np.array([g[i]["w"][0] for i in range(len(g))])
    used = np.array([i for i in range(len(g)) if g[i]["block"] in observed])
    sub = q[np.ix_(used, used)]
    want = 0.5 * np.linalg.slogdet(sub)[1] - 0.5 * w[used] @ sub @ w[used] - len(used) / 2 * np.log(2 * np.pi)
    want += (-0.5 * (np.log(2 * np.pi * var) + (e - h @ w) ** 2 / var))[seen].sum()
    assert np.isclose(engine.logliks(state, [theta])[0], want)
    weight = np.where(seen, 1 / var, 0.0)
    a, color = q + h.T @ (weight[:, None] * h), {r["block"]: r["color"] for r in colors.collect()}
    for b in sorted(observed, key=lambda b: (color[b], b)):
        m = np.array([g[i]["block"] == b for i in range(len(g))])
        rest = np.isin(np.arange(len(g)), used) & ~m
        w[m] = np.linalg.solve(a[np.ix_(m, m)], (h.T @ (weight * e))[m] - a[np.ix_(m, rest)] @ w[rest])
    engine.sweep(state, (1, 0), noise=False)
    got = {r["block"]: r["w"] for r in engine.process().collect()}
    assert all(np.allclose(got[b], w[[r["ix"] for r in by[b]]]) for b in observed)
    means = {r["ix"]: (r["w"][0], r["mean"]) for r in engine.values(state).collect()}
    for k, r in enumerate(d):
        if r["block"] in observed:
            assert np.allclose(means[r["ix"]], (h[k] @ w, h[k] @ w + r["x"][0] * beta[r["component"]][0]))
    x = np.array([r["x"][0] for r in d])
    for o, (xx, xr) in enumerate(engine.beta_sums(state)):
        m = seen & np.array([r["component"] == o for r in d])
        scale = taus[o] / var[m]
        y = np.array([r["y"] or 0.0 for r in d])[m]
        assert np.isclose(xx[0, 0], (scale * x[m] ** 2).sum()) and np.isclose(xr[0], (scale * x[m] * (y - (h @ w)[m])).sum())
    draws = gaussian.fit(blocked, edges, colors, Settings(family=family, bounds=((0.1, 3.0),) * 6 + ((0.1, 30.0),) * 3 + ((0.01, 2.0),) * 2 + ((0.1, 30.0),) + ((0.01, 2.0),) * 3, keep=1), x=["x1"], data=placed)[1]
    assert draws.count() == len(rows)


def dense_front(n=50, k=22):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(n, n))
    return a @ a.T + n * np.eye(n), rng.normal(size=n), fronts._Front(4, [7, 9, 3, 5], [4, 4, 2, 1], [10, k - 10, 20, n - k - 20])


def test_a_front_is_eliminated_in_place(monkeypatch):
    """In panels of its lower triangle, which takes in and leaves some rows at a time: no task holds a second matrix of the front's size, no row of a table one."""
    monkeypatch.setattr(fronts, "PANEL", 7)
    monkeypatch.setattr(fronts, "NUMBERS", 60)
    a, v, front = dense_front()
    some = np.array([*range(10), *range(22, 50)])  # two pieces, one of which has no points of block 9
    part = np.zeros_like(a)
    part[np.ix_(some, some)] = a[np.ix_(some, some)] / 2
    whole = fronts._Lower(50)
    whole.add(a - part, 0, np.arange(50))
    front.add([7, 9, 3, 5], [10, 12, 20, 8], whole.behind(0), v)
    front.add([7, 3, 5], [10, 20, 8], [(0, part[np.ix_(some, some)])], np.zeros(38))
    front.eliminate()
    left = a[22:, 22:] - a[22:, :22] @ np.linalg.solve(a[:22, :22], a[:22, 22:])
    rows = list(fronts._left(2, front))
    assert len(rows) > 8 and max(len(r[8]) for r in rows) <= 60 * 8 and [r[9] != b"" for r in rows].count(True) == 1
    found = fronts._Lower(28)
    for r in pd.DataFrame(rows, columns=fronts._NAMES).itertuples():
        found.add(fronts._numbers(r), r.first, np.arange(28))
    assert np.allclose(found.times(np.eye(28)), left) and np.allclose(front.shift[22:], v[22:] - a[22:, :22] @ np.linalg.solve(a[:22, :22], v[:22]))
    assert np.isclose(front.term, v[:22] @ np.linalg.solve(a[:22, :22], v[:22]) / 2 - np.linalg.slogdet(a[:22, :22])[1] / 2)


def test_a_large_front_takes_little_more_than_its_triangle():
    n, k = 3000, 800
    tracemalloc.start()
    front = fronts._Front(2, [1, 2], [2, 1], [k, n - k])
    rows = ((i, np.eye(100, i + 100, i)) for i in range(0, n, 100))
    front.add([1, 2], [k, n - k], rows, np.ones(n))
    front.eliminate()
    assert sum(len(r) for _, r in front.left()) == n - k
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.8 * n * n * 8

def test_the_inverse_over_a_front_is_sent_in_parts(monkeypatch):
    monkeypatch.setattr(fronts, "PANEL", 7)
    monkeypatch.setattr(fronts, "NUMBERS", 60)
    a, v, front = dense_front()
    front.add([7, 9, 3, 5], [10, 12, 20, 8], [(0, a)], v)
    front.eliminate()
    inverse, mean = np.linalg.inv(a), np.linalg.solve(a, v)
    known = fronts._Lower(28)
    known.add(inverse[22:, 22:], 0, np.arange(28))
    found = fronts._Inverse(np.concatenate([rows for _, rows in front.factor()]), front.shift[:22], known, mean[22:])
    assert np.allclose(found.own, inverse[:22, :22]) and np.allclose(found.mean, mean)
    at = front.at([9, 3], [12, 20])
    sent = fronts._Lower(32)
    for first, rows in found.part(at):
        assert rows.size <= 60
        sent.add(rows, first, np.arange(32))
    assert np.allclose(sent.times(np.eye(32)), inverse[np.ix_(at, at)])
