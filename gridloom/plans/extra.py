"""More registered queries, of the smaller operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import covariance as cov
from ..functions import scalars as sc
from ..operators import mesh, summaries
from ..operators import tessellation as tess
from ..sources import sites
from .queries import BLANKET, COUNTS, EDGES_2D, GRID_2D, GRID_3D, MASKED_2D, MASKED_3D, PAIRS_2D, SITES_2D, SITES_3D, TILE, _blocks_2d, _component_pairs, _mesh_2d, _pairs_2d, blocks_sql, levels_sql, lined_up, masked_2d, masked_3d, query, six, six_of, thresholds_sql

# --- tables of sites ---------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice NULLS LAST, o_orderkey) AS ix FROM orders")
def row_ids(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return sites.row_ids(rows, ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("ix").cast("long").alias("ix"))


@query("""WITH a AS (SELECT event_id, user_id % 50 AS var1, CASE WHEN event_id % 11 <> 0 THEN event_id % 7 END AS var2 FROM events),
b AS (SELECT DISTINCT user_id % 50 AS var1, CASE WHEN event_id % 11 <> 0 THEN event_id % 7 END AS var2, user_id % 50 * 10 AS label FROM events WHERE user_id % 50 < 40)
SELECT event_id, a.var1, a.var2, label FROM a LEFT JOIN b ON a.var1 IS NOT DISTINCT FROM b.var1 AND a.var2 IS NOT DISTINCT FROM b.var2""")
def coordinate_join(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("user_id") % 50).alias("var1"), F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 7).alias("var2"))
    right = rows.where("var1 < 40").select("var1", "var2").distinct().withColumn("label", F.col("var1") * 10)
    return sites.coordinate_join(rows, right)


@query("SELECT event_id, round(user_id / m, 6) AS a, round(event_id / m, 6) AS b FROM events, (SELECT max(event_id)::DOUBLE AS m FROM events)")
def rescaled(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").cast("double").alias("a"), F.col("event_id").cast("double").alias("b"))
    return sites.rescale(rows, ["a", "b"], "b").select("event_id", six("a").alias("a"), six("b").alias("b"))


@query(f"WITH {SITES_2D} SELECT ix, round(y_full, 6) + 0.0 AS truth FROM s WHERE y0 IS NULL")
def held_out_rows(spark, sf_dir):
    return sites.held_out(sites.sites_2d(spark, sf_dir)).select("ix", six("y_full").alias("truth"))


@query(f"""WITH {SITES_2D}, j AS (SELECT y_full AS y, x2 AS mean, x2 - 0.3 AS lower, x2 + 0.3 AS upper FROM s WHERE y0 IS NULL)
SELECT count(*) AS n, round(sqrt(avg((mean - y) ** 2)), 6) AS rmse, round(avg(abs(mean - y)), 6) AS mae, round(avg((lower < y AND y < upper)::INTEGER), 6) AS coverage FROM j""")
def held_out_scores(spark, sf_dir):
    rows = sites.held_out(sites.sites_2d(spark, sf_dir))
    s = summaries.scores(rows.select(F.col("y_full").alias("truth"), F.col("x2").alias("mean"), (F.col("x2") - 0.3).alias("lower"), (F.col("x2") + 0.3).alias("upper")), truth="truth")
    return s.select("n", *[six(c).alias(c) for c in ("rmse", "mae", "coverage")])


CELLS = "s AS (SELECT vec_id, vec_id % 40 + 1 AS i, vec_id // 40 + 1 AS j FROM embeddings)"


def _cells(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (F.col("vec_id") % 40 + 1).alias("i"), F.expr("vec_id div 40 + 1").alias("j"))


@query(f"WITH {CELLS} SELECT * FROM s WHERE (i - 1) % 4 = 0 AND (j - 1) % 4 = 0")
def decimated(spark, sf_dir):
    return sites.decimate(_cells(spark, sf_dir), ["i", "j"], 4)


@query(f"WITH {CELLS} SELECT vec_id, (SELECT max(i) FROM s) + 1 - i AS i, (SELECT max(j) FROM s) + 1 - j AS j FROM s")
def reversed_axes(spark, sf_dir):
    return sites.reverse(sites.reverse(_cells(spark, sf_dir), "i"), "j")


@query("SELECT vec_id, i::INTEGER AS i, j::INTEGER AS j, round(embedding[(i - 1) * 4 + j]::DOUBLE, 6) + 0.0 AS value FROM embeddings, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([1, 2, 3, 4]) AS j)")
def melted(spark, sf_dir):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    matrix = F.array(*[F.array(*[e(4 * r + c) for c in range(4)]) for r in range(3)])
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", matrix.alias("m"))
    return sites.melt(rows, ["vec_id"], "m").select("vec_id", "i", "j", six("value").alias("value"))


@query("SELECT event_id, value, event_id % 3 AS slice FROM events")
def stacked(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", (F.col("event_id") % 3).alias("slice"))
    return sites.stack(sites.unstack(rows, "slice", [0, 1, 2]), "slice").withColumn("slice", F.col("slice").cast("long"))


@query("SELECT vec_id AS row, vec_id * 3 + k AS col, round(embedding[k + 1]::DOUBLE, 6) + 0.0 AS v FROM embeddings, (SELECT unnest([0, 1, 2]) AS k)")
def block_diagonal(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("z"))
    return sites.block_diagonal(rows, "vec_id", "z").select("row", F.col("col").cast("long").alias("col"), six("v").alias("v"))


@query("SELECT c_custkey, list_sort([c_custkey % 5, 7, 7, c_custkey % 3] )::VARCHAR AS a, (CASE WHEN c_custkey % 5 = c_custkey % 3 THEN [7] ELSE list_sort([c_custkey % 5, 7]) END)::VARCHAR AS rest FROM customer WHERE c_custkey % 5 <> 7")
def multiset_rest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, seven = F.col("c_custkey"), F.lit(7).cast("long")
    a = F.array_sort(F.array((k % 5).cast("long"), seven, seven, (k % 3).cast("long")))
    text = lambda c: F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
    rest = F.when(k % 5 == k % 3, sc.multiset_except(sc.multiset_except(a, F.array(seven, (k % 3).cast("long"))), F.array((k % 5).cast("long")))).otherwise(sc.multiset_except(a, F.array_sort(F.array(seven, (k % 3).cast("long")))))
    return rows.select("c_custkey", text(a).alias("a"), text(rest).alias("rest"))


@query("SELECT ps AS value FROM (SELECT DISTINCT event_id % 50 AS ps FROM events EXCEPT SELECT DISTINCT user_id % 20 FROM events)")
def values_left(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    of = lambda c: rows.select(c.alias("value")).distinct()  # noqa: E731  few values, before any of them is dealt to a task
    return of(F.col("event_id") % 50).subtract(of(F.col("user_id") % 20))


# --- tessellation and mesh ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {SITES_3D}, {thresholds_sql(GRID_3D)}, {levels_sql(3)}, {blocks_sql(3)} SELECT ix, block, (4 * (l3 % 2) + ((l1 - 1) * 2 + (l2 - 1)) % 4)::INTEGER AS color FROM b0")
def tess_color_3d(spark, sf_dir):
    return tess.tessellate(sites.sites_3d(spark, sf_dir), ["var1", "var2", "var3"], GRID_3D, colors=True).select("ix", "block", "color")


@query(f"WITH {SITES_2D}, {thresholds_sql((7, 7))}, {levels_sql(2)} SELECT l1, l2, count(*) AS n FROM lv GROUP BY ALL")
def tess_one_number(spark, sf_dir):
    """One number of intervals for all axes."""
    found = tess.tessellate(sites.sites_2d(spark, sf_dir), ["var1", "var2"], 7)
    return found.groupBy(F.col("l1").cast("long").alias("l1"), F.col("l2").cast("long").alias("l2")).agg(F.count("*").alias("n"))


@query(f"WITH {SITES_2D} SELECT count(*) / 25.0 * 2 AS size FROM s")
def block_size(spark, sf_dir):
    n = sites.sites_2d(spark, sf_dir).count()
    return spark.createDataFrame([(tess.average_block_size(n, GRID_2D, 2),)], "size double")


@query(f"WITH {MASKED_2D}, {COUNTS(2)} SELECT count(*) AS blocks, count(*) FILTER (WHERE n_obs > 0) AS reference, sum(n_rows) FILTER (WHERE n_obs > 0)::BIGINT AS reference_rows, sum(n_obs)::BIGINT AS observed FROM k")
def reference_blocks(spark, sf_dir):
    return mesh.reference_summary(tess.block_counts(masked_2d(spark, sf_dir), 2))


@query(f"WITH {MASKED_2D}, {COUNTS(2)} SELECT block, n_obs > 0 AS fitting, true AS predicting, true AS whole FROM k")
def computed_blocks(spark, sf_dir):
    blocks, n = tess.block_counts(masked_2d(spark, sf_dir), 2), F.col("n_obs")
    return blocks.select("block", mesh.compute_block(False, n).alias("fitting"), mesh.compute_block(True, n).alias("predicting"), mesh.compute_block(False, n, True).alias("whole"))


@query(f"""WITH {MASKED_2D}, {COUNTS(2)} SELECT * FROM (SELECT block AS child, lag(block) OVER (PARTITION BY l1 ORDER BY l2) AS parent, 0 AS slot FROM k
UNION ALL SELECT block, lag(block) OVER (PARTITION BY l2 ORDER BY l1), 1 FROM k) WHERE parent IS NOT NULL""")
def mesh_all_observed(spark, sf_dir):
    return mesh.mesh_edges(tess.block_counts(masked_2d(spark, sf_dir), 2), 2, all_observed=True)


#: First fit over blocks in order: earlier members' colours are looked up in the list so far.
FIRST_FIT = f"""{BLANKET}, o AS (SELECT block, row_number() OVER (ORDER BY block) AS i FROM k WHERE n_obs > 0),
nb AS (SELECT a.i, list(b.i) AS near FROM mb JOIN o a ON mb.block = a.block JOIN o b ON mb.member = b.block WHERE b.i < a.i GROUP BY 1),
fit AS (SELECT 0::BIGINT AS i, []::INTEGER[] AS cs UNION ALL
  SELECT fit.i + 1, list_append(cs, list_min(list_filter(range(0, 20), lambda c: NOT list_contains(list_transform(coalesce(near, []), lambda m: cs[m]), c)))::INTEGER)
  FROM fit JOIN o ON o.i = fit.i + 1 LEFT JOIN nb ON nb.i = o.i),
found AS (SELECT block, cs[o.i] AS color FROM o, (SELECT cs FROM fit ORDER BY i DESC LIMIT 1)),
colors AS (SELECT * FROM found UNION ALL SELECT block, (SELECT max(color) + 1 FROM found) FROM k WHERE n_obs = 0)"""


@query(f"WITH RECURSIVE {MASKED_2D}, {COUNTS(2)}, {EDGES_2D}, {FIRST_FIT} SELECT block, color::INTEGER AS color FROM colors")
def first_fit_colors(spark, sf_dir):
    blocks, edges = _mesh_2d(spark, sf_dir)
    return mesh.greedy_colors(mesh.blanket(edges, blocks), blocks)


@query(f"WITH RECURSIVE {MASKED_2D}, {COUNTS(2)}, {EDGES_2D}, {FIRST_FIT} SELECT color::INTEGER AS color, list_sort(list(block))::VARCHAR AS blocks FROM colors GROUP BY 1")
def color_groups(spark, sf_dir):
    blocks, edges = _mesh_2d(spark, sf_dir)
    found = mesh.color_groups(mesh.greedy_colors(mesh.blanket(edges, blocks), blocks))
    return found.select("color", F.concat(F.lit("["), F.array_join("blocks", ", "), F.lit("]")).alias("blocks"))


@query(f"""WITH RECURSIVE {MASKED_2D}, {COUNTS(2)}, {EDGES_2D}, path AS (SELECT block, 0 AS steps FROM k UNION SELECT child, steps + 1 FROM path JOIN edges ON parent = block)
SELECT block, max(steps)::INTEGER AS color FROM path GROUP BY 1""")
def group_repair(spark, sf_dir):
    """Groups of one colour for all blocks, repaired until no child shares its parent's."""
    blocks, edges = _mesh_2d(spark, sf_dir)
    return mesh.colors_apart(edges, blocks.select("block", F.lit(0).alias("color")))


def _sweeps_sql(sweeps: int) -> str:
    """Steps of a recolouring from one colour, axis after axis; a step of a valid colouring changes nothing."""
    parts, last = ["r0 AS (SELECT l1, l2, block, 0 AS color FROM k)"], "r0"
    for n in range(1, 2 * sweeps + 1):
        along, across = ("l1", "l2") if n % 2 else ("l2", "l1")
        line = f"OVER (PARTITION BY {across} ORDER BY {along})"
        same = f"color = lag(color) {line} AND row_number() {line} % 2 = 0"
        parts.append(f"r{n} AS MATERIALIZED (SELECT l1, l2, block, CASE WHEN {same} THEN (SELECT max(color) FROM {last}) + 1 ELSE color END AS color FROM {last})")
        last = f"r{n}"
    return ", ".join(parts)


@query(f"WITH {MASKED_2D}, {COUNTS(2)}, {_sweeps_sql(6)} SELECT block, color::INTEGER AS color FROM r12")
def axis_recolor(spark, sf_dir):
    """One colour for all blocks, changed until no block shares its neighbour's along any axis."""
    return mesh.axis_recolor(_mesh_2d(spark, sf_dir)[0].withColumn("color", F.lit(0)), 2).select("block", "color")


@query(f"""WITH {MASKED_2D}, {COUNTS(2)}, c AS (SELECT block, ((l1 - 1) * 2 + (l2 - 1)) % 4 AS color FROM k), e AS (SELECT block AS child, lag(block) OVER (PARTITION BY l1 ORDER BY l2) AS parent FROM k
UNION ALL SELECT block, lag(block) OVER (PARTITION BY l2 ORDER BY l1) FROM k)
SELECT child, parent, a.color::INTEGER AS color, b.color::INTEGER AS parent_color FROM e JOIN c a ON child = a.block JOIN c b ON parent = b.block""")
def sampling_graph(spark, sf_dir):
    blocks, edges = mesh.sampling_graph(masked_2d(spark, sf_dir), 2)
    a, b = blocks.select(F.col("block").alias("child"), "color"), blocks.select(F.col("block").alias("parent"), F.col("color").alias("parent_color"))
    return edges.join(a, "child").join(b, "parent").select("child", "parent", "color", "parent_color")


@query(f"WITH {MASKED_3D}, {COUNTS(3)} SELECT block, (4 * (l3 % 2) + ((l1 - 1) * 2 + (l2 - 1)) % 4)::INTEGER AS color FROM k")
def block_colors_3d(spark, sf_dir):
    return mesh.sampling_graph(masked_3d(spark, sf_dir), 3)[0].select("block", "color")


# --- covariances and scalars -------------------------------------------------------------------------------------------------------------


@query(f"WITH {PAIRS_2D} SELECT i, j, round(exp(-1.5 * h) + CASE WHEN i = j THEN 0.2 ELSE 0 END, 6) AS c FROM p")
def cov_nugget(spark, sf_dir):
    p = _pairs_2d(spark, sf_dir)
    return lined_up(p.select("i", "j", six_of(cov.with_nugget(cov.exponential(p["h"], 1.0, 1.5), p["i"] == p["j"], 0.2)).alias("c")), "c")


@query(f"WITH {PAIRS_2D}, d AS (SELECT r, s, CASE WHEN r = s THEN 0.0 ELSE 0.8 END AS v FROM (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1]) AS s)) SELECT i * 2 + r AS a, j * 2 + s AS b, round(1.3 / (d.v + 1) * exp(-2.0 * h / sqrt(d.v + 1)), 6) AS c FROM p, d")
def cov_matrix_q2(spark, sf_dir):
    """The matrix over sites and two components, by row and column."""
    p = _component_pairs(_blocks_2d(spark, sf_dir), TILE, [[0.0, 0.8], [0.8, 0.0]])
    c = cov.covariance(2, 2, p["h"], F.lit(0.0), p["v"], [1.3, 2.0])
    return p.select((F.col("i") * 2 + F.col("r")).alias("a"), (F.col("j") * 2 + F.col("s")).alias("b"), six_of(c).alias("c"))


@query(f"WITH {PAIRS_2D} SELECT i, j, round(2.0 * exp(-1.5 * h), 6) AS c0, round(2.0 * exp(-(1.5 * d1 * d1 + 3.0 * d2 * d2)) + CASE WHEN 1.5 * d1 * d1 + 3.0 * d2 * d2 = 0 THEN 0.001 ELSE 0 END, 6) AS c1 FROM p")
def cov_models(spark, sf_dir):
    """Two covariances of each pair; the nearest pairs come first, as their second ones have few values."""
    p = _pairs_2d(spark, sf_dir)
    of = lambda kind, params: six_of(cov.model(kind, 2, 1, p["h"], F.lit(0.0), p["v"], [p["d1"], p["d2"]], params))
    return lined_up(p.select("i", "j", of(0, [2.0, 1.5]).alias("c0"), of(1, [2.0, 1.5, 3.0]).alias("c1")), F.desc("c0"))


@query("SELECT n_nationkey, (n_nationkey + 1)::DOUBLE AS sigmasq, (n_nationkey + 2)::DOUBLE AS a, (n_nationkey + 3)::DOUBLE AS b, (n_nationkey + 4)::DOUBLE AS c, (n_nationkey + 5)::DOUBLE AS d2_1, (n_nationkey + 6)::DOUBLE AS d3_1, (n_nationkey + 7)::DOUBLE AS d3_2 FROM nation")
def unpacked_parameters(spark, sf_dir):
    params = F.array(*[F.col("n_nationkey").cast("double") + k for k in range(1, 8)])
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", *[c.alias(n) for n, c in cov.unpack(params, 2, 3).items()])


@query("SELECT * FROM (VALUES (2, 1, 1), (2, 2, 2), (2, 3, 6), (3, 1, 3), (3, 2, 4), (3, 3, 8)) t(dims, q, n)")
def parameter_counts(spark, sf_dir):
    return spark.createDataFrame([(d, q, cov.parameter_count(d, q)) for d in (2, 3) for q in (1, 2, 3)], "dims int, q int, n int")


XY = "(SELECT event_id, (event_id % 19 + 0.5) / 10.0 AS x, (event_id % 17 + 0.5) / 10.0 AS y FROM events)"


@query(f"SELECT event_id, round(-ln((2 - x) / x), 6) + 0.0 AS a, round(-ln((3 - y) / (y + 1)), 6) + 0.0 AS b, round(x, 6) AS back_a, round(y, 6) AS back_b FROM {XY}")
def vector_logits(spark, sf_dir):
    x, y, bounds = (F.col("event_id") % 19 + 0.5) / 10.0, (F.col("event_id") % 17 + 0.5) / 10.0, [(0.0, 2.0), (-1.0, 3.0)]
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", sc.logits(F.array(x, y), bounds).alias("t"))
    back = sc.logistics(F.col("t"), bounds)
    return rows.select("event_id", six(F.get("t", F.lit(0))).alias("a"), six(F.get("t", F.lit(1))).alias("b"), six(F.get(back, F.lit(0))).alias("back_a"), six(F.get(back, F.lit(1))).alias("back_b"))


@query(f"""SELECT event_id, round(2.0 * ln(3.0) - lgamma(2.0) + ln(x) - 3.0 * x, 6) + 0.0 AS g, round(0.5 * ln(y / 2) + 1.5 * ln(1 - y / 2), 6) + 0.0 AS b,
round(-0.5 * ln(2 * pi()) - ln(0.7) - ln(x) - (ln(x) - 0.1) ** 2 / (2 * 0.49), 6) + 0.0 AS ln, round(-0.5 * ln(2 * pi()) - 0.5 * ln(y) - 0.5 * x * x / y, 6) + 0.0 AS n FROM {XY}""")
def log_densities(spark, sf_dir):
    x, y = (F.col("event_id") % 19 + 0.5) / 10.0, (F.col("event_id") % 17 + 0.5) / 10.0
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = {"g": sc.gamma_logdens(x, 2.0, 3.0), "b": sc.beta_logdens(y / 2, 1.5, 2.5), "ln": sc.lognormal_logdens(x, 0.1, 0.7), "n": sc.gaussian_logdens(x, y)}
    return rows.select("event_id", *[six(c).alias(k) for k, c in found.items()])


@query(f"""SELECT event_id, round(ln(y) - ln(x), 6) + 0.0 AS jump, round((-3.0 * ln(y) - 2.0 / y) - (-3.0 * ln(x) - 2.0 / x) + (-4.0 * ln(x) - 3.0 / x) - (-4.0 * ln(y) - 3.0 / y), 6) + 0.0 AS prior,
exp(ln(y) - ln(x)) > 0.8 AS taken, CASE WHEN x < 0.5 THEN 0.5 WHEN x > 1.5 THEN 1.5 ELSE round(x, 6) END AS inside, x < 0.5 OR x > 1.5 AS moved FROM {XY}""")
def proposal_terms(spark, sf_dir):
    x, y = (F.col("event_id") % 19 + 0.5) / 10.0, (F.col("event_id") % 17 + 0.5) / 10.0
    inside, moved = sc.clamp(x, 0.5, 1.5)
    prior = sc.prior_log_ratio(F.array(x, y), F.array(y, x), [(2.0, 2.0), (3.0, 3.0)])
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", six(sc.lognormal_proposal(x, y)).alias("jump"), six(prior).alias("prior"), sc.accepted(sc.lognormal_proposal(x, y), F.lit(0.8)).alias("taken"), six(inside).alias("inside"), moved.alias("moved"))


@query("""WITH e AS (SELECT l_suppkey % 50 AS i, l_partkey % 50 AS j, sum(l_quantity::DOUBLE) AS v FROM lineitem GROUP BY ALL)
SELECT round(sum(abs(coalesce(a.v, 0) - coalesce(b.v, 0))), 3) AS asymmetry FROM (SELECT * FROM e WHERE i > j) a FULL JOIN (SELECT j AS i, i AS j, v FROM e WHERE i < j) b ON a.i = b.i AND a.j = b.j""")
def asymmetry(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_suppkey") % 50).alias("i"), (F.col("l_partkey") % 50).alias("j")).agg(F.sum(F.col("l_quantity").cast("double")).alias("v"))
    return sc.asymmetry(rows).select(F.round("asymmetry", 3).alias("asymmetry"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE * embedding[4]::DOUBLE + embedding[2]::DOUBLE * embedding[5]::DOUBLE + embedding[3]::DOUBLE * embedding[6]::DOUBLE, 6) + 0.0 AS zw FROM embeddings")
def coefficient_sums(spark, sf_dir):
    part = lambda k: F.slice("embedding", k, 3).cast("array<double>")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", six(summaries.weighted_sum(part(1), part(4))).alias("zw"))
