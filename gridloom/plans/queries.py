"""The registered queries of the spatial operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import covariance as cov
from ..functions import scalars as sc
from ..operators import fronts, gaussian, mesh, neighbors, summaries
from ..operators import tessellation as tess
from ..operators.kernels import Family
from ..operators.sampler import Settings, State
from ..operators.tables import cut
from ..sources import sites

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def six(c: Column | str) -> Column:
    """Six decimals; a negative zero counts as zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


GRID_2D, GRID_3D = (5, 5), (4, 3, 2)

# --- SQL of sites, levels and blocks -------------------------------------------------------------------------------------------------

SITES_2D = """s AS (SELECT vec_id AS ix, embedding[1]::DOUBLE AS var1, embedding[2]::DOUBLE AS var2, embedding[3]::DOUBLE AS y_full,
    CASE WHEN vec_id % 10 <> 0 THEN embedding[3]::DOUBLE END AS y0, embedding[4]::DOUBLE AS x2, label % 3 + 1 AS mv_id FROM embeddings)"""
SITES_3D = """s AS (SELECT event_id AS ix, user_id::DOUBLE AS var1, (event_id % 97)::DOUBLE AS var2, epoch_us(ts) / 86400000000.0 AS var3,
    CASE WHEN event_id % 7 <> 0 THEN value END AS y0 FROM events)"""


def thresholds_sql(intervals, table: str = "s", names=("var1", "var2", "var3")) -> str:
    parts = [
        f"SELECT {a} AS axis, i, x AS threshold FROM (SELECT {names[a - 1]}::DOUBLE AS x, row_number() OVER (ORDER BY {names[a - 1]}) - 1 AS rk, count(*) OVER () AS n FROM {table}), "
        f"(SELECT unnest(range(1, {k})) AS i) WHERE rk = i * n // {k}"
        for a, k in enumerate(intervals, 1)
    ]
    return "thr AS (" + " UNION ALL ".join(parts) + ")"


def levels_sql(dims: int, table: str = "s", out: str = "lv", names=("var1", "var2", "var3")) -> str:
    made = ", ".join(f"1 + len(list_filter(coalesce((SELECT list(threshold) FROM thr WHERE axis = {a}), []), lambda z: {names[a - 1]}::DOUBLE >= z)) AS l{a}" for a in range(1, dims + 1))
    return f"{out} AS (SELECT *, {made} FROM {table})"


def blocks_sql(dims: int, padded: bool = False, table: str = "lv", out: str = "b0") -> str:
    label = lambda a: f"lpad(l{a}::VARCHAR, 3, '0')" if padded else f"l{a}::VARCHAR"
    names = ", ".join(f"l{a}" for a in range(1, dims + 1))
    ranks = ", ".join(f"dense_rank() OVER (ORDER BY {label(a)}) - 1 AS r{a}" for a in range(1, dims + 1))
    block, scale = "1", "1"
    for a in range(1, dims + 1):
        block, scale = f"{block} + r{a} * {scale}", f"{scale} * (SELECT count(DISTINCT l{a}) FROM {table})"
    return f"{out} AS (SELECT {table}.*, blk.block FROM {table} JOIN (SELECT {names}, ({block})::INTEGER AS block FROM (SELECT *, {ranks} FROM (SELECT DISTINCT {names} FROM {table}))) blk USING ({names}))"


#: Blocked sites with two masks on y, as masked_2d() and masked_3d() make them, and their blocks.
MASKED_2D = f"{SITES_2D}, {thresholds_sql(GRID_2D)}, {levels_sql(2)}, {blocks_sql(2)}, b AS (SELECT *, CASE WHEN NOT (l1 >= 4 AND l2 >= 4) THEN y0 END AS y FROM b0)"
MASKED_3D = f"{SITES_3D}, {thresholds_sql(GRID_3D)}, {levels_sql(3)}, {blocks_sql(3)}, b AS (SELECT *, CASE WHEN NOT (l1 = 2 AND l2 >= 2) THEN y0 END AS y FROM b0)"
COUNTS = lambda d: f"k AS (SELECT {', '.join(f'l{a}' for a in range(1, d + 1))}, block, count(*) AS n_rows, count(y) AS n_obs FROM b GROUP BY ALL)"


def masked_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = tess.tessellate(sites.sites_2d(spark, sf_dir), ["var1", "var2"], GRID_2D)
    return blocked.withColumn("y", F.when(~((F.col("l1") >= 4) & (F.col("l2") >= 4)), F.col("y")))


def masked_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = tess.tessellate(sites.sites_3d(spark, sf_dir), ["var1", "var2", "var3"], GRID_3D)
    return blocked.withColumn("y", F.when(~((F.col("l1") == 2) & (F.col("l2") >= 2)), F.col("y")))


# --- tessellation --------------------------------------------------------------------------------------------------------------------


@query(f"WITH {SITES_2D}, {thresholds_sql((5, 7))} SELECT axis, i::INTEGER AS i, round(threshold, 6) AS threshold FROM thr")
def tess_thresholds_2d(spark, sf_dir):
    found = tess.order_statistics(sites.sites_2d(spark, sf_dir), ["var1", "var2"], (5, 7))
    return found.select("axis", "i", six("threshold").alias("threshold"))


@query(f"WITH {SITES_2D}, {thresholds_sql(GRID_2D)}, {levels_sql(2)} SELECT ix, l1, l2 FROM lv")
def tess_levels_2d(spark, sf_dir):
    return tess.tessellate(sites.sites_2d(spark, sf_dir), ["var1", "var2"], GRID_2D).select("ix", F.col("l1").cast("long").alias("l1"), F.col("l2").cast("long").alias("l2"))


@query(f"WITH {MASKED_2D}, {COUNTS(2)} SELECT block, n_rows, n_obs, round(n_obs / n_rows, 6) AS share_obs FROM k")
def tess_blocks_2d(spark, sf_dir):
    return tess.block_counts(masked_2d(spark, sf_dir), 2).select("block", "n_rows", "n_obs", six("share_obs").alias("share_obs"))


@query(f"WITH {MASKED_3D}, {COUNTS(3)} SELECT l1, l2, l3, block, n_rows, n_obs FROM k")
def tess_blocks_3d(spark, sf_dir):
    return tess.block_counts(masked_3d(spark, sf_dir), 3).select(*[F.col(c).cast("long").alias(c) for c in ("l1", "l2", "l3")], "block", "n_rows", "n_obs")


@query(f"WITH {SITES_2D}, {thresholds_sql((12, 4))}, {levels_sql(2)}, {blocks_sql(2, True)} SELECT ix, block FROM b0")
def tess_blocks_civ(spark, sf_dir):
    return tess.tessellate(sites.sites_2d(spark, sf_dir), ["var1", "var2"], (12, 4), padded=True).select("ix", "block")


@query(f"WITH {SITES_2D}, {thresholds_sql((12, 4))}, {levels_sql(2)}, {blocks_sql(2)} SELECT ix, block, (((l1 - 1) * 2 + (l2 - 1)) % 4)::INTEGER AS color FROM b0")
def tess_color(spark, sf_dir):
    return tess.tessellate(sites.sites_2d(spark, sf_dir), ["var1", "var2"], (12, 4), colors=True).select("ix", "block", "color")


TIES = "s AS (SELECT l_quantity::DOUBLE AS var1, l_discount::DOUBLE AS var2, epoch(l_shipdate::TIMESTAMP) / 86400 AS var3 FROM lineitem)"


@query(f"WITH {TIES}, {thresholds_sql((60, 6, 8))}, {levels_sql(3)} SELECT l1, l2, l3, count(*) AS n FROM lv GROUP BY ALL")
def tess_ties(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    rows = rows.select(F.col("l_quantity").cast("double").alias("var1"), F.col("l_discount").cast("double").alias("var2"), day.alias("var3"))
    found = tess.tessellate(rows, ["var1", "var2", "var3"], (60, 6, 8))
    return found.groupBy(*[F.col(c).cast("long").alias(c) for c in ("l1", "l2", "l3")]).agg(F.count("*").alias("n"))


FIXED = "thr AS (SELECT * FROM (VALUES (1, 1, -0.05), (1, 2, 0.0), (1, 3, 0.1), (2, 1, 0.0), (2, 2, 0.02)) t(axis, i, threshold))"


@query(f"WITH {SITES_2D}, {FIXED}, {levels_sql(2)}, {blocks_sql(2)} SELECT block, count(*) AS n FROM b0 GROUP BY 1")
def tess_fixed(spark, sf_dir):
    given = spark.createDataFrame([(1, 1, -0.05), (1, 2, 0.0), (1, 3, 0.1), (2, 1, 0.0), (2, 2, 0.02)], "axis int, i int, threshold double")
    return tess.tessellate(sites.sites_2d(spark, sf_dir), ["var1", "var2"], (4, 3), thresholds=given).groupBy("block").agg(F.count("*").alias("n"))


MIDS = """e AS (SELECT axis, 1 AS place, threshold::DOUBLE AS x FROM thr UNION ALL SELECT 1, 0, min(var1) FROM s UNION ALL SELECT 1, 2, max(var1) FROM s
    UNION ALL SELECT 2, 0, min(var2) FROM s UNION ALL SELECT 2, 2, max(var2) FROM s),
m AS (SELECT DISTINCT axis, (x + nx) / 2 AS mid FROM (SELECT axis, x, lead(x) OVER (PARTITION BY axis ORDER BY x, place) AS nx FROM e) WHERE nx IS NOT NULL),
g AS (SELECT a.mid AS var1, b.mid AS var2 FROM m a, m b WHERE a.axis = 1 AND b.axis = 2)"""


@query(f"WITH {SITES_2D}, {thresholds_sql((6, 5))}, {MIDS}, {levels_sql(2, 'g', 'lg')} SELECT round(var1, 6) AS var1, round(var2, 6) AS var2, l1, l2 FROM lg")
def fake_coords(spark, sf_dir):
    rows = sites.sites_2d(spark, sf_dir)
    found = tess.midpoints(rows, ["var1", "var2"], tess.collect_thresholds(tess.order_statistics(rows, ["var1", "var2"], (6, 5)), 2))
    return found.select(six("var1").alias("var1"), six("var2").alias("var2"), F.col("l1").cast("long").alias("l1"), F.col("l2").cast("long").alias("l2"))


@query(
    f"WITH {SITES_2D}, {thresholds_sql((30, 30))}, {MIDS}, {levels_sql(2, 'g', 'lg')}, {levels_sql(2)} "
    "SELECT lg.l1, lg.l2, round(var1, 6) AS var1, round(var2, 6) AS var2 FROM lg WHERE NOT EXISTS (SELECT 1 FROM lv WHERE lv.l1 = lg.l1 AND lv.l2 = lg.l2)"
)
def missing_blocks(spark, sf_dir):
    whole = tess.complete(sites.sites_2d(spark, sf_dir), ["var1", "var2"], (30, 30))
    return whole.where("ix is null").select(F.col("l1").cast("long").alias("l1"), F.col("l2").cast("long").alias("l2"), six("var1").alias("var1"), six("var2").alias("var2"))


@query(f"WITH {SITES_2D}, {thresholds_sql((30, 30))}, {levels_sql(2)}, c AS (SELECT ix, (l2 - 1) * 30 + l1 AS block FROM lv) SELECT ix, dense_rank() OVER (ORDER BY block)::INTEGER AS block FROM c")
def relabelled_blocks(spark, sf_dir):
    """Cells of a fine grid, of which many are empty, numbered without gaps."""
    levelled = tess.tessellate(sites.sites_2d(spark, sf_dir), ["var1", "var2"], (30, 30))
    cells = levelled.select("ix", ((F.col("l2") - 1) * 30 + F.col("l1")).alias("block"))
    return tess.relabel(cells).select("ix", F.col("block").cast("int").alias("block"))


# --- mesh ----------------------------------------------------------------------------------------------------------------------------

EDGES_2D = """ob AS (SELECT * FROM k WHERE n_obs > 0),
kk AS (SELECT *, CASE WHEN n_obs > 0 THEN block END AS ob FROM k),
eg AS (
 SELECT block AS child, lag(block) OVER (PARTITION BY l1 ORDER BY l2) AS parent, 0 AS slot FROM ob
 UNION ALL SELECT block, lag(block) OVER (PARTITION BY l2 ORDER BY l1), 1 FROM ob
 UNION ALL SELECT block, p, slot FROM (
  SELECT block, n_obs, last_value(ob IGNORE NULLS) OVER (PARTITION BY l1 ORDER BY l2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, 0 AS slot FROM kk
  UNION ALL SELECT block, n_obs, first_value(ob IGNORE NULLS) OVER (PARTITION BY l1 ORDER BY l2 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1 FROM kk
  UNION ALL SELECT block, n_obs, last_value(ob IGNORE NULLS) OVER (PARTITION BY l2 ORDER BY l1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2 FROM kk
  UNION ALL SELECT block, n_obs, first_value(ob IGNORE NULLS) OVER (PARTITION BY l2 ORDER BY l1 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 3 FROM kk) WHERE n_obs = 0),
edges AS (SELECT * FROM eg WHERE parent IS NOT NULL)"""


def _line_3d(axis: int, side: str) -> str:
    others = ", ".join(f"l{a}" for a in (1, 2, 3) if a != axis)
    return f"{side} OVER (PARTITION BY {others} ORDER BY l{axis} ROWS BETWEEN " + ("UNBOUNDED PRECEDING AND 1 PRECEDING)" if side.startswith("last") else "1 FOLLOWING AND UNBOUNDED FOLLOWING)")


EDGES_3D = (
    "ob AS (SELECT * FROM k WHERE n_obs > 0), kk AS (SELECT *, CASE WHEN n_obs > 0 THEN block END AS ob FROM k), eg AS ("
    + " UNION ALL ".join(f"SELECT block AS child, lag(block) OVER (PARTITION BY {', '.join(f'l{a}' for a in (1, 2, 3) if a != axis)} ORDER BY l{axis}) AS parent, {slot} AS slot FROM ob" for slot, axis in enumerate((2, 1, 3)))
    + " UNION ALL SELECT block, p, slot FROM ("
    + " UNION ALL ".join(f"SELECT block, n_obs, {_line_3d(axis, f)} AS p, {2 * place + side} AS slot FROM kk" for place, axis in enumerate((3, 2, 1)) for side, f in enumerate(("last_value(ob IGNORE NULLS)", "first_value(ob IGNORE NULLS)")))
    + ") WHERE n_obs = 0), edges AS (SELECT * FROM eg WHERE parent IS NOT NULL)"
)


def _mesh_2d(spark, sf_dir):
    blocks = cut(tess.block_counts(masked_2d(spark, sf_dir), 2))
    return blocks, cut(mesh.mesh_edges(blocks, 2))


@query(f"WITH {MASKED_2D}, {COUNTS(2)}, {EDGES_2D} SELECT child, parent, slot FROM edges")
def mesh_edges_2d(spark, sf_dir):
    return _mesh_2d(spark, sf_dir)[1]


@query(f"WITH {MASKED_3D}, {COUNTS(3)}, {EDGES_3D} SELECT child, parent, slot FROM edges")
def mesh_edges_3d(spark, sf_dir):
    return mesh.mesh_edges(cut(tess.block_counts(masked_3d(spark, sf_dir), 3)), 3)


@query(f"WITH {MASKED_2D}, {COUNTS(2)}, {EDGES_2D} SELECT child, list_sort(list(DISTINCT parent))::VARCHAR AS parents FROM edges JOIN k ON block = child WHERE n_obs = 0 GROUP BY 1")
def mesh_predict_parents(spark, sf_dir):
    blocks, edges = _mesh_2d(spark, sf_dir)
    alone = edges.join(blocks.where("n_obs = 0").select(F.col("block").alias("child")), "child", "left_semi")
    return alone.groupBy("child").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("parent")), ", "), F.lit("]")).alias("parents"))


REAL = "real AS (SELECT edges.* FROM edges JOIN k ON block = child WHERE n_obs > 0)"
BLANKET = f"""{REAL}, mb AS (SELECT child AS block, parent AS member FROM real UNION SELECT parent, child FROM real
  UNION SELECT a.parent, b.parent FROM real a JOIN real b ON a.child = b.child WHERE a.parent <> b.parent)"""


@query(f"WITH {MASKED_2D}, {COUNTS(2)}, {EDGES_2D}, {BLANKET} SELECT block, member FROM mb")
def mesh_blanket(spark, sf_dir):
    blocks, edges = _mesh_2d(spark, sf_dir)
    return mesh.blanket(edges, blocks)


@query(f"WITH {MASKED_2D}, {COUNTS(2)}, {EDGES_2D}, {REAL} SELECT DISTINCT a.parent AS parent1, b.parent AS parent2, a.child FROM real a JOIN real b ON a.child = b.child WHERE a.parent < b.parent")
def mesh_common_children(spark, sf_dir):
    blocks, edges = _mesh_2d(spark, sf_dir)
    return mesh.common_children(edges, blocks)


@query(f"WITH {MASKED_2D}, {COUNTS(2)} SELECT count(*) FILTER (WHERE n_obs > 0) AS colored, 0::BIGINT AS conflicts, count(*) AS blocks FROM k")
def color_conflicts(spark, sf_dir):
    blocks, edges = _mesh_2d(spark, sf_dir)
    members = mesh.blanket(edges, blocks)
    colors = mesh.greedy_colors(members, blocks)
    bad = mesh.color_conflicts(colors, members).agg(F.count("*").alias("conflicts"))
    seen = colors.join(blocks, "block").agg(F.count(F.when(F.col("n_obs") > 0, 1)).alias("colored"), F.count("*").alias("blocks"))
    return seen.crossJoin(bad).select("colored", "conflicts", "blocks")


@query(f"WITH {MASKED_2D}, {COUNTS(2)}, {EDGES_2D} SELECT child, slot, parent, count(*) AS n, sum(ix)::BIGINT AS ix_sum FROM edges JOIN b ON b.block = parent GROUP BY ALL")
def mesh_related_rows(spark, sf_dir):
    _, edges = _mesh_2d(spark, sf_dir)
    found = mesh.related_rows(edges, masked_2d(spark, sf_dir))
    return found.groupBy("child", "slot", "parent").agg(F.count("*").alias("n"), F.sum("ix").alias("ix_sum"))


@query(
    f"WITH {MASKED_2D}, {COUNTS(2)}, {EDGES_2D} SELECT child, slot, parent, coalesce(sum(n_rows) OVER (PARTITION BY child ORDER BY slot, parent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, n_rows AS n "
    "FROM edges JOIN k ON k.block = parent"
)
def mesh_parent_offsets(spark, sf_dir):
    blocks, edges = _mesh_2d(spark, sf_dir)
    return mesh.parent_offsets(edges, blocks)


#: Sites on a lattice by their id, 60 a row, in cells of 4 x 4 (the last ones cut by the table's end): congruent where they are whole.
LATTICE = """s AS (SELECT vec_id AS ix, (vec_id % 60) / 64.0 AS var1, (vec_id // 60) / 64.0 AS var2, ((vec_id // 60 // 4) * 15 + vec_id % 60 // 4)::INTEGER AS block FROM embeddings),
f AS (SELECT *, first_value(var1) OVER w AS o1, first_value(var2) OVER w AS o2 FROM s WINDOW w AS (PARTITION BY block ORDER BY var1, var2, ix)),
g AS (SELECT block, list(struct_pack(a := round((var1 - o1) * 10000)::BIGINT, b := round((var2 - o2) * 10000)::BIGINT) ORDER BY var1 - o1, var2 - o2) AS shape FROM f GROUP BY 1),
rep AS (SELECT block, min(block) OVER (PARTITION BY shape) AS representative FROM g)"""


def _lattice(spark, sf_dir):
    i = F.col("vec_id")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    column, row = i % 60, F.floor(i / 60)
    return rows.select(i.alias("ix"), (column / 64.0).alias("var1"), (row / 64.0).alias("var2"), (F.floor(row / 4) * 15 + F.floor(column / 4)).cast("int").alias("block"))


@query(f"WITH {LATTICE} SELECT block, representative FROM rep")
def congruent_blocks(spark, sf_dir):
    return mesh.congruence_keys(_lattice(spark, sf_dir), ["var1", "var2"])


@query(f"WITH {LATTICE} SELECT count(*) AS blocks, count(DISTINCT representative) AS shapes, round(100 - 100.0 * count(DISTINCT representative) / count(*), 6) AS hits FROM rep")
def cache_key_stats(spark, sf_dir):
    """How many blocks use another's factors."""
    return mesh.cache_hits(mesh.congruence_keys(_lattice(spark, sf_dir), ["var1", "var2"])).withColumn("hits", six("hits"))


@query(f"""WITH {LATTICE}, p AS (SELECT a.block, a.ix AS i, b.ix AS j, sqrt((a.var1 - b.var1) ** 2 + (a.var2 - b.var2) ** 2) AS h FROM s a JOIN s b ON a.block = b.block)
SELECT block, round(sum(2.0 * exp(-3.0 * h)), 5) AS total, count(*) AS n FROM p GROUP BY 1""")
def cached_block_sums(spark, sf_dir):
    """Sums of each block's covariances, made once for each shape and joined back to the blocks."""
    rows = cut(_lattice(spark, sf_dir))
    keys = cut(mesh.congruence_keys(rows, ["var1", "var2"]))
    some = rows.join(keys.select(F.col("representative").alias("block")).distinct(), "block", "left_semi")
    a, b, c = some.alias("a"), some.alias("b"), F.col
    pairs = a.join(b, c("a.block") == c("b.block")).select(c("a.block").alias("block"), cov.distance(c("a.var1"), c("a.var2"), c("b.var1"), c("b.var2")).alias("h"))
    sums = pairs.groupBy("block").agg(F.sum(cov.exponential(c("h"), 2.0, 3.0)).alias("total"), F.count("*").alias("n"))
    return mesh.from_representatives(keys, sums).select("block", F.round("total", 5).alias("total"), "n")


# --- covariances: pairs of sites within blocks ---------------------------------------------------------------------------------------

PAIRS_2D = f"{SITES_2D}, {thresholds_sql(GRID_2D)}, {levels_sql(2)}, {blocks_sql(2)}, p AS (SELECT a.ix AS i, b.ix AS j, sqrt((a.var1 - b.var1) ** 2 + (a.var2 - b.var2) ** 2) AS h, abs(a.mv_id - b.mv_id) / 2.0 AS v, a.mv_id AS mi, b.mv_id AS mj, a.var1 - b.var1 AS d1, a.var2 - b.var2 AS d2 FROM b0 a JOIN b0 b ON a.block = b.block AND a.ix <= b.ix)"
PAIRS_3D = """p AS (SELECT a.event_id AS i, b.event_id AS j, sqrt((a.event_id % 97 - b.event_id % 97) ** 2) / 97.0 AS h, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 86400000000.0 AS u, abs(a.event_id % 3 - b.event_id % 3) / 2.0 AS v
    FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <= b.event_id)"""


#: Rows of a block that a task of pairs compares with as many, about.
TILE = 2048
#: Pairs of small cells in a task that has as many pairs.
CELLS = 128
#: Rows of a cell that are paired at once where a pair has several components; a multiple of 8, as files pack values by eight.
RUN = 16


def _blocks_2d(spark, sf_dir):
    return cut(tess.tessellate(sites.sites_2d(spark, sf_dir), ["var1", "var2"], GRID_2D).select("ix", "block", "var1", "var2", "mv_id"))


def _pairs_2d(spark, sf_dir):
    """All pairs of sites of a block: its sites are dealt to tiles by a hash, and a task joins two tiles, so that no task has more pairs as tables grow."""
    return _paired(_blocks_2d(spark, sf_dir), TILE)


def _paired(rows, tile):
    counts = cut(rows.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    # so many that few tasks get several pairs of tiles, and what one sorts fits in its memory
    tasks = 3 * (counts.agg(F.sum(F.expr("tiles * (tiles + 1) div 2"))).head()[0] or 1)
    # rows of one ix lie in one tile, where both orders of them are pairs
    tiled = rows.where("ix is not null").join(F.broadcast(counts), "block").withColumn("tile", F.pmod(F.xxhash64("ix"), "tiles").cast("int"))
    # a tile is the first of the pairs of tiles from its own on, the second of those up to its own
    first = tiled.withColumns({"lo": F.col("tile"), "hi": F.explode(F.sequence("tile", F.col("tiles") - 1))})
    second = tiled.withColumns({"hi": F.col("tile"), "lo": F.explode(F.sequence(F.lit(0), "tile"))})
    a, b, c = first.repartition(tasks, "block", "lo", "hi").alias("a"), second.repartition(tasks, "block", "lo", "hi").alias("b"), F.col
    same = (c("a.block") == c("b.block")) & (c("a.lo") == c("b.lo")) & (c("a.hi") == c("b.hi"))
    both = a.join(b, same & ((c("a.lo") < c("a.hi")) | (c("a.ix") <= c("b.ix"))))
    ordered = c("a.ix") <= c("b.ix")
    turned = lambda x, y: F.when(ordered, x).otherwise(y)
    apart = lambda v: turned(c(f"a.{v}") - c(f"b.{v}"), c(f"b.{v}") - c(f"a.{v}"))
    return both.select(
        F.least("a.ix", "b.ix").alias("i"), F.greatest("a.ix", "b.ix").alias("j"), cov.distance(c("a.var1"), c("a.var2"), c("b.var1"), c("b.var2")).alias("h"), (F.abs(c("a.mv_id") - c("b.mv_id")) / 2.0).alias("v"),
        turned(c("a.mv_id"), c("b.mv_id")).alias("mi"), turned(c("b.mv_id"), c("a.mv_id")).alias("mj"), apart("var1").alias("d1"), apart("var2").alias("d2"),
    )


def _cells(rows, size):
    """block, cell, var1, var2 (its middle), wide (its longer side), rows: strips of a block along var1, cut along var2, of about so many rows each."""
    c, n = F.col, F.ceil(F.col("n") / size)
    counts = rows.groupBy("block").agg(F.count("*").alias("n")).withColumn("strips", F.ceil(F.sqrt(n)).cast("int")).withColumn("across", F.ceil(n / c("strips")).cast("int"))
    place = lambda by, *within: F.row_number().over(Window.partitionBy("block", *within).orderBy(by, "ix")) - 1
    strips = rows.where("ix is not null").join(F.broadcast(counts), "block").withColumn("strip", F.floor(place("var1") * c("strips") / c("n")).cast("int"))
    along = F.floor(place("var2", "strip") * c("across") / F.count("*").over(Window.partitionBy("block", "strip")))
    found = strips.withColumn("cell", (c("strip") * c("across") + along).cast("int"))
    # rows of one ix lie in one cell, where both orders of them are pairs
    found = found.withColumn("cell", F.min("cell").over(Window.partitionBy("block", "ix")))
    listed = F.sort_array(F.collect_list(F.struct("ix", "var1", "var2"))).alias("rows")
    wide = F.greatest(*[F.max(v) - F.min(v) for v in ("var1", "var2")]).alias("wide")
    return found.groupBy("block", "cell").agg(F.avg("var1").alias("var1"), F.avg("var2").alias("var2"), wide, listed)


def _component_pairs(rows, tile, latent):
    """i, j, r, s, h, v: the pairs of rows for all pairs of components and their latent distance v, those equally distant behind one another.

    Blocks are cut in cells, and pairs of cells are dealt by their width and how far apart they lie, about tile squared pairs of rows to a task: its values are
    few, so its file holds each once; and rows come as the matrix of two cells has them, so nothing is sorted.
    """
    cells = cut(_cells(rows, (tile * tile / CELLS) ** 0.5), "cells")
    c, key = F.col, ["block", "lo", "hi"]
    first = cells.select("block", c("cell").alias("lo"), c("rows").alias("some"), c("var1").alias("x"), c("var2").alias("y"), c("wide").alias("w"))
    second = cells.select("block", c("cell").alias("hi"), c("rows").alias("others"), "var1", "var2", "wide")
    apart = first.drop("some").join(second.drop("others"), "block").where("lo <= hi")
    apart = apart.select(*key, F.round(F.log2(c("w") + c("wide"))).alias("spread"), cov.distance(c("x"), c("y"), c("var1"), c("var2")).alias("apart"))
    tasks = -(-apart.count() // CELLS) or 1
    dealt = cut(apart.repartitionByRange(tasks, "spread", "apart", *key).select(*key, F.spark_partition_id().alias("task")), "dealt")
    lists = dealt.join(first.drop("x", "y", "w"), ["block", "lo"]).join(second.drop("var1", "var2", "wide"), ["block", "hi"]).repartitionById(tasks, "task")
    # a few rows behind one another for each pair of components: their equal values lie close together
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("others") - 1) / RUN).cast("int")), lambda k: F.slice("others", k * RUN + 1, RUN))
    each = lists.withColumn("others", runs).select("lo", "hi", F.explode("some").alias("a"), "others").select("lo", "hi", "a", F.explode("others").alias("others"))
    both = cov.component_pairs(each, latent).select("*", F.explode("others").alias("b")).where((c("lo") < c("hi")) | (c("a.ix") <= c("b.ix")))
    apart = cov.distance(c("a.var1"), c("a.var2"), c("b.var1"), c("b.var2"))
    return both.select(F.least("a.ix", "b.ix").alias("i"), F.greatest("a.ix", "b.ix").alias("j"), "r", "s", apart.alias("h"), "v")


def six_of(c):
    """six() of numbers from 0 to 10 ** 9, which pairs of sites are too many for: without decimal arithmetic, as SQL rounds."""
    return F.when(F.isnan(c), c).otherwise(F.floor(c * 1e6 + 0.5) / 1e6)


def lined_up(pairs, *values):
    """pairs of sites in the order of their values within a task: the same ones lie together, so files hold a run of them as one (a task has about TILE ** 2 pairs)."""
    return pairs.sortWithinPartitions(*values)


def _pairs_3d(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    a, b, c = rows.alias("a"), rows.alias("b"), F.col
    both = a.join(b, (c("a.user_id") == c("b.user_id")) & (c("a.event_id") <= c("b.event_id")))
    return both.select(
        c("a.event_id").alias("i"), c("b.event_id").alias("j"), (F.sqrt(F.pow(c("a.event_id") % 97 - c("b.event_id") % 97, 2)) / 97.0).alias("h"),
        (F.abs(c("a.t") - c("b.t")) / 86400000000.0).alias("u"), (F.abs(c("a.event_id") % 3 - c("b.event_id") % 3) / 2.0).alias("v"),
    )


def _covariance(name: str, pairs, with_sql: str, make, sql: str) -> None:
    def run(spark, sf_dir):
        p = pairs(spark, sf_dir)
        return lined_up(p.select("i", "j", six_of(make(p)).alias("c")), "c") if pairs is _pairs_2d else p.select("i", "j", six(make(p)).alias("c"))

    run.__name__ = name
    query(f"WITH {with_sql} SELECT i, j, round({sql}, 6) + 0.0 AS c FROM p")(run)


H, U, V = F.col, F.col, F.col
_covariance("cov_exp", _pairs_2d, PAIRS_2D, lambda p: cov.exponential(p["h"], 2.0, 1.5), "2.0 * exp(-1.5 * h)")
_covariance("cov_matern1", _pairs_2d, PAIRS_2D, lambda p: cov.matern(p["h"], 2.0, 3.0, 1), "CASE WHEN h = 0 THEN 2.0 ELSE 2.0 * exp(-3.0 * h) END")
_covariance("cov_matern3", _pairs_2d, PAIRS_2D, lambda p: cov.matern(p["h"], 2.0, 3.0, 3), "CASE WHEN h = 0 THEN 2.000001 ELSE 2.0 * exp(-3.0 * h) * (1 + 3.0 * h) END")
_covariance("cov_matern5", _pairs_2d, PAIRS_2D, lambda p: cov.matern(p["h"], 2.0, 3.0, 5), "CASE WHEN h = 0 THEN 2.0 ELSE 2.0 * exp(-3.0 * h) * (1 + 3.0 * h + 9.0 * h * h / 3) END")
_covariance("cov_space_biv", _pairs_2d, PAIRS_2D, lambda p: cov.space_two(p["h"], p["v"], 1.3, 2.0), "1.3 / (v + 1) * exp(-2.0 * h / sqrt(v + 1))")
_covariance("cov_space_multi", _pairs_2d, PAIRS_2D, lambda p: cov.covariance(2, 3, p["h"], F.lit(0.0), p["v"], [1.3, 0.7, 0.5, 2.0]), "1.3 / exp(0.5 * ln(1 + 0.7 * v)) * exp(-2.0 * h / exp(0.25 * ln(1 + 0.7 * v)))")
_covariance(
    "cov_mv_cross", _pairs_2d, PAIRS_2D,
    lambda p: cov.cross_outcome(p["h"], p["v"], 0.5 + p["mi"] * 0.25, 0.5 + p["mj"] * 0.25, 0.2 * p["mi"], 1.0 + p["mi"], 2, [2.0]),
    "CASE WHEN v = 0 THEN (0.5 + mi * 0.25) ** 2 * exp(-2.0 * h) + (0.2 * mi) ** 2 * exp(-(1.0 + mi) * h) ELSE (0.5 + mi * 0.25) * (0.5 + mj * 0.25) / (v + 1) * exp(-2.0 * h / sqrt(v + 1)) END",
)
_covariance("cov_ard", _pairs_2d, PAIRS_2D, lambda p: cov.ard([p["d1"], p["d2"]], [2.0, 5.0], 1.5), "1.5 * exp(-(2.0 * d1 * d1 + 5.0 * d2 * d2)) + CASE WHEN 2.0 * d1 * d1 + 5.0 * d2 * d2 = 0 THEN 0.001 ELSE 0 END")
_covariance("cov_gneiting_st", _pairs_3d, PAIRS_3D, lambda p: cov.covariance(3, 1, p["h"], p["u"], p["v"], [1.2, 0.3, 0.8, 2.0]), "1.2 / exp(0.8 * ln(1 + 0.3 * u)) * exp(-2.0 * h / exp(0.4 * ln(1 + 0.3 * u)))")
_covariance("cov_st_biv", _pairs_3d, PAIRS_3D, lambda p: cov.covariance(3, 2, p["h"], p["u"], p["v"], [1.2, 0.3, 0.8, 2.0]), "1.2 / exp(0.8 * ln(1 + 0.3 * u / sqrt(v + 1))) * exp(-2.0 * h / exp(0.4 * ln(1 + 0.3 * u / sqrt(v + 1)))) / sqrt(v + 1)")
_covariance(
    "cov_st_multi", _pairs_3d, PAIRS_3D, lambda p: cov.covariance(3, 3, p["h"], p["u"], p["v"], [1.2, 0.5, 0.9, 0.3, 0.8, 2.0]),
    "1.2 / exp(0.8 * ln(1 + 0.3 * u / exp(0.45 * ln(1 + 0.5 * v)))) * exp(-2.0 * h / exp(0.4 * ln(1 + 0.3 * u / exp(0.45 * ln(1 + 0.5 * v))))) / exp(0.45 * ln(1 + 0.5 * v))",
)


@query("SELECT h, u, v, round(1.2 / exp(0.8 * ln(1 + 0.3 * u / sqrt(v + 1))) * exp(-2.0 * h / exp(0.4 * ln(1 + 0.3 * u / sqrt(v + 1)))) / sqrt(v + 1), 6) AS c FROM (SELECT unnest(range(0, 21)) / 20.0 AS h), (SELECT unnest(range(0, 11)) / 10.0 AS u), (SELECT unnest(range(0, 3)) / 2.0 AS v)")
def cov_lag_grid(spark, sf_dir):
    axis = lambda n, d, c: spark.range(n).select((F.col("id") / F.lit(float(d))).alias(c))
    lags = axis(21, 20, "h").crossJoin(axis(11, 10, "u")).crossJoin(axis(3, 2, "v"))
    return lags.select("h", "u", "v", six(cov.space_time_two(F.col("h"), F.col("u"), F.col("v"), 1.2, 0.3, 0.8, 2.0)).alias("c"))


# --- draws, scores, cross products ---------------------------------------------------------------------------------------------------

DRAWS = "d AS (SELECT event_id // 10 AS draw, event_id % 10 AS ix, value::DOUBLE AS value FROM events)"


def quantile_sql(q: float) -> str:
    r, begin = f"({q} * n)", f"greatest({q} * n - 1, 0.0)"
    low, up = f"floor({begin})::INTEGER", f"ceil({begin})::INTEGER"
    lower = f"CASE WHEN {r} >= n / 2 THEN v[{low} + 1] ELSE v[greatest({up} - 1, 0) + 1] END"
    upper = f"CASE WHEN {r} >= n / 2 THEN v[least({low} + 1, n - 1) + 1] ELSE v[{up} + 1] END"
    return f"(0.5 - ({r} - floor({r} + 0.5))) * ({lower}) + (0.5 + ({r} - floor({r} + 0.5))) * ({upper})"


LISTED = "l AS (SELECT ix, list(value ORDER BY value) AS v, count(*) AS n FROM d GROUP BY 1)"


@query(f"WITH {DRAWS} SELECT ix, round(avg(value), 6) AS mean FROM d GROUP BY 1")
def draws_mean(spark, sf_dir):
    return summaries.draw_means(sites.pseudo_draws(spark, sf_dir)).select("ix", six("mean").alias("mean"))


@query(f"WITH {DRAWS}, {LISTED} " + " UNION ALL ".join(f"SELECT ix, {q}::DOUBLE AS prob, round({quantile_sql(q)}, 6) AS quantile FROM l" for q in (0.025, 0.05, 0.5, 0.95)))
def draws_quantile(spark, sf_dir):
    found = summaries.draw_quantiles(sites.pseudo_draws(spark, sf_dir), (0.025, 0.05, 0.5, 0.95))
    return found.select("ix", "prob", six("quantile").alias("quantile"))


@query(f"WITH {DRAWS} SELECT ix, round(quantile_cont(value, 0.25), 6) AS quantile FROM d GROUP BY 1")
def draws_quantile_linear(spark, sf_dir):
    return summaries.draw_quantiles(sites.pseudo_draws(spark, sf_dir), (0.25,), linear=True).select("ix", six("quantile").alias("quantile"))


@query(
    f"""WITH {DRAWS}, {LISTED}, q AS (SELECT ix, {quantile_sql(0.05)} AS lower, {quantile_sql(0.95)} AS upper FROM l), m AS (SELECT ix, avg(value) AS mean FROM d GROUP BY 1),
j AS (SELECT d.value AS y, mean, lower, upper FROM d JOIN m USING (ix) JOIN q USING (ix))
SELECT count(*) AS n, round(sqrt(avg((mean - y) ** 2)), 6) AS rmse, round(avg(abs(mean - y)), 6) AS mae, round(avg((lower < y AND y < upper)::INTEGER), 6) AS coverage, round(corr(mean, y), 6) AS corr FROM j"""
)
def score_rmse_mae_cov(spark, sf_dir):
    draws = sites.pseudo_draws(spark, sf_dir)
    limits = summaries.draw_quantiles(draws, (0.05, 0.95)).groupBy("ix").agg(F.min_by("quantile", "prob").alias("lower"), F.max_by("quantile", "prob").alias("upper"))
    joined = draws.select("ix", F.col("value").alias("y")).join(summaries.draw_means(draws), "ix").join(limits, "ix")
    s = summaries.scores(joined)
    return s.select("n", *[six(c).alias(c) for c in ("rmse", "mae", "coverage", "corr")])


@query("""SELECT l_returnflag AS g, count(*) AS n, round(sum(l_quantity::DOUBLE * l_quantity::DOUBLE), 2) AS xx_1_1, round(sum(l_quantity::DOUBLE * l_discount::DOUBLE), 2) AS xx_1_2, round(sum(l_discount::DOUBLE * l_discount::DOUBLE), 2) AS xx_2_2,
round(sum(l_quantity::DOUBLE * l_tax::DOUBLE), 2) AS xy_1, round(sum(l_discount::DOUBLE * l_tax::DOUBLE), 2) AS xy_2, round(sum(l_tax::DOUBLE * l_tax::DOUBLE), 2) AS yy FROM lineitem WHERE l_tax IS NOT NULL GROUP BY 1""")
def xtx_xty(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_returnflag", "g")
    found = summaries.cross_products(rows, ["l_quantity", "l_discount"], "l_tax", ["g"])
    return found.select("g", "n", *[F.round(c, 2).alias(c) for c in found.columns[2:]])


@query("""WITH a AS (SELECT sum(l_quantity::DOUBLE * l_quantity::DOUBLE) AS xx, sum(l_quantity::DOUBLE * l_tax::DOUBLE) AS xy FROM lineitem)
SELECT round(xy / 0.1 / (xx / 0.1 + 0.01), 9) AS mean, round(1 / (xx / 0.1 + 0.01), 9) AS var FROM a""")
def beta_postmean_p1(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", F.col("l_tax").cast("double").alias("rest"))
    mean, var = gaussian.beta_posterior(rows, ["l_quantity"], "rest", 0.1)
    return spark.createDataFrame([(round(float(mean[0]), 9), round(float(var[0, 0]), 9))], "mean double, var double")


@query("SELECT event_type, round(sum((value - 0.5 * (event_id % 3)) ** 2), 4) AS rss FROM events GROUP BY 1")
def rss(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = F.col("value") - 0.5 * (F.col("event_id") % 3)
    return rows.groupBy("event_type").agg(F.round(F.sum(e * e), 4).alias("rss"))


@query("SELECT event_id, round(avg((value > 0.5)::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS ratio, round(avg((value > 0.5)::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS recent FROM events")
def acceptance_ratio(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", (F.col("value") > 0.5).alias("hit"))
    found = summaries.running_ratio(rows, "hit", "event_id", 20, ["user_id"])
    return found.select("event_id", six("ratio").alias("ratio"), six("recent").alias("recent"))


# --- scalar functions and reshaping --------------------------------------------------------------------------------------------------


@query("SELECT event_id, round(-ln((2 - x) / (x + 1)), 6) + 0.0 AS t, round(-1 + 3 / (1 + exp(ln((2 - x) / (x + 1)))), 6) + 0.0 AS back FROM (SELECT event_id, (event_id % 19) / 10.0 - 0.9 + 0.05 AS x FROM events)")
def logit_logistic(spark, sf_dir):
    x = (F.col("event_id") % 19) / 10.0 - 0.9 + 0.05
    t = sc.logit(x, -1.0, 2.0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", six(t).alias("t"), six(sc.logistic(t, -1.0, 2.0)).alias("back"))


@query("SELECT event_id, round((-ln(2 - x) - ln(x)) - (-ln(2 - y) - ln(y)), 6) + 0.0 AS j, round(2.0 * ln(3.0) - lgamma(2.0) - 3.0 * ln(y) - 3.0 / y, 6) + 0.0 AS ig FROM (SELECT event_id, (event_id % 19 + 0.5) / 10.0 AS x, (event_id % 17 + 0.5) / 10.0 AS y FROM events)")
def log_jacobian(spark, sf_dir):
    x, y = (F.col("event_id") % 19 + 0.5) / 10.0, (F.col("event_id") % 17 + 0.5) / 10.0
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", six(sc.log_jacobian(x, y, 0.0, 2.0)).alias("j"), six(sc.invgamma_logdens(y, 2.0, 3.0)).alias("ig"))


@query("SELECT c_custkey, (CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * c_custkey)::INTEGER AS n FROM customer")
def hex_to_dec(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(F.when(F.col("c_custkey") % 2 == 0, "0x").otherwise("-"), F.hex("c_custkey"))
    return rows.select("c_custkey", sc.hex_to_int(text).alias("n"))


@query("""WITH v AS (SELECT n_nationkey, [n_nationkey + 1.0, n_nationkey + 2.0, n_nationkey + 3.0] AS v FROM nation)
SELECT n_nationkey, i, j, CASE WHEN i = j THEN 0.0::DOUBLE ELSE v[CASE WHEN least(i, j) = 1 THEN greatest(i, j) - 1 ELSE 3 END]::DOUBLE END AS value FROM v, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([1, 2, 3]) AS j)""")
def symmat(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    v = F.array(*[F.col("n_nationkey").cast("double") + k for k in (1.0, 2.0, 3.0)])
    return sc.symmetric_entries(rows.withColumn("v", v), "v", ["n_nationkey"])


@query("SELECT event_id, name, round(value, 6) AS value FROM (SELECT event_id, value AS a, value * 2 AS b FROM events) UNPIVOT INCLUDE NULLS (value FOR name IN (a, b))")
def unpivot_values(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("value").alias("a"), (F.col("value") * 2).alias("b"))
    return summaries.to_long(rows, ["event_id"], ["a", "b"]).select("event_id", "name", six("value").alias("value"))


@query("SELECT event_id // 4 AS draw, " + ", ".join(f"round(max(CASE WHEN event_id % 4 = {k} THEN value END), 6) AS s{k}" for k in range(4)) + " FROM events GROUP BY 1")
def pivot_values(spark, sf_dir):
    wide = summaries.to_wide(sites.pseudo_draws(spark, sf_dir, 4), ["draw"], "ix", "value", [0, 1, 2, 3])
    return wide.select("draw", *[six(str(k)).alias(f"s{k}") for k in range(4)])


@query("SELECT event_id, nullif(event_id % 5, 0) AS a FROM events")
def plot_nullif(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 5).alias("a"))
    return summaries.null_values(rows, 0, ["a"])


@query(f"WITH {SITES_2D} SELECT ix, round((var1 - m1) / r + 0.5, 6) AS var1, round((var2 - m2) / r + 0.5, 6) AS var2 FROM s, (SELECT avg(var1) AS m1, avg(var2) AS m2, max(var1) - min(var1) AS r FROM s)")
def scaled_coords(spark, sf_dir):
    found = sites.scaled(sites.sites_2d(spark, sf_dir), ["var1", "var2"], "var1")
    return found.select("ix", six("var1").alias("var1"), six("var2").alias("var2"))


@query(f"WITH {SITES_3D}, c AS (SELECT var2 AS t, avg(var1) AS cx, 0.0 AS cy FROM s GROUP BY 1) SELECT ix, (var1 - cx) ** 2 + (var2 - cy) ** 2 < 900 AS masked FROM s JOIN c ON var2 = t")
def cloud_mask(spark, sf_dir):
    rows = sites.sites_3d(spark, sf_dir).withColumn("t", F.col("var2"))
    centres = rows.groupBy("t").agg(F.avg("var1").alias("cx"), F.lit(0.0).alias("cy"))
    return sites.cloud_mask(rows, centres, 900.0, time="t").select("ix", "masked")


# --- nearest sites and kriging -------------------------------------------------------------------------------------------------------

#: Every tenth row has no y (sites_2d): these are the new sites, the others what is known of them.
NEAR = f"""{SITES_2D}, f AS (SELECT * FROM s WHERE y0 IS NOT NULL), n AS (SELECT * FROM s WHERE y0 IS NULL),
c AS (SELECT n.ix, n.y_full, f.ix AS near, f.y_full AS w, (n.var1 - f.var1) * (n.var1 - f.var1) + (n.var2 - f.var2) * (n.var2 - f.var2) AS d2 FROM n, f),
x AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY ix ORDER BY d2, near) = 1)"""


def _near(spark, sf_dir):
    rows = sites.sites_2d(spark, sf_dir)
    return neighbors.nearest_site(rows.where("y is null"), rows.where("y is not null"), keep=["y_full"])


@query(f"WITH {NEAR} SELECT ix, near, round(sqrt(d2), 6) AS dist FROM x")
def nn_block(spark, sf_dir):
    return _near(spark, sf_dir).select("ix", "near", six("dist").alias("dist"))


@query(f"WITH {NEAR} SELECT ix, round(exp(-1.5 * sqrt(d2)) * w, 6) + 0.0 AS mean, round(2.0 * (1 - exp(-3.0 * sqrt(d2))), 6) AS var FROM x")
def krige_1nn(spark, sf_dir):
    return _krige_1nn(spark, sf_dir).select("ix", six("mean").alias("mean"), six("var").alias("var"))


def _krige_1nn(spark, sf_dir):
    """Kriging from a block of one site: the nearest."""
    found = cut(_near(spark, sf_dir).withColumn("block", F.col("ix").cast("int")))
    rows = sites.sites_2d(spark, sf_dir)
    known = rows.select(F.col("ix").alias("near"), "var1", "var2").join(found.select("near", "block", F.array("y_full").alias("w_draws")), "near")
    known = known.select(F.col("block").cast("long").alias("ix"), "var1", "var2", "block", "w_draws")
    new = rows.select("ix", "var1", "var2").join(found.select("ix", "block"), "ix")
    none = spark.createDataFrame([], "child int, parent int, slot int")
    return gaussian.predict(new, known, none, [(2.0, 1.5)])


@query(f"WITH {NEAR} SELECT ix, round(1 / sqrt(2.0 * (1 - exp(-3.0 * sqrt(d2)))), 5) AS half FROM x WHERE d2 > 0")
def krige_half(spark, sf_dir):
    """One over the deviation that is left at each new site."""
    return _krige_1nn(spark, sf_dir).where("var > 0").select("ix", F.round(sc.inverse_deviation(F.col("var")), 5).alias("half"))


#: Covariances between outcomes a and b at a distance h, as cov_mv_cross has them, for kriging of an outcome from another's nearest site.
def cross_sql(a: str, b: str, h: str) -> str:
    return (
        f"CASE WHEN {a} = {b} THEN (0.5 + {a} * 0.25) ** 2 * exp(-2.0 * {h}) + (0.2 * {a}) ** 2 * exp(-(1.0 + {a}) * {h}) "
        f"ELSE (0.5 + {a} * 0.25) * (0.5 + {b} * 0.25) / 1.5 * exp(-2.0 * {h} / sqrt(1.5)) END"
    )


OUTCOMES = f"""{NEAR}, o AS (SELECT x.ix, x.w, sqrt(d2) AS h, a.mv_id AS a, b.mv_id AS b FROM x JOIN s a ON a.ix = x.ix JOIN s b ON b.ix = x.near),
k AS (SELECT *, {cross_sql("a", "b", "h")} AS c, {cross_sql("b", "b", "0.0")} AS kb, {cross_sql("a", "a", "0.0")} AS ka FROM o)"""


@query(f"WITH {OUTCOMES} SELECT ix, round(c / kb * w, 6) + 0.0 AS mean, round(greatest(0, ka - c * c / kb), 6) + 0.0 AS var FROM k")
def outcomes_1nn(spark, sf_dir):
    """Kriging of an outcome at each new site from the nearest site, whatever its outcome: three outcomes, a block of one site."""
    found = cut(_near(spark, sf_dir).withColumn("block", F.col("ix").cast("int")))
    rows = sites.sites_2d(spark, sf_dir).withColumn("comp", F.col("mv_id") - 1)
    known = rows.select(F.col("ix").alias("near"), "var1", "var2", "comp").join(found.select("near", "block", F.array("y_full").alias("w_draws")), "near")
    known = known.select(F.col("block").cast("long").alias("ix"), "var1", "var2", "comp", "block", "w_draws")
    new = rows.select("ix", "var1", "var2", "comp").join(found.select("ix", "block"), "ix")
    none = spark.createDataFrame([], "child int, parent int, slot int")
    # shared and own loadings, own decays, the core's decay, latent distances of a half
    theta = (0.75, 1.0, 1.25, 0.2, 0.4, 0.6, 2.0, 3.0, 4.0, 1.0, 1.0, 2.0, 0.5, 0.5, 0.5)
    found = gaussian.predict(new, known, none, [theta], Family(q=3, several=True))
    return found.select("ix", six("mean").alias("mean"), six("var").alias("var"))


# --- Gaussian process steps (tests hold those without SQL against dense matrices) -----------------------------------------------------

#: Sites of a block on average, from which the grid of the Gaussian queries follows.
BLOCK_SITES = 64


def _fitted(spark, sf_dir, masked: bool = False):
    """Blocked sites with w (the third component), y and z; masked: blocks of a corner without observations."""
    rows = sites.sites_2d(spark, sf_dir)
    side = max(2, round((rows.count() / BLOCK_SITES) ** 0.5))
    blocked = tess.tessellate(rows, ["var1", "var2"], (side, side)).withColumn("w", F.col("y_full"))
    if masked:
        blocked = blocked.withColumn("y", F.when(~((F.col("l1") > 0.7 * side) & (F.col("l2") > 0.7 * side)), F.col("y")))
    blocked = cut(blocked)
    return blocked, *gaussian.mesh_of(blocked)[1:]


@query(f"""WITH {SITES_2D}, r AS (SELECT ix, y_full AS w, row_number() OVER (ORDER BY ix) AS b, lag(y_full) OVER (ORDER BY ix) AS pw,
    sqrt((var1 - lag(var1) OVER (ORDER BY ix)) ** 2 + (var2 - lag(var2) OVER (ORDER BY ix)) ** 2) AS h FROM s),
c AS (SELECT b, w, CASE WHEN pw IS NULL THEN 0 ELSE exp(-2.0 * h) END AS k, coalesce(pw, 0) AS pw FROM r)
SELECT b::INTEGER AS block, round(-0.5 * ln(1.5 * (1 - k * k)), 6) + 0.0 AS logdet, round((w - k * pw) ** 2 / (1.5 * (1 - k * k)), 5) + 0.0 AS quad FROM c""")
def block_loglik(spark, sf_dir):
    """A chain of blocks of one site, each the parent of the next: the density of a block in closed form."""
    rows = sites.row_ids(sites.sites_2d(spark, sf_dir), ["ix"], "block").withColumn("block", F.col("block").cast("int")).withColumn("w", F.col("y_full"))
    rows = cut(rows)
    edges = rows.where("block > 1").select(F.col("block").alias("child"), (F.col("block") - 1).alias("parent"), F.lit(0).alias("slot"))
    found = gaussian.block_logliks(rows, edges, [(1.5, 2.0)])
    return found.select("block", six("logdet").alias("logdet"), (F.round("quad", 5) + F.lit(0.0)).alias("quad"))


#: A chain of blocks of one site: the filter's mean m and variance v of each, and the log density so far; then the smoother's, from the end.
CHAIN = f"""{SITES_2D}, r AS (SELECT ix, y_full AS y, row_number() OVER (ORDER BY ix) AS i, exp(-2.0 * sqrt((var1 - lag(var1) OVER (ORDER BY ix)) ** 2 + (var2 - lag(var2) OVER (ORDER BY ix)) ** 2)) AS k0 FROM s),
q AS (SELECT i, ix, y, coalesce(k0, 0.0) AS k FROM r),
f AS (SELECT 0::BIGINT AS i, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v, 0.0::DOUBLE AS ll, 0.0::DOUBLE AS a, 1.5::DOUBLE AS p UNION ALL
  SELECT q.i, k * m + (k * k * v + 1.5 * (1 - k * k)) / (k * k * v + 1.5 * (1 - k * k) + 0.1) * (y - k * m),
    (k * k * v + 1.5 * (1 - k * k)) * 0.1 / (k * k * v + 1.5 * (1 - k * k) + 0.1),
    ll - 0.5 * (ln(2 * pi() * (k * k * v + 1.5 * (1 - k * k) + 0.1)) + (y - k * m) ** 2 / (k * k * v + 1.5 * (1 - k * k) + 0.1)), k * m, k * k * v + 1.5 * (1 - k * k)
  FROM f JOIN q ON q.i = f.i + 1),
g AS (SELECT i, m AS x, v AS w FROM f WHERE i = (SELECT max(i) FROM q) UNION ALL
  SELECT f.i, f.m + f.v * q.k / n.p * (x - n.a), f.v + (f.v * q.k / n.p) ** 2 * (w - n.p) FROM g JOIN f ON f.i = g.i - 1 JOIN f AS n ON n.i = g.i JOIN q ON q.i = g.i WHERE f.i > 0)"""


def _chain(spark, sf_dir):
    """The sites as a chain of blocks of one site, each the parent of the next, dissected by their numbers."""
    rows = sites.row_ids(sites.sites_2d(spark, sf_dir), ["ix"], "block").withColumn("block", F.col("block").cast("int")).withColumn("y", F.col("y_full"))
    rows = cut(rows)
    edges = rows.where("block > 1").select(F.col("block").alias("child"), (F.col("block") - 1).alias("parent"), F.lit(0).alias("slot"))
    places = rows.select("block", F.col("block").cast("double").alias("var1"), F.lit(0.0).alias("var2"))
    return fronts.Dissection(rows, edges, places=places, leaf=32)


@query(f"WITH RECURSIVE {CHAIN} SELECT round(ll, 5) AS loglik FROM f WHERE i = (SELECT max(i) FROM q)")
def collapsed_chain(spark, sf_dir):
    """The log density of a chain's observations, the process integrated out: in SQL, a Kalman filter."""
    return spark.createDataFrame([(round(_chain(spark, sf_dir).collapsed((1.5, 2.0), 0.1), 5),)], "loglik double")


@query(f"WITH RECURSIVE {CHAIN} SELECT ix, round(x, 6) + 0.0 AS mean, round(w, 6) AS var FROM g JOIN q USING (i)")
def posterior_chain(spark, sf_dir):
    """The posterior mean and variance at each site of a chain: in SQL, a Kalman smoother."""
    found = _chain(spark, sf_dir).posterior((1.5, 2.0), 0.1)
    return found.select("ix", six(F.get("mean", F.lit(0))).alias("mean"), six(F.get("var", F.lit(0))).alias("var"))


@query()
def collapsed_mesh(spark, sf_dir):
    """The collapsed log density of the sites' mesh for some parameters."""
    blocked, edges, _ = _fitted(spark, sf_dir, masked=True)
    whole = fronts.Dissection(blocked, edges)
    return spark.createDataFrame([(s2, phi, t2, whole.collapsed((s2, phi), t2)) for s2, phi, t2 in ((0.05, 1.0, 0.01), (0.05, 4.0, 0.01), (0.05, 4.0, 0.1))], "sigmasq double, phi double, tausq double, loglik double")


@query()
def posterior_mesh(spark, sf_dir):
    """The posterior mean and variance of the process at each site of the mesh, by the selected inverse."""
    blocked, edges, _ = _fitted(spark, sf_dir, masked=True)
    found = fronts.Dissection(blocked, edges).posterior((0.05, 4.0), 0.01)
    return found.select("ix", F.get("mean", F.lit(0)).alias("mean"), F.get("var", F.lit(0)).alias("var"))


@query()
def theta_grid_loglik(spark, sf_dir):
    blocked, edges, _ = _fitted(spark, sf_dir)
    grid = [(s2, phi) for s2 in (0.01, 0.1, 1.0) for phi in (1.0, 4.0, 16.0)]
    names = spark.createDataFrame([(k, *t) for k, t in enumerate(grid)], "theta int, sigmasq double, phi double")
    return names.join(gaussian.loglik(gaussian.block_logliks(blocked, edges, grid)), "theta")


@query()
def coefficients_loglik(spark, sf_dir):
    """Two coefficient processes, on the sites' third and fourth components."""
    blocked, edges, _ = _fitted(spark, sf_dir)
    return gaussian.loglik(gaussian.block_logliks(blocked.withColumn("w", F.array("y_full", "x2")), edges, [(0.05, 2.0, 0.5), (0.05, 8.0, 0.5)], Family(q=2)))


@query()
def outcomes_loglik(spark, sf_dir):
    """Three outcomes, a row each."""
    blocked, edges, _ = _fitted(spark, sf_dir)
    theta = (0.2, 0.2, 0.2, 0.1, 0.1, 0.1, 2.0, 2.0, 2.0, 0.5, 0.5, 2.0, 0.3, 0.6, 0.9)
    return gaussian.loglik(gaussian.block_logliks(blocked.withColumn("comp", F.col("mv_id") - 1), edges, [theta], Family(q=3, several=True)))


@query()
def precision_entries(spark, sf_dir):
    blocked, edges, _ = _fitted(spark, sf_dir)
    return gaussian.precision_entries(blocked, edges, (1.0, 4.0))


@query()
def gibbs_sweep(spark, sf_dir):
    """The process's conditional means at all sites, colour by colour, each given those of the earlier ones."""
    blocked, edges, colors = _fitted(spark, sf_dir)
    return gaussian.gibbs_means(blocked, edges, colors, (1.0, 4.0), 0.1).select("ix", F.get("w", F.lit(0)).alias("w"))


@query()
def chain_draws(spark, sf_dir):
    """Parameter draws of two iterations of jobs: a test of the steps, too short a chain to infer anything from."""
    blocked, edges, colors = _fitted(spark, sf_dir, masked=True)
    return gaussian.fit(blocked, edges, colors, Settings(keep=2), x=["x2"])[0]


@query()
def chains_on_tasks(spark, sf_dir):
    """Means of the parameters over the kept draws of two chains of 300 iterations on a simulated grid of 25 x 25 sites, a task each."""
    rows = sites.grid(spark, (25, 25)).withColumn("ix", F.col("ix").cast("long"))
    rows = gaussian.simulated(rows, (1.0, 4.0), 0.1, seed=3)
    blocked = cut(tess.tessellate(rows, ["var1", "var2"], (5, 5)))
    _, edges, colors = gaussian.mesh_of(blocked)
    parameters, _ = gaussian.fit_chains(blocked, edges, colors, Settings(keep=100, burn=200), chains=2)
    return parameters.groupBy("chain", "name").agg(F.avg("value").alias("mean"), F.count("*").alias("draws"))


@query()
def predict_block(spark, sf_dir):
    """Kriging of every row without y from its nearest site's block, for two draws."""
    blocked, edges, _ = _fitted(spark, sf_dir)
    known = blocked.where("y is not null").withColumn("w_draws", F.array("w", F.col("w") * 0.5))
    unseen = blocked.where("y is null")
    near = neighbors.nearest_site(unseen, known, keep=["block"])
    new = unseen.select("ix", "var1", "var2").join(near.select("ix", "block"), "ix")
    return gaussian.predict(new, known, edges, [(1.0, 4.0), (1.0, 2.0)], tausq=[0.1, 0.1])


@query()
def outcomes_predict(spark, sf_dir):
    """Kriging of three outcomes at every row without y, from the block of its nearest site and those before it, for two draws of one theta."""
    blocked, edges, _ = _fitted(spark, sf_dir)
    blocked = cut(blocked.withColumn("comp", F.col("mv_id") - 1))
    known = blocked.where("y is not null").withColumn("w_draws", F.array("w", F.col("w") * 0.5))
    unseen = blocked.where("y is null")
    near = neighbors.nearest_site(unseen, known, keep=["block"])
    new = unseen.select("ix", "var1", "var2", "comp").join(near.select("ix", "block"), "ix")
    theta = (0.2, 0.2, 0.2, 0.1, 0.1, 0.1, 2.0, 2.0, 2.0, 0.5, 0.5, 2.0, 0.3, 0.6, 0.9)
    return gaussian.predict(new, known, edges, [theta, theta], Family(q=3, several=True), tausq=[0.1, 0.1])


@query()
def latent_means(spark, sf_dir):
    """Three outcomes whose process lives on a lattice over the sites' range, a node for each outcome: a sweep of conditional means there, and the means at all sites."""
    rows = sites.sites_2d(spark, sf_dir).withColumn("comp", F.col("mv_id") - 1)
    box = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{g}_{c}") for c in ("var1", "var2") for f, g in ((F.min, "lo"), (F.max, "hi"))]).head()
    a_side = max(4, round((box["n"] / 6) ** 0.5))
    place = {c: F.lit(box[f"lo_{c}"]) + F.col(c) * (box[f"hi_{c}"] - box[f"lo_{c}"]) for c in ("var1", "var2")}
    nodes = sites.grid(spark, (a_side, a_side)).withColumns(place).withColumn("comp", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    nodes = nodes.select((F.col("ix") * 3 + F.col("comp")).alias("ix"), "var1", "var2", "comp", F.lit(0.0).alias("w"))
    side = max(2, round((3 * a_side * a_side / BLOCK_SITES) ** 0.5))
    blocked = cut(tess.tessellate(nodes, ["var1", "var2"], (side, side)))
    placed, edges, colors = gaussian.latent_mesh(blocked, rows)
    engine = gaussian.SparkEngine(blocked, edges, colors, Family(q=3, several=True), data=placed)
    state = State([0.2, 0.2, 0.2, 0.1, 0.1, 0.1, 2.0, 2.0, 2.0, 0.5, 0.5, 2.0, 0.3, 0.6, 0.9], [0.1, 0.1, 0.1])
    engine.sweep(state, (0, 0), noise=False)
    return engine.values(state).select("ix", F.get("w", F.lit(0)).alias("w"))


@query()
def mvn_draws(spark, sf_dir):
    return gaussian.multivariate_normal(spark, 1000, [1.0, -1.0], [[2.0, 0.5], [0.5, 1.0]])
