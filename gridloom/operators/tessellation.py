"""Blocks of a coordinate domain: order-statistic thresholds, levels, block ids, midpoints of empty blocks.

Tables: sites have ix and the coordinates var1, var2 (and var3, time), and y, null or not finite where it is to be predicted. Every step is
a DataFrame expression. Thresholds are exact at any size: ranks come from counts of bins, never from one sorted partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sites import row_ids
from .tables import doubles

#: Buckets of an axis whose values are counted: 16 for an interval within these limits.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 10, 1 << 16


def is_observed(y: Column) -> Column:
    """Whether y is a finite number."""
    return y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))


def ordered_place(x: Column, values: Sequence[float]) -> Column:
    """How many of the sorted values are at or under x: a binary search whose steps, not values, are evaluated."""
    if not values:
        return F.lit(0)
    steps = F.lit([1 << k for k in reversed(range(len(values).bit_length()))])
    held = doubles(values)
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(held, n + step - 1) <= x, step).otherwise(F.lit(0)))


def order_statistics(df: DataFrame, axes: Sequence[str], intervals: Sequence[int]) -> DataFrame:
    """axis (from 1), i, threshold: for i = 1, ..., k - 1 the value that floor(i * n / k) others come before in the axis's order.

    Approximate quantiles cut each axis in buckets, many more than intervals; one aggregate counts all buckets of all axes. So the bucket of every
    rank is known, and only the values of these buckets, a row for each, are shuffled and ranked. Expressions are as many as axes, however
    many the intervals.
    """
    spark = df.sparkSession
    wanted = {a: k for a, k in enumerate(intervals, 1) if k > 1}
    schema = "axis int, i int, threshold double"
    if not wanted:
        return spark.createDataFrame([], schema)
    x = {a: F.col(axes[a - 1]).cast("double") for a in wanted}
    x = {a: F.when(~F.isnan(c), c) for a, c in x.items()}  # null where there is no number
    parts = {a: min(MOST_BUCKETS, max(LEAST_BUCKETS, 16 * k)) for a, k in wanted.items()}
    cuts = df.agg(*[F.percentile_approx(x[a], doubles(p / n for p in range(1, n)), F.lit(10_000)).alias(f"p{a}") for a, n in parts.items()]).head()
    cuts = {a: sorted(set(cuts[f"p{a}"] or [])) for a in wanted}
    each = F.array(*[F.when(x[a].isNotNull(), F.struct(F.lit(a).alias("axis"), ordered_place(x[a], cuts[a]).alias("bucket"), x[a].alias("x"))) for a in wanted])
    placed = df.select(F.explode(F.array_compact(each)).alias("v")).select("v.*")
    counts = placed.groupBy("axis", "bucket").agg(F.count("*").alias("n")).orderBy("axis", "bucket").collect()  # one row a bucket
    total = {a: sum(r["n"] for r in counts if r["axis"] == a) for a in wanted}
    ranks = {a: [(i * total[a] // k, i) for i in range(1, k)][::-1] for a, k in wanted.items()}
    before, sought = {a: 0 for a in wanted}, []
    for r in counts:
        a = r["axis"]
        while ranks[a] and ranks[a][-1][0] < before[a] + r["n"]:
            rank, i = ranks[a].pop()
            sought.append((a, r["bucket"], i, rank - before[a]))
        before[a] += r["n"]
    if not sought:
        return spark.createDataFrame([], schema)
    sought = F.broadcast(spark.createDataFrame(sought, "axis int, bucket int, i int, rank long"))  # one row an interval
    held = placed.join(sought.select("axis", "bucket").distinct(), ["axis", "bucket"], "left_semi").groupBy("axis", "bucket", "x").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("axis", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.withColumn("end", F.sum("n").over(upto)).join(sought, ["axis", "bucket"])
    return ranked.where("end > rank and end - n <= rank").select("axis", "i", F.col("x").alias("threshold"))


def collect_thresholds(thresholds: DataFrame, dims: int) -> list[list[float]]:
    """The ordered thresholds of each axis; as many as the axes have intervals, so the driver can hold them."""
    out: list[list[float]] = [[] for _ in range(dims)]
    for axis, threshold in thresholds.select("axis", "threshold").orderBy("axis", "threshold").collect():
        out[axis - 1].append(threshold)
    return out


def level(x: Column, thresholds: Sequence[float]) -> Column:
    """1 + the number of the sorted thresholds at or under x."""
    return F.when(x.isNotNull(), 1 + ordered_place(x, thresholds))


def with_levels(df: DataFrame, axes: Sequence[str], thresholds: Sequence[Sequence[float]]) -> DataFrame:
    """df with l1, ..., ld by the thresholds of each axis: a projection, without a shuffle."""
    return df.withColumns({f"l{a}": level(F.col(c).cast("double"), t) for a, (c, t) in enumerate(zip(axes, thresholds, strict=True), 1)})


def with_blocks(levelled: DataFrame, dims: int, padded: bool = False) -> DataFrame:
    """levelled with block: the first axis runs fastest, 1 + r1 + n1 * r2 + n1 * n2 * r3 over the ranks of levels among those present.

    Ranks follow the levels as strings ("1", "10", "2"); padded: in numeric order, as labels of three digits. An axis has at most as many
    levels as intervals, so the ranks are literals of the projection.
    """
    names = [f"l{a}" for a in range(1, dims + 1)]
    present = levelled.agg(*[F.collect_set(c).alias(c) for c in names]).head()
    block, scale = F.lit(1), 1
    for c in names:
        label = (lambda v: f"{v:03d}") if padded else str
        order = sorted(present[c], key=label)
        ranks = [0] * (max(order, default=0) + 1)
        for rank, v in enumerate(order):
            ranks[v] = rank
        block, scale = block + F.get(F.lit(ranks), F.col(c)) * scale, scale * len(order)
    return levelled.withColumn("block", block.cast("int"))


def color(dims: int) -> Column:
    """A checkerboard colour of levels."""
    flat = F.pmod((F.col("l1") - 1) * 2 + (F.col("l2") - 1), F.lit(4))
    return (flat if dims == 2 else 4 * F.pmod(F.col("l3"), F.lit(2)) + flat).cast("int")


def tessellate(df: DataFrame, axes: Sequence[str], intervals: Sequence[int] | int, thresholds: DataFrame | None = None, padded: bool = False, colors: bool = False) -> DataFrame:
    """df with l1, ..., ld, block (and color): thresholds from the data unless given (axis, i, threshold)."""
    intervals = [intervals] * len(axes) if isinstance(intervals, int) else list(intervals)
    found = order_statistics(df, axes, intervals) if thresholds is None else thresholds
    blocked = with_blocks(with_levels(df, axes, collect_thresholds(found, len(axes))), len(axes), padded)
    return blocked.withColumn("color", color(len(axes))) if colors else blocked


def midpoints(df: DataFrame, axes: Sequence[str], thresholds: Sequence[Sequence[float]]) -> DataFrame:
    """var1, ..., vard, l1, ..., ld: the middle of every cell of the grid that the thresholds make between each axis's least and greatest value."""
    limits = df.agg(*[f(F.col(c).cast("double")).alias(f"{g}_{c}") for c in axes for f, g in ((F.min, "lo"), (F.max, "hi"))]).head()
    names = [f"var{a}" for a in range(1, len(axes) + 1)]
    columns = []
    for name, c, inner in zip(names, axes, thresholds, strict=True):
        ends = sorted([limits[f"lo_{c}"], *inner, limits[f"hi_{c}"]])
        mids = sorted({(x + y) / 2 for x, y in zip(ends, ends[1:], strict=False)})
        columns.append(df.sparkSession.createDataFrame([(m,) for m in mids], f"{name} double"))
    return with_levels(reduce(DataFrame.crossJoin, columns), names, thresholds)


def block_counts(blocked: DataFrame, dims: int, y: str = "y") -> DataFrame:
    """l1, ..., ld, block, n_rows, n_obs, share_obs of each block."""
    names = [f"l{a}" for a in range(1, dims + 1)]
    seen = F.count(F.when(is_observed(F.col(y)), 1))
    return blocked.groupBy(*names, "block").agg(F.count("*").alias("n_rows"), seen.alias("n_obs"), (seen / F.count("*")).alias("share_obs"))


def missing_levels(blocked: DataFrame, grid: DataFrame, dims: int) -> DataFrame:
    """The grid's cells (midpoints) whose levels no row of blocked has."""
    names = [f"l{a}" for a in range(1, dims + 1)]
    empty = grid.select(*names).subtract(blocked.select(*names))
    return empty.join(grid, names, "left")


def complete(df: DataFrame, axes: Sequence[str], intervals: Sequence[int], y: str = "y") -> DataFrame:
    """Blocked rows of df and, for each cell without a row, one synthetic row at its middle (ix and y null)."""
    thresholds = collect_thresholds(order_statistics(df, axes, intervals), len(axes))
    blocked = with_levels(df, axes, thresholds)
    added = missing_levels(blocked, midpoints(df, axes, thresholds), len(axes))
    whole = blocked.unionByName(added.withColumnsRenamed({f"var{a}": c for a, c in enumerate(axes, 1)}), allowMissingColumns=True)
    return with_blocks(whole, len(axes))


def relabel(df: DataFrame, column: str = "block") -> DataFrame:
    """df with the column's distinct values numbered 1, 2, ... in order."""
    values = row_ids(df.select(column).distinct(), [column], "_place")
    return df.join(values, column).withColumn(column, F.col("_place")).drop("_place")


def average_block_size(rows: int, intervals: Sequence[int], q: int = 1) -> float:
    """Rows (times q) of a block on average; over 100 a block's dense matrices get slow."""
    cells = reduce(lambda a, b: a * b, intervals, 1)
    return rows / cells * q
