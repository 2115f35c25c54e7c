"""Site tables: from Parquet, from the supplied tables, and generated grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import cut


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_draws(draws: DataFrame, path: str) -> None:
    draws.write.mode("overwrite").parquet(path)


def sites_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ix, var1, var2, y_full, y (null for every tenth row), mv_id from the embeddings' first components."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(
        F.col("vec_id").alias("ix"), e(0).alias("var1"), e(1).alias("var2"), e(2).alias("y_full"), F.when(F.col("vec_id") % 10 != 0, e(2)).alias("y"), e(3).alias("x2"), (F.col("label") % 3 + 1).alias("mv_id")
    )


def sites_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ix, var1, var2, var3 (days), y (null for every seventh row) from the events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    days = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400000000.0)
    return rows.select(F.col("event_id").alias("ix"), F.col("user_id").cast("double").alias("var1"), (F.col("event_id") % 97).cast("double").alias("var2"), days.alias("var3"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("y"))


def pseudo_draws(spark: SparkSession, sf_dir: str, sites: int = 10) -> DataFrame:
    """draw, ix, value: the events dealt as draws of a few sites."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.floor(F.col("event_id") / sites).alias("draw"), (F.col("event_id") % sites).alias("ix"), F.col("value").cast("double").alias("value"))


def grid(spark: SparkSession, sizes: Sequence[int]) -> DataFrame:
    """ix, var1, ..., vard: a regular grid within (0, 1): size + 2 even steps an axis, without the two at the ends."""
    axes = [spark.range(1, n + 1).select((F.col("id") / F.lit(float(n + 1))).alias(f"var{a}"), F.col("id").alias(f"i{a}")) for a, n in enumerate(sizes, 1)]
    cells = reduce(lambda a, b: a.crossJoin(b), axes)
    place, scale = F.lit(1).cast("long"), 1
    for a, n in enumerate(sizes, 1):
        place, scale = place + (F.col(f"i{a}") - 1) * scale, scale * n
    return cells.select(place.alias("ix"), *[f"var{a}" for a in range(1, len(sizes) + 1)])


def scaled(df: DataFrame, axes: Sequence[str], by: str) -> DataFrame:
    """df with the axes centred and divided by the range of one of them, plus a half."""
    middle = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in axes], (F.max(by) - F.min(by)).alias("_range"))
    wide = df.crossJoin(F.broadcast(middle))
    return wide.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col("_range") + 0.5 for c in axes}).select(*df.columns)


def cloud_mask(df: DataFrame, centres: DataFrame, r2: float, x: str = "var1", y: str = "var2", time: str = "var3") -> DataFrame:
    """df with masked: whether a site lies within a disc (squared radius r2) around its time slice's centre (columns time, cx, cy)."""
    joined = df.join(centres, time, "left")
    inside = (F.col(x) - F.col("cx")) * (F.col(x) - F.col("cx")) + (F.col(y) - F.col("cy")) * (F.col(y) - F.col("cy")) < r2
    return joined.withColumn("masked", F.coalesce(inside, F.lit(False))).select(*df.columns, "masked")


def row_ids(df: DataFrame, order: Sequence[str], name: str = "ix") -> DataFrame:
    """df with the place of each row in a total order, from 1, nulls last: range partitions are numbered by their own windows and the counts before them."""
    spark = df.sparkSession
    by = [F.col(c).asc_nulls_last() for c in order]
    dealt = cut(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).withColumn("_pid", F.spark_partition_id()))
    counts = dealt.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = dealt.join(F.broadcast(before), "_pid")  # a row for each partition
    own = F.row_number().over(Window.partitionBy("_pid").orderBy(*by))
    return placed.withColumn(name, F.col("_before") + own).drop("_pid", "_n", "_before")


def coordinate_join(left: DataFrame, right: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """left with the columns of right where all common columns (or on) agree, null with null; repeated matches multiply rows."""
    on = list(on or [c for c in left.columns if c in right.columns])
    other = right.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[f"_{c}"]) for c in on])
    return left.join(other, same, "left").drop(*[f"_{c}" for c in on])


def rescale(df: DataFrame, axes: Sequence[str], by: str) -> DataFrame:
    """df with each axis divided by the greatest value of one of them: the same value for all, whatever their order."""
    top = F.broadcast(df.agg(F.max(by).cast("double").alias("_top")))
    return df.crossJoin(top).withColumns({c: F.col(c) / F.col("_top") for c in axes}).select(*df.columns)


def decimate(df: DataFrame, axes: Sequence[str], every: int) -> DataFrame:
    """The rows whose places (from 1) are the first of each so many, on all axes."""
    return df.where(reduce(lambda a, b: a & b, [F.pmod(F.col(c) - 1, F.lit(every)) == 0 for c in axes]))


def reverse(df: DataFrame, axis: str) -> DataFrame:
    """df with the places of an axis (from 1 to its greatest) counted from the other end."""
    top = F.broadcast(df.agg(F.max(axis).alias("_top")))
    return df.crossJoin(top).withColumn(axis, F.col("_top") + 1 - F.col(axis)).select(*df.columns)


def melt(df: DataFrame, keep: Sequence[str], rows: str) -> DataFrame:
    """keep, i, j, value (from 1) of an array of rows of numbers."""
    first = df.select(*keep, F.posexplode(rows).alias("i", "row"))
    return first.select(*keep, (F.col("i") + 1).alias("i"), F.posexplode("row").alias("j", "value")).select(*keep, "i", (F.col("j") + 1).alias("j"), "value")


def stack(slices: dict, axis: str) -> DataFrame:
    """Tables of equal columns, by slice, as one with the slice in a column."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(axis, F.lit(k)) for k, df in slices.items()])


def unstack(df: DataFrame, axis: str, values: Sequence) -> dict:
    """The slices of a stack."""
    return {k: df.where(F.col(axis) == F.lit(k)).drop(axis) for k in values}


def block_diagonal(df: DataFrame, row: str, z: str) -> DataFrame:
    """row, col, v: each row's array z in columns of its own, row * q + k (from 0)."""
    return df.select(F.col(row).alias("row"), (F.col(row) * F.size(z)).alias("_at"), F.posexplode(z).alias("k", "v")).select("row", (F.col("_at") + F.col("k")).alias("col"), "v")


def held_out(df: DataFrame, y: str = "y") -> DataFrame:
    """The rows without a finite y."""
    return df.where(F.coalesce(F.isnan(y) | (F.abs(y) == float("inf")), F.lit(True)))


def simulate(sites: DataFrame, w: str, beta: Sequence[float], tausq: float, seed: int = 1) -> DataFrame:
    """sites with y_full = x beta + w + noise; x is an array column."""
    fixed = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(b)) for b in beta]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return sites.withColumn("y_full", fixed + F.col(w) + F.randn(seed) * (tausq**0.5))
