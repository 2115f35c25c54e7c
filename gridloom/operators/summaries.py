"""Summaries of posterior draws, hold-out scores, cross products and reshaping.

draws: draw, ix, value in long form. Means and scores have partial sums; quantiles are selected, so that no task holds the draws of a site.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, doubles

#: Rows of a key that one task sorts; keys with more at most; buckets of such a key.
MANY, HOT, BUCKETS = 1_000_000, 1000, 1024


def draw_means(draws: DataFrame, keys: Sequence[str] = ("ix",), value: str = "value") -> DataFrame:
    return draws.groupBy(*keys).agg(F.avg(value).alias("mean"))


def quantile_ranks(n: Column, q: float, linear: bool = False) -> tuple[Column, Column, Column]:
    """The places (from 0) of the two order statistics around q * n, of n values, and the weight of the second."""
    if linear:
        at = F.lit(q) * (n - 1)
        lo = F.floor(at).cast("long")
        return lo, F.least(lo + 1, n - 1), at - lo
    r = F.lit(q * 100 / 100) * n
    begin = F.greatest(r - 1, F.lit(0.0))
    low, up = F.floor(begin).cast("long"), F.ceil(begin).cast("long")
    upper_half = r >= n / 2
    lower = F.when(upper_half, low).otherwise(F.greatest(up - 1, F.lit(0).cast("long")))
    upper = F.when(upper_half, F.least(low + 1, n - 1)).otherwise(up)
    return lower, upper, F.lit(0.5) + (r - F.floor(r + 0.5))


def ranked_values(rows: DataFrame, wanted: DataFrame, many: int = MANY) -> DataFrame:
    """k, rank, x: of rows (k, x) the order statistics that wanted (k, n, ranks) asks for: n rows of the key, an array of places from 0.

    A key of up to many rows (more where all rows are more than HOT times that) is sorted by one task, on disk where memory ends. The others, at
    most HOT, are cut at their own approximate quantiles: the buckets are counted, each wanted place is looked for in its bucket, and so on
    with the bucket as the key. Values that equal a cut are buckets of their own, so that ties need no sorting.
    """
    total = wanted.agg(F.sum("n")).head()[0] or 0
    most = max(many, total // HOT)
    hot = cut(wanted.where(F.col("n") > most), "hot")
    by = Window.partitionBy("k").orderBy("x")
    few = rows.join(wanted.where(F.col("n") <= most).select("k", "ranks"), "k").withColumn("rank", (F.row_number().over(by) - 1).cast("long"))
    found = few.where(F.array_contains("ranks", F.col("rank"))).select("k", "rank", "x")
    if hot.isEmpty():
        return found
    plain = rows.join(F.broadcast(hot.select("k")), "k", "left_semi")
    cuts = plain.groupBy("k").agg(F.array_sort(F.array_distinct(F.percentile_approx("x", doubles(p / BUCKETS for p in range(1, BUCKETS)), F.lit(10_000)))).alias("cuts"))
    steps = F.lit([1 << b for b in reversed(range(BUCKETS.bit_length()))])
    under = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get("cuts", n + step - 1) <= F.col("x"), step).otherwise(F.lit(0)))
    bucket = F.transform(F.array(under), lambda u: 2 * u - F.when(F.get("cuts", u - 1) == F.col("x"), 1).otherwise(0))[0]
    placed = plain.join(F.broadcast(cut(cuts, "cuts")), "k").select("k", "x", bucket.alias("bucket"))  # HOT rows of BUCKETS numbers at most
    counts = placed.groupBy("k", "bucket").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    spans = counts.withColumn("end", F.sum("n").over(Window.partitionBy("k").orderBy("bucket"))).join(hot.select("k", "ranks"), "k")
    spans = spans.withColumn("begin", F.col("end") - F.col("n")).withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("begin")) & (r < F.col("end"))))
    spans = cut(spans.where(F.size("ranks") > 0).select(F.struct("k", "bucket").alias("k"), "n", "lo", "hi", "begin", F.transform("ranks", lambda r: r - F.col("begin")).alias("ranks")), "spans")
    told = spans.where("lo = hi").select("k.k", F.explode("ranks").alias("rank"), F.col("lo").alias("x"), "begin").select("k", (F.col("rank") + F.col("begin")).alias("rank"), "x")
    inner = spans.where("lo < hi")
    within = placed.select(F.struct("k", "bucket").alias("k"), "x").join(F.broadcast(inner.select("k")), "k", "left_semi")
    deeper = ranked_values(within, inner.select("k", "n", "ranks"), many).join(inner.select("k", "begin"), "k")
    return found.union(told).union(deeper.select("k.k", (F.col("rank") + F.col("begin")).alias("rank"), "x"))


def draw_quantiles(draws: DataFrame, probs: Sequence[float], keys: Sequence[str] = ("ix",), value: str = "value", linear: bool = False, many: int = MANY) -> DataFrame:
    """keys, prob, quantile: between two order statistics, exact, for keys with any number of draws. Null and NaN are no draws."""
    rows = draws.select(F.struct(*keys).alias("k"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    counts = cut(rows.groupBy("k").agg(F.count("*").alias("n")), "counts")
    ranks = {q: quantile_ranks(F.col("n"), q, linear) for q in probs}
    wanted = counts.select("k", "n", F.array_distinct(F.array(*[r for lower, upper, _ in ranks.values() for r in (lower, upper)])).alias("ranks"))
    found = ranked_values(rows, wanted, many)
    asked = F.array(*[F.struct(F.lit(float(q)).alias("prob"), lower.alias("lower"), upper.alias("upper"), weight.alias("weight")) for q, (lower, upper, weight) in ranks.items()])
    values = found.groupBy("k").agg(F.map_from_entries(F.collect_set(F.struct("rank", "x"))).alias("at"))  # two for a probability
    each = counts.join(values, "k").select("k", "at", F.explode(asked).alias("q"))
    a, b = F.col("at")[F.col("q.lower")], F.col("at")[F.col("q.upper")]
    return each.select(*[F.col("k")[c].alias(c) for c in keys], "q.prob", ((1 - F.col("q.weight")) * a + F.col("q.weight") * b).alias("quantile"))


def scores(predicted: DataFrame, truth: str = "y", mean: str = "mean", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """One row: n, rmse, mae, coverage of the open interval, corr."""
    t, m = F.col(truth), F.col(mean)
    return predicted.agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg((m - t) * (m - t))).alias("rmse"),
        F.avg(F.abs(m - t)).alias("mae"),
        F.avg(((F.col(lower) < t) & (t < F.col(upper))).cast("double")).alias("coverage"),
        F.corr(mean, truth).alias("corr"),
    )


def cross_products(df: DataFrame, x: Sequence[str], y: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, n, the sums x_i * x_j (xx_i_j, i <= j), x_i * y (xy_i) and y * y (yy) over rows with y."""
    have = df.where(F.col(y).isNotNull())
    d = lambda c: F.col(c).cast("double")
    sums = [F.sum(d(a) * d(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(x, 1) for j, b in enumerate(x, 1) if i <= j]
    sums += [F.sum(d(a) * d(y)).alias(f"xy_{i}") for i, a in enumerate(x, 1)]
    return have.groupBy(*groups).agg(F.count("*").alias("n"), *sums, F.sum(d(y) * d(y)).alias("yy"))


def running_ratio(trace: DataFrame, accepted: str, order: str, last: int = 200, keys: Sequence[str] = ("chain",)) -> DataFrame:
    """trace with ratio (so far) and recent (over the last so many steps) of accepted proposals, for each chain."""
    w = Window.partitionBy(*keys).orderBy(order)
    hit = F.col(accepted).cast("double")
    return trace.withColumn("ratio", F.avg(hit).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("recent", F.avg(hit).over(w.rowsBetween(1 - last, 0)))


def weighted_sum(z: Column, w: Column) -> Column:
    """The sum of products of two arrays of equal length."""
    return F.aggregate(F.zip_with(z, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def null_values(df: DataFrame, value: float, columns: Sequence[str]) -> DataFrame:
    """df with value replaced by null in columns."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(value)) for c in columns})


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence) -> DataFrame:
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.first(value))
