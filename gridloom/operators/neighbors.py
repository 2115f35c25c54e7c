"""The nearest reference site of each new site, by a tree of cells over the reference.

Reference places are ordered by the Morton key of their cell in a square (the quadtree's depth-first order), and FAN successive ones are a leaf, FAN
successive leaves a node, and so on to one root. Every node knows the box of its places. All new sites go down the tree together, a join for
each level: a site keeps the nodes whose box may hold a place as near as the nearest that some other box is sure to hold. So the number of
joins is the logarithm of the reference's size to the base FAN, wherever a new site lies and however unevenly the reference is spread.

Distances are found from scaled components (hypot), so that no square overflows or vanishes. A site far from the whole reference can't tell its
distances apart; there, what a place adds to the distance of the square's middle is compared instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sites import row_ids
from .tables import cut, shuffles

#: Places of a leaf, and nodes under a node.
FAN = 32
#: Bits of a cell's number on each axis.
DEPTH = 31
#: Coordinates are multiplied by this power of two, so that differences of the greatest numbers are finite.
SCALE = 2.0**-6
#: A new site is far when it lies so many spans of the reference from its middle.
FAR = 4.0
#: Masks that spread 32 bits to every other of 64, from the widest step to the narrowest.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def morton(a: Column, b: Column) -> Column:
    """The bits of two numbers below 2 ** 31 in turn."""

    def spread(x: Column) -> Column:
        for shift, mask in SPREAD:
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    return spread(a.cast("long")).bitwiseOR(F.shiftleft(spread(b.cast("long")), 1))


def depth(places: int) -> int:
    """Levels of the tree over so many places."""
    levels = 1
    while places > FAN:
        places, levels = -(-places // FAN), levels + 1
    return levels


def cell_tree(places: DataFrame, low: tuple[float, float], span: float, levels: int) -> list[DataFrame]:
    """node, kids of each level, the leaves' first: places (x, y, row) there, above the nodes' numbers and boxes. places: x, y, row."""
    cell = lambda c, lo: F.floor(F.least(F.greatest((F.col(c) - lo) / span, F.lit(0.0)), F.lit(1.0)) * ((1 << DEPTH) - 1))
    keyed = places.withColumn("key", morton(cell("x", low[0]), cell("y", low[1])))
    node = F.floor((F.col("place") - 1) / FAN).cast("long").alias("node")
    box = [f(c).alias(f"{g}_{c}") for c in ("x", "y") for f, g in ((F.min, "lo"), (F.max, "hi"))]
    leaves = row_ids(keyed, ["key", "x", "y"], "place").select(node, "x", "y", "row")
    below = cut(leaves.groupBy("node").agg(F.collect_list(F.struct("x", "y", "row")).alias("kids"), *box))
    tree = [below.select("node", "kids")]
    for _ in range(levels - 1):
        up = below.withColumn("up", F.floor(F.col("node") / FAN).cast("long"))
        boxes = [f(f"{g}_{c}").alias(f"{g}_{c}") for c in ("x", "y") for f, g in ((F.min, "lo"), (F.max, "hi"))]
        below = cut(up.groupBy(F.col("up").alias("node")).agg(F.collect_list(F.struct("node", "lo_x", "hi_x", "lo_y", "hi_y")).alias("kids"), *boxes))
        tree.append(below.select("node", "kids"))
    return tree


def nearest_site(new: DataFrame, reference: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """ix, near, dist of each row of new (ix, var1, var2): the ix of the nearest row of reference; ties to the smaller one.

    Rows at one place, of new or of reference, count as one. New rows whose coordinates are null or not finite have no nearest row (nulls); such
    reference rows are nobody's. Distances that are equal as doubles are ties, but for far new sites. keep: further columns of reference.
    """
    keep = keep or []
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    whole = finite("var1") & finite("var2")
    scaled = lambda c: (F.col(c).cast("double") * SCALE).alias({"var1": "x", "var2": "y"}[c])
    kind = lambda c: reference.schema[c].dataType
    nothing = lambda rows: rows.select("ix", F.lit(None).cast(kind("ix")).alias("near"), F.lit(None).cast("double").alias("dist"), *[F.lit(None).cast(kind(c)).alias(c) for c in keep])
    places = reference.where(whole).groupBy(scaled("var1"), scaled("var2")).agg(F.min(F.struct("ix", *keep)).alias("row"))
    places = cut(places, "places")
    box = places.agg(F.count("*").alias("n"), *[f(c).alias(f"{g}_{c}") for c in ("x", "y") for f, g in ((F.min, "lo"), (F.max, "hi"))]).head()
    if not box["n"]:
        return nothing(new)
    span = max(box["hi_x"] - box["lo_x"], box["hi_y"] - box["lo_y"]) or 1.0
    middle = {c: box[f"lo_{c}"] / 2 + box[f"hi_{c}"] / 2 for c in ("x", "y")}
    tree = cell_tree(places, (box["lo_x"], box["lo_y"]), span, depth(box["n"]))

    # few bytes but much work a place: dealt by a number, which windows and groups take as it is, so they are not gathered to fewer tasks on the way
    asked = new.where(whole).select(scaled("var1"), scaled("var2")).distinct().withColumn("of", F.xxhash64("x", "y")).repartition(shuffles(new.sparkSession), "of")
    reach = F.greatest(*[F.abs(F.col(c) - middle[c]) for c in ("x", "y")])
    state = asked.withColumn("reach", reach).withColumn("far", F.col("reach") > FAR * span).withColumn("node", F.lit(0).cast("long"))

    def cost(c: str, at: Column) -> Column:
        """What a place's coordinate adds to its distance; far: to that of the middle, in units of the reach."""
        own = at - middle[c]
        return F.when(F.col("far"), own * (own / F.col("reach")) - 2 * own * ((F.col(c) - middle[c]) / F.col("reach"))).otherwise(F.abs(at - F.col(c)))

    both = lambda a, b: F.when(F.col("far"), a + b).otherwise(F.hypot(a, b))
    per_site = Window.partitionBy("of", "x", "y")
    as_near = lambda c: F.when(F.col("far"), c + span * 2.0**-48).otherwise(c * (1 + 2.0**-50))  # noqa: E731  beyond rounding

    def sides(k: Column, c: str) -> tuple[Column, Column, Column]:
        """The costs of a box's nearest coordinate, of its nearer side and of its farther side."""
        lo, hi = k[f"lo_{c}"], k[f"hi_{c}"]
        left = F.abs(F.col(c) - lo) <= F.abs(F.col(c) - hi)
        return cost(c, F.least(F.greatest(F.col(c), lo), hi)), cost(c, F.when(left, lo).otherwise(hi)), cost(c, F.when(left, hi).otherwise(lo))

    def judged(k: Column) -> Column:
        """Some place of the box is on each of its sides, so the nearest is no farther than a nearer side's farther end."""
        (x0, x1, x2), (y0, y1, y2) = sides(k, "x"), sides(k, "y")
        return F.struct(k["node"].alias("node"), both(x0, y0).alias("least"), F.least(both(x1, y2), both(x2, y1)).alias("sure"))

    for level in reversed(tree[1:]):
        met = state.join(level, "node").withColumn("kids", F.transform("kids", judged)).withColumn("sure", F.array_min(F.transform("kids", lambda k: k["sure"])))
        met = met.withColumn("best", as_near(F.min("sure").over(per_site)))
        state = met.select("of", "x", "y", "reach", "far", F.explode(F.filter("kids", lambda k: k["least"] <= F.col("best"))).alias("kid")).select("of", "x", "y", "reach", "far", "kid.node")
    k = F.col("kid")
    told = F.struct(both(cost("x", k["x"]), cost("y", k["y"])).alias("cost"), k["row"].alias("row"), F.hypot(k["x"] - F.col("x"), k["y"] - F.col("y")).alias("d"))
    found = state.join(tree[0], "node").select("of", "x", "y", "reach", "far", F.explode("kids").alias("kid")).select("of", "x", "y", told.alias("told"))
    found = found.groupBy("of", "x", "y").agg(F.min("told").alias("best")).drop("of")
    rows = new.where(whole).select("ix", scaled("var1"), scaled("var2")).join(found, ["x", "y"])
    answers = rows.select("ix", F.col("best.row.ix").alias("near"), (F.col("best.d") / SCALE).alias("dist"), *[F.col("best.row")[c].alias(c) for c in keep])
    return answers.union(nothing(new.where(~whole)))
