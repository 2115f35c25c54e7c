"""The directed mesh of blocks: edges, Markov blankets, common children, colours.

blocks: l1, ..., ld, block, n_obs. edges: child, parent, slot. Neighbours along an axis are a window's work over the blocks of one grid
line, so nothing here grows with the rows of the sites.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sites import row_ids
from .tables import cut

#: Blocks of successive numbers that one task of settle() holds.
TILE = 1 << 16


def _line(axis: int, dims: int):
    """A window along an axis: the blocks that agree in all other levels."""
    return Window.partitionBy(*[f"l{a}" for a in range(1, dims + 1) if a != axis]).orderBy(f"l{axis}")


def mesh_edges(blocks: DataFrame, dims: int, all_observed: bool = False) -> DataFrame:
    """child, parent, slot of all edges.

    A block with observations has as parents the next such block before it along the second axis (slot 0), the first (1) and the third (2).
    A block without has the nearest observed ones before and behind it on each axis: slots 0 and 1 along the last axis, and so on to the first.
    """
    seen = F.lit(True) if all_observed else F.col("n_obs") > 0
    marked = blocks.withColumn("seen", seen)
    order = [2, 1, 3][:dims]
    observed = marked.where("seen")
    parts = [observed.select(F.col("block").alias("child"), F.lag("block").over(_line(axis, dims)).alias("parent"), F.lit(slot).alias("slot")) for slot, axis in enumerate(order)]
    known = F.when(F.col("seen"), F.col("block"))
    for place, axis in enumerate(range(dims, 0, -1)):
        line = _line(axis, dims)
        before = F.last(known, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
        behind = F.first(known, ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
        both = marked.withColumn("before", before).withColumn("behind", behind).where("not seen")
        parts += [both.select(F.col("block").alias("child"), F.col(side).alias("parent"), F.lit(2 * place + k).alias("slot")) for k, side in enumerate(("before", "behind"))]
    return reduce(DataFrame.union, parts).where("parent is not null")


def observed_edges(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """The edges whose child has observations: only these make a block a child of its parents."""
    return edges.join(blocks.where("n_obs > 0").select(F.col("block").alias("child")), "child", "left_semi")


def blanket(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """block, member: parents, children and the children's other parents of each block with observations."""
    real = observed_edges(edges, blocks)
    up = real.select(F.col("child").alias("block"), F.col("parent").alias("member"))
    down = real.select(F.col("parent").alias("block"), F.col("child").alias("member"))
    other = real.select(F.col("child"), F.col("parent").alias("member"))
    beside = real.select("child", F.col("parent").alias("block")).join(other, "child").where("block <> member").select("block", "member")
    return up.union(down).union(beside).distinct()


def common_children(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """parent1 < parent2, child: blocks that are parents of one child."""
    real = observed_edges(edges, blocks)
    a, b = real.select("child", F.col("parent").alias("parent1")), real.select("child", F.col("parent").alias("parent2"))
    return a.join(b, "child").where("parent1 < parent2").select("parent1", "parent2", "child").distinct()


def settle(waits: DataFrame, rule: str, tile: int = TILE) -> DataFrame:
    """block, value of each block of waits (block, waiting: the blocks, all in the table, whose values its own follows from).

    rule: "first_fit", the least number from 0 that no waited-for block has; "longest", one more than the greatest of them, 0 without any.
    The values are those of going through the blocks one by one, each behind all that it waits for (Jones and Plassmann's rule: a block is
    settled once those before it are). In a round, each tile of blocks (successive numbers) settles in memory all that follows from
    what is known; what it settled is joined to those that wait for it in other tiles. Where blocks only wait for smaller ones, the first unfinished tile
    is always finished, so rounds are at most as many as tiles, and fewer where blocks in the tiles behind can be settled before. A circle is an error.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        blocks = rows["block"].tolist()
        waiting = {b: set(w) for b, w in zip(blocks, rows["waiting"], strict=True)}
        taken = {b: set(t) for b, t in zip(blocks, rows["taken"], strict=True)}
        later: dict[int, list[int]] = {}
        for b, w in waiting.items():
            for m in w:
                if m in waiting:
                    later.setdefault(m, []).append(b)
        value, ready = {}, sorted(b for b, w in waiting.items() if not w)
        for b in ready:
            have = taken[b]
            v = next(c for c in range(len(have) + 1) if c not in have) if rule == "first_fit" else max(have, default=-1) + 1
            value[b] = v
            for c in later.get(b, ()):
                taken[c].add(v)
                waiting[c].discard(b)
                if not waiting[c]:
                    ready.append(c)
        out = rows[["tile", "block"]].copy()
        out["value"] = pd.array([value.get(b) for b in blocks], dtype="Int32")
        out["waiting"], out["taken"] = [list(waiting[b]) for b in blocks], [list(taken[b]) for b in blocks]
        return out

    none = F.array().cast("array<int>")
    todo = waits.select(F.floor(F.col("block") / tile).cast("int").alias("tile"), F.col("block").cast("int").alias("block"), F.col("waiting").cast("array<int>").alias("waiting"), none.alias("taken"))
    done, rounds = None, 0
    while True:
        met = cut(todo.groupBy("tile").applyInPandas(run, "tile int, block int, value int, waiting array<int>, taken array<int>"), "settled")
        new, left = met.where("value is not null").select("block", "value"), met.where("value is null").drop("value")
        done, rounds = new if done is None else done.union(new), rounds + 1
        if left.isEmpty():
            done._gridloom_rounds = rounds
            return done
        if new.isEmpty():
            raise ValueError("blocks wait for one another in a circle")
        known = left.select("block", F.explode("waiting").alias("member")).join(new.select(F.col("block").alias("member"), "value"), "member")
        known = known.groupBy("block").agg(F.collect_list("member").alias("found"), F.collect_set("value").alias("values"))
        todo = left.join(known, "block", "left").select("tile", "block", F.array_except("waiting", F.coalesce("found", none)).alias("waiting"), F.array_union("taken", F.coalesce("values", none)).alias("taken"))


def greedy_colors(members: DataFrame, blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """block, color: first fit in block order, so that no block shares its colour with its blanket; blocks without observations come last, in one colour."""
    seen = blocks.where("n_obs > 0").select("block")
    before = members.where("member < block").join(seen.withColumnRenamed("block", "member"), "member", "left_semi").groupBy("block").agg(F.collect_set("member").alias("waiting"))
    waits = seen.join(before, "block", "left").select("block", F.coalesce("waiting", F.array().cast("array<int>")).alias("waiting"))
    found = settle(waits, "first_fit", tile)
    last = found.agg((F.coalesce(F.max("value"), F.lit(-1)) + 1).alias("color"))
    rest = blocks.where("n_obs = 0").select("block").crossJoin(F.broadcast(last))  # one row
    return found.select("block", F.col("value").alias("color")).union(rest.select(F.col("block").cast("int").alias("block"), F.col("color").cast("int").alias("color")))


def color_conflicts(colors: DataFrame, members: DataFrame) -> DataFrame:
    """block, member: blanket pairs of equal colour; empty for a valid colouring."""
    other = colors.select(F.col("block").alias("member"), F.col("color").alias("other"))
    return members.join(colors, "block").join(other, "member").where("color = other").select("block", "member")


def color_groups(colors: DataFrame) -> DataFrame:
    """color, blocks: the blocks that are sampled together."""
    return colors.groupBy("color").agg(F.sort_array(F.collect_list("block")).alias("blocks"))


def related_rows(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """child, slot, parent, ix: the rows of each block's parents."""
    return edges.join(blocked.select(F.col("block").alias("parent"), "ix"), "parent").select("child", "slot", "parent", "ix")


def parent_offsets(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """child, slot, parent, first, n: where each parent's rows lie among all parents' rows of a block, in slot order (from 0)."""
    sized = edges.join(blocks.select(F.col("block").alias("parent"), F.col("n_rows").alias("n")), "parent")
    upto = Window.partitionBy("child").orderBy("slot", "parent").rowsBetween(Window.unboundedPreceding, -1)
    return sized.select("child", "slot", "parent", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"), "n")


def congruence_keys(blocked: DataFrame, axes: list[str], tolerance: float = 1e-4) -> DataFrame:
    """block, representative: the least of the blocks whose rows lie alike up to a shift, within tolerance.

    Shapes (coordinates relative to the first row, in order) that agree when rounded are one; blocks that rounding parts are compared once more,
    one of each shape: those of as many rows whose sums of coordinates lie in the same or neighbouring cells, coordinate by coordinate.
    """
    first = Window.partitionBy("block").orderBy(*axes, "ix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    apart = [(F.col(c).cast("double") - F.first(F.col(c).cast("double")).over(first)).alias(c) for c in axes]
    shapes = blocked.select("block", F.struct(*apart).alias("p")).groupBy("block").agg(F.sort_array(F.collect_list("p")).alias("shape"))
    rounded = F.transform("shape", lambda p: F.struct(*[F.round(p[c] / tolerance).cast("long").alias(c) for c in axes]))
    each = shapes.withColumn("rounded", rounded)
    classes = cut(each.groupBy("rounded").agg(F.min_by("shape", "block").alias("shape"), F.min("block").alias("own")))
    n = F.size("shape")
    sums = [F.floor(F.aggregate(F.col("shape")[c], F.lit(0.0), lambda s, x: s + x) / (n * tolerance)) for c in axes]
    cells = classes.select("own", "shape", n.alias("n"), *[x.alias(f"cell{k}") for k, x in enumerate(sums)])
    near = cells
    for k in range(len(axes)):
        near = near.withColumn(f"cell{k}", F.explode(F.array(*[F.col(f"cell{k}") + d for d in (-1, 0, 1)])))
    keys = ["n", *[f"cell{k}" for k in range(len(axes))]]
    pairs = cells.join(near.select(F.col("own").alias("other"), F.col("shape").alias("that"), *keys), keys).where("other < own")
    same = F.forall(F.zip_with("shape", "that", lambda p, q: F.greatest(*[F.abs(p[c] - q[c]) for c in axes]) < tolerance), lambda x: x)
    earlier = pairs.where(same).groupBy("own").agg(F.min("other").alias("earlier"))
    mapped = classes.join(earlier, "own", "left").select("rounded", F.coalesce("earlier", "own").alias("representative"))
    return each.select("block", "rounded").join(mapped, "rounded").select("block", "representative")


def cache_hits(keys: DataFrame) -> DataFrame:
    """blocks, shapes, hits: the percentage of blocks that use another's factors."""
    counts = keys.agg(F.count("*").alias("blocks"), F.count_distinct("representative").alias("shapes"))
    return counts.withColumn("hits", 100 - 100 * F.col("shapes") / F.col("blocks"))


def from_representatives(keys: DataFrame, made: DataFrame) -> DataFrame:
    """What was made for each representative (a table by block), for every block that it stands for."""
    return keys.join(made.withColumnRenamed("block", "representative"), "representative").drop("representative")


def compute_block(predicting: bool, n_obs: Column, all_observed: bool = False) -> Column:
    """Whether a block takes part: all do if all count as observed or in a prediction, else those with observations."""
    return F.lit(True) if all_observed or predicting else n_obs > 0


def reference_summary(blocks: DataFrame) -> DataFrame:
    """blocks, reference (blocks with observations), reference_rows (their rows), observed (rows with y)."""
    seen = F.col("n_obs") > 0
    return blocks.agg(F.count("*").alias("blocks"), F.count_if(seen).alias("reference"), F.coalesce(F.sum(F.when(seen, F.col("n_rows"))), F.lit(0)).alias("reference_rows"), F.coalesce(F.sum("n_obs"), F.lit(0)).alias("observed"))


def colors_apart(edges: DataFrame, colors: DataFrame, tile: int = TILE) -> DataFrame:
    """block, color without equal colours of a child and its parent: each of a group's blocks that has a parent in it moves behind.

    Groups are repaired until no child is in its parent's group; a block's new group is the number of steps on the longest path of such equal
    colours that leads to it, so groups stay few where the graph is shallow, and in the worst case are one for each block, as in a sequence.
    """
    of = colors.select(F.col("block").alias("parent"), F.col("color").alias("same"))
    clash = edges.join(colors.select(F.col("block").alias("child"), "color"), "child").join(of, "parent").where("color = same")
    waiting = clash.groupBy(F.col("child").alias("block")).agg(F.collect_set("parent").alias("waiting"))
    waits = colors.select("block").join(waiting, "block", "left").select("block", F.coalesce("waiting", F.array().cast("array<int>")).alias("waiting"))
    moved = cut(settle(waits, "longest", tile).join(colors, "block").select("block", F.col("value").alias("depth"), "color"))
    groups = row_ids(moved.select("depth", "color").distinct(), ["depth", "color"], "place")
    return moved.join(groups, ["depth", "color"]).select("block", (F.col("place") - 1).cast("int").alias("color"))


def axis_recolor(blocks: DataFrame, dims: int, sweeps: int = 20) -> DataFrame:
    """blocks with color changed where a block and the next one of its grid line have the same: the later takes the colour after the largest.

    A line's blocks are compared by a window, axis after axis, until nothing changes or sweeps are over.
    """
    for _ in range(sweeps):
        changed = blocks
        for axis in range(1, dims + 1):
            same = F.coalesce(F.col("color") == F.lag("color").over(_line(axis, dims)), F.lit(False))
            run = F.row_number().over(_line(axis, dims))
            changed = changed.withColumn("_same", same & (F.pmod(run, F.lit(2)) == 0))
            top = F.broadcast(changed.agg(F.max("color").alias("_top")))
            changed = changed.crossJoin(top).withColumn("color", F.when(F.col("_same"), F.col("_top") + 1).otherwise(F.col("color"))).drop("_same", "_top")
        changed = cut(changed)
        if changed.join(blocks.select("block", F.col("color").alias("_was")), "block").where("color <> _was").isEmpty():
            return changed
        blocks = changed
    return blocks


def sampling_graph(blocked: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """blocks (with the checkerboard colour of their levels) and edges of sites that are only to be sampled: all blocks take part."""
    from .tessellation import block_counts, color

    blocks = block_counts(blocked, dims).withColumn("color", color(dims))
    return blocks, mesh_edges(blocks, dims, all_observed=True)
