"""The trie of conversations that begin alike, by partition refinement.

All different conversations are one class at first. In each round a class is split by its members' next turn, so that its members always have
their first d turns in common: a class is a node of depth d. A class of one conversation is retired: the rest of it is a chain of nodes without
branches, written in one go, however long. Rounds go on while two different conversations agree, so they follow the longest shared beginning,
not the longest conversation. What the nodes hold is then folded back from the deepest round to the root.

Equal conversations are one member with a weight from the start: they are told apart by their length and 256 bits of hashes of their turns
(a turn is known by its SHA-256). Turns are numbered, and their code points summed up, over range partitions and the counts of those before,
so that one conversation may hold any share of all turns. Ids of equal conversations are joined by commas in range partitions, stretch by
stretch, and one pass over the stretches in order makes the hash: of a group of any size only the stretch at hand is in memory.

Defined results: turns are in order of turn (null first), then role, then text (both null first); null role or text is the empty one; repeated rows are
turns of their own; rows without conv_id are no conversation's; no conversations give no nodes, not even a root. Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._support import release, store

#: Ids of a stretch.
STRETCH = 4096
_LANES = 4
_NOTHING = hashlib.sha256(b"").hexdigest()


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, d (from 1), key, points, upto: turns in order; key tells turns apart, points are the code points of the text, upto their running sum."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", F.monotonically_increasing_id().alias("tie"))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    key = F.unhex(F.sha2(F.concat(F.length(empty("role")).cast("string"), F.lit(":"), empty("role"), empty("text")), 256))
    placed = store(dealt.select("conv_id", key.alias("key"), F.length(empty("text")).cast("long").alias("points"), F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at")), "turns")
    # a conversation may go over several partitions: what the earlier ones hold of it
    runs = placed.groupBy("conv_id", "pid").agg(F.count("*").alias("n"), F.sum("points").alias("sum"))
    earlier = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    before = runs.select("conv_id", "pid", zero(F.sum("n").over(earlier)).alias("n0"), zero(F.sum("sum").over(earlier)).alias("sum0"))
    own = Window.partitionBy("conv_id", "pid").orderBy("at")
    inside = placed.withColumn("k", F.row_number().over(own)).withColumn("s", F.sum("points").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(before, ["conv_id", "pid"]).select("conv_id", (F.col("n0") + F.col("k")).alias("d"), "key", "points", (F.col("sum0") + F.col("s")).alias("upto"))


def rebuilt(turns: DataFrame, donor: Column, most: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """conversations (conv_id, n, lanes) and turns (as ordered()): each begins with the first most turns of the conversation donor, all if fewer, none
    if absent, and goes on with its own turns behind its first most. donor and most follow from conv_id; most is limit at most."""
    spans = turns.groupBy("conv_id").agg(F.max("d").alias("n"), F.max("upto").alias("sum"), F.max(F.when(F.col("d") <= most, F.col("upto"))).alias("skipped"))
    convs = spans.select("conv_id", donor.alias("donor"), most.cast("long").alias("h"), F.coalesce("skipped", F.lit(0)).cast("long").alias("skipped"))
    few = turns.where(F.col("d") <= limit).withColumnRenamed("conv_id", "donor")
    given = convs.join(few, "donor").where("d <= h").select("conv_id", "d", "key", "points", "upto")
    taken = given.groupBy("conv_id").agg(F.max("d").alias("m"), F.max("upto").alias("got"))
    moved = store(convs.join(taken, "conv_id", "left").select("conv_id", "h", "skipped", F.coalesce("m", F.lit(0)).cast("long").alias("m"), F.coalesce("got", F.lit(0)).cast("long").alias("got")), "moved")
    kept = turns.join(moved, "conv_id").where("d > h").select("conv_id", (F.col("d") - F.col("h") + F.col("m")).alias("d"), "key", "points", (F.col("upto") - F.col("skipped") + F.col("got")).alias("upto"))
    made = store(given.union(kept), "rebuilt")
    lanes = [F.coalesce(F.bit_xor(F.xxhash64(F.lit(k), "d", "key")), F.lit(0)).alias(f"lane{k}") for k in range(_LANES)]
    marked = made.groupBy("conv_id").agg(F.max("d").alias("n"), *lanes)
    none = F.lit(0).cast("long")
    whole = moved.select("conv_id").join(marked, "conv_id", "left").select("conv_id", F.coalesce("n", none).alias("n"), *[F.coalesce(f"lane{k}", none).alias(f"lane{k}") for k in range(_LANES)])
    return store(whole, "conversations"), made


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, first, ids: the ids of each stretch, comma-joined, of rows sorted by (rep, conv_id)."""
    rep, held = None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], names=["rep", "first", "ids"])

    for batch in batches:
        for r, c in zip(batch.column("rep").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if held and (r != rep or len(held) == STRETCH):
                yield made()
                held = []
            rep = r
            held.append(c)
    if held:
        yield made()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, sha of rows sorted by (rep, first)."""
    rep, sha = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([sha.hexdigest()])], names=["rep", "sha"])
    for batch in batches:
        for r, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if sha is None or r != rep:
                if sha is not None:
                    yield done()
                rep, sha = r, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if sha is not None:
        yield done()


def id_hashes(copies: DataFrame) -> DataFrame:
    """rep, sha: of each group (rep, conv_id) the SHA-256 of its ids in ascending order, comma-joined."""
    dealt = copies.select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    parts = dealt.mapInArrow(_stretches, "rep long, first long, ids string")
    return parts.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(_digests, "rep long, sha string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node. convs, turns: see rebuilt()."""
    lanes = ["n", *[f"lane{k}" for k in range(_LANES)]]
    alike = store(convs.groupBy(*lanes).agg(F.min("conv_id").alias("rep"), F.count("*").alias("w")), "alike")
    if alike.isEmpty():
        empty = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return convs.sparkSession.createDataFrame([], empty)
    several = convs.join(alike.where("w > 1").drop("w"), lanes).select("rep", "conv_id")
    shas = id_hashes(several).union(alike.where("w = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("sha")))
    members = alike.select("rep", "w", "n")
    steps = store(turns.withColumnRenamed("conv_id", "rep").join(members, "rep").sortWithinPartitions("d"), "steps")

    # refinement: nodes of the classes of each depth, and which member ends there
    root = members.agg(F.lit(0).cast("long").alias("depth"), F.min("rep").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.sum("w").alias("n_convs"), F.count("*").alias("m"), F.lit(0).cast("long").alias("points"), F.max(F.when(F.col("n") == 0, F.col("rep"))).alias("ender"))
    levels, d = [store(root, "level")], 0
    first = levels[0].head()["conv_id"]
    active = members.where("n > 0").select("rep", F.lit(first).cast("long").alias("class"))
    while not active.isEmpty():
        d += 1
        at = steps.where(F.col("d") == d).join(active, "rep")
        found = at.groupBy("class", "key").agg(F.min("rep").alias("conv_id"), F.sum("w").alias("n_convs"), F.count("*").alias("m"), F.first("points").alias("points"), F.max(F.when(F.col("n") == d, F.col("rep"))).alias("ender"))
        level = store(found, "level")
        levels.append(level.select(F.lit(d).cast("long").alias("depth"), "conv_id", F.col("class").alias("parent"), "n_convs", "m", "points", "ender"))
        shared = level.where("m > 1").select("class", "key", "conv_id")
        later = store(at.where(F.col("n") > d).join(shared, ["class", "key"]).select("rep", F.col("conv_id").alias("class")), "active")
        if d > 1:
            release(active)
        active = later

    # chains: what is left of a member that became a class of its own
    total = steps.where(F.col("d") == F.col("n")).select("rep", F.col("upto").alias("total"))
    retired = None
    for level in levels[1:]:
        alone = level.where("m = 1").select(F.col("conv_id").alias("rep"), F.col("depth").alias("start"), "parent")
        retired = alone if retired is None else retired.union(alone)
    one, parts = F.lit(1).cast("long"), []
    if retired is not None:
        chain = steps.join(retired, "rep").where("d >= start").join(total, "rep")
        saved = (F.col("w") - 1) * (F.col("total") - F.col("upto") + F.col("points"))
        above = F.when(F.col("d") == F.col("start"), F.col("parent")).otherwise(F.col("rep"))
        chain = store(chain.select(F.col("rep").alias("conv_id"), F.col("d").alias("depth"), above.alias("parent"), "start", F.col("w").alias("n_convs"), (F.col("d") < F.col("n")).cast("long").alias("n_children"), one.alias("n_leaves"), saved.alias("saved"), F.when(F.col("d") == F.col("n"), F.col("rep")).alias("ender")), "chains")
        tops = store(chain.where("depth = start").select("start", "parent", "n_leaves", "saved"), "tops")
        parts.append(chain.drop("start"))

    # back from the deepest class to the root
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth].where("m > 1") if depth else levels[0]
        heads = [] if retired is None else [tops.where(F.col("start") == depth + 1).drop("start")]
        heads += [] if below is None else [below.select("parent", "n_leaves", "saved")]
        lost = (F.col("n_convs") - 1) * F.col("points")
        if heads:
            sums = (heads[0] if len(heads) == 1 else heads[0].union(heads[1])).groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("under"))
            joined = here.join(sums.withColumnRenamed("parent", "conv_id"), "conv_id", "left")
        else:
            joined = here.selectExpr("*", "null n_children", "null leaves", "null under")
        zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
        below = store(joined.select("conv_id", "depth", "parent", "n_convs", zero("n_children").alias("n_children"), F.coalesce(F.col("leaves").cast("long"), one).alias("n_leaves"), (lost + zero("under")).alias("saved"), "ender"), "folded")
        parts.append(below)
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.union(p)
    hashed = nodes.where("ender is not null").join(shas.withColumnRenamed("rep", "ender"), "ender").drop("ender")
    nodes = hashed.union(nodes.where("ender is null").drop("ender").withColumn("sha", F.lit(_NOTHING)))
    return nodes.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))
