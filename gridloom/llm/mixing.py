"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents form one stream in a permuted order that depends only on (seed, doc_id, text). A source with target T takes whole
passes over its stream and then the first T mod size words of it, so its taken words are the target rounded down, exactly. What it takes is
cut into blocks of block_words words; a document is in the block that its first word in a pass falls in. The blocks of all sources are dealt
to the output shards by a binary tree: at each node the left half draws its blocks without replacement, which gives every source a
multivariate-hypergeometric quota; quotas add up exactly, at every node, to the source's blocks and to the shards' sizes. A shard gets as many
next blocks of each permuted stream as its quota says, disjoint from all others', and is sorted by a keyed hash of its documents: the local
shuffle. A source's blocks are dealt round from a hashed one on. All of it is DataFrame expressions. Any number of sources can be mixed: a
tree node is a row for each group of about 2^FAN_BITS sources, which holds their counts that are not zero; only the windows that number and cap the sources (a name and two numbers each) run in one task.

Defined results: null text has size 0; null source is a source of its own, last in order; a source of no words has target 0; a negative
or missing id only enters hashes; equal rows get one place each, in an order that can't be told apart; an empty table gives an empty one;
columns of docs that share a name with a result give way to it, in texts() all stay. Documents that straddle the end of a source's last pass
are taken in part (their first words), so that taken never exceeds 2 * size; they may straddle the border of a shard, and lie in the first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._support import WORD, carried, named, store, unit_hash, unpacked

WEIGHTS = (5, 2, 1)
#: A hypergeometric draw looks at counts within so many standard deviations of the mean: beyond lies less than 1e-30.
WIDTH = 12.0
#: Sources (or groups of them) in a group of the tree: 2^FAN_BITS, about. Rows that one window over a source's stream sorts, about.
FAN_BITS, BUCKET_ROWS = 10, 20_000
MEMBER = ("last", "source", "sub")
MADE = ("size", "source_size", "target", "taken", "pieces")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of the marked are among the drawn, by inversion of the uniform number u; exact to double precision.

    Masses follow from one another by their ratios, from the lowest count within WIDTH deviations of the mean to the highest.
    """

    def limits(a: Column) -> Column:
        mean = a["k"] * a["d"] / F.greatest(a["n"], F.lit(1.0))
        spread = F.sqrt(mean * (1 - a["d"] / F.greatest(a["n"], F.lit(1.0))) + 1)
        low = F.greatest(F.lit(0.0), a["d"] + a["k"] - a["n"], F.floor(mean - WIDTH * spread).cast("double"))
        high = F.least(a["k"], a["d"], F.ceil(mean + WIDTH * spread).cast("double"))
        return F.struct(a.alias("a"), a["u"].alias("u"), low.cast("long").alias("low"), high.cast("long").alias("high"))

    def invert(b: Column) -> Column:
        n, k, d = b["a"]["n"], b["a"]["k"], b["a"]["d"]
        points = F.when(b["high"] > b["low"], F.sequence(b["low"] + 1, b["high"])).otherwise(F.array().cast("array<bigint>"))
        next_mass = lambda s, x: s["p"] * (k - x + 1) * (d - x + 1) / (x * (n - k - d + x))
        first = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"))
        mass = F.aggregate(points, first, lambda s, x: _let(next_mass(s, x), lambda p: F.struct(p.alias("p"), (s["sum"] + p).alias("sum"))))["sum"]
        begin = lambda m: F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), b["low"].alias("x"), (m * b["u"]).alias("at"))
        step = lambda s, x: _let(next_mass(s, x), lambda p: F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.when(s["sum"] <= s["at"], x).otherwise(s["x"]).alias("x"), s["at"].alias("at")))
        return F.aggregate(points, begin(mass), step)["x"]

    given = F.struct(*[c.cast("double").alias(x) for x, c in zip("nkdu", (total, marked, drawn, u), strict=True)])
    return _let(_let(given, limits), invert)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of each source of a table with source and size: weights repeat over sources in code point order."""
    order = F.col("source").asc_nulls_last()
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), order)
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = sources.withColumn("weight", weight).withColumn("cap", cap.cast("double")).withColumn("level", level)
    # the level at which the first source stays under its cap holds for all after it; earlier ones stop at their caps
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    at = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("cap") / F.col("weight"))).over(Window.partitionBy())
    return levelled.select("source", "source_size", F.least(F.col("cap"), F.coalesce(at * F.col("weight"), F.col("cap"))).alias("target"))


def _deal(listed: DataFrame, shards: int, seed: int, depth: int, top: bool) -> DataFrame:
    """last, source, sub (a member of a group), quotas, from rows of group, at (its members with their blocks n) and given (its own quotas).

    quotas: for each shard that gets any, in order, how many blocks it gets and how many it and those before it. The top group gives half of
    its blocks to each half of the shards; another what its quotas say. At each node the members in order draw from what the earlier left.
    """
    tree = listed.select("group", "given", F.lit(0).cast("long").alias("node"), "at")
    for level in range(shards.bit_length() - 1):
        width, salt = shards >> level, F.lit(level)
        total = F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + x["n"])
        before = lambda shard: F.aggregate("given", F.lit(0).cast("long"), lambda s, r: s + F.when(r["shard"] < shard, r["n"]).otherwise(F.lit(0)))
        half = F.ceil(total / 2).cast("long") if top else before(F.col("node") * width + width // 2) - before(F.col("node") * width)
        start = F.struct(total.alias("left"), half.alias("draw"), F.array().cast("array<bigint>").alias("got"))

        def split(s: Column, x: Column) -> Column:
            u = unit_hash(seed, salt, F.col("node"), *([F.lit(depth), x["sub"]] if depth else [x["last"], x["source"]]))  # noqa: B023
            after = lambda got: F.struct((s["left"] - x["n"]).alias("left"), (s["draw"] - got).alias("draw"), F.concat(s["got"], F.array(got)).alias("got"))
            return _let(hypergeometric(s["left"], x["n"], s["draw"], u), after)

        drawn = tree.select("group", "given", "node", F.arrays_zip("at", F.aggregate("at", start, split)["got"].alias("got")).alias("both"))
        part = lambda n: F.filter(F.transform("both", lambda z: F.struct(*[z["at"][c].alias(c) for c in MEMBER], n(z).alias("n"))), lambda x: x["n"] > 0)
        left = F.struct((F.col("node") * 2).alias("node"), part(lambda z: z["got"]).alias("at"))
        right = F.struct((F.col("node") * 2 + 1).alias("node"), part(lambda z: z["at"]["n"] - z["got"]).alias("at"))
        tree = drawn.select("group", "given", F.explode(F.array(left, right)).alias("half")).select("group", "given", "half.*").where(F.size("at") > 0)
    flat = tree.select("node", F.explode("at").alias("q")).select(*[F.col("q")[c].alias(c) for c in MEMBER], F.col("node").alias("shard"), F.col("q")["n"].alias("n"))
    upto = flat.withColumn("upto", F.sum("n").over(Window.partitionBy(*MEMBER).orderBy("shard")))
    return upto.groupBy(*MEMBER).agg(F.array_sort(F.collect_list(F.struct("shard", "n", "upto"))).alias("quotas"))


def shard_quotas(sources: DataFrame, shards: int, block_words: int, seed: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """sources with blocks (their number of taken blocks) and quotas: (shard, n, upto) for each shard that gets n > 0 of them.

    shards is a power of two. Each level of the tree splits every node's counts in two: together a multivariate-hypergeometric draw of
    exactly half the node's blocks. Sources are grouped by a hash, about 2^fan_bits to a group, and groups likewise: what a group draws is
    drawn first, then divided among its members, so no row holds more than a group.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    counted = sources.withColumn("blocks", F.ceil(F.floor("target") / F.lit(float(block_words))).cast("long"))
    bits = max(0, (counted.count() - 1).bit_length() - fan_bits)
    group = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << bits))
    ranks = [counted.where("blocks > 0").select(group.alias("group"), F.col("source").isNull().alias("last"), "source", F.lit(0).cast("long").alias("sub"), F.col("blocks").alias("n"))]
    while bits:
        up = min(bits, fan_bits)
        inner = [F.lit(False).alias("last"), F.lit(None).cast("string").alias("source"), F.col("group").alias("sub")]
        ranks.append(ranks[-1].groupBy("group").agg(F.sum("n").alias("n")).select(F.shiftright("group", up).alias("group"), *inner, "n"))
        bits -= up
    given = None
    for depth in reversed(range(len(ranks))):
        listed = ranks[depth].groupBy("group").agg(F.array_sort(F.collect_list(F.struct(*MEMBER, "n"))).alias("at"))
        listed = listed.withColumn("given", F.lit(None)) if given is None else listed.join(given, "group")
        dealt = _deal(listed, shards, seed, depth, given is None)
        given = dealt.select(F.col("sub").alias("group"), F.col("quotas").alias("given"))
    drawn = dealt.select(F.col("source").alias("of"), "quotas")
    none = F.array().cast(drawn.schema["quotas"].dataType)
    return counted.join(drawn, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("quotas", F.coalesce("quotas", none))


def _pieces(docs: DataFrame, keep: list[str], weights, share: float, most: int, shards: int, block_words: int, seed: int, bucket_rows: int) -> DataFrame:
    """row (the columns keep), text, size, source_size, target and pieces (see mix) of each row of docs."""
    buckets = max(64, 1 << (docs.count() // bucket_rows).bit_length())
    text = named("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(F.lit(seed), named("doc_id"), text)
    # none and of stand for source in keys: equality of plain columns keeps the join and the window on one shuffle
    names = [F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("of")]
    bucket = F.pmod(key, F.lit(buckets)).cast("int").alias("bucket")
    sized = docs.select(named("source").cast("string").alias("source"), bucket, size.alias("size"))
    keyed = docs.select(carried(keep), named("source").cast("string").alias("source"), bucket, key.alias("key"), size.alias("size")).select("row", *names, "bucket", "key", "size")
    # where each bucket of a source's stream starts: sums of buckets, then a window over the buckets alone
    per = store(sized.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = per.select(*names, "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("begin"), F.col("size").alias("length"))
    plan = shard_quotas(source_targets(per, weights, share, most), shards, block_words, seed)
    # a source's blocks are dealt from one of them on, by a hash, and round: else the last, shorter ones would fill the last shards
    turn = F.floor(unit_hash(seed + 2, *names) * F.col("blocks")).cast("long")
    plan = plan.select(*names, "source_size", "target", "blocks", turn.alias("turn"), "quotas")
    # of its source's quotas, a bucket carries those that its stretches of the stream meet, one in each pass
    block = lambda p, at: F.floor((p * F.col("source_size") + at) / block_words) + F.col("turn")
    ends = [(block(F.lit(p), F.col("begin")) - back, block(F.lit(p), F.col("begin") + F.col("length")) - back) for p in range(most + 1) for back in (F.lit(0), F.col("blocks"))]
    met = F.filter("quotas", lambda r: reduce(or_, [(r["upto"] > lo) & (r["upto"] - r["n"] <= hi) for lo, hi in ends]))
    begins = begins.join(plan, ["none", "of"]).select("none", "of", "bucket", "begin", "source_size", "target", "blocks", "turn", met.alias("quotas"))
    placed = keyed.join(begins, ["none", "of", "bucket"])
    inside = Window.partitionBy("none", "of", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.col("begin") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # pass p of the stream is [p * source_size, (p + 1) * source_size) of what the source takes: [0, target)
    quota = F.floor("target").cast("long")

    def piece(p: Column) -> Column:
        lo = p * F.col("source_size") + F.col("at")
        words = F.least(lo + F.col("size"), quota) - lo
        # the shard whose quota the block of the first word falls in
        number = (F.floor(lo / block_words) + F.col("turn")) % F.greatest("blocks", F.lit(1))
        shard = F.get(F.filter("quotas", lambda r: r["upto"] > number), F.lit(0))["shard"].cast("int")
        return F.struct(p.alias("pass"), shard.alias("shard"), F.xxhash64(F.lit(seed + 1), "none", "of", "key", p).alias("place"), words.alias("words"))

    pieces = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most)), piece), lambda x: x["words"] > 0)
    return placed.select("row", "size", "source_size", "target", pieces.alias("pieces"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2, shards: int = 16, block_words: int = 1024, seed: int = 42, keep: list[str] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """keep (default: all columns of docs) with size, source_size, target, taken, pieces.

    pieces: an array of (pass, shard, place, words), what the mix takes of the document: in each pass its first words, which go to the shard
    that drew the block of the pass's first one, and lie there at place (a sort key: the local shuffle).
    """
    keep = docs.columns if keep is None else keep
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    cut = _pieces(docs, keep, weights, share, most, shards, block_words, seed, bucket_rows)
    return cut.select(*unpacked(keep, MADE), "size", "source_size", "target", taken.alias("taken"), "pieces")


def texts(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2, shards: int = 16, block_words: int = 1024, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The mix as rows of docs: a partition for each shard, shuffled by place; a document once for each pass it is taken in.

    The last documents of a source may be cut behind a word; n_chars, where there is one, follows the text.
    """
    cut = _pieces(docs, docs.columns, weights, share, most, shards, block_words, seed, bucket_rows)
    rows = cut.select("row", "size", F.explode("pieces").alias("piece")).repartitionById(shards, F.col("piece.shard")).sortWithinPartitions("piece.place")
    text, words = F.col("row")["text"].cast("string"), F.col("piece.words")
    # words with the white space before them: joined they are the text's beginning again
    begin = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words.cast("int")), "")
    part = words < F.col("size")
    changes = {"text": F.when(part, begin).otherwise(text)}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(part, F.length(begin)).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changes.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
