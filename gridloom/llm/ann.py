"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: unit vectors are centred and rotated by matrices learned by iterative quantization (Gong and Lazebnik) on a sample of at most SAMPLE
rows, one rotation for each stretch of bits, and each coordinate's sign is a bit. A code is split into substrings of WIDTH bits. The index
has a row for each substring of each code, dealt by (substring, its first bits, part): as many first bits as keep groups small, and parts
where one value has very many rows. By the pigeonhole principle a code within the radius r of a query has, over m substrings, one of the first
r mod m + 1 within floor(r / m) bits, or one of the others within floor(r / m) - 1; probing these values retrieves every such code, and many
farther ones. Codes found are kept if all their bits are within a second, looser radius and they are among the nearest of their group (NEAREST),
and reranked by exact cosines in double precision. A query for which a group holds more codes within the looser radius than that, as in a crowd
of near copies, is compared with all rows instead, block by block: nothing within the radii is left out, and no pair of a crowd is written.

Both radii are learned: SAMPLED queries are compared with all rows, exactly, and the first radius is the least that retrieves SHARE of their true
neighbours; so it shrinks as the table gets denser. A query for which fewer rows than asked for are found is compared with all rows instead.
The index's rows grow with the rows, its probes with the queries times the groups they reach. The exact comparison reads queries times rows: a row
goes to each block of QUERY_BLOCK queries that need it, so where a share of the queries lies in crowds, its work is that share of a whole scan.

Equal vectors are one node with the k + 1 least of their ids: more of them can't be among the k nearest.

Defined results: vectors that are null, zero, of another length than most of the sample's, or hold null or non-finite components take no
part, nor do rows without id; finite components of any size do; a query is never its own neighbour, nor is a row that repeats its id; repeated
queries count once, one with several vectors by the least of them; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._support import named, release, store

SAMPLE, BITS, ROUNDS, WIDTH = 4096, 512, 20, 16
#: Queries that set the radii, and the share of their neighbours that the first radius retrieves at least.
SAMPLED, SHARE = 128, 0.97
#: Rows that one task's tables hold, about; rows and queries of a block of the exact comparison.
GROUP, ROW_BLOCK, QUERY_BLOCK = 8_192, 8_192, 1_024
#: Codes that a query takes from one group: those as near as this many of its nearest there (ties included) go to the exact rerank.
NEAREST = 256
#: In place of a node: the query lost codes within the loose radius.
CUT = -1

_WEIGHT = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint32)).astype(np.uint8)
#: All values of a substring by their number of bits, and where those of more bits than r begin.
_MASKS = np.argsort(_WEIGHT, kind="stable").astype(np.uint16)
_UPTO = np.searchsorted(_WEIGHT[_MASKS], np.arange(WIDTH + 2), "left")


@dataclass
class Codebook:
    mean: np.ndarray
    turn: np.ndarray  # dimensions x bits
    radius: int = 0
    loose: int = BITS

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of substrings, of vectors scaled to length one."""
        return np.packbits((vectors - self.mean) @ self.turn > 0, axis=1).view(np.uint16)

    def reach(self, substrings: int) -> np.ndarray:
        """How many bits each substring is probed for; -1: not at all."""
        each, rest = divmod(self.radius, substrings)
        return np.where(np.arange(substrings) <= rest, each, each - 1)


def learn(sample: np.ndarray, bits: int = BITS, seed: int = 7) -> Codebook:
    """Rotations from unit vectors."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    x = sample - mean
    dims = min(x.shape[1], bits)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :dims]
    flat, turns = x @ axes, []
    for _ in range(-(-bits // dims)):
        turn, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (u @ v).T
        turns.append(axes @ turn)
    return Codebook(mean, np.concatenate(turns, axis=1)[:, :bits])


def set_radii(book: Codebook, asked: np.ndarray, near: np.ndarray, share: float = SHARE) -> None:
    """From pairs of unit vectors, queries and their true neighbours."""
    apart = np.bitwise_count(book.encode(asked) ^ book.encode(near)).astype(int)
    if not len(apart):
        return
    m = apart.shape[1]
    for radius in range(BITS + 1):
        book.radius = radius
        if (apart <= book.reach(m)).any(axis=1).mean() >= share:
            break
    whole = apart.sum(axis=1)
    book.loose = max(book.radius, int(np.ceil(np.quantile(whole, 0.995))) + 2)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; a power of two takes care of very large and very small components first."""
    scaled = vectors / np.exp2(np.floor(np.log2(np.abs(vectors).max(axis=1, keepdims=True))))
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy().reshape(len(column), -1)
    return np.array(column.tolist(), np.float64)


def _encoded(batches: Iterator[pa.RecordBatch], book: Codebook) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            codes = book.encode(unit(_matrix(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["node", "code"])


def _codes(column: pd.Series | pa.Array) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), -1)


def _keyed(batches: Iterator[pa.RecordBatch], first_bits: int, reach: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """place, head, node, code: the groups each code is indexed in, or with reach those in which a query probes."""
    heads = np.arange(1 << first_bits, dtype=np.uint32)
    for b in batches:
        for rows in (b.slice(lo, 1_000) for lo in range(0, b.num_rows, 1_000)):
            codes = _codes(rows.column(1))
            head = (codes >> np.uint16(WIDTH - first_bits)).astype(np.int32) if first_bits else np.zeros(codes.shape, np.int32)
            if reach is None:
                row, place = np.divmod(np.arange(codes.size), codes.shape[1])
                found = head.ravel()
            else:
                near = np.bitwise_count(heads[None, :] ^ np.arange(1 << first_bits, dtype=np.uint32)[:, None]) if first_bits <= 8 else None
                parts = []
                for j in range(codes.shape[1]):
                    if reach[j] < 0:
                        continue
                    if near is not None:
                        r, h = np.nonzero(near[head[:, j]] <= reach[j])
                    else:
                        masks = _MASKS[: _UPTO[reach[j] + 1]]
                        masks = masks[masks < 1 << first_bits].astype(np.int32)
                        r, h = np.repeat(np.arange(len(head)), len(masks)), (head[:, j, None] ^ masks).ravel()
                    parts.append((r, np.full(len(r), j), h))
                row, place, found = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, int)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(found.astype(np.int32)), rows.column(0).take(pa.array(row)), rows.column(1).take(pa.array(row))], names=["place", "head", "node", "code"])


def _probe(queries: pd.DataFrame, rows: pd.DataFrame, book: Codebook, first_bits: int) -> pd.DataFrame:
    """asked, node of the codes of one group that a query retrieves there first, over all substrings in order, and that are within the loose radius; or CUT."""
    asked, found = [], []
    if len(queries) and len(rows):
        place, head = int(rows["place"].iloc[0]), int(rows["head"].iloc[0])
        codes, wanted = _codes(rows["code"]), _codes(queries["code"])
        reach = book.reach(codes.shape[1])
        order = np.argsort(codes[:, place], kind="stable")
        codes, nodes = codes[order], rows["node"].to_numpy()[order]
        last_bits = WIDTH - first_bits
        table = np.searchsorted(codes[:, place].astype(np.int64), (head << last_bits) + np.arange((1 << last_bits) + 1))
        masks = _MASKS[: _UPTO[reach[place] + 1]]
        words, code_words = np.ascontiguousarray(wanted).view(np.uint64), np.ascontiguousarray(codes).view(np.uint64)
        for q, node in enumerate(queries["node"].tolist()):
            value = masks ^ wanted[q, place]
            value = value[value >> np.uint16(last_bits) == head] if last_bits < WIDTH else value
            value = value & np.uint16((1 << last_bits) - 1)
            begin, n = table[value], table[value.astype(np.int64) + 1] - table[value]
            at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            apart = np.bitwise_count(code_words[at] ^ words[q]).sum(axis=1, dtype=int)
            at, apart = at[apart <= book.loose], apart[apart <= book.loose]
            if place and len(at):  # those that an earlier substring retrieves are found there
                new = ~(np.bitwise_count(codes[at, :place] ^ wanted[q, :place]) <= reach[:place]).any(axis=1)
                at, apart = at[new], apart[new]
            if len(at) > NEAREST:
                last = np.partition(apart, NEAREST - 1)[NEAREST - 1]
                if (apart > last).any():
                    asked.append([node])
                    found.append([CUT])
                at = at[apart <= last]
            asked.append(np.full(len(at), node))
            found.append(nodes[at])
    return pd.DataFrame({"asked": np.concatenate(asked), "node": np.concatenate(found)} if asked else {"asked": np.zeros(0, np.int64), "node": np.zeros(0, np.int64)})


def _nearest_of(batches: Iterator[pa.RecordBatch], ids: np.ndarray, asked: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k rows of each batch with the largest cosine to each of a few vectors."""
    for b in batches:
        if not b.num_rows:
            continue
        score = asked @ unit(_matrix(b.column(1))).T
        score[b.column(0).to_numpy()[None, :] == ids[:, None]] = -2
        best = np.argpartition(-score, min(k, b.num_rows) - 1, axis=1)[:, :k]
        row, at = np.repeat(np.arange(len(asked)), best.shape[1]), best.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(score[row, at]), *(c.take(pa.array(at)) for c in b.columns)], names=["asked", "score", "node", "vector"])


def _compare(block: pd.DataFrame, k: int) -> pd.DataFrame:
    """asked, node: the k nearest rows of a block, and those tied with them but for rounding, of each of a block of queries."""
    rows, queries = block[~block["query"]], block[block["query"]]
    if not len(rows) or not len(queries):
        return pd.DataFrame({"asked": np.zeros(0, np.int64), "node": np.zeros(0, np.int64)})
    score = unit(_matrix(queries["vector"])) @ unit(_matrix(rows["vector"])).T
    least = np.partition(score, max(0, len(rows) - k), axis=1)[:, max(0, len(rows) - k)]
    q, r = np.nonzero(score >= least[:, None] - 1e-12)
    return pd.DataFrame({"asked": queries["node"].to_numpy()[q], "node": rows["node"].to_numpy()[r]})


def _candidates(nodes: DataFrame, asked: DataFrame, n: int, sample: int, k: int) -> DataFrame:
    """asked, node: pairs that the index retrieves."""
    drawn = nodes.select("node", "vector").orderBy(F.xxhash64("vector"), "node").limit(sample).toPandas()
    some = unit(_matrix(drawn["vector"]))
    book = learn(some)
    ids, few = drawn["node"].to_numpy()[:SAMPLED], some[:SAMPLED]
    # the true neighbours of some rows, from one pass over all
    kinds = f"asked int, score double, node bigint, vector {nodes.schema['vector'].dataType.simpleString()}"
    found = nodes.select("node", "vector").mapInArrow(lambda b: _nearest_of(b, ids, few, k), kinds)
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "node")
    true = found.where("score > -2").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("asked", "vector").toPandas()
    if len(true):
        set_radii(book, few[true["asked"].to_numpy()], unit(_matrix(true["vector"])))
    first_bits = min(WIDTH, max(0, (n // GROUP).bit_length()))
    places = BITS // WIDTH
    reach = book.reach(places)
    codes = store(nodes.select("node", "vector").mapInArrow(lambda b: _encoded(b, book), "node bigint, code binary"), "codes")
    keyed = "place int, head int, node bigint, code binary"
    rows = codes.mapInArrow(lambda b: _keyed(b, first_bits, None), keyed)
    # at most places << WIDTH groups, 32 MB
    parts = rows.groupBy("place", "head").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    parts = F.broadcast(store(parts, "groups"))
    left = codes.join(asked, "node", "left_semi").mapInArrow(lambda b: _keyed(b, first_bits, reach), keyed).join(parts, ["place", "head"])
    left = left.select("place", "head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "code")
    right = rows.join(parts, ["place", "head"]).select("place", "head", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "code")
    group = ["place", "head", "part"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(lambda q, r: _probe(q, r, book, first_bits), "asked bigint, node bigint")


def _exact(nodes: DataFrame, asked: DataFrame, n: int, k: int) -> DataFrame:
    """asked, node: the nearest of all rows, for queries of which there are few; each block of queries meets each block of rows once."""
    rows, blocks = -(-n // ROW_BLOCK), max(1, -(-asked.count() // QUERY_BLOCK))
    own = lambda m: F.pmod(F.xxhash64("node"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = nodes.select(F.lit(False).alias("query"), "node", "vector", own(rows).alias("rows"), every(blocks).alias("queries"))
    right = nodes.join(asked, "node", "left_semi").select(F.lit(True).alias("query"), "node", "vector", every(rows).alias("rows"), own(blocks).alias("queries"))
    return left.union(right).groupBy("rows", "queries").applyInPandas(lambda b: _compare(b, k), "asked bigint, node bigint")


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows nearest by cosine to each row for which is_query holds."""
    key, values = named(id), named(vector)
    valid = key.isNotNull() & (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    usable = rows.where(F.coalesce(valid, F.lit(False))).select(key.alias("vec_id"), values.cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    kind = usable.schema["vec_id"].dataType.simpleString()
    lengths = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").head()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    usable = usable.where(F.size("vector") == lengths["size"])
    once = usable.groupBy("vec_id", "vector").agg(F.max("query").alias("query"))
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    nodes = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    # lengths from components over a power of two, so that no square is out of range
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("vector", F.abs)))))
    scaled = F.transform("vector", lambda x: x / F.col("scale"))
    nodes = nodes.withColumn("scale", scale).withColumn("scaled", scaled).withColumn("norm", F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x)))
    nodes = store(nodes.select(F.monotonically_increasing_id().alias("node"), "vector", "scaled", "norm", "ids", F.size("ids").alias("n_ids")), "nodes")
    members = once.where("query").groupBy("vec_id").agg(F.min("vector").alias("vector")).join(nodes.select("vector", "node"), "vector")
    members = store(members.select(F.col("vec_id").alias("query_id"), F.col("node").alias("asked")), "members")
    asked = members.select(F.col("asked").alias("node")).distinct()
    n, ids = nodes.agg(F.count("*"), F.sum("n_ids")).head()
    pairs = store(_candidates(nodes, asked, n, sample, k), "pairs")
    # queries for which too few were found, or too many to keep
    counts = pairs.join(nodes.select("node", "n_ids"), "node").groupBy("asked").agg(F.sum("n_ids").alias("n"))
    short = asked.join(counts.withColumnRenamed("asked", "node"), "node", "left").where(F.coalesce("n", F.lit(0)) < min(k + 1, ids)).select("node")
    short = store(short.union(pairs.where(F.col("node") == CUT).select("asked")).distinct(), "short")
    if not short.isEmpty():
        pairs = pairs.join(short.withColumnRenamed("node", "asked"), "asked", "left_anti").unionByName(_exact(nodes.select("node", "vector"), short, n, k + 1))
    there = nodes.select("node", "scaled", "norm", "ids")
    here = nodes.select(F.col("node").alias("asked"), F.col("scaled").alias("own"), F.col("norm").alias("own_norm"))
    dot = F.aggregate(F.zip_with("scaled", "own", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(there, "node").join(here, "asked").select("asked", (dot / (F.col("norm") * F.col("own_norm"))).alias("score"), F.explode("ids").alias("vec_id"))
    nearest_first = [F.desc("score"), F.col("vec_id")]
    top = scored.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(*nearest_first))).where(F.col("rank") <= k + 1).drop("rank")
    told = members.join(top, "asked").where("query_id <> vec_id")
    ranked = told.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*nearest_first)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
