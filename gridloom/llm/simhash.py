"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has a bit set where over half of the XXH64 hashes of its word shingles have it. Fingerprints within DISTANCE bits are
linked. The 64 bits form a ring of SEGMENTS; by the pigeonring principle, two fingerprints within DISTANCE have a segment from which on
every chain of l segments differs in at most l * DISTANCE / SEGMENTS bits. For 3 bits and 4 segments: some segment is equal, and with the
next one differs in at most 1 bit, with the next two in at most 2. The first two budgets make the index: the equal segment, together with
one half of the next (one bit can't touch both halves), is the key of a group; within a group the chains' cumulative differences are
checked before the full Hamming distance.

Equal fingerprints are one node. A group of many different fingerprints is dealt in blocks, each pair of blocks to some task, which compares
them in memory and gives out only a forest of links: no task holds more than two blocks of GROUP rows, and links grow with the rows; the rows
dealt grow with the square of a group over GROUP, that of its comparisons.

Defined results: A-Z are lower-cased and words are runs other than white space; a text of fewer words than a shingle is one shingle; null
and empty texts have fingerprint zero and are linked like any other; a null id never is a component's id unless all of them are null;
equal rows share a component; long texts are read whole, in parts that overlap by a shingle; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._graph import components
from ._support import carried, fresh, named, read_texts, store, unpacked
from ._text import BLOCK, blocks, mix, string_buffers

DISTANCE, SEGMENTS, WIDTH = 3, 4, 16
#: Fingerprints of a group that one task compares with one another, or with as many others.
GROUP = 1024
SEED = 42
#: For similarity instead of a distance: words of 64 bits in a fingerprint, minima in a key, keys of a text.
LANES, ROWS, BANDS = 8, 3, 16
#: Standard deviations by which fingerprints of candidates may lie beyond their expected distance; shingles of a block of sets.
LOOSE, SHINGLES = 8.0, 1 << 20

_LANES = np.uint64(0x0001000100010001)
_FULL = 65_535


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of every run of so many words of text, lower-cased and joined by spaces."""
    digest, rest, out, at, first = xxhash.xxh64_intdigest, [], [], 0, True
    while at < len(text) or first:
        first = False
        cut = len(text)
        if cut - at > BLOCK:
            found = re.compile(rb"[\x20\x09-\x0D]").search(text, at + BLOCK)
            cut = found.start() if found else cut
        parts = rest + text[at:cut].lower().split()
        at, rest = cut, parts[len(parts) - words + 1 :] if len(parts) >= words else parts
        if len(parts) < words:
            if at >= len(text) and not out and parts:
                out.append(np.array([digest(b" ".join(parts), SEED)], np.uint64))
            continue
        line = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
        ends = ends[words - 1 :].tolist()
        out.append(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def majority(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each range of hashes, the bits that over half of them have. Sixteen bits at a time are counted in lanes of 16 bits."""
    out = np.zeros(len(off) - 1, np.uint64)
    n = np.diff(off)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    pieces = [np.arange(off[d], off[d + 1], _FULL) for d in full] if n.max() > _FULL else None
    starts = np.concatenate(pieces) if pieces else off[full]
    owner = np.cumsum([0, *map(len, pieces)])[:-1] if pieces else None
    for k in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        for lane in range(4):
            count = ((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
            if owner is not None:
                count = np.add.reduceat(count, owner)
            out[full] |= (2 * count > n[full]).astype(np.uint64) << np.uint64(16 * lane + k)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = string_buffers(batch.column(batch.num_columns - 1))
        raw = data.tobytes()
        for lo, hi in blocks(off):
            hashes = [shingle_hashes(raw[off[d] : off[d + 1]], words) for d in range(lo, hi)]
            ends = np.cumsum([0, *map(len, hashes)])
            found = majority(np.concatenate(hashes), ends).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), pa.array(found)], names=[*batch.schema.names[:-1], "fingerprint"])


def _segment(bits: Column, at: int) -> Column:
    return F.shiftrightunsigned(bits, WIDTH * (at % SEGMENTS)).bitwiseAND((1 << WIDTH) - 1)


def group_keys(bits: Column) -> Column:
    """The keys of the groups a fingerprint is in: each segment with each half of the segment behind it."""
    half = WIDTH // 2
    return F.array(*[
        F.lit((2 * i + j) << (WIDTH + half)) + F.shiftleft(_segment(bits, i), half) + F.shiftrightunsigned(_segment(bits, i + 1), half * j).bitwiseAND((1 << half) - 1)
        for i in range(SEGMENTS)
        for j in range(2)
    ])


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether fingerprints are within DISTANCE: chains of segments within their budgets first, then all bits for those left."""
    differ = x ^ y
    ok = np.zeros(differ.shape, bool)
    each = [np.bitwise_count((differ >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)) for s in range(SEGMENTS)]
    for start in range(SEGMENTS):
        total, chain = each[start], each[start] <= DISTANCE // SEGMENTS
        for n in range(2, SEGMENTS):
            total = total + each[(start + n - 1) % SEGMENTS]
            chain &= total <= n * DISTANCE // SEGMENTS
        ok |= chain
    at = np.nonzero(ok)
    ok[at] = np.bitwise_count(differ[at]) <= DISTANCE
    return ok


def forest(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each fingerprint, but one of each connected set, to another of its set."""
    n = len(bits)
    label = np.arange(n)
    near = [linked(bits[lo : lo + 256, None], bits[None, :]) for lo in range(0, n, 256)]
    while True:
        least = np.concatenate([np.where(m, label[None, :], n).min(axis=1) for m in near])
        least = label[least]
        if (least == label).all():
            break
        label = least
    move = label != np.arange(n)
    return bits[move], bits[label[move]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, lo, hi); a group, which may lie over several batches, has at most about 2 * GROUP rows."""
    held: list[pa.RecordBatch] = []

    def groups(last: bool) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        key, lo, hi, bits = (rows.column(c).to_numpy() for c in ("key", "lo", "hi", "fingerprint"))
        cut = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        edges = [0, *cut.tolist(), *([len(key)] if last else [])]
        a, b = [], []
        for s, e in zip(edges, edges[1:], strict=False):
            if e - s == 2:  # most groups
                x, y = bits[s : s + 1], bits[s + 1 : e]
                if np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64))[0] <= DISTANCE:
                    a.append(x)
                    b.append(y)
            elif e - s > 2:
                x, y = forest(bits[s:e].view(np.uint64))
                a.append(x.view(np.int64))
                b.append(y.view(np.int64))
        held[:] = [] if last else rows.slice(edges[-1]).to_batches()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            yield from groups(False)
    if held:
        yield from groups(True)


def links(bits: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (a table with the column fingerprint) that join all that are within DISTANCE."""
    keyed = bits.select("fingerprint", F.explode(group_keys(F.col("fingerprint"))).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    grouped = keyed.join(counts, "key").withColumn("parts", parts).withColumn("own", own)
    pairs = grouped.select("key", "fingerprint", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = pairs.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fingerprint")
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """keep (default: id), fingerprint (bigint), component_id (the least id of all rows that links lead to) of each row.

    Columns of docs that share a name with a result give way to it.
    """
    keep = list(dict.fromkeys([id, *(keep or [])]))
    marked = store(read_texts(docs, keep, text, lambda batches: _fingerprint(batches, words), "fingerprint bigint"), "fingerprints")
    distinct = store(marked.groupBy("fingerprint").agg(F.min(F.col("row")[id]).alias("least")), "distinct")
    labels = components(links(distinct))
    labelled = distinct.join(labels, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("label", "fingerprint").alias("label"))
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of = labelled.select("fingerprint", "label").join(ids, "label").select("fingerprint", "component_id")
    return marked.join(of, "fingerprint").select(*unpacked(keep, ["fingerprint", "component_id"]), "fingerprint", "component_id")


def radius(similarity: float, bits: int = 64 * LANES, slack: float = 1.5) -> int:
    """The distance of fingerprints of texts with this Jaccard similarity of shingles, and slack standard deviations more.

    A bit of two fingerprints differs with the probability angle / pi, the angle being that of the texts' sets of shingles.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + slack * np.sqrt(bits * p * (1 - p)))


def _turned(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of many independent hashes that follow from one."""
    with np.errstate(over="ignore"):
        return mix(hashes * np.uint64(2 * k + 1) + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def sketch(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range of hashes: a fingerprint of LANES words, and BANDS keys of ROWS minima each (of an empty range: zeros)."""
    n = len(off) - 1
    bits = np.stack([majority(_turned(hashes, k), off) for k in range(LANES)], axis=1)
    keys = np.zeros((n, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(off))
    for k in range(BANDS * ROWS if len(full) else 0):
        least = np.minimum.reduceat(_turned(hashes, LANES + k), off[full])
        with np.errstate(over="ignore"):
            keys[full, k // ROWS] = mix(keys[full, k // ROWS] + least + np.uint64(k // ROWS + 1))
    return bits, keys


def _shingle_sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """Row ranges of a batch, the sorted distinct shingle hashes of each row's text (the last column), and a hash of each such set."""
    data, off = string_buffers(batch.column(batch.num_columns - 1))
    raw = data.tobytes()
    for lo, hi in blocks(off):
        hashes = [np.unique(shingle_hashes(raw[off[d] : off[d + 1]], words)) for d in range(lo, hi)]
        yield lo, hi, hashes, np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in hashes], np.uint64).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    fixed = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel().view(np.int64)))
    for batch in batches:
        for lo, hi, hashes, node in _shingle_sets(batch, words):
            bits, keys = sketch(np.concatenate(hashes), np.cumsum([0, *map(len, hashes)]))
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), fixed(bits), fixed(keys), pa.array(node)], names=[*batch.schema.names[:-1], "bits", "keys", "node"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, hashes, node in _shingle_sets(batch, words):
            ends = np.cumsum([0, *map(len, hashes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hashes).view(np.int64)))], names=["node", "shingles"])


def near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Whether fingerprints (words in the last axis) are within most bits: chains of two words within their budgets, then all bits."""
    each = np.bitwise_count(x ^ y).astype(np.int16)
    n = each.shape[-1]
    chain = (each * n <= most) & ((each + np.roll(each, -1, axis=-1)) * n <= 2 * most)
    ok = chain.any(axis=-1)
    at = np.nonzero(ok)
    ok[at] = each[at].sum(axis=-1) <= most
    return ok


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of more than one row among rows sorted by (key, lo, hi)."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain((b for b in batches if b.num_rows), [None]):
        held += [batch] if batch is not None else []
        if not held:
            return
        rows = pa.Table.from_batches(held)
        key, lo, hi = (rows.column(c).to_numpy() for c in ("key", "lo", "hi"))
        cut = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        edges = [0, *cut.tolist(), *([len(key)] if batch is None else [])]
        for a, b in itertools.pairwise(edges):
            if b - a > 1:
                yield rows.slice(a, b - a)
        held = rows.slice(edges[-1]).to_batches()


def _wide_links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A forest of links within each group of rows, sorted by (key, lo, hi); a group has at most about 2 * GROUP rows."""
    for rows in _groups(batches):
        node = rows.column("node").to_numpy()
        bits = rows.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        label = np.arange(len(node))
        within = [near(bits[lo : lo + 64, None, :], bits[None, :, :], most) for lo in range(0, len(node), 64)]
        while True:
            least = label[np.concatenate([np.where(m, label[None, :], len(node)).min(axis=1) for m in within])]
            if (least == label).all():
                break
            label = least
        move = label != np.arange(len(node))
        yield pa.RecordBatch.from_arrays([pa.array(node[move]), pa.array(node[label[move]])], names=["a", "b"])


def set_forest(shingles: np.ndarray, off: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets (ranges of distinct shingles, none empty) that join all whose Jaccard similarity is at least similarity."""
    code = np.unique(shingles, return_inverse=True)[1]
    size, has = np.diff(off), np.zeros(len(code), bool)
    open_ = np.ones(len(size), bool)
    left, codes, starts = np.arange(len(size)), code, off[:-1]
    a, b = [], []
    for first in range(len(size)):
        queue = [first] if open_[first] else []
        open_[first] = False
        while queue:
            i = queue.pop()
            if 2 * np.count_nonzero(open_) < len(left):  # those reached already need no more links
                left = np.flatnonzero(open_)
                if not len(left):
                    break
                codes = np.concatenate([code[off[j] : off[j + 1]] for j in left])
                starts = np.cumsum(size[left]) - size[left]
            own = code[off[i] : off[i + 1]]
            has[own] = True
            common = np.add.reduceat(has[codes], starts, dtype=np.int64)
            has[own] = False
            found = left[(common / (size[left] + size[i] - common) >= similarity) & open_[left]]
            open_[found] = False
            a.append(found)
            b.append(np.full(len(found), i))
            queue += found.tolist()
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _set_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches):
        node, sets = rows.column("node").to_numpy(), rows.column("shingles").combine_chunks()
        off = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        a, b = set_forest(sets.flatten().to_numpy(), off, similarity)
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])


def _dealt(members: DataFrame, carried: str) -> DataFrame:
    """key, lo, hi, node, carried: each far row (key, node, far, far_parts, near_parts) meets all rows of its key, in pairs of blocks."""
    own = F.pmod(F.xxhash64("node"), F.when(F.col("far"), F.col("far_parts")).otherwise(F.col("near_parts"))).cast("int")
    # far blocks have the numbers 0, 1, ..., near blocks -1, -2, ...
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    with_fars = lambda x: upto(F.col("far_parts"), lambda i: F.struct(F.least(x, i).alias("lo"), F.greatest(x, i).alias("hi")))
    with_nears = upto(F.col("near_parts"), lambda i: F.struct((-1 - i).alias("lo"), F.col("own").alias("hi")))
    pairs = F.when(F.col("far"), F.concat(with_fars(F.col("own")), with_nears)).otherwise(with_fars(-1 - F.col("own")))
    dealt = members.withColumn("own", own).select("key", F.explode(pairs).alias("pair"), "node", carried).select("key", "pair.lo", "pair.hi", "node", carried)
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def similar_links(nodes: DataFrame, most: int) -> DataFrame:
    """a, b: links between the rows of a table with node, bits, keys that join all that share a key and are within most bits.

    Every row of a key is compared with the key's least node. Those near it are connected already; the others are compared with all rows
    of the key, in pairs of blocks: a key of many copies of one text costs no more than its rows, one of many different ones a row for each block.
    """
    keyed = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    at = nodes.select(F.col("node").alias("pivot"), F.col("bits").alias("pivot_bits"))
    members = keyed.join(groups.join(at, "pivot"), "key").join(nodes.select("node", "bits"), "node")
    apart = F.aggregate(F.zip_with("bits", "pivot_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    members = store(members.select("key", "n", "node", "pivot", (apart > most).alias("far"), "bits"), "members")
    stars = members.where("not far and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    rest = members.where("far and n > 2").groupBy("key").agg(F.count("*").alias("fars"))
    blocks_of = lambda n: F.ceil(n / GROUP).cast("int")
    open_ = members.join(rest, "key").withColumn("far_parts", blocks_of(F.col("fars"))).withColumn("near_parts", blocks_of(F.col("n") - F.col("fars")))
    return stars.union(_dealt(open_, "bits").mapInArrow(lambda b: _wide_links(b, most), "a bigint, b bigint"))


def set_links(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between the rows of a table with node, key, shingles that join all of a key whose sets are similar.

    key is one of the key's nodes. Every set is compared with that node's; those similar to it are connected already, and the others are
    compared with all sets of the key, in pairs of blocks.
    """
    pivots = members.where("node = key").select("key", F.col("shingles").alias("pivot"))
    common = members.join(pivots, "key").select("key", "node", F.size("shingles").alias("n"), F.size("pivot").alias("m"), F.size(F.array_intersect("shingles", "pivot")).alias("both"))
    judged = store(common.select("key", "node", "n", (F.col("both") / (F.col("n") + F.col("m") - F.col("both")) < similarity).alias("far")), "judged")
    stars = judged.where("not far and node <> key").select(F.col("node").alias("a"), F.col("key").alias("b"))
    blocks_of = lambda which: F.greatest(F.ceil(F.count_if(which) / GROUP), F.ceil(F.sum(F.when(which, F.col("n"))) / SHINGLES)).cast("int")
    rest = judged.groupBy("key").agg(F.count("*").alias("rows"), blocks_of(F.col("far")).alias("far_parts"), blocks_of(~F.col("far")).alias("near_parts"))
    open_ = judged.join(rest.where("far_parts > 0 and rows > 2"), "key").select("key", "node", "far", "far_parts", "near_parts")
    dealt = _dealt(open_.join(members.select("node", "shingles"), "node"), "shingles")
    return stars.union(dealt.mapInArrow(lambda b: _set_links(b, similarity), "a bigint, b bigint"))


def similar(docs: DataFrame, keep: list[str], text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """keep, label of each row: rows whose texts are similar, directly or over others, have equal labels.

    Texts are similar where the Jaccard similarity of their sets of (hashed) shingles is at least similarity; texts of equal sets are one
    node. A radius of few bits finds no copies at a similarity like 0.8, and one that does leaves segments of no use as keys. So candidates
    share a key of minima of their shingles (at 0.8, all but 1 in 90,000 pairs do) and have wide fingerprints within a loose radius; then the
    sets of all that candidates connect are compared, and only these comparisons link.
    """
    kept = docs.select(carried(keep), F.xxhash64(named(text)).alias("text_key"), named(text).alias("text"))
    schema = StructType([*kept.schema.fields[:-1], *StructType.fromDDL("bits array<bigint>, keys array<bigint>, node bigint").fields])
    marked = store(kept.mapInArrow(lambda b: _sketch(b, words), schema), "sketches")
    nodes = store(marked.groupBy("node").agg(F.min("bits").alias("bits"), F.min("keys").alias("keys")), "nodes")
    loose = components(similar_links(nodes, radius(similarity, slack=LOOSE))).select("node", F.col("label").alias("key"))
    wanted = marked.join(loose, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key")).select("text_key").distinct()
    sets = kept.join(wanted, "text_key", "left_semi").select("text").mapInArrow(lambda b: _sets(b, words), "node bigint, shingles array<bigint>")
    members = store(sets.groupBy("node").agg(F.first("shingles").alias("shingles")).join(loose, "node"), "sets")
    labels = components(set_links(members, similarity))
    return marked.join(labels, "node", "left").select(*unpacked(keep, ["label"]), F.coalesce("label", "node").alias("label"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row (of the least id; null last) of each class of similar texts."""
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    keyed = docs.withColumn(k1, F.xxhash64(id, text)).withColumn(k2, F.xxhash64(text, id))
    found = similar(keyed.select(F.col(id).alias("id"), F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(text).alias("text")), ["id", "k1", "k2"], "text", words, similarity)
    first = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2")).alias("row"))
    kept = first.select(F.col("row.k1").alias(k1), F.col("row.k2").alias(k2)).distinct()
    # rows that agree in id and text are one
    again = F.row_number().over(Window.partitionBy(k1, k2).orderBy(k1))
    turn = fresh(keyed, "turn")
    return keyed.join(kept, [k1, k2], "left_semi").withColumn(turn, again).where(F.col(turn) == 1).select(*[named(c) for c in docs.columns])
