"""Documents whose sets of word shingles are similar, by a grouped prefix join.

Shingles are put in one global order: by the number of sets that hold them, the rarest first. Two sets of n and m shingles can only have a
Jaccard similarity of t or more if they have a shingle in common among the first n - ceil(t n) + 1 and m - ceil(t m) + 1: their prefixes. Sets of
equal prefixes and equal size are one group, whatever their other shingles. Groups that have a prefix shingle in common are a candidate pair
unless their sizes differ too much, or the parity bitmaps of their first members, less the distances of their other members from these, differ
in more bits than similar sets can: two sets' bitmaps never differ in more bits than the sets in shingles. What passes is expanded to its
members, and only a comparison of the whole sets links. Filters leave nothing out, so all links are found that a comparison of all pairs finds,
but for those that follow from others.

The counts behind the order cover every shingle of every document. They pass through two shuffles in packed form: a block of documents sends
its distinct shingles (48 bits of their hashes) to buckets of these bits, with the document where it is only one of the block, so that a
shingle that a third of all documents hold is one entry for each block; buckets return only what occurs twice or more in the corpus.
Most shingles of a text occur nowhere else, and so most texts have no candidates at all.

No step makes all pairs of a key. Members of a key are compared with one of them, those that may be similar are connected by it, and only the
others meet the rest, in blocks that tasks compare in memory (see simhash.set_links, which compares whole sets likewise).

Defined results: A-Z are lower-cased, words are runs other than white space; a text of fewer words than a shingle is one shingle; null texts
and those without words have an empty set and are linked with nothing, not even with one another; equal sets are linked; rows of a null id are linked,
but such an id is no component's unless all are null; equal rows share a component; long texts are read whole, in parts; an empty table gives
an empty result; columns of docs that share a name with a result give way to it. Sets are of 64-bit hashes, words' and shingles'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._support import carried, named, release, store, unpacked
from ._text import BLOCK, blocks, mix, string_buffers
from .simhash import GROUP, _dealt, _groups, set_links

SEED = 42
#: Bits of a parity bitmap; shingles of a bucket of counts, about; documents of a block at most.
BITS, BUCKET, DOCS = 512, 1 << 20, 1 << 15
#: Words whose hashes a task keeps between texts.
KEPT_WORDS = 1 << 17
_SHIFT = np.uint64(16)
_SEVERAL = (1 << 16) - 1
_REST, _INFO, _SHARED, _COUNTS = 0, 1, 2, 3


class _Hashes(dict):
    """XXH64 of words, kept for those seen before, up to KEPT_WORDS between texts."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_HASHES = _Hashes()


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of the text, lower-cased; read in parts of BLOCK bytes, or one longer word."""
    if len(_HASHES) > KEPT_WORDS:
        _HASHES.clear()
    out, at = [], 0
    while at < len(text):
        cut = len(text)
        if cut - at > BLOCK:
            found = re.compile(rb"[\x20\x09-\x0D]").search(text, at + BLOCK)
            cut = found.start() if found else cut
        words = text[at:cut].lower().split()
        out.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
        at = cut
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of so many words, or of the whole sequence if it is shorter."""
    k = min(width, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = words[:n] + np.uint64(k)
        for j in range(1, k):
            h = mix(h) + words[j : j + n]
        h = np.sort(mix(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def sets_of(batch: pa.RecordBatch, width: int, limit: int = BLOCK) -> Iterator[tuple[int, int, list[np.ndarray], list[bytes]]]:
    """Row ranges of a batch, the set of each row's text (the last column), and 128 bits that tell sets apart."""
    data, off = string_buffers(batch.column(batch.num_columns - 1))
    for lo, hi in blocks(off, limit):
        for a in range(lo, hi, DOCS):
            b = min(hi, a + DOCS)
            sets = [shingle_set(word_hashes(data[off[d] : off[d + 1]].tobytes()), width) for d in range(a, b)]
            yield a, b, sets, [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]


def _marked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, sets, digests in sets_of(batch, width):
            made = [pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), *made], names=[*batch.schema.names[:-1], "digest", "n"])


def _shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, sets, digests in sets_of(batch, width):
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], names=["digest", "shingles"])


def parity(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """BITS bits for each of n sets: each hash turns one bit of its set's (of, which ascends)."""
    bit = (mix(hashes) & np.uint64(BITS - 1)).astype(np.int64)
    odd = [np.bincount((of[a:b] - lo) * BITS + bit[a:b], minlength=512 * BITS) & 1 for lo in range(0, n, 512) for a, b in [np.searchsorted(of, [lo, lo + 512])]]
    return np.packbits(np.concatenate(odd)[: n * BITS].astype(np.uint8).reshape(n, BITS), axis=1)


def _packed(tokens: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted tokens of 48 bits, with a document and a count each, in columns, so that equal upper bits and counts compress."""
    return b"".join([(tokens >> np.uint64(32)).astype(np.uint16).tobytes(), tokens.astype(np.uint32).tobytes(), docs.astype(np.uint16).tobytes(), counts.astype(np.uint32).tobytes()])


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 12
    high, low = np.frombuffer(data, np.uint16, n), np.frombuffer(data, np.uint32, n, 2 * n)
    return (high.astype(np.uint64) << np.uint64(32)) | low, np.frombuffer(data, np.uint16, n, 6 * n), np.frombuffer(data, np.uint32, n, 8 * n)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], names=["bucket", "block", "kind", "data"])


def _block_tokens(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """bucket, block, kind, data: of each block its distinct tokens by bucket, the tokens of several of its documents, and what is known of each document."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for _, _, sets, digests in sets_of(batch, width):
            chosen = {d: s for d, s in zip(digests, sets, strict=True) if len(s)}
            if not chosen:
                continue
            block += 1
            sizes = np.array([len(s) for s in chosen.values()], np.int64)
            hashes, of = np.concatenate(list(chosen.values())), np.repeat(np.arange(len(sizes)), sizes)
            digests = b"".join(chosen)
            del sets, chosen
            bitmaps = parity(hashes, of, len(sizes))
            tokens = hashes >> _SHIFT
            del hashes
            # sets are sorted, so equal tokens of one lie side by side
            new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])])
            tokens, of = tokens[new], of[new]
            short = np.bincount(of, minlength=len(sizes))
            order = np.argsort(tokens, kind="stable")
            tokens, of = tokens[order], of[order]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            count = np.diff(np.append(first, len(tokens)))
            several = np.repeat(count > 1, count)
            alone, docs = tokens[first], np.where(count > 1, _SEVERAL, of[first])
            bucket = (alone >> np.uint64(48 - bits)).astype(np.int64) if bits else np.zeros(len(alone), np.int64)
            cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            rows = [(int(bucket[a]), block, _REST, _packed(alone[a:b], docs[a:b], count[a:b])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            home = (block * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - bits)
            info = b"".join([sizes.astype(np.int64).tobytes(), short.astype(np.int64).tobytes(), digests, bitmaps.tobytes()])
            rows += [(home, block, _INFO, info), (home, block, _SHARED, _packed(tokens[several], of[several], np.zeros(several.sum(), np.int64)))]
            yield _rows(rows)


def _by(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """The rows of each key, of rows sorted by it."""
    held: list[tuple] = []
    at = ["bucket", "block"].index(key)
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("bucket", "block", "kind", "data")), strict=True):
            row = tuple(x.as_py() for x in row)
            if held and held[0][at] != row[at]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of each block's tokens those that two or more documents hold, with the number of these."""
    for rows in _by(batches, "bucket"):
        passed = [r for r in rows if r[2] != _REST]
        if passed:
            yield _rows(passed)
        rest = [r for r in rows if r[2] == _REST]
        if not rest:
            continue
        parts = [_unpacked(r[3]) for r in rest]
        tokens, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts]).astype(np.int64)
        order = np.argsort(tokens, kind="stable")
        sorted_ = tokens[order]
        first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        total = np.empty(len(tokens), np.int64)
        total[order] = np.add.reduceat(counts[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        at = 0
        for r, (own, docs, _) in zip(rest, parts, strict=True):
            held = total[at : at + len(own)]
            again = held > 1
            at += len(own)
            if again.any():
                yield _rows([(r[0], r[1], _COUNTS, _packed(own[again], docs[again], np.minimum(held[again], (1 << 32) - 1)))])


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """digest, n, keys, whole, bits of each document whose prefix has tokens of other documents, its keys; whole: all of its prefix are such."""
    for rows in _by(batches, "block"):
        info = next(r[3] for r in rows if r[2] == _INFO)
        n = len(info) // (16 + 16 + BITS // 8)
        sizes, short = np.frombuffer(info, np.int64, n), np.frombuffer(info, np.int64, n, 8 * n)
        digests, bitmaps = info[16 * n : 32 * n], np.frombuffer(info, np.int64, n * (BITS // 64), 32 * n).reshape(n, -1)
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        tokens, docs, counts = (np.concatenate(x) for x in zip(none, *(_unpacked(r[3]) for r in rows if r[2] == _COUNTS), strict=True))
        docs = docs.astype(np.int64)
        order = np.argsort(tokens)
        tokens, docs, counts = tokens[order], docs[order], counts[order]
        many = docs == _SEVERAL
        shared, holder, _ = _unpacked(next(r[3] for r in rows if r[2] == _SHARED))
        at = np.searchsorted(tokens[many], shared)
        tokens, docs, counts = np.concatenate([tokens[~many], shared]), np.concatenate([docs[~many], holder]), np.concatenate([counts[~many], counts[many][at]])
        common = np.bincount(docs, minlength=n)
        prefix = sizes - (percent * sizes + 99) // 100 + 1
        take = np.maximum(0, prefix - (short - common))  # behind those that no other document has
        order = np.lexsort((tokens, counts, docs))
        start = np.concatenate([[0], np.cumsum(common)])
        chosen = order[np.arange(len(order)) - start[docs[order]] < take[docs[order]]]
        full = np.flatnonzero(take)
        if not len(full):
            continue
        ends = np.concatenate([[0], np.cumsum(np.minimum(take, common)[full])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([digests[16 * d : 16 * d + 16] for d in full.tolist()], pa.binary()),
                pa.array(sizes[full]),
                pa.ListArray.from_arrays(ends, pa.array(tokens[chosen].astype(np.int64))),
                pa.array(short[full] == common[full]),
                pa.ListArray.from_arrays(np.arange(0, bitmaps.shape[1] * len(full) + 1, bitmaps.shape[1], dtype=np.int32), pa.array(bitmaps[full].ravel())),
            ],
            names=["digest", "n", "keys", "whole", "bits"],
        )


def prefixes(docs: DataFrame, text: str, width: int, percent: int, shingles: int) -> DataFrame:
    """node (a number), digest, n, keys, whole, bits: the different sets whose prefixes have shingles of others. shingles: of all documents, for the number of buckets."""
    bits = min(24, max(0, (shingles // BUCKET).bit_length()))
    schema = "bucket int, block long, kind int, data binary"
    dealt = docs.select(named(text).cast("string").alias("text")).mapInArrow(lambda b: _block_tokens(b, width, bits), schema)
    counted = dealt.repartition(1 << bits, "bucket").sortWithinPartitions("bucket").mapInArrow(_count, schema)
    back = counted.repartition(1 << bits, "block").sortWithinPartitions("block")
    found = back.mapInArrow(lambda b: _prefixes(b, percent), "digest binary, n long, keys array<bigint>, whole boolean, bits array<bigint>")
    once = found.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n", "keys", "whole", "bits")])
    return store(once.withColumn("node", F.monotonically_increasing_id()), "prefixes")


def _apart(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)


def grouped(nodes: DataFrame) -> DataFrame:
    """nodes with chief: the least of those of the same size and prefix; and apart: bits that differ from the chief's. A prefix with a shingle of its own is nobody else's."""
    of = nodes.where("whole").groupBy("n", "keys").agg(F.min(F.struct("node", "bits")).alias("c"))
    shared = nodes.where("whole").join(of, ["n", "keys"]).select(*nodes.columns, F.col("c.node").alias("chief"), F.col("c.bits").alias("chief_bits"))
    alone = nodes.where("not whole").select(*nodes.columns, F.col("node").alias("chief"), F.col("bits").alias("chief_bits"))
    return shared.union(alone).withColumn("apart", _apart("bits", "chief_bits")).drop("chief_bits")


def may_link(n: Column, m: Column, apart: Column, percent: int) -> Column:
    """Whether sets of n and m shingles whose bitmaps differ in at least so many bits can be similar."""
    total = n + m
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart <= total - 2 * F.ceil(percent * total / (100 + percent)).cast("long"))


def may_links(n: np.ndarray, bits: np.ndarray, wide: np.ndarray, lo: int, hi: int, percent: int) -> np.ndarray:
    """may_link() of groups lo to hi with all groups of a block; wide: the distance of a group's members from its bitmap."""
    total = n[lo:hi, None] + n[None, :]
    apart = np.bitwise_count(bits[lo:hi, None, :] ^ bits[None, :, :]).sum(axis=-1, dtype=np.int64) - wide[lo:hi, None] - wide[None, :]
    sizes = 100 * np.minimum(n[lo:hi, None], n[None, :]) >= percent * np.maximum(n[lo:hi, None], n[None, :])
    return sizes & (apart <= total - 2 * -(-percent * total // (100 + percent)))


def _candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """A forest of candidate links within each block of rows (key, lo, hi), at most about 2 * GROUP rows."""
    for rows in _groups(batches):
        about = rows.column("about").combine_chunks()
        node, n, wide = rows.column("node").to_numpy(), about.field("n").to_numpy(), about.field("wide").to_numpy()
        bits = about.field("bits").flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        label = np.arange(len(node))
        within = [may_links(n, bits, wide, lo, min(lo + 64, len(node)), percent) for lo in range(0, len(node), 64)]
        while True:
            least = label[np.concatenate([np.where(m, label[None, :], len(node)).min(axis=1) for m in within])]
            if (least == label).all():
                break
            label = least
        move = label != np.arange(len(node))
        yield pa.RecordBatch.from_arrays([pa.array(node[move]), pa.array(node[label[move]])], names=["a", "b"])


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join all nodes (see prefixes()) whose groups are candidates, and the members of each group."""
    held = store(grouped(nodes), "grouped")
    heads = held.where("node = chief").select("node", "n", "keys", "bits")
    wide = held.groupBy("chief").agg(F.max("apart").cast("long").alias("wide")).withColumnRenamed("chief", "node")
    heads = store(heads.join(wide, "node").select("node", "keys", F.struct("n", "wide", "bits").alias("about")), "heads")
    keyed = heads.select("node", F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.min("node").alias("pivot")).where("rows > 1")
    about = heads.select("node", "about")
    members = keyed.join(groups.join(about.select(F.col("node").alias("pivot"), F.col("about").alias("of")), "pivot"), "key").join(about, "node")
    apart = _apart("about.bits", "of.bits") - F.col("about.wide") - F.col("of.wide")
    near = may_link(F.col("about.n"), F.col("of.n"), apart, percent)
    members = store(members.select("key", "node", "rows", "pivot", (~near).alias("far"), "about"), "members")
    stars = members.where("not far and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    rest = members.where("far and rows > 2").groupBy("key").agg(F.count("*").alias("fars"))
    parts = lambda n: F.ceil(n / GROUP).cast("int")
    open_ = members.join(rest, "key").withColumn("far_parts", parts(F.col("fars"))).withColumn("near_parts", parts(F.col("rows") - F.col("fars")))
    forest = _dealt(open_, "about").mapInArrow(lambda b: _candidates(b, percent), "a bigint, b bigint")
    inside = held.where("node <> chief").select(F.col("node").alias("a"), F.col("chief").alias("b"))
    return inside.union(stars).union(forest)


def similar(docs: DataFrame, keep: list[str], id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """keep, n_shingles, component_id (the least id of all rows that links lead to) of each row; linked: 100 * common >= percent * all shingles of both."""
    body = named(text).cast("string")
    # two hashes tell texts apart where one row of each is looked up again
    text_key = F.struct(F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"))
    kept = docs.select(carried(keep), named(id).alias("id"), text_key.alias("text_key"), body.alias("text"))
    schema = kept.drop("text").schema.add("digest", "binary").add("n", "long")
    marked = store(kept.mapInArrow(lambda b: _marked(b, width), schema), "marked")
    shingles = marked.agg(F.sum("n")).head()[0] or 0
    nodes = prefixes(docs, text, width, percent, shingles)
    loose = components(candidates(nodes, percent)).select("node", F.col("label").alias("key"))
    wanted = store(loose.join(nodes.select("node", "digest"), "node"), "wanted")
    rows = marked.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("text_key").alias("text_key")).select("text_key.*")
    found = docs.select(text_key.alias("of"), body.alias("text")).select("of.*", "text").join(rows, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    sets = found.select("text").mapInArrow(lambda b: _shingles(b, width), "digest binary, shingles array<bigint>")
    members = store(sets.join(wanted, "digest").select("node", "key", "shingles"), "sets")
    labels = components(set_links(members, percent / 100)).join(nodes.select("node", "digest"), "node").select("digest", "label")
    least = marked.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"))
    named_ = least.join(labels, "digest")
    ids = named_.groupBy("label").agg(F.min("least").alias("component"))
    linked = named_.join(ids, "label").select("digest", "component")
    component = store(least.join(linked, "digest", "left").select("digest", F.coalesce("component", "least").alias("component_id")), "components")
    release(members, wanted)
    made = marked.join(component, "digest", "left")
    return made.select(*unpacked(keep, ["n_shingles", "component_id"]), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
