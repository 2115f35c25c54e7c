"""Repeated strings of a fixed length by distributed prefix doubling, and their removal.

Positions are thinned first: every string of LENGTH bytes has one sample, the least-named of its substrings of LENGTH / 4 bytes, at a place
that depends on the string alone (see _anchors). Successive positions with one sample make a run. Spark sorts all runs by the pair (name of
the sample, name of the bytes the run covers) and position, in range partitions, so that the runs of one sample may lie over any number of
them. Neighbours in this order decide: a sample without an equal is unique, and all its strings with it; they drop out. A run with an equal
is repeated as a whole. What is left are runs at the borders of repeats. Up to 16 successive strings of one share a position, the last start:
what follows it is common to them. The positions go through the doubling:

1. The rank of the first quarter of the common bytes is their name.
2. Spark sorts the pairs (rank at p, rank a quarter on); a pair's place in that order is the rank of half the common bytes. Positions whose
   pair is unique drop out. So do those whose other half is unique.
3. It sorts the pairs (rank at p, rank half way on), which ranks all common bytes; unique ones drop out.
4. Positions that agree in every byte of their strings are settled together. Of those left, each single string is ranked at the threshold,
   by the pair of that rank and its own name: what has an equal here is repeated.

The runs at a partition's ends, two at most, are settled by what others begin and end with. Strings are judged on the input, and matches lie within documents.

Names are 64-bit fingerprints of content, so that nothing has to be looked up at position + offset for them; at least two, of different bytes,
must agree for strings to be taken as equal.

Defined results: null and empty texts have no bytes; equal rows are copies of one another, so a whole text of at least LENGTH bytes goes
from each; a text shorter than LENGTH keeps all; bytes that remain of a cut character remain, unless whole characters are asked for; any other columns are kept as asked;
an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _anchors
from ._support import carried, named, release, store, unpacked
from ._text import blocks, span_hashes, string_buffers

LENGTH = 200
#: Bits of the filter that spares most documents without repeats a shuffle; it only ever lets too many through.
FILTER_BITS = 1 << 26
_MANY, _REP, _EDGE = 1, 2, 3


def _parts(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """row, first start in its text, number of starts, two names, for blocks of rows; a long text in overlapping parts."""
    for lo, hi in blocks(off, _anchors.PART):
        size = off[hi] - off[lo]
        for at in range(0, max(1, int(size)), _anchors.PART):  # more than one turn for a single long text only
            if at and at + length > size:
                break
            end = min(size, at + _anchors.PART + length - 1)
            here = np.array([0, end - at]) if at or end < size else off[lo : hi + 1] - off[lo]
            first, count, sample, whole = _anchors.runs(data[off[lo] + at : off[lo] + end], here, length)
            row = np.searchsorted(here, first, "right") - 1
            yield row + lo, first - here[row] + at, count, sample, whole


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = string_buffers(batch.column(2))
        k1, k2 = (batch.column(c).to_numpy() for c in (0, 1))
        for row, first, count, sample, whole in _parts(data, off, length):
            if len(row):
                columns = (sample.view(np.int64), whole.view(np.int64), k1[row], k2[row], first, count.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sample", "whole", "k1", "k2", "first", "n"])


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks sorted runs and drops unique samples.

    Of a sample at a partition's end all is known here but whether its first or last run goes on beyond: a run that has no equal here and
    is the partition's first or last row stays open. A row of status 0 tells what the partition begins and ends with.
    """
    names = ["sample", "whole", "k1", "k2", "first", "n", "status", "open", "alone", "pid"]
    pid = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    begun = False

    def marked(rows: pa.Table, starts: bool, ends: bool) -> pa.RecordBatch:
        sample, whole = rows.column("sample").to_numpy(), rows.column("whole").to_numpy()
        new_sample = np.concatenate([[True], sample[1:] != sample[:-1]])
        new_whole = new_sample | np.concatenate([[True], whole[1:] != whole[:-1]])
        of_sample, of_whole = np.cumsum(new_sample) - 1, np.cumsum(new_whole) - 1
        runs, equal = np.bincount(of_sample)[of_sample], np.bincount(of_whole)[of_whole]
        edges = np.bincount(of_sample[new_whole & (equal == 1)], minlength=of_sample[-1] + 1)[of_sample]
        status = np.where(equal == 1, _EDGE, np.where(new_whole & ((edges > 0) | starts | ends), _REP, _MANY)).astype(np.int8)
        opened = np.zeros(len(sample), bool)
        opened[0] |= starts and equal[0] == 1
        opened[-1] |= ends and equal[-1] == 1  # it may be the first as well
        keep = np.flatnonzero((runs > 1) | opened)
        more = (status, opened, runs == 1, np.full(len(sample), pid, np.int32))
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks().take(pa.array(keep)) for c in names[:6]), *(pa.array(np.ascontiguousarray(c[keep])) for c in more)], names=names)

    def marker(rows: pa.RecordBatch, at: int) -> pa.RecordBatch:
        row = rows.slice(at, 1)
        more = (pa.array([0], pa.int8()), *(pa.array([False]) for _ in range(2)), pa.array([pid], pa.int32()))
        return pa.RecordBatch.from_arrays([*row.columns[:6], *more], names=names)

    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            if not held and not begun:
                yield marker(batch, 0)
            held.append(batch)
            if held[0].column(0)[0] == held[-1].column(0)[-1]:
                continue  # one sample so far
        if not held:
            return
        if batch is None:
            yield marker(held[-1], held[-1].num_rows - 1)
        rows = pa.Table.from_batches(held).combine_chunks()
        sample = rows.column("sample").to_numpy()
        head = 0 if begun else int(np.searchsorted(sample, sample[0], "right"))
        tail = int(np.searchsorted(sample, sample[-1], "left"))
        if head and tail:
            yield marked(rows.slice(0, head), True, False)
            begun = True
        if tail > head:
            yield marked(rows.slice(head, tail - head), False, False)
        held = rows.slice(tail).to_batches()
        if batch is None:
            yield marked(pa.Table.from_batches(held), not begun, True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that each run covers of those that are listed for a document."""
    for batch in batches:
        text, listed, k1, k2 = (batch.column(c) for c in range(4))
        raw, off = string_buffers(text)
        owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(listed).to_numpy())
        runs = pa.RecordBatch.from_struct_array(listed.flatten())
        begin = off[owner] + runs.column("first").to_numpy()
        for lo in range(0, len(begin), 10_000):
            part = slice(lo, lo + 10_000)
            data = [raw[b : b + n].tobytes() for b, n in zip(begin[part].tolist(), runs.column("bytes").to_numpy()[part].tolist(), strict=True)]
            columns = [runs.column("sample").slice(lo, 10_000), k1.take(pa.array(owner[part])), k2.take(pa.array(owner[part])), *(runs.column(c).slice(lo, 10_000) for c in ("first", "times")), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["sample", "k1", "k2", "first", "times", "bytes"])


def _thinned(length: int) -> int:
    """Strings whose starts share one position of the doubling."""
    return max(1, min(16, length // 8))


def _stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One position for each stretch of a run's strings: those that begin k * width to (k + 1) * width - 1 bytes before the sample.

    All strings of a stretch have the bytes in common that follow its position, the last start, up to the end of the string of the first. a and
    b name the quarter of these from the position on and the one behind it, c and d those half way on (overlapping, so that they end where
    these bytes end). at: the first start; n: starts; cover names all bytes that the run's strings have of the stretch, back: bytes before the sample.
    """
    names = ["k1", "k2", "first", "times", "at", "n", "back", "cover", "a", "b", "c", "d"]
    width, part = _thinned(length), _anchors.part_of(length)
    common = length - width + 1
    quarter = -(-common // 4)
    for batch in batches:
        for rows in (batch.slice(lo, 2_000) for lo in range(0, batch.num_rows, 2_000)):
            data, off = string_buffers(rows.column("bytes").cast(pa.large_binary()).view(pa.large_string()))
            sample, first = (rows.column(c).to_numpy() for c in ("sample", "first"))
            small = _anchors.rolling(data, part)
            high = np.argmax(small[off[:-1, None] + np.arange(length - part + 1)] == sample.view(np.uint64)[:, None], axis=1)
            low = high - (np.diff(off) - length)
            per = high // width - low // width + 1
            run = np.repeat(np.arange(len(high)), per)
            k = high[run] // width - (np.arange(len(run)) - (np.cumsum(per) - per)[run])
            least, most = np.maximum(k * width, low[run]), np.minimum(k * width + width - 1, high[run])
            place = off[:-1][run] + high[run]  # of the sample
            with np.errstate(over="ignore"):
                cover = _anchors.mix(span_hashes(data, place - most, place - least + length) + _anchors.mix((least << 32 | most).astype(np.uint64)))
                salt = _anchors.mix(sample.view(np.uint64)[run] + k.astype(np.uint64))
            quarters = _anchors.rolling(data, quarter)
            spots = [place - k * width + step for step in (0, quarter, common - 2 * quarter, common - quarter)]
            columns = [*(rows.column(c).to_numpy()[run] for c in ("k1", "k2", "first", "times")), first[run] + high[run] - most, (most - least + 1).astype(np.int32), most.astype(np.int32), cover.view(np.int64)]
            columns += [(quarters[spots[0]] ^ salt).view(np.int64), *(quarters[x].view(np.int64) for x in spots[1:])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=names)


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every string of the stretches, by its name and the rank of what it has in common with those of its stretch."""
    for batch in batches:
        for rows in (batch.slice(lo, 5_000) for lo in range(0, batch.num_rows, 5_000)):
            data, off = string_buffers(rows.column("bytes").cast(pa.large_binary()).view(pa.large_string()))
            n, at, back = (rows.column(c).to_numpy() for c in ("n", "at", "back"))
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            name = _anchors.rolling(data, length)[off[row] + at[row] - rows.column("first").to_numpy()[row] + step]
            with np.errstate(over="ignore"):
                name = _anchors.mix(name + (back[row] - step).astype(np.uint64)).view(np.int64)
            columns = [rows.column(c).to_numpy()[row] for c in ("k1", "k2", "times", "core")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(at[row] + step), pa.array(name)], names=["k1", "k2", "times", "core", "first", "name"])


def _doubled(positions: DataFrame, left: str, right: str, rank: str) -> DataFrame:
    """positions with the rank of their pair of names or ranks in place of it; those whose pair is nowhere else drop out.

    The different pairs are sorted by Spark, and a pair's rank is its place in that order; the table of ranks is written, so that they
    stay what they are when an executor is lost. Pairs are counted before they are shuffled, so none is hot.
    """
    pairs = positions.groupBy(left, right).agg(F.sum("times").alias("all")).where("all > 1").select(left, right)
    ranks = store(pairs.orderBy(left, right).withColumn(rank, F.monotonically_increasing_id()), "ranks")
    return positions.join(ranks, [left, right]).drop(left, right)


def _whole_characters(text: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """stay without the bytes of characters that lose any of theirs."""
    begin = np.flatnonzero((text & 0xC0) != 0x80)
    if not len(begin) or begin[0]:
        begin = np.append(0, begin)
    return np.repeat(np.logical_and.reduceat(stay, begin), np.diff(np.append(begin, len(text))))


def _remove(batches: Iterator[pa.RecordBatch], length: int, characters: bool = False) -> Iterator[pa.RecordBatch]:
    names = ["n_bytes", "spans", "kept"]
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))
    for batch in batches:
        data, off = string_buffers(batch.column(batch.num_columns - 2))
        listed = batch.column(batch.num_columns - 1)
        counts = pa.compute.fill_null(pa.compute.list_value_length(listed), 0).to_numpy()
        runs = pa.RecordBatch.from_struct_array(listed.flatten())
        first, n = runs.column("first").to_numpy(), runs.column("n").to_numpy()
        ends = np.cumsum(counts)
        spans, kept = [], []
        for row, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
            text = data[off[row] : off[row + 1]]
            if not count:
                spans.append([])
                kept.append(text.tobytes())
                continue
            at = np.sort(first[end - count : end])
            order = np.argsort(first[end - count : end], kind="stable")
            stop = np.maximum.accumulate(at + n[end - count : end][order] - 1 + length)
            new = np.concatenate([[True], at[1:] > stop[:-1]])
            lo, hi = at[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
            stay = np.ones(len(text), bool)
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                stay[a:b] = False
            if characters:
                stay = _whole_characters(text, stay)
            spans.append([{"first": a, "length": b - a} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            kept.append(text[stay].tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(np.diff(off)), pa.array(spans, spans_type), pa.array(kept, pa.binary())], names=[*batch.schema.names[:-2], *names])


def _maybe(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs that may be among keys (by k1), and docs that can't be: one bit for each value of k1's last bits, 8 MB at most in all."""
    place = F.pmod(F.col("k1"), F.lit(FILTER_BITS))
    bucket, bit = F.shiftright(place, 15).cast("int"), F.pmod(place, F.lit(1 << 15))
    bits = keys.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    tested = docs.withColumn("bucket", bucket).join(F.broadcast(store(bits, "filter")), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
    return tested.where(hit).drop("bucket", "bits"), tested.where(~hit).drop("bucket", "bits")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """k1, k2, first, n: for the documents of a table with k1, k2 (keys), text, the starts of strings that also start elsewhere."""
    spark = docs.sparkSession
    runs = docs.select("k1", "k2", "text").mapInArrow(lambda b: _scan(b, length), "sample bigint, whole bigint, k1 bigint, k2 int, first bigint, n int")
    order = ["sample", "whole", "k1", "k2", "first"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = runs.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ranked = store(ranked.mapInArrow(_rank, "sample bigint, whole bigint, k1 bigint, k2 int, first bigint, n int, status tinyint, open boolean, alone boolean, pid int"), "ranked")
    columns = ["sample", "k1", "k2", "first", "n", "status"]
    # open runs, two a partition at most: do other partitions begin or end with the same run, or sample
    ends, opened = ranked.where("status = 0"), ranked.where("open")
    by_whole = ends.groupBy("sample", "whole").agg(F.min("pid").alias("whole_lo"), F.max("pid").alias("whole_hi"))
    by_sample = ends.groupBy("sample").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi"))
    settled = opened.join(by_whole, ["sample", "whole"]).join(by_sample, "sample").where("not alone or lo < pid or hi > pid")
    settled = settled.withColumn("status", F.when(F.expr("whole_lo < pid or whole_hi > pid"), F.lit(_REP)).otherwise(F.lit(_EDGE)).cast("tinyint"))
    found = ranked.where("status > 0 and not open").select(columns).union(settled.select(columns))
    # the runs at the borders of repeats; one that stands for several equal ones counts twice
    times = F.when(F.col("status") == _EDGE, 1).otherwise(2).alias("times")
    border = found.where(F.col("status") >= _REP).groupBy("k1", "k2").agg(F.collect_list(F.struct("sample", "first", (F.col("n") + (length - 1)).alias("bytes"), times)).alias("runs"))
    border = store(border, "border")
    near, _ = _maybe(docs.select("k1", "k2", "text"), border)
    cut = near.dropDuplicates(["k1", "k2"]).join(border, ["k1", "k2"]).select("text", "runs", "k1", "k2")
    cut = store(cut.mapInArrow(_cut, "sample bigint, k1 bigint, k2 int, first bigint, times int, bytes binary"), "cut")
    positions = store(cut.mapInArrow(lambda b: _stretches(b, length), "k1 bigint, k2 int, first bigint, times int, at bigint, n int, back int, cover bigint, a bigint, b bigint, c bigint, d bigint"), "positions")
    # ranks of a quarter are names; pairs of them rank halves, pairs of these rank all that the strings of a stretch have in common
    halves = _doubled(_doubled(positions, "a", "b", "r"), "c", "d", "s")
    cores = store(_doubled(store(halves, "halves"), "r", "s", "core"), "cores")
    # a stretch that has an equal is repeated as a whole; one of each, where others differ, goes on to its single strings
    equal = cores.groupBy("core", "cover").agg(F.sum("times").alias("all"), F.min(F.struct("k1", "k2", "at")).alias("one"))
    differ = equal.groupBy("core").agg((F.count("*") > 1).alias("more"), (F.min("all") == 1).alias("open"))
    judged = store(cores.join(equal.join(differ, "core"), ["core", "cover"]), "judged")
    on = judged.where("more and open and struct(k1, k2, at) = one").select("k1", "k2", "first", "at", "n", "back", "core", F.when(F.col("all") > 1, 2).otherwise(1).alias("times"))
    strings = on.join(cut.select("k1", "k2", "first", "bytes"), ["k1", "k2", "first"]).mapInArrow(lambda b: _strings(b, length), "k1 bigint, k2 int, times int, core bigint, first bigint, name bigint")
    last = _doubled(store(strings, "strings"), "core", "name", "rank").where("times = 1").select("k1", "k2", "first", F.lit(1).alias("n"))
    whole = found.where(F.col("status") < _EDGE).select("k1", "k2", "first", "n")
    stretches = judged.where("all > 1 and times = 1").select("k1", "k2", F.col("at").alias("first"), "n")
    # rows that agree in id and text have the same runs: each is listed once, however many the rows
    listed = store(whole.union(stretches).union(last).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", F.col("n").cast("int").alias("n"))).alias("runs")), "repeats")
    release(ranked, border, cut, positions, cores, judged)
    return listed


def remove_repeats(docs: DataFrame, keep: list[str], id: str = "doc_id", text: str = "text", length: int = LENGTH, characters: bool = False) -> DataFrame:
    """keep, n_bytes, spans (first, length of each removed run of bytes), kept (the bytes that remain) of each row.

    characters: kept lacks the rest of a character that was cut, and so is UTF-8 again.
    """
    key, whole = named(id), named(text).cast("string")
    keyed = docs.select(carried(keep), F.xxhash64(key, whole).alias("k1"), F.hash(whole, key).alias("k2"), whole.alias("text"))
    starts = repeats(keyed, length)
    near, far = _maybe(keyed, starts)
    near = near.join(starts, ["k1", "k2"], "left").select("row", "text", "runs")
    far = far.select("row", "text", F.lit(None).cast(starts.schema["runs"].dataType).alias("runs"))
    made = ("n_bytes", "spans", "kept")
    schema = StructType([keyed.schema["row"], *StructType.fromDDL("n_bytes bigint, spans array<struct<first: bigint, length: bigint>>, kept binary").fields])
    done = [x.mapInArrow(lambda b: _remove(b, length, characters), schema) for x in (near, far)]
    return done[0].union(done[1]).select(*unpacked(keep, made), *made)
