"""Audit of how filters interact: what each removes in every order, alone, redundantly, and on average over all orders.

For each part, the documents that fail all filters of a set are counted for all 32 sets, as sums of products of failure flags (with the labels
as further factors). These joint failures decide everything else. Inclusion and exclusion over the subsets of a set gives its survivors, and so
what a filter removes behind any others; Moebius inversion over the supersets of one filter gives the documents that only it rejects. The game
"documents removed by a set of filters" has the Harsanyi dividends (-1)^(k + 1) * joint(set of k), each shared equally by its k filters: that
is the Shapley value, here times the number of orders, which makes it whole.

Sums are aggregated before they are shuffled, 96 numbers for each part and task. Texts that occur twice are found by their SHA-256: only the
digest, the least id and the flags are shuffled, never a text.

Defined results: null text is the empty text; a null part is the part ''; filter E is false for the least id of a text, for all rows that have
it, and for null ids, which no other row counts as smaller; several labels of one id count if any of them does, labels of no document not at
all; no documents give no rows. Texts are read in parts of a few MB; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._support import named, read_texts, store
from ._text import BLOCK, blocks, string_buffers, sums

FILTERS = "ABCDE"
#: Characters that filter D looks for.
MARKS = b"#$%&*|"
SETS = range(1 << len(FILTERS))

_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True


def word_counts(text: bytes) -> tuple[int, int]:
    """Words of a text, and different ones; at most BLOCK bytes (or one longer word) are split at once."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = len(text)
        if cut - at > BLOCK:
            breaks = [p for p in (text.find(b, at + BLOCK) for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if p >= 0]
            cut = min(breaks, default=cut)
        words = text[at:cut].split()
        n += len(words)
        seen.update(words)
        at = cut
    return n, len(seen)


def block_failures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The failures of filters A to D of each text, as bits 1, 2, 4, 8."""
    raw = data.tobytes()
    words = np.array([word_counts(raw[a:b]) for a, b in itertools.pairwise(off.tolist())], np.int64).reshape(-1, 2)
    points = sums(((data & 0xC0) != 0x80).view(np.int8), off)
    capitals = sums(((data >= 65) & (data <= 90)).view(np.int8), off)
    marks = sums(_MARK[data].view(np.int8), off)
    fails = [words[:, 0] < 50, 100 * words[:, 1] < 65 * words[:, 0], 100 * capitals > 5 * points, marks > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = string_buffers(batch.column(batch.num_columns - 1))
        for lo, hi in blocks(off):
            part = data[off[lo] : off[hi]]
            ends = off[lo : hi + 1] - off[lo]
            raw = part.tobytes()
            digest = [hashlib.sha256(raw[a:b]).digest() for a, b in itertools.pairwise(ends.tolist())]
            made = [pa.array(block_failures(part, ends), pa.int32()), pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), *made], names=[*batch.schema.names[:-1], "fails", "digest"])


def failures(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part, fails (the bits of all five filters) of each row."""
    found = read_texts(docs.select(named(id).alias("id"), F.coalesce(named(part).cast("string"), F.lit("")).alias("part"), named(text).cast("string").alias("text")), ["id", "part"], "text", _failures, "fails int, digest binary")
    marked = store(found.select("row.id", "row.part", "fails", "digest"), "failures")
    first = marked.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    again = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).cast("int")
    return marked.join(first, "digest", "left").select("id", "part", (F.col("fails") + 16 * again).alias("fails"))


def joint_failures(flagged: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """part, and for each measure (a boolean column) an array over all sets of filters: the rows of the measure that fail
    every filter of the set, the sum of the products of its flags (bits of fails)."""
    of = flagged.select("part", "fails", *[which.alias(name) for name, which in measures.items()])
    made = of.groupBy("part").agg(*[F.expr(f"count_if({name} and (fails & {s}) = {s}) {name}{s}") for name in measures for s in SETS])
    return made.select("part", *[F.array(*[f"{name}{s}" for s in SETS]).alias(name) for name in measures])


def _signed(joint: str, terms: dict[int, int]) -> str:
    """The sum of entries of an array, each times its factor, as an expression."""
    return " ".join(f"{'+' if f > 0 else '-'} {abs(f)} * {joint}[{t}]" for t, f in terms.items())


def survivors(joint: str) -> Column:
    """For each set of filters the rows that pass all of them: inclusion and exclusion over its subsets."""
    return F.expr(f"array({', '.join(_signed(joint, {t: (-1) ** t.bit_count() for t in SETS if t & s == t}) for s in SETS)})")


def only(joint: str) -> Column:
    """For each filter the rows that fail it and no other: Moebius inversion over the sets that hold it."""
    return F.expr(f"array({', '.join(_signed(joint, {t: (-1) ** (t.bit_count() - 1) for t in SETS if t >> k & 1}) for k in range(len(FILTERS)))})")


def shapley(joint: str) -> Column:
    """For each filter its Shapley value in the game of removed rows, times the number of orders, from the dividends of the sets that hold it."""
    orders = math.factorial(len(FILTERS))
    dividend = lambda t: (-1) ** (t.bit_count() + 1) * (orders // t.bit_count())
    return F.expr(f"array({', '.join(_signed(joint, {t: dividend(t) for t in SETS if t >> k & 1}) for k in range(len(FILTERS)))})")


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each part, order and step."""
    marks = labels.groupBy(named("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flagged = failures(docs, id, text, part).join(marks, "id", "left")
    is_one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    joint = joint_failures(flagged, {"rows": F.lit(True), "good": is_one("good"), "toxic": is_one("toxic")})
    counted = joint.select("part", "rows", *[survivors(m).alias(f"left_{m}") for m in ("rows", "good", "toxic")], only("rows").alias("only"), shapley("rows").alias("shapley"))
    orders = ["".join(o) for o in itertools.permutations(FILTERS)]
    bit = lambda letter: f"shiftleft(1, instr('{FILTERS}', {letter}) - 1)"
    each = counted.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.lit(list(range(1, len(FILTERS) + 1)))))
    each = each.withColumn("k", F.expr(f"instr('{FILTERS}', substr(filter_order, step, 1)) - 1"))
    each = each.withColumn("before", F.expr(f"aggregate(slice(split(filter_order, ''), 1, step - 1), 0, (s, x) -> s | {bit('x')})"))
    each = each.withColumn("own", F.expr(bit("substr(filter_order, step, 1)"))).withColumn("upto", F.col("before").bitwiseOR(F.col("own")))
    lost = lambda m: F.get(f"left_{m}", F.col("before")) - F.get(f"left_{m}", F.col("upto"))
    failing = F.get("rows", F.col("own"))
    return each.select(
        "part", "filter_order", "step", F.get("left_rows", F.col("upto")).alias("kept"), lost("rows").alias("removed"), (failing - lost("rows")).alias("redundant"),
        F.get("only", F.col("k")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", F.col("k")).alias("shapley"),
    )
