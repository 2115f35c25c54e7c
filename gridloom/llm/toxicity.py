"""Toxic severity by cumulative-link ordinal regression on sparse text features.

Features are counts of a text's words (runs of letters and digits, lower-cased) and of their first 4 to 8 bytes, so that a stem counts in
all its forms. On a sample of at most SAMPLE labelled ids, taken by a hash, with one text each, Spark counts the documents of each feature by
label and keeps those that clearly tell toxic texts (log odds over MIN_Z standard errors, at most FEATURES of them). One weight vector w
and ordered thresholds t_1 < ... < t_K are fitted to the sample's grades on the driver: P(grade >= k) = logistic(w.x - t_k). Every document
is then scored on the executors: expected severity is the sum of these probabilities, the grade the number of them over one half; toxic is
whether P(grade >= 1) is over the value that parts the sample's toxic and clean rows best. Grades are whatever the labels give: with 0 and 1
only there is one threshold. The table of labels has no severity, so the query grades a toxic row 2 where it is labelled of low quality too.

Defined results: null and empty texts have no features; whole texts count, of any length; rows without a label, or whose label is null,
are scored but not learned from; without any toxic or any clean labelled row there are no weights and every severity is 0; rows of one id
(or of none) are one to learn from, that of the least grade and hash of the text, however many there are; repeated rows get equal scores; an
empty table gives an empty one; columns kept by name are returned unless they clash with results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import read_texts, release, store, unpacked
from ._text import blocks, classes, spans, string_buffers

SAMPLE, FEATURES, MIN_Z, MIN_DOCS = 8000, 2000, 4.0, 4
STEMS = (4, 5, 6, 7, 8)

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(1, np.inf))
    cut: float = 0.5  # a text is called toxic where P(grade >= 1) is over it

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, ..., K in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -700, 700)))


def _keys(word: bytes) -> list[int]:
    """The features of a word: itself and its stems."""
    return [xxhash.xxh64_intdigest(word), *(xxhash.xxh64_intdigest(word[:k], k) for k in STEMS if len(word) > k)]


def block_features(data: np.ndarray, off: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, key, count of each feature of each text; known: of these (sorted) keys only."""
    starts, ends = spans(_WORD[data], off)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none
    word, first = classes(data, starts, ends)
    own = [_keys(data[a:b].tobytes()) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    key, of = np.array([k for keys in own for k in keys], np.uint64), np.repeat(np.arange(len(own)), [len(x) for x in own])
    if known is not None:
        hit = np.isin(key, known)
        key, of = key[hit], of[hit]
    begin = np.searchsorted(of, np.arange(len(own) + 1))
    pair, times = np.unique((np.searchsorted(off, starts, "right") - 1) * len(own) + word, return_counts=True)
    row, word = np.divmod(pair, len(own))
    n = np.diff(begin)[word]
    at = np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    row, key, times = np.repeat(row, n), key[at], np.repeat(times, n)
    # words of one stem add up
    order = np.lexsort((key, row))
    row, key, times = row[order], key[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], key[new], np.add.reduceat(times, new) if len(new) else times


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return string_buffers(pa.compute.utf8_lower(column.fill_null("")))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = _lower(batch.column(2))
        for lo, hi in blocks(off):
            row, key, count = block_features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            take = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(key.view(np.int64)), pa.array(count)], names=["id", "grade", "key", "count"])


def fit(labelled: DataFrame, id: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = SAMPLE) -> Model:
    """A model from rows of id, text and grade: 0 for clean texts, then 1, 2, ... by severity; as many grades as there are."""
    hashed = F.xxhash64(F.col(id).cast("string"))
    rows = labelled.where(F.col(grade).isNotNull()).select(hashed.alias("id"), F.col(grade).cast("int").alias("grade"), F.col(text).cast("string").alias("text"))
    bound = rows.select("id").distinct().orderBy("id").limit(sample).agg(F.max("id")).head()[0]
    if bound is None:
        return Model()
    rows = rows.where(F.col("id") <= bound).withColumn("own", F.xxhash64("text"))
    counted = rows.groupBy("id", "grade", "own").agg(F.count("*").alias("n"))
    # one row for each id, at most sample of them; n: how often it is there
    picked = store(counted.groupBy("id").agg(F.min(F.struct("grade", "own", "n")).alias("r")).select("id", "r.*"), "sample")
    totals = {r["grade"]: r["count"] for r in picked.groupBy("grade").count().collect()}

    def features(some: DataFrame) -> DataFrame:
        seen = rows.join(F.broadcast(some.drop("n")), ["id", "grade", "own"]).select("id", "grade", "text")
        return seen.mapInArrow(_occurrences, "id bigint, grade int, key bigint, count bigint")

    # only rows that repeat are compared with one another, by their features: no text is shuffled
    found = features(picked.where("n = 1")).unionByName(features(picked.where("n > 1")).distinct()).persist()
    try:
        return _fit(found, totals)
    finally:
        found.unpersist()
        release(picked)


def _fit(seen: DataFrame, totals: dict[int, int]) -> Model:
    """From the features of the sample (id, grade, key, count) and the number of its rows by grade."""
    bad, clean = sum(n for g, n in totals.items() if g > 0), sum(n for g, n in totals.items() if g <= 0)
    if not bad or not clean:
        return Model()
    counted = seen.groupBy("key").agg(F.count(F.when(F.col("grade") > 0, 1)).alias("a"), F.count(F.when(F.col("grade") <= 0, 1)).alias("b")).where(F.col("a") >= MIN_DOCS)
    odds = F.ln((F.col("a") + 0.5) / (F.greatest(bad - F.col("a"), F.lit(0)) + 0.5)) - F.ln((F.col("b") + 0.5) / (F.greatest(clean - F.col("b"), F.lit(0)) + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.greatest(bad - F.col("a"), F.lit(0)) + 0.5) + 1 / (F.col("b") + 0.5) + 1 / (F.greatest(clean - F.col("b"), F.lit(0)) + 0.5))
    keys = counted.withColumn("z", odds / error).where((F.col("z") >= MIN_Z) & (odds > 2)).orderBy(F.desc("z"), "key").limit(FEATURES).select("key")
    told = seen.join(F.broadcast(keys), "key").groupBy("id", "grade").agg(F.collect_list(F.struct("key", "count")).alias("x")).toPandas()
    found = np.array(sorted({r["key"] for x in told["x"] for r in x}), np.int64)
    keys = np.sort(found.view(np.uint64))
    n = len(told)
    at = np.searchsorted(keys, np.array([r["key"] for x in told["x"] for r in x], np.int64).view(np.uint64))
    row = np.repeat(np.arange(n), [len(x) for x in told["x"]])
    value = 1 + np.log(np.array([r["count"] for x in told["x"] for r in x], float))
    grade = np.maximum(told["grade"].to_numpy(int), 0)
    # rows without any telling feature are alike: they count as often as there are of them
    seen_of, whole = np.bincount(grade), np.zeros(max(totals) + 1, int)
    for g, k in totals.items():
        whole[max(g, 0)] += k
    bare = np.maximum(whole - np.pad(seen_of, (0, len(whole) - len(seen_of))), 0)
    return ordinal(keys, row, at, value, np.concatenate([grade, np.arange(len(whole))]), np.concatenate([np.ones(n), bare]))


def likelihood(w: np.ndarray, t: np.ndarray, gap: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray, grade: np.ndarray, times: np.ndarray, ridge: float) -> tuple[float, list[np.ndarray]]:
    """The log likelihood less ridge / 2 times the squared weights, and its gradient by w, t (first threshold) and gap (logs of the gaps behind it)."""
    n, k = len(grade), len(gap) + 1
    cuts = t[0] + np.concatenate([[0], np.cumsum(np.exp(gap))])
    score = np.bincount(row, w[at] * value, n)
    p = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -700, 700)))
    # likelihood of grade g: p_g - p_(g + 1), with p_0 = 1 and p_(K + 1) = 0
    edge = np.column_stack([np.ones(n), p, np.zeros(n)])
    each = np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-12)
    slope = p * (1 - p)
    own = np.stack([((grade == j + 1).astype(float) - (grade == j)) * slope[:, j] / each * times for j in range(k)], axis=1)
    to_score = own.sum(axis=1)
    grads = [np.bincount(at, to_score[row] * value, len(w)) - ridge * w, np.array([-own.sum()]), -np.array([own[:, j:].sum() for j in range(1, k)]) * np.exp(gap)]
    return float(times @ np.log(each) - ridge / 2 * w @ w), grads


def ordinal(keys: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray, grade: np.ndarray, times: np.ndarray, ridge: float = 0.02, rounds: int = 1500) -> Model:
    """Cumulative-link (logit) weights and thresholds by gradient descent with Adam steps; ridge keeps weights small.

    row, at, value: the sparse matrix; grade and times (weight) of each row. Thresholds are a first one and positive gaps.
    """
    n = len(grade)
    params = [np.zeros(len(keys)), np.zeros(1), np.zeros(max(0, int(grade.max()) - 1))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        _, grads = likelihood(*params, row, at, value, grade, times, ridge)
        for q, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q += 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-9)
    w, t, gap = params
    model = Model(keys, w, t[0] + np.concatenate([[0], np.cumsum(np.exp(gap))]))
    # the cut that gains most: toxic rows over it less clean rows over it
    p = model.probabilities(np.bincount(row, w[at] * value, n))[:, 0]
    order = np.argsort(-p, kind="stable")
    gain = np.cumsum(np.where(grade > 0, times, -times)[order])
    last = np.append(np.flatnonzero(np.diff(p[order])), n - 1)
    best = last[np.argmax(gain[last])]
    model.cut = float((p[order[best]] + p[order[min(best + 1, n - 1)]]) / 2)
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = _lower(batch.column(1))
        score = np.zeros(batch.num_rows)
        for lo, hi in blocks(off) if len(model.keys) else ():
            row, key, count = block_features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], model.keys)
            score[lo:hi] += np.bincount(row, model.weights[np.searchsorted(model.keys, key)] * (1 + np.log(count)), hi - lo)
        p = model.probabilities(score)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array((p > 0.5).sum(axis=1).astype(np.int32)), pa.array(p[:, 0] > model.cut)], names=["row", "severity", "grade", "toxic"])


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep, severity (expected grade), grade, toxic of each row."""
    scored = read_texts(docs, keep, text, lambda batches: _score(batches, model), "severity double, grade int, toxic boolean")
    made = ("severity", "grade", "toxic")
    return scored.select(*unpacked(keep, made), *made)
