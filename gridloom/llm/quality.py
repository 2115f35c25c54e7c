"""Host-level quality rules: failures are counted for each domain, rates shrunk by an empirical beta prior, verdicts joined back.

Defined results: null and empty texts have no words and fail the length rule; a null domain is a domain of its own; equal rows are
judged alike; texts of any length are read whole; an empty table gives an empty one; columns of docs that share a name with a result
give way to it, any other column is returned as it is. Counts are exact: words and lines are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._support import read_texts, store, unpacked
from ._text import SPACE, blocks, classes, line_spans, spans, string_buffers, sums

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Characters that mark leftover markup.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def block_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """FEATURES of each document, as an int64 array of one row a document."""
    n = len(off) - 1
    out = np.zeros((n, len(FEATURES)), np.int64)
    if not len(data):
        return out
    inside = ~SPACE[data]
    starts, ends = spans(inside, off)
    words = np.searchsorted(starts, off)
    out[:, 0] = np.diff(words)
    out[:, 1] = sums((inside & ((data & 0xC0) != 0x80)).view(np.int8), off)
    out[:, 2] = sums(_SYMBOL[data].view(np.int8), off)
    # lines with a word: those between whose ends some word starts
    lo, hi, _ = line_spans(data, off)
    full = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    lo, hi = lo[full], hi[full]
    doc = np.searchsorted(off, lo, "right") - 1
    line, first = classes(data, lo, hi)
    out[:, 3] = np.bincount(doc, minlength=n)
    out[:, 3] -= np.bincount(np.unique(doc * max(1, len(first)) + line) // max(1, len(first)), minlength=n)
    # windows of three words of one document that occur twice or more in it
    if len(starts) > 2:
        word, first = classes(data, starts, ends)
        doc = np.repeat(np.arange(n), out[:, 0])
        pair = np.unique(word[:-1] * len(first) + word[1:], return_inverse=True)[1]
        tri = np.unique(pair[:-1] * len(first) + word[2:], return_inverse=True)[1]
        own = doc[:-2] == doc[2:]
        order = np.sort((doc[2:] * len(tri) + tri)[own])
        again = np.unique(order[1:][order[1:] == order[:-1]])
        twice = own & np.isin(doc[2:] * len(tri) + tri, again, kind="sort") if len(again) else np.zeros(len(tri), bool)
        covered = np.zeros(len(starts), np.int8)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        out[:, 4] = sums(covered, words)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = string_buffers(batch.column(batch.num_columns - 1))
        rest = batch.columns[:-1]
        for lo, hi in blocks(off):
            found = block_features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in rest), *(pa.array(x) for x in found.T)], names=[*batch.schema.names[:-1], *FEATURES])


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """row (the columns keep in a struct), then FEATURES of each row's text."""
    return read_texts(docs, keep, text, _measure, ", ".join(f"{c} bigint" for c in FEATURES))


def base_failed(max_repeat: float = 50.0, min_words: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Document rules whose failures are counted for each domain."""
    return {
        "short": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > 5 * F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        "lines": F.col("n_dup_lines") * 10 > F.col("n_words"),
    }


def host_verdicts(features: DataFrame, domain: Column, most: float = 0.6, sure: float = 3.0) -> DataFrame:
    """domain (null included) and rejected: whether for some rule the shrunk failure rate, less sure deviations, is over most.

    For each rule, a beta prior is fitted to the rates of all domains by moments: the variance between domains beyond what binomial
    sampling explains gives its strength. A domain's rate is then the posterior mean (failures + a) / (documents + a + b).
    """
    counted = features.groupBy(domain.alias("domain")).agg(F.count("*").alias("n"), *[F.count(F.when(c, 1)).alias(k) for k, c in rules().items()])
    # one row for a domain and rule
    long = counted.select("domain", "n", F.explode(F.create_map(*[x for k in rules() for x in (F.lit(k), F.col(k))])).alias("rule", "failed"))
    total = long.groupBy("rule").agg(F.sum("n").alias("docs"), F.count("*").alias("domains"), F.sum("failed").alias("bad"), F.sum(F.col("n") * F.col("n").cast("double")).alias("squares"), F.sum(F.col("failed") * F.col("failed").cast("double") / F.col("n")).alias("scaled"))
    mean = F.col("bad") / F.col("docs")
    between = F.col("scaled") - F.col("docs") * mean * mean
    noise = (F.col("domains") - 1) * mean * (1 - mean)
    extra = (between - noise) / F.greatest(F.col("docs") - F.col("squares") / F.col("docs"), F.lit(1e-9))
    share = F.least(F.lit(0.999), F.greatest(F.lit(1e-6), extra / F.greatest(mean * (1 - mean), F.lit(1e-12))))
    prior = total.select("rule", mean.alias("mean"), (1 / share - 1).alias("strength"))
    rate = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + F.col("strength") + 1))
    judged = long.join(prior, "rule").withColumn("over", rate - sure * deviation > most)
    return judged.groupBy("domain").agg(F.max("over").alias("rejected"))


def judge(docs: DataFrame, keep: list[str], text: str = "text", domain: str = "source", scratch: bool = True) -> DataFrame:
    """keep, FEATURES, base_failed, kept for each row: kept unless it fails the base rules or its domain is rejected.

    scratch: write the features once and read them for both the counts and the join; otherwise (where keep holds the text) the texts
    are measured twice and nothing is written.
    """
    own = list(dict.fromkeys([*keep, domain]))
    features = store(measure(docs, own, text), "features") if scratch else measure(docs, own, text)
    of = F.col("row")[domain]
    verdicts = host_verdicts(features if scratch else measure(docs, [domain], text), of)
    joined = features.withColumn("base_failed", base_failed()).join(verdicts, of.eqNullSafe(F.col("domain")))
    return joined.select(*unpacked(keep, (*FEATURES, "base_failed", "kept")), *FEATURES, "base_failed", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"))
