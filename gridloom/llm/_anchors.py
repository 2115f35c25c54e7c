"""Sampled positions that stand for all strings of a fixed length, computed per block of texts with numpy."""

from __future__ import annotations

import numpy as np

from ._text import _DOWN, _UP, _SLICE, mix  # noqa: F401
from ._text import span_hashes

_PLACE = np.uint64((1 << 22) - 1)
#: Positions of one call of runs(); places must fit _PLACE.
PART = 1 << 20


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """The 64-bit name of the string of this length at each position (len(data) - length + 1 of them)."""
    with np.errstate(over="ignore"):
        out = np.empty(max(0, len(data) - length + 1), np.uint64)
        step = _SLICE - length
        for lo in range(0, len(out), step):
            part = data[lo : lo + step + length - 1].astype(np.uint64)
            part += np.uint64(1)
            part *= _UP[: len(part)]
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(part, out=sums[1:])
            n = min(step, len(out) - lo)
            out[lo : lo + n] = (sums[length : length + n] - sums[:n]) * _DOWN[:n]
        return mix(out)


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of this width, by prefix and suffix minima of stretches as long as a window."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def part_of(length: int) -> int:
    """The length of the samples of strings of this length."""
    return max(1, length // 4)


def runs(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of strings of this length that share their sample: first start, number of starts, and two names.

    A string's sample is the first of its substrings of a quarter of the length whose name is least (by its upper bits), so equal strings have
    equal samples at equal places. The names: of the sample, and of all bytes that the run's strings cover.
    """
    part = part_of(length)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    names = rolling(data, part)
    least = window_least((names & ~_PLACE) | np.arange(len(names), dtype=np.uint64), length - part + 1)
    ok = np.zeros(len(least), bool)
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if hi - lo >= length:
            ok[lo : hi - length + 1] = True
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, none.view(np.uint64), none.view(np.uint64)
    sample = (least[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (sample[1:] != sample[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.append(first, len(at)))
    lo = at[first]
    return lo, count, names[sample[first]], span_hashes(data, lo, lo + count - 1 + length)
