"""Word and line boundaries and their 64-bit hashes, computed for whole Arrow batches with numpy.

Memory is bounded by a few times the bytes of one block of documents (BLOCK bytes, or one longer document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 4 << 20
_SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, _SLICE)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _SLICE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null is the empty string."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes; a longer document is a range of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; no run crosses a document's end."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all \\n-separated lines, and the first line of each document (n + 1 offsets)."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([off[1:], breaks]), kind="stable")
    per = np.diff(np.searchsorted(breaks, off)) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(per)])


def _prefix(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The polynomial prefix hash of data at sorted positions."""
    out, carry, scale = np.empty(len(at), np.uint64), np.uint64(0), 1
    edges = np.arange(0, len(data) + _SLICE + 1, _SLICE)
    cut = np.searchsorted(at, edges)
    for k, base in enumerate(edges[:-1]):
        part = data[base : base + _SLICE].astype(np.uint64)
        part += np.uint64(1)
        part *= _UP[: len(part)]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        sums *= np.uint64(scale)
        sums += carry
        out[cut[k] : cut[k + 1]] = sums[at[cut[k] : cut[k + 1]] - base]
        carry, scale = sums[-1], scale * pow(_BASE, _SLICE, 1 << 64) & _MASK
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each span of bytes; starts and ends are each sorted. Texts can be made to collide: see classes()."""
    with np.errstate(over="ignore"):
        h = _prefix(data, ends) - _prefix(data, starts)
        far = np.array([pow(pow(_BASE, -1, 1 << 64), k * _SLICE, 1 << 64) for k in range(len(data) // _SLICE + 1)], np.uint64)
        h *= _DOWN[starts % _SLICE] * far[starts // _SLICE]
        return mix(h + (ends - starts).astype(np.uint64))


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, limit: int = 1 << 20) -> bool:
    """Whether the bytes from each a equal those from b, size of them; compared about limit bytes at a time."""
    ends = np.cumsum(size)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        n = size[lo:hi]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(a[lo:hi], n) + step] != data[np.repeat(b[lo:hi], n) + step]).any():
            return False
        lo = hi
    return True


def classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, from 0, equal for equal bytes only, and the first span of each number.

    Spans of equal hashes are compared byte for byte; where texts are made to collide, all spans are told apart by their bytes.
    """
    _, first, of = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size, chief = ends - starts, first[of]
    again = np.flatnonzero(chief != np.arange(len(of)))
    if (size[again] != size[chief[again]]).any() or not _same(data, starts[again], starts[chief[again]], size[again]):
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.unique(of, return_index=True)[1]
    return of, first


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i + 1]] for each i."""
    out = np.add.reduceat(np.append(values, values.dtype.type(0)), off[:-1], dtype=np.int64)
    out[off[1:] == off[:-1]] = 0
    return out
