"""Vectorised text primitives on Arrow buffers.

A batch of documents is one UTF-8 byte buffer with offsets; words, hashes and
windows are whole-buffer NumPy operations. Python never loops over words, and
working memory is bounded by ``limit`` bytes plus the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
_BYTE = np.random.default_rng(20240607).integers(1, 2**64 - 1, 256, dtype=np.uint64) | U(1)
_BASES = {0: 0x9E3779B97F4A7C15, 1: 0xC2B2AE3D27D4EB4F, 2: 0xD6E8FEB86659FD93}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers modulo 2**64 of an odd base and of its inverse."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        have = _POWERS[which] = tuple(out)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    if data is None or not data.size:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batches, text: int | str, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offs = texts(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
            hi = min(hi, batch.num_rows)
            yield batch.slice(lo, hi - lo), buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def spans(keep: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a row's end."""
    n = len(keep)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start = keep.copy()
    start[1:] &= ~keep[:-1] | first[1:n]
    stop = keep.copy()
    stop[:-1] &= ~keep[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each row's first word (n rows + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    starts, ends = spans(~WHITE[buf], offs)
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span (spans may overlap)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = powers(which, len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * p[: len(buf)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(items: np.ndarray, starts: np.ndarray, lengths, which: int = 1) -> np.ndarray:
    """A 64-bit hash of ``items[s : s + length]`` for each start; items are word hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = powers(which, len(items) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * p[: len(items)], out=sums[1:])
        return mix((sums[starts + lengths] - sums[starts]) * q[starts] + np.asarray(lengths).astype(np.uint64))


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from each row's first item (n rows + 1)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def signed(x: np.ndarray) -> pa.Array:
    """uint64 hashes as Arrow int64."""
    return pa.array(x.view(np.int64))


def per_row(values: np.ndarray, first: np.ndarray, kind=np.int64) -> np.ndarray:
    """Sums of values by row, where row r has items first[r] to first[r + 1]."""
    sums = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
