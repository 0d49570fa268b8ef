"""Words and word shingles of Arrow text columns, found on the UTF-8 bytes.

A word is a maximal run of bytes outside ``0x20`` and ``0x09``–``0x0D``. All
of these are ASCII, so bytes and code points agree. Words get 64-bit hashes of
all their bytes (optionally with ``A``–``Z`` lower-cased); nothing here builds
a Python string. Two words fall together with a probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = {False: mix(np.arange(1, 257, dtype=np.uint64)), True: mix(_LOWER.astype(np.uint64) + np.uint64(1))}
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``p**0 … p**n`` and the same for the inverse of ``p``, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        both = []
        for base in (int(_ODD), _inverse(int(_ODD))):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, ends


class Words:
    """Words of some rows: ``start`` and ``end`` (bytes), ``hash``, and ``first`` (per row, in words)."""

    def __init__(self, start: np.ndarray, end: np.ndarray, hashed: np.ndarray, first: np.ndarray):
        self.start, self.end, self.hash, self.first = start, end, hashed, first

    def row(self) -> np.ndarray:
        """The row number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _spans(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``raw``; no word crosses a position in ``cuts``."""
    solid = np.zeros(len(raw) + 2, dtype=bool)
    solid[1:-1] = ~_BLANK[raw]
    start = solid[1:-1] & ~solid[:-2]
    end = solid[1:-1] & ~solid[2:]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    start[inner] |= solid[inner + 1]
    end[inner - 1] |= solid[inner]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    power, inverse = _powers(len(raw))
    run = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[lower][raw] * power[: len(raw)], out=run[1:])
    return mix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(column: pa.Array, lower: bool = True) -> Words:
    """All words of all rows, in at most ``CHUNK`` bytes at a time unless one word is longer."""
    raw, ends = buffers(column)
    base = int(ends[0]) if len(ends) else 0
    raw = raw[base : int(ends[-1])] if len(ends) else raw
    cuts = ends - base
    starts, stops, hashes, at = [], [], [], 0
    while at < len(raw):
        to = min(len(raw), at + CHUNK)
        if to < len(raw):
            blank = np.flatnonzero(_BLANK[raw[at:to]])
            row_cuts = cuts[np.searchsorted(cuts, at, "right") : np.searchsorted(cuts, to, "right")]
            last = max(int(blank[-1]) + 1 if len(blank) else 0, int(row_cuts[-1]) - at if len(row_cuts) else 0)
            while last == 0:  # one word fills the chunk
                more = min(len(raw), to + CHUNK)
                blank = np.flatnonzero(_BLANK[raw[to:more]])
                row_cuts = cuts[np.searchsorted(cuts, to, "right") : np.searchsorted(cuts, more, "right")]
                ahead = [int(blank[0]) + 1] * bool(len(blank)) + [int(row_cuts[0]) - to] * bool(len(row_cuts))
                last, to = (min(ahead) + to - at, to) if ahead else (len(raw) - at if more == len(raw) else 0, more)
            to = at + last
        part = raw[at:to]
        s, e = _spans(part, cuts[(cuts > at) & (cuts < to)] - at)
        starts.append(s + at)
        stops.append(e + at)
        hashes.append(_hashes(part, s, e, lower))
        at = to
    none = np.zeros(0, dtype=np.int64)
    start = np.concatenate(starts) if starts else none
    return Words(
        start,
        np.concatenate(stops) if stops else none,
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        np.searchsorted(start, cuts, "left"),
    )


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and where each row's runs begin.

    A row with fewer words, but at least one, has its whole sequence as one run.
    """
    count = np.diff(found.first)
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(runs)])
    begin = np.repeat(found.first[:-1], runs) + np.arange(first[-1]) - np.repeat(first[:-1], runs)
    length = np.repeat(np.minimum(count, size), runs)
    out = np.zeros(len(begin), dtype=np.uint64)
    for k in range(size):
        inside = length > k
        out[inside] = mix(out[inside] * _ODD + found.hash[begin[inside] + k])
    return out, first


def sub_batches(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of text each, a row at least."""
    if not batch.num_rows:
        return
    _, ends = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
