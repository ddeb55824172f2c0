"""Vectorised word splitting and hashing over Arrow string columns.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``; A-Z count as a-z. Each
word gets a 64-bit hash of its bytes, computed for all words of a slab at once from
prefix sums of a polynomial, so no Python loop runs over words. Temporaries are
bounded by the slab, not by the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB = 1 << 19

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240101).integers(1, _MASK, 256, dtype=np.uint64)[_LOWER]

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for b in (_BASE, inverse):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (tables[0], tables[1])
    return _powers


def text_buffers(column: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) for runs of rows of about ``limit`` bytes; null counts as ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def fold_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals U+00C0 to U+00DE made small, so that case does not tell words apart."""
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    if len(capital):
        data = data.copy()
        data[capital] += 0x20
    return data


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of every word of the rows in ``data``, in order."""
    n = len(data)
    parts = []
    at = 0
    borders = np.unique(offsets[(offsets > 0) & (offsets < n)])
    while at < n:
        stop = min(at + SLAB, n)
        if stop < n:  # cut where no word runs across: at a white space, or at a row's start
            spaces = np.flatnonzero(_SPACE[data[at:stop]])
            row = borders[np.searchsorted(borders, stop, "right") - 1] if len(borders) else 0
            cut = max(int(spaces[-1]) + at + 1 if len(spaces) else 0, int(row) if row > at else 0)
            if cut <= at:  # one word fills the slab: take all of it
                look = stop
                while look < n:
                    more = np.flatnonzero(_SPACE[data[look : look + SLAB]])
                    nextrow = np.searchsorted(borders, look, "left")
                    edge = int(borders[nextrow]) if nextrow < len(borders) else n
                    if len(more) or edge <= look + SLAB:
                        look = min(look + int(more[0]) if len(more) else n, edge)
                        break
                    look += SLAB
                cut = min(max(look, stop), n)
            stop = cut
        piece = data[at:stop]
        inner = ~_SPACE[piece]
        begins = inner.copy()
        begins[1:] &= ~inner[:-1]
        finishes = inner.copy()
        finishes[:-1] &= ~inner[1:]
        own = borders[np.searchsorted(borders, at, "right") : np.searchsorted(borders, stop, "left")] - at
        begins[own] = inner[own]
        finishes[own - 1] = inner[own - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        if len(starts):
            power, inverse = _power_tables(len(piece))
            sums = np.empty(len(piece) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[piece] * power[: len(piece)], dtype=np.uint64, out=sums[1:])
            hashes = (sums[ends] - sums[starts]) * inverse[starts]
            hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            parts.append((starts + at, ends + at, hashes))
        at = stop
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends, hashes


def ngrams(row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of ``n`` words within one row."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    same = np.flatnonzero(row[:count] == row[n - 1 :])
    out = np.full(len(same), n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[same + k])
    return same, out


def shingle_sets(row: np.ndarray, hashes: np.ndarray, n: int, rows: int) -> list[np.ndarray]:
    """For each of ``rows`` rows the sorted distinct ``n``-word shingles as int64.

    A row of fewer than ``n`` words has its whole sequence as its one shingle; a row
    without words has none.
    """
    counts = np.bincount(row, minlength=rows)
    ends = np.cumsum(counts)
    index, grams = ngrams(row, hashes, n)
    gram_ends = np.cumsum(np.bincount(row[index], minlength=rows)) if len(index) else np.zeros(rows, np.int64)
    out = []
    low = 0
    for r in range(rows):
        if counts[r] >= n:
            out.append(np.unique(grams[low : gram_ends[r]].view(np.int64)))
        elif counts[r]:
            k = int(counts[r])
            out.append(ngrams(row[ends[r] - k : ends[r]], hashes[ends[r] - k : ends[r]], k)[1].view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        low = gram_ends[r]
    return out
