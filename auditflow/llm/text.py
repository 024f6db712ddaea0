"""Whole string columns as byte arrays: words, hashes and sums per row.

Every function works on a slice of an Arrow batch at once.  A slice holds few bytes
unless a single text is longer; texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The blanks of ``[^\x20\x09-\x0D]+``.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20, max_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut so that the texts of ``column`` hold about ``max_bytes``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, min(int(np.searchsorted(ends, before + max_bytes, "right")), first + max_rows))
            yield batch.slice(first, last - first)
            first = last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of ``values`` over each row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def row_of(offsets: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """For each position the number of its row."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=kind), np.diff(offsets))


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the place of its first word (n + 1 places)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~blank[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    edge[1:] = ~inside[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & edge)
    edge[-1] = True
    edge[:-1] = ~inside[1:]
    edge[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, wherever the word stands."""
    n = len(data)
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        for k, base in enumerate((_ODD, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[data] * _powers[0][:n], out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window of ``size`` words inside one row, and the window's hash."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mixed(total * _ODD + hashes[k : k + n])
    left = np.repeat(first[1:], np.diff(first))[:n]  # the end of each place's row
    places = np.flatnonzero(np.arange(n) + size <= left)
    return places, total[places]


def joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows with one space between them: bytes, starts, ends, first places."""
    starts, ends, first = words(data, offsets)
    lengths = ends - starts
    new = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=new[1:])
    keep = ~BLANK[data]
    after = ends[ends < len(data)]
    out = np.full(int(new[-1]), 0x20, np.uint8)
    if len(after) == len(ends) and not np.any(~BLANK[data[after]]):  # a blank after each word: it becomes the space
        keep[after] = True
        out[:] = data[keep]
        out[new[1:] - 1] = 0x20
    else:
        at = np.ones(len(out), bool)
        at[new[1:] - 1] = False
        out[at] = data[keep]
    return out, new[:-1], new[:-1] + lengths, first


def crc32_mod(column, modulus: int):
    """crc32 of a column's text, modulo ``modulus``; null stays null."""
    from pyspark.sql import functions as F

    return F.crc32(column.cast("string").cast("binary")) % modulus
