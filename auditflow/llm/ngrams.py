"""Hashed character and word n-grams of whole texts as one dense row per text."""

from __future__ import annotations

import numpy as np

from auditflow.llm import text as T

LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)


def lower_latin(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; all else in ASCII is a space."""
    out = LETTERS[data]
    if len(data) > 1:
        after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][after] += 0x20
    return out


def counts(row: np.ndarray, buckets: np.ndarray, rows: int, dims: int) -> np.ndarray:
    return np.bincount(row * dims + buckets, minlength=rows * dims).reshape(rows, dims)


def char_counts(data: np.ndarray, offsets: np.ndarray, dims: int, size: int = 3) -> np.ndarray:
    """How often each hashed byte n-gram occurs in each row; n-grams do not cross rows."""
    rows, n = len(offsets) - 1, len(data) - size + 1
    if n <= 0:
        return np.zeros((rows, dims), np.int64)
    code = np.zeros(n, np.uint32)
    for k in range(size):
        code = code * np.uint32(0x9E3779B1) + data[k : k + n] + np.uint32(k + 1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code >>= np.uint32(32 - int(dims).bit_length() + 1)
    row = T.row_of(offsets)
    whole = row[:n] == row[size - 1 :]
    if not whole.all():
        return counts(row[:n][whole], code[whole].astype(np.int64), rows, dims)
    return counts(row[:n], code.astype(np.int64), rows, dims)


def word_counts(hashes: np.ndarray, first: np.ndarray, dims: int, size: int = 1) -> np.ndarray:
    """How often each hashed word n-gram occurs in each row."""
    places, grams = T.windows(hashes, first, size) if size > 1 else (np.arange(len(hashes)), hashes)
    row = T.row_of(first)
    return counts(row[places], (grams >> np.uint64(65 - int(dims).bit_length())).astype(np.int64), len(first) - 1, dims)


def frequencies(n: np.ndarray) -> np.ndarray:
    """Counts as shares of their row; a row without any stays zero."""
    return (n / np.maximum(n.sum(axis=1, keepdims=True), 1)).astype(np.float32)
