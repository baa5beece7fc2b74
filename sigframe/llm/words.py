"""Texts of an Arrow batch as byte buffers, words as spans of them, and hashes of words and word windows.

A word is a maximal run of bytes other than space and the controls 9 to 13 (`bytes.split` uses the same set). Everything
here is vectorised over a piece of a batch; a piece holds whole texts and about `PIECE` bytes, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of the texts (null: empty)."""
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(batch: pa.RecordBatch, text: int = 1, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows so that each part holds about `limit` bytes of text."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // limit
    cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut, cut[1:]):
        yield batch.slice(a, b - a)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more entry than texts)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start, end = ~space, ~space
    start[1:] &= space[:-1] | edge[1:-1]
    end[:-1] &= space[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    if not len(s):
        return np.zeros(0, np.uint64)
    length = e - s
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    byte = data[np.repeat(s, length) + at].astype(np.uint64) + np.uint64(1)
    total = np.add.reduceat(byte * _powers(_MUL, int(length.max()))[at], np.cumsum(length) - length)
    return _mix(total + length.astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` words (also of those that cross texts; see `starts_inside`)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_MUL, len(words)))])
    return _mix((sums[width:] - sums[:n]) * _powers(_INV, n))


def starts_inside(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of `n` windows of `width` words lie inside one text."""
    ok = np.zeros(n + 1, np.int64)
    last = np.maximum(first[1:] - width + 1, first[:-1])
    np.add.at(ok, np.minimum(first[:-1], n), 1)
    np.add.at(ok, np.minimum(last, n), -1)
    return np.cumsum(ok[:n]) > 0


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    return (np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]) if rest else out


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of true values."""
    d = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
