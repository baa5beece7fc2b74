"""Fast Fourier transforms of frames and correlations by lag.

A transform runs stage by stage over all frames of an Arrow batch at once: butterflies of doubling width where the length is a power of two, and Bluestein's
chirp (two such transforms of a longer, padded frame) for every other length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=32)
def _stages(n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bit-reversed order and the twiddle factors of each stage."""
    order = np.zeros(1, dtype=np.int64)
    while len(order) < n:
        order = np.concatenate((2 * order, 2 * order + 1))
    return order, [np.exp(-1j * np.pi * np.arange(h) / h) for h in (1 << i for i in range(n.bit_length() - 1))]


@lru_cache(maxsize=32)
def _chirp(n: int) -> tuple[np.ndarray, np.ndarray]:
    """exp(-i pi k^2 / n), and the transform of its inverse, padded."""
    k = np.arange(n)
    wave = np.exp(-1j * np.pi * (k * k % (2 * n)) / n)
    m = 1 << (2 * n - 2).bit_length()
    padded = np.zeros((1, m), complex)
    padded[0, :n] = wave.conj()
    padded[0, m - n + 1 :] = wave.conj()[:0:-1]
    return wave, fourier(padded)[0]


def fourier(z: np.ndarray) -> np.ndarray:
    """Unscaled transform of every row."""
    frames, n = z.shape
    if n < 2:
        return z.astype(complex)
    if n & (n - 1):
        wave, kernel = _chirp(n)
        padded = np.zeros((frames, len(kernel)), complex)
        padded[:, :n] = z * wave
        return inverse(fourier(padded) * kernel)[:, :n] * wave
    order, twiddles = _stages(n)
    z = z[:, order].astype(complex)
    for w in twiddles:
        h = len(w)
        pairs = z.reshape(frames, n // (2 * h), 2, h)
        odd = pairs[:, :, 1] * w
        z = np.concatenate((pairs[:, :, 0] + odd, pairs[:, :, 0] - odd), axis=2).reshape(frames, n)
    return z


def inverse(z: np.ndarray) -> np.ndarray:
    return fourier(z.conj()).conj() / z.shape[1]


def correlation(a: np.ndarray, b: np.ndarray, lags: int) -> np.ndarray:
    """sum of a[n] b[n + s] over all n, for s = 0 .. lags - 1; `b` has at least `len(a) + lags - 1` values."""
    m = 1 << (len(a) + lags - 1).bit_length()
    both = np.zeros((1, m), complex)
    both[0, : len(a)] = a
    both[0, : len(a) + lags - 1] += 1j * b[: len(a) + lags - 1]
    f = fourier(both)[0]
    back = np.roll(f[::-1], 1).conj()  # real input in the real part, another in the imaginary part
    fa, fb = (f + back) / 2, (f - back) / 2j
    return inverse((fa.conj() * fb)[None])[0].real[:lags]


LIMB = 14  # bits of a number that are correlated at a time: with 16,384 products the error stays far below a half


def exact_correlation(a: np.ndarray, b: np.ndarray, lags: int) -> np.ndarray:
    """`correlation` of whole numbers below 2^42 in size, without error; the sums must fit 64 bits."""
    total = np.zeros(lags, dtype=np.int64)
    parts = lambda x: [(np.sign(x) * ((np.abs(x) >> LIMB * i) & (1 << LIMB) - 1)) for i in range(3)]
    for i, p in enumerate(parts(a)):
        for j, q in enumerate(parts(b)):
            if p.any() and q.any():
                total += np.rint(correlation(p, q, lags)).astype(np.int64) << LIMB * (i + j)
    return total


def shift_costs(x: np.ndarray, own: int, lags: np.ndarray) -> np.ndarray | None:
    """sum of (x[n + s] - x[n])^2 for each lag, over the first `own` positions that have a value `max(lags)` ahead; None if there is none.
    Two energies less twice the correlation; without error for whole numbers."""
    top = int(lags.max())
    m = min(own, len(x) - top)
    if m <= 0:
        return None
    if len(lags) < 24 or x.dtype.kind == "f" and not np.isfinite(x).all():
        return np.array([np.nansum((x[s : s + m] - x[:m]) ** 2) for s in lags.tolist()], x.dtype)
    find = exact_correlation if x.dtype.kind == "i" else correlation
    total = np.concatenate(([0], np.cumsum(x * x)))
    return total[m] + total[lags + m] - total[lags] - 2 * find(x[:m], x, top + 1)[lags]


def shift_cost_udf(lags: list[int], kind: str):
    """Costs of a block as an array: from its samples in order and how many of them are its own."""
    at = np.array(lags)

    def run(frames: pa.Array, own: pa.Array) -> pa.Array:
        whole = kind == "bigint"
        rows = [shift_costs(np.asarray(f.values.to_numpy(zero_copy_only=False), np.int64 if whole and not f.values.null_count else float), k, at) for f, k in zip(frames, own.to_pylist())]
        flat = np.concatenate([np.zeros(0), *[r for r in rows if r is not None]]) if not whole else np.concatenate([np.zeros(0, np.int64), *[np.rint(r).astype(np.int64) for r in rows if r is not None]])
        return _lists(rows, pa.array(flat))

    return F.arrow_udf(run, f"array<{kind}>")


_SPECTRUM = pa.struct([("re", pa.float64()), ("im", pa.float64())])


def _by_length(frames: pa.Array, work) -> list[np.ndarray | None]:
    """`work` on the frames of each length at once; null for null frames."""
    size = frames.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = frames.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null values become NaN
    start = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))
    out: list[np.ndarray | None] = [None] * len(frames)
    for n in np.unique(size[size >= 0]).tolist():
        rows = np.flatnonzero(size == n)
        done = work(values[start[rows][:, None] + np.arange(n)])
        for i, r in zip(rows.tolist(), done):
            out[i] = r
    return out


def _lists(rows: list[np.ndarray | None], values: pa.Array) -> pa.Array:
    ends = np.cumsum([0, *[0 if r is None else len(r) for r in rows]])
    mask = pa.array([r is None for r in rows])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=mask)


def _spectra(frames: pa.Array) -> pa.Array:
    rows = _by_length(frames, lambda x: fourier(x)[:, : x.shape[1] // 2 + 1] if x.shape[1] else x)
    flat = np.concatenate([np.zeros(0, complex), *[r for r in rows if r is not None]])
    parts = [pa.array(np.ascontiguousarray(p), mask=np.isnan(p)) for p in (flat.real, flat.imag)]
    return _lists(rows, pa.StructArray.from_arrays(parts, fields=list(_SPECTRUM)))


def _signals(re: pa.Array, im: pa.Array) -> pa.Array:
    def whole(z: np.ndarray) -> np.ndarray:
        if z.shape[1] < 2:
            return np.zeros((len(z), 0))
        z = z.copy()
        z[:, [0, -1]] = z[:, [0, -1]].real
        return inverse(np.concatenate((z, z[:, -2:0:-1].conj()), axis=1)).real

    both = [None if a is None or b is None else a + 1j * b for a, b in zip(_by_length(re, list), _by_length(im, list))]
    rows: list[np.ndarray | None] = [None] * len(both)
    for n in {len(z) for z in both if z is not None}:
        at = [i for i, z in enumerate(both) if z is not None and len(z) == n]
        for i, x in zip(at, whole(np.array([both[i] for i in at]).reshape(len(at), n))):
            rows[i] = x
    flat = np.concatenate([np.zeros(0), *[r for r in rows if r is not None]])
    return _lists(rows, pa.array(flat, mask=np.isnan(flat)))


def dft(xs: Column) -> Column:
    """Spectrum of a frame of any length: array of struct(re, im), bins 0 .. len/2. A null value makes all bins null; an empty frame has none."""
    return F.arrow_udf(_spectra, "array<struct<re:double,im:double>>")(xs.cast("array<double>"))


def idft(re: Column, im: Column) -> Column:
    """Frame from its half spectrum (even length); the imaginary parts of the first and last bin do not count."""
    return F.arrow_udf(_signals, "array<double>")(re.cast("array<double>"), im.cast("array<double>"))
