"""Recursive filters, transforms and long convolutions on blocks of samples.

A recursive filter looks sequential, but it is linear: the output of a block is its response from rest plus the
response to the state it starts in. Pass one filters every block from rest and keeps only the state at its end;
those states (one row per block) are folded in order, in two levels, so that no fold holds more than `FAN` rows of
one signal at a time; pass two filters every block from its true starting state. Both passes are tasks of one block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.plans.blocked import block_of, with_halo

KEYS = ["signal_id", "channel"]
FILTER_BLOCK = 16384
FAN = 4096
_SUB = 64


@dataclass(frozen=True)
class Section:
    """y[n] = b0 x[n] + b1 x[n-1] + b2 x[n-2] + a1 y[n-1] + a2 y[n-2]; the output is y[n] + direct x[n]."""

    b0: float
    b1: float = 0.0
    b2: float = 0.0
    a1: float = 0.0
    a2: float = 0.0
    direct: float = 0.0


@lru_cache(maxsize=64)
def _responses(a1: float, a2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-sample answers of y[n] = u[n] + a1 y[n-1] + a2 y[n-2]: to the input (as a matrix), to y[-1] and to y[-2]."""
    g = np.zeros(_SUB + 2)  # impulse response, g[2] is at time 0
    g[2] = 1.0
    for i in range(3, _SUB + 2):
        g[i] = a1 * g[i - 1] + a2 * g[i - 2]
    i, j = np.indices((_SUB, _SUB))
    toeplitz = np.where(i >= j, g[np.maximum(i - j, 0) + 2], 0.0)
    return toeplitz.T.copy(), a1 * g[2:] + a2 * g[1:-1], a2 * g[2:]


def _recur(u: np.ndarray, s: Section, y1: float, y2: float) -> np.ndarray:
    """y[n] = u[n] + a1 y[n-1] + a2 y[n-2]: 64 samples at a time as a matrix product, then the states in order."""
    if s.a1 == 0 and s.a2 == 0:
        return u
    n = len(u)
    into, h1, h2 = _responses(s.a1, s.a2)
    z = np.pad(u, (0, -n % _SUB)).reshape(-1, _SUB) @ into
    starts = np.empty((len(z), 2))
    for k, (last, prev) in enumerate(z[:, [-1, -2]].tolist()):
        starts[k] = (y1, y2)
        y1, y2 = last + h1[-1] * y1 + h2[-1] * y2, prev + h1[-2] * y1 + h2[-2] * y2
    return (z + starts[:, :1] * h1 + starts[:, 1:] * h2).reshape(-1)[:n]


def run_sections(x: np.ndarray, before: tuple[float, float], sections: Sequence[Section], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter one block. `before` is (x[-1], x[-2]); `state` holds (y[-1], y[-2]) of every section."""
    out_state = np.empty(2 * len(sections))
    x1, x2 = before
    for i, s in enumerate(sections):
        y1, y2 = state[2 * i], state[2 * i + 1]
        u = s.b0 * x
        if s.b1:
            u = u + s.b1 * np.concatenate(([x1], x[:-1]))
        if s.b2:
            u = u + s.b2 * np.concatenate(([x2, x1], x[:-2]))[: len(x)]
        y = _recur(u, s, y1, y2)
        tail = np.concatenate(([y2, y1], y))[-2:]
        out_state[2 * i : 2 * i + 2] = tail[::-1]
        x1, x2 = y1, y2
        x = y + s.direct * x if s.direct else y
    return x, out_state


def _check(sections: Sequence[Section]) -> None:
    for a, b in zip(sections, sections[1:]):
        if a.direct and (b.b1 or b.b2):
            raise ValueError("a section after a direct path cannot use input history")


def sample_blocks(df: DataFrame, keys: Sequence[str], before: int, size: int) -> DataFrame:
    """One row per (keys, block): `xs`, the block's samples in order, led by up to `before` samples of the block
    before it (fewer at the start); `lead` counts those."""
    halo = with_halo(df, "n", before, 0, size).filter((F.col("_block") == block_of("n", size)) | ~F.col("_core"))
    pairs = F.array_sort(F.collect_list(F.struct("n", "x")))
    return halo.groupBy(*keys, "_block").agg(
        F.transform(pairs, lambda p: p["x"].cast("double")).alias("xs"), F.sum((~F.col("_core")).cast("int")).alias("lead")
    )


def _ordered(rows: DataFrame, keys: Sequence[str], by: str, value: str, out: str) -> DataFrame:
    """The states of a group as one flat array in the order of `by`, and the first `by`."""
    pairs = F.array_sort(F.collect_list(F.struct(by, value)))
    return rows.groupBy(*keys).agg(F.min(by).alias("_from"), F.flatten(F.transform(pairs, lambda p: p[value])).alias(out))


def _fold(ends: DataFrame, keys: Sequence[str], power: np.ndarray) -> DataFrame:
    """Starting state of every block from the at-rest end states: s[k+1] = P s[k] + e[k], s[0] = 0. Blocks are taken
    in groups of `FAN`: the groups' totals are folded first, then each group from its own start."""
    dim = len(power)
    keys = list(keys)
    full = np.linalg.matrix_power(power, FAN)

    def scan(flat: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.asarray(flat, dtype=float).reshape(-1, dim)
        starts, s = np.empty_like(e), start
        for i, x in enumerate(e):
            starts[i] = s
            s = step @ s + x
        return starts.reshape(-1), s

    @F.pandas_udf("array<double>")
    def total(flat: pd.Series) -> pd.Series:
        return pd.Series([scan(f, np.zeros(dim), power)[1] for f in flat])

    @F.pandas_udf("array<double>")
    def group_starts(flat: pd.Series) -> pd.Series:
        return pd.Series([scan(f, np.zeros(dim), full)[0] for f in flat])

    @F.pandas_udf("array<double>")
    def block_starts(flat: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([scan(f, np.asarray(b, dtype=float), power)[0] for f, b in zip(flat, base)])

    def unpack(df: DataFrame, flat: str, index: str, out: str) -> DataFrame:
        count = (F.size(flat) / dim).cast("int")
        at = df.withColumn("_i", F.explode(F.sequence(F.lit(0), count - 1)))
        value = F.slice(F.col(flat), F.col("_i") * dim + 1, F.lit(dim))
        return at.withColumns({index: F.col("_from") + F.col("_i"), out: value})

    local = _ordered(ends.withColumn("_group", block_of("_block", FAN)), [*keys, "_group"], "_block", "state", "_flat")
    totals = local.select(*keys, "_group", total("_flat").alias("state"))
    upper = _ordered(totals, keys, "_group", "state", "_flat").select(*keys, "_from", group_starts("_flat").alias("_flat"))
    bases = unpack(upper, "_flat", "_group", "base").select(*keys, "_group", "base")
    done = local.join(bases, [*keys, "_group"]).select(*keys, "_from", block_starts("_flat", "base").alias("_flat"))
    return unpack(done, "_flat", "_block", "start").select(*keys, "_block", "start")


def cascade_scan(df: DataFrame, sections: Sequence[Section], keys: Sequence[str] = KEYS, size: int = FILTER_BLOCK) -> DataFrame:
    """Run second-order sections one after another over each signal, from rest. Returns `keys, n, x, y`."""
    _check(sections)
    sections = list(sections)
    dim = 2 * len(sections)
    power = np.stack([run_sections(np.zeros(size), (0.0, 0.0), sections, unit)[1] for unit in np.eye(dim)], axis=1)
    blocks = sample_blocks(df, keys, 2, size)

    def split(xs: np.ndarray, lead: int) -> tuple[np.ndarray, tuple[float, float]]:
        head = np.concatenate((np.zeros(2), xs[:lead]))[-2:]
        return np.asarray(xs[lead:], dtype=float), (head[1], head[0])

    @F.pandas_udf("array<double>")
    def end_state(xs: pd.Series, lead: pd.Series) -> pd.Series:
        out = []
        for a, k in zip(xs, lead):
            x, before = split(a, int(k))
            out.append(run_sections(x, before, sections, np.zeros(dim))[1])
        return pd.Series(out)

    @F.pandas_udf("array<double>")
    def response(xs: pd.Series, lead: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for a, k, s in zip(xs, lead, start):
            x, before = split(a, int(k))
            out.append(run_sections(x, before, sections, np.asarray(s, dtype=float))[0])
        return pd.Series(out)

    ends = blocks.select(*keys, "_block", end_state("xs", "lead").alias("state"))
    starts = _fold(ends, keys, power)
    done = blocks.join(starts, [*keys, "_block"]).withColumn("ys", response("xs", "lead", "start"))
    own = F.slice("xs", F.col("lead") + 1, F.size("xs") - F.col("lead"))
    flat = done.select(*keys, "_block", F.posexplode(F.arrays_zip(own.alias("x"), F.col("ys").alias("y"))).alias("_j", "_p"))
    return flat.select(*keys, (F.col("_block") * size + F.col("_j")).alias("n"), "_p.x", "_p.y")


def affine_scan(df: DataFrame, a: float, b: float, a2: float = 0.0, **kw) -> DataFrame:
    """y[n] = a y[n-1] + a2 y[n-2] + b x[n]."""
    return cascade_scan(df, [Section(b0=b, a1=a, a2=a2)], **kw)


def dc_block(df: DataFrame, amount: int = 9, **kw) -> DataFrame:
    """Leaky differencer in floating point: gain 1 - 2^-(amount + 1), leak 1 - 2^-amount."""
    gain = 1.0 - 2.0 ** -(amount + 1)
    return cascade_scan(df, [Section(b0=gain, b1=-gain, a1=1.0 - 2.0**-amount)], **kw)


EQ_BANDWIDTH = 2.0  # fixed value


def eq_section(frequency: float, gain: float, rate: float) -> Section | None:
    """Peaking section of one band; None for unity gain or a band above 0.45 of the rate."""
    f = frequency / rate
    if gain == 1.0 or f > 0.45:
        return None
    k = f * math.pi
    k = k + k * f
    width = (0.5 if gain < 1 else 1.0) / EQ_BANDWIDTH
    up, down, k2 = gain * width * k, width * k, k * k
    d = 1 + down + k2
    slope = 2 * (k2 - 1) / d
    return Section(b0=(1 + up + k2) / d, b1=slope, b2=(1 - up + k2) / d, a1=-slope, a2=-(1 - down + k2) / d)


def eq6(df: DataFrame, bands: Sequence[tuple[float, float]], rate: float, **kw) -> DataFrame:
    """Up to six (centre frequency, gain) bands in series; bands without effect are skipped."""
    sections = [s for s in (eq_section(f, g, rate) for f, g in bands) if s is not None]
    return cascade_scan(df, sections or [Section(b0=1.0)], **kw)


BUTTERWORTH_Q = 1.30656296487637653  # fixed value: pole pair of a fourth-order Butterworth filter


def cutoff_hz(cutoff: float, modifier: int, rate: float) -> float:
    hz = 110.0 * 2.0 ** (0.25 + cutoff * (modifier + 256) / (24.0 * 512.0))
    return min(max(hz, 120.0), 20000.0, rate * 0.5)


def resonant_sections(cutoff: int, resonance: int, rate: float, high_pass: bool = False, modifier: int = 0, classic: bool = False) -> list[Section]:
    """A two-pole resonant section (cutoff and resonance 0..127) and the Butterworth section after it. In high-pass
    mode the first section keeps `output - input` as its state. The `classic` form damps in proportion to the period, and does nothing at all without resonance when the
    modified cutoff is fully open."""
    if classic and resonance == 0 and cutoff * (modifier + 256) // 256 >= 254:  # fixed value: fully open
        return []
    damping = 10.0 ** (-resonance * (24.0 / 128.0) / 20.0)
    omega = cutoff_hz(cutoff, modifier, rate) * 2.0 * math.pi / rate
    e = 1.0 / (omega * omega)
    if classic:
        d = damping / omega + damping - 1.0
    else:
        d = (2.0 * damping - min((1.0 - 2.0 * damping) * omega, 2.0)) / omega
    total = 1.0 + d + e
    feed = 1.0 / total
    a1, a2 = (d + e + e) / total, -e / total
    first = Section(b0=-feed, a1=a1, a2=a2, direct=1.0) if high_pass else Section(b0=feed, a1=a1, a2=a2)
    alpha = math.sin(omega) / (2.0 * BUTTERWORTH_Q)
    norm = 1.0 / (1.0 + alpha)
    edge = 2.0 + 2.0 * math.cos(omega) if high_pass else 2.0 - 2.0 * math.cos(omega)
    return [first, Section(b0=edge * norm, a1=2.0 * math.cos(omega) * norm, a2=-(1.0 - alpha) * norm)]


def resonant_filter(df: DataFrame, cutoff: int, resonance: int, rate: float, high_pass: bool = False, modifier: int = 0, classic: bool = False, **kw) -> DataFrame:
    return cascade_scan(df, resonant_sections(cutoff, resonance, rate, high_pass, modifier, classic) or [Section(b0=1.0)], **kw)


def _delay_line(df: DataFrame, keys: Sequence[str], delay: int, gain: float, feedback: float, size: int) -> DataFrame:
    """`y`, the delay line's content `delay` samples ago: each residue of n modulo the delay is a first-order scan."""
    split = df.withColumn("_res", F.pmod("n", F.lit(delay))).withColumn("n", F.floor(F.col("n") / delay).cast("long"))
    done = cascade_scan(split, [Section(b0=0.0, b1=gain, a1=feedback)], [*keys, "_res"], size)
    return done.select(*keys, (F.col("n") * delay + F.col("_res")).alias("n"), "x", "y")


def echo(df: DataFrame, delay: int, feedback: float, wet: float, cross: bool = False, gain: float | None = None, size: int = FILTER_BLOCK) -> DataFrame:
    """line[n] = gain x[n] + feedback line[n - D]; out = (1 - wet) x + wet line[n - D], in `y`. With `cross` the two
    channels 0 and 1 read each other's line, which is the same filter on their sum and, with the feedback negated,
    on their difference. The default gain is sqrt(1 - feedback^2)."""
    g = math.sqrt(1.0 - feedback * feedback) if gain is None else gain
    if not cross:
        out = _delay_line(df, KEYS, delay, g, feedback, size)
        return out.withColumn("y", F.col("x") * (1 - wet) + F.col("y") * wet)
    pair = df.groupBy("signal_id", "n").agg(
        F.sum("x").alias("_sum"), F.sum(F.when(F.col("channel") == 0, F.col("x")).otherwise(-F.col("x"))).alias("_diff")
    )
    lines = {}
    for name, fb, gg in (("_sum", feedback, g), ("_diff", -feedback, g)):
        one = pair.select("signal_id", "n", F.col(name).alias("x"))
        lines[name] = _delay_line(one, ["signal_id"], delay, gg, fb, size).select("signal_id", "n", F.col("y").alias(name))
    both = df.join(lines["_sum"], ["signal_id", "n"]).join(lines["_diff"], ["signal_id", "n"])
    other = F.when(F.col("channel") == 0, F.col("_sum") - F.col("_diff")).otherwise(F.col("_sum") + F.col("_diff")) / 2
    return both.withColumn("y", F.col("x") * (1 - wet) + other * wet).drop("_sum", "_diff")


def convolve_blocks(df: DataFrame, taps: Sequence[float], size: int = FILTER_BLOCK) -> DataFrame:
    """y[n] = sum of h[k] x[n-k] for long filters: every block carries the samples before it that its outputs need,
    so blocks are independent and one pass is enough."""
    h = np.asarray(taps, dtype=float)
    size = max(size, len(h))
    blocks = sample_blocks(df, KEYS, len(h) - 1, size)

    @F.pandas_udf("array<double>")
    def conv(xs: pd.Series, lead: pd.Series) -> pd.Series:
        out = []
        for a, k in zip(xs, lead):
            full = len(a) + len(h) - 1
            if len(h) > 128:
                m = 1 << (full - 1).bit_length()
                y = np.fft.irfft(np.fft.rfft(a, m) * np.fft.rfft(h, m), m)[: len(a)]
            else:
                y = np.convolve(a, h)[: len(a)]
            out.append(y[int(k) :])
        return pd.Series(out)

    own = F.slice("xs", F.col("lead") + 1, F.size("xs") - F.col("lead"))
    done = blocks.select(*KEYS, "_block", own.alias("x"), conv("xs", "lead").alias("y"))
    flat = done.select(*KEYS, "_block", F.posexplode(F.arrays_zip("x", "y")).alias("_j", "_p"))
    return flat.select(*KEYS, (F.col("_block") * size + F.col("_j")).alias("n"), "_p.x", "_p.y")


def overlap_add(frames: DataFrame, hop: int, keys: Sequence[str]) -> DataFrame:
    """Add frames `keys, frame, i, x` back into one signal by position."""
    return frames.groupBy(*keys, (F.col("frame") * hop + F.col("i")).alias("n")).agg(F.sum("x").alias("x"))
