"""Click and crackle detection and repair on `signal_id, channel, n, x`.

The residual detector, the median repair and the autoregressive repair follow our own definitions, written in
each docstring; window lengths and thresholds are the fixed presets below.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.plans.blocked import BLOCK, block_of, islands, with_halo
from sigframe.session import materialize

MAD_FLOOR = 1e-12
KEYS = ["signal_id", "channel"]
AR_BLOCK = 4096
RESIDUAL_BLOCK = 16384


@dataclass(frozen=True)
class DetectParams:
    window: int
    z_hi: float
    z_lo: float
    max_len: int
    pad: int
    merge_gap: int


def click_params(rate: int) -> DetectParams:
    """Click preset for a sample rate."""
    return DetectParams(max(int(0.004 * rate), 63) | 1, 10.0, 4.5, min(max(int(0.001 * rate), 8), 64), 1, 2)


def crackle_params(rate: int) -> DetectParams:
    """Crackle preset for a sample rate."""
    return DetectParams(max(int(0.003 * rate), 31) | 1, 7.5, 3.2, min(max(int(0.00045 * rate), 2), 24), 0, 1)


class CleanupMode(Enum):
    OFF = "off"
    DECLICK_AR = "declick_ar"
    DECLICK_MEDIAN = "declick_median"
    DECRACKLE = "decrackle"


class CleanupVersion(Enum):
    V1 = "v1"
    V21 = "v21"


@dataclass(frozen=True)
class CleanupSettings:
    """Mode and version with the stable tag used in cache keys: off 0; version 1 modes 1..3; version 2.1 modes 4..6."""

    mode: CleanupMode = CleanupMode.OFF
    version: CleanupVersion = CleanupVersion.V21

    @property
    def tag(self) -> int:
        rank = list(CleanupMode).index(self.mode)
        return rank if rank == 0 or self.version is CleanupVersion.V1 else rank + 3

    @classmethod
    def all_active(cls) -> list[CleanupSettings]:
        return [cls(m, v) for v in CleanupVersion for m in CleanupMode if m is not CleanupMode.OFF]


def _running_median(x: np.ndarray, h: int) -> np.ndarray:
    """Median over [i - h, i + h], cut short at the ends; NaN is ignored. Missing values sort last as infinity, and
    the number of values present picks the middle."""
    n, w = len(x), 2 * h + 1
    there = ~np.isnan(x)
    padded = np.pad(np.where(there, x, np.inf), h, constant_values=np.inf)
    upto = np.concatenate(([0], np.cumsum(there)))
    at = np.arange(n)
    have = upto[np.minimum(at + h + 1, n)] - upto[np.maximum(at - h, 0)]
    view = np.lib.stride_tricks.sliding_window_view(padded, w)
    out = np.empty(n)
    for a in range(0, n, 4096):
        k = have[a : a + 4096]
        if (k == w).all():
            out[a : a + 4096] = np.partition(view[a : a + 4096], h, axis=1)[:, h]
            continue
        rows, i = np.sort(view[a : a + 4096], axis=1), np.arange(len(k))
        middle = (rows[i, np.maximum(k - 1, 0) // 2] + rows[i, np.minimum(k // 2, w - 1)]) / 2
        out[a : a + 4096] = np.where(k > 0, middle, np.nan)
    return out


def robust_residual(df: DataFrame, window: int, size: int = RESIDUAL_BLOCK) -> DataFrame:
    """z = |x - med| / max(MAD, 1e-12): `med` is the median over a centred window of odd length, MAD the median
    over the same window of every sample's distance to its own median. Windows are cut short at the ends.

    A moving median is a numeric kernel: a framed `percentile` rebuilds its state for every row, so blocks of samples,
    with two half windows of their neighbours on either side, go to numpy instead. Returns the keys, `n`, `x`, `med`,
    `mad`, `z`.
    """
    h = window // 2
    size = max(size, 4 * h)
    pairs = F.array_sort(F.collect_list(F.struct("n", "x")))
    blocks = (
        with_halo(df.select(*KEYS, "n", F.col("x").cast("double").alias("x")), "n", 2 * h, 2 * h, size)
        .groupBy(*KEYS, "_block")
        .agg(pairs.alias("_p"), F.min(F.when(F.col("_core"), F.col("n"))).alias("_first"), F.count_if("_core").cast("int").alias("_size"))
        .filter(F.col("_size") > 0)
        .withColumns({"_xs": F.transform("_p", lambda p: p["x"]), "_lead": (F.col("_first") - F.element_at("_p", 1)["n"]).cast("int")})
    )

    @F.pandas_udf("struct<med:array<double>,mad:array<double>,z:array<double>>")
    def kernel(xs: pd.Series, lead: pd.Series, count: pd.Series) -> pd.DataFrame:
        rows = []
        for a, k, c in zip(xs, lead, count):
            x = np.array(a, dtype=float)
            med = _running_median(x, h)
            dev = np.abs(x - med)
            mad = _running_median(dev, h)
            own = slice(k, k + c)
            rows.append((med[own], mad[own], dev[own] / np.maximum(mad[own], MAD_FLOOR)))
        return pd.DataFrame(rows, columns=["med", "mad", "z"])

    done = blocks.withColumn("_k", kernel("_xs", "_lead", "_size"))
    own = F.slice("_xs", F.col("_lead") + 1, F.col("_size"))
    cells = F.arrays_zip(own.alias("x"), F.col("_k.med").alias("med"), F.col("_k.mad").alias("mad"), F.col("_k.z").alias("z"))
    flat = done.select(*KEYS, "_first", F.posexplode(cells).alias("_j", "_c"))
    known = {c: F.when(~F.isnan(F.col(f"_c.{c}")), F.col(f"_c.{c}")).alias(c) for c in ("med", "mad", "z")}
    return flat.select(*KEYS, (F.col("_first") + F.col("_j")).alias("n"), F.col("_c.x").alias("x"), *known.values())


def hysteresis_mask(df: DataFrame, z_hi: float, z_lo: float, max_len: int, size: int = BLOCK) -> DataFrame:
    """Runs of consecutive samples with z >= z_lo that reach z_hi somewhere and are at most `max_len` long:
    one row per region with `start_n, end_n, top_z`."""
    runs = islands(df.filter(F.col("z") >= z_lo), KEYS, "n", {"top_z": ("max", F.col("z"))}, size)
    return runs.filter((F.col("top_z") >= z_hi) & (F.col("end_n") - F.col("start_n") + 1 <= max_len))


def merge_regions(regions: DataFrame, pad: int, gap: int, size: int = BLOCK) -> DataFrame:
    """Pad regions, join those at most `gap` samples apart, and take the union over channels, so that all
    channels of a signal are repaired at the same places. Regions are short (see `hysteresis_mask`), so they
    are laid out as positions and merged as runs."""
    lo = F.greatest(F.col("start_n") - pad, F.lit(0).cast("long"))
    covered = regions.select("signal_id", F.explode(F.sequence(lo, F.col("end_n") + pad + gap)).alias("n")).distinct()
    return islands(covered, ["signal_id"], "n", size=size).withColumn("end_n", F.col("end_n") - gap)


def detect_regions(df: DataFrame, p: DetectParams, size: int = BLOCK) -> DataFrame:
    """Residual, hysteresis and merging in one go; the last region is cut at the end of the signal."""
    z = robust_residual(df, p.window)
    merged = merge_regions(hysteresis_mask(z, p.z_hi, p.z_lo, p.max_len, size), p.pad, p.merge_gap, size)
    last = df.groupBy("signal_id").agg(F.max("n").alias("_last"))
    return merged.join(last, "signal_id").withColumn("end_n", F.least("end_n", "_last")).drop("_last")


def _region_context(df: DataFrame, regions: DataFrame, context: int, size: int) -> DataFrame:
    """Samples within `context` of a region, matched by block so that no task sees a whole signal. Adds
    `start_n, end_n, _inside`."""
    spread = regions.withColumn(
        "_block",
        F.explode(
            F.sequence(
                F.greatest(block_of(F.col("start_n") - context, size), F.lit(0).cast("long")),
                block_of(F.col("end_n") + context, size),
            )
        ),
    )
    rows = df.withColumn("_block", block_of("n", size)).join(spread, ["signal_id", "_block"])
    return (
        rows.filter(F.col("n").between(F.col("start_n") - context, F.col("end_n") + context))
        .withColumn("_inside", F.col("n").between(F.col("start_n"), F.col("end_n")))
        .drop("_block")
    )


def repair_median(df: DataFrame, regions: DataFrame, context: int, size: int = BLOCK) -> DataFrame:
    """Replace every region, in all channels, by the median of the samples within `context` on either side that
    belong to no region. With no such neighbour the samples stay. Output has the rows of `df` and `repaired`."""
    regions = materialize(regions, "regions")  # detection is the costly part, and it is used twice
    near = _region_context(df, regions, context, size)
    own = ["signal_id", "channel", "start_n"]
    bad = near.filter("_inside").select("signal_id", "channel", "n").distinct().withColumn("_bad", F.lit(True))
    clean = near.filter(~F.col("_inside")).join(bad, ["signal_id", "channel", "n"], "left_anti")
    fill = clean.groupBy(*own).agg(F.percentile("x", F.lit(0.5)).alias("_fill"))
    spans = regions.withColumn("n", F.explode(F.sequence("start_n", "end_n"))).select("signal_id", "start_n", "n")
    fixes = spans.join(fill, ["signal_id", "start_n"]).select("signal_id", "channel", "n", "_fill")
    return (
        df.join(fixes, ["signal_id", "channel", "n"], "left")
        .withColumn("repaired", F.col("_fill").isNotNull())
        .withColumn("x", F.coalesce("_fill", "x"))
        .drop("_fill")
    )


def _ar_fill(x: np.ndarray, inside: np.ndarray, order: int) -> np.ndarray:
    """Least-squares autoregressive prediction of the `inside` samples from both sides of the context."""
    ok = ~inside
    first, last = int(np.argmax(inside)), len(inside) - 1 - int(np.argmax(inside[::-1]))
    left, right = x[:first], x[last + 1 :]
    rows, rhs = [], []
    for part in (left, right):
        if len(part) > order:
            view = np.lib.stride_tricks.sliding_window_view(part, order + 1)
            rows.append(view[:, :order][:, ::-1])
            rhs.append(view[:, order])
    if not rows or not ok.any():
        return x
    a, *_ = np.linalg.lstsq(np.vstack(rows), np.concatenate(rhs), rcond=None)
    gap = last - first + 1

    def extend(history: np.ndarray) -> np.ndarray:
        buf = list(history[-order:])
        for _ in range(gap):
            buf.append(float(np.dot(a, buf[: -order - 1 : -1])))
        return np.array(buf[order:])

    ahead = extend(left) if len(left) >= order else None
    behind = extend(right[::-1])[::-1] if len(right) >= order else None
    if ahead is None and behind is None:
        return x
    w = (np.arange(gap) + 1) / (gap + 1)
    guess = behind if ahead is None else ahead if behind is None else ahead * (1 - w) + behind * w
    out = x.copy()
    limit = np.abs(x[ok]).max()
    out[first : last + 1] = np.clip(guess, -limit, limit)
    return out


def repair_ar(df: DataFrame, regions: DataFrame, context: int, order: int = 8, size: int = BLOCK) -> DataFrame:
    """Replace every region, in all channels, by an autoregressive prediction: coefficients are fitted by least
    squares on `context` samples each side, the gap is predicted forwards and backwards and cross-faded, and
    limited to the loudest context sample. A group holds the regions that start in one block, with their context."""
    near = (
        _region_context(df, regions, context, size)
        .select("signal_id", "channel", "start_n", "n", "x", "_inside")
        .withColumn("_block", block_of("start_n", AR_BLOCK))
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, one in pdf.sort_values("n").groupby("start_n", sort=False):
            inside = one["_inside"].to_numpy(dtype=bool)
            fixed = _ar_fill(one["x"].to_numpy(dtype=float), inside, order)
            parts.append(one.loc[inside, ["signal_id", "channel", "n"]].assign(_fill=fixed[inside]))
        return pd.concat(parts)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    fixes = near.groupBy("signal_id", "channel", "_block").applyInPandas(
        fit, f"signal_id {kinds['signal_id']}, channel {kinds['channel']}, n {kinds['n']}, _fill double"
    )
    return (
        df.join(fixes, ["signal_id", "channel", "n"], "left")
        .withColumn("repaired", F.col("_fill").isNotNull())
        .withColumn("x", F.coalesce("_fill", "x"))
        .drop("_fill")
    )


def apply_cleanup(df: DataFrame, rate: int, settings: CleanupSettings, context: int = 64) -> DataFrame:
    """Run the passes of a mode: one declick pass (AR or median), or two crackle passes. Only the first version is defined."""
    if settings.version is not CleanupVersion.V1:
        raise ValueError(f"no definition of cleanup version {settings.version}")
    out = df.withColumn("repaired", F.lit(False))
    if settings.mode is CleanupMode.OFF:
        return out
    passes = 2 if settings.mode is CleanupMode.DECRACKLE else 1
    params = crackle_params(rate) if settings.mode is CleanupMode.DECRACKLE else click_params(rate)
    fix = repair_median if settings.mode is CleanupMode.DECLICK_MEDIAN else repair_ar
    cur = df
    for k in range(passes):
        now = cur.drop("repaired") if k == 0 else materialize(cur.drop("repaired"), "pass")
        cur = fix(now, detect_regions(now, params), context)
    return cur


def clicks_per_stream(df: DataFrame, p: DetectParams, size: int = BLOCK) -> DataFrame:
    """The flagship question: which signals contain clicks, where, and how loud is each signal?"""
    loud = df.groupBy("signal_id").agg(F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    found = detect_regions(df, p, size)
    return found.join(loud, "signal_id")
