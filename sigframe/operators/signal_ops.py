"""Sample-by-sample operators on `signal_id, channel, n, x` with dense positions `n`.

Neighbours are reached through blocks with halos and signal lengths through a block-expanded join, so no task has
to hold a whole signal.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sigframe.operators.signal_stats import attach_by_block, lengths
from sigframe.operators.transforms import shift_cost_udf
from sigframe.plans.blocked import BLOCK, block_of, core_only, halo_window, positions, running, shifted, with_halo

KEYS = ["signal_id", "channel"]
Curve = Callable[[Column], Column]

# Fade laws: functions of a position 0..1. Any other Column function may be passed instead.
FADE_LAWS: dict[str, Curve] = {
    "linear": lambda p: p,
    "pow": lambda p: p * p,
    "sqrt": lambda p: F.sqrt(p),
    "log": lambda p: F.log10(p * 99.0 + 1.0) * 0.5,
    "quarter_sine": lambda p: F.sin(p * (0.5 * math.pi)),
    "half_sine": lambda p: (F.cos(p * math.pi + math.pi) + 1.0) * 0.5,
}


def delta_decode(df: DataFrame, keys: Sequence[str], n: str, x: str, bits: int, size: int = BLOCK) -> DataFrame:
    """Wrapping running sum of `x`, read as a signed integer of `bits` bits, in `decoded`."""
    span = 1 << bits
    out = running(df, keys, [n], block_of(n, size), {"_s": ("sum", F.pmod(F.col(x), F.lit(span)))})
    u = F.pmod(F.col("_s"), F.lit(span))
    return out.withColumn("decoded", F.when(u >= span // 2, u - span).otherwise(u).cast("long")).drop("_s")


def running_limiter(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """Gain 1 / peak once the peak so far, over all channels, exceeds 1; it never recovers."""
    out = running(df, ["signal_id"], ["n"], block_of("n", size), {"_peak": ("max", F.abs("x"))}, peers=True)
    gain = F.when(F.col("_peak") > 1, 1 / F.col("_peak")).otherwise(1.0)
    return out.withColumn("y", F.col("x") * gain).drop("_peak")


def fade(df: DataFrame, law: str | Curve, fade_in: bool = True) -> DataFrame:
    """Multiply by the law of the position n / (N - 1), reversed for a fade-out."""
    curve = FADE_LAWS[law] if isinstance(law, str) else law
    sized = attach_by_block(df, lengths(df))
    pos = F.when(F.col("frames") > 1, F.col("n") / (F.col("frames") - 1)).otherwise(1.0)
    return sized.withColumn("y", F.col("x") * curve(pos if fade_in else 1 - pos)).drop("frames")


def tremolo_gate(df: DataFrame, half_period: int, triangle: bool) -> DataFrame:
    """Square: pass the first half of each period, mute the second. Triangle: rise, then fall."""
    c = F.pmod("n", F.lit(2 * half_period))
    first = c < half_period
    if triangle:
        y = F.col("x") * F.when(first, c).otherwise(2 * half_period - c) / half_period
    else:
        y = F.when(first, F.col("x")).otherwise(0.0)
    return df.withColumn("y", y)


def lfo(phase: Column, wave: str, amplitude: float, offset: float, inverted: bool = False, cycle: Column | None = None) -> Column:
    """Oscillator value in 0..1 at a phase 0..1. Waves: sine, triangle, saw, square, and two noises whose random
    points are a hash of the cycle number (ours)."""

    def point(c: Column) -> Column:
        return F.conv(F.substring(F.md5(c.cast("string")), 1, 5), 16, 10).cast("double") / float(1 << 19) - 1.0

    if wave == "sine":
        v = F.sin(phase * (2 * math.pi))
    elif wave == "triangle":
        v = 1.0 - F.abs(phase - 0.5) * 4.0
    elif wave == "saw":
        v = phase * 2.0 - 1.0
    elif wave == "square":
        v = F.when(phase < 0.5, -1.0).otherwise(1.0)
    elif wave in ("hold_noise", "smooth_noise") and cycle is not None:
        w = phase * phase * phase * (phase * (phase * 6.0 - 15.0) + 10.0)
        v = point(cycle) if wave == "hold_noise" else point(cycle + 1) * w + point(cycle) * (1.0 - w)
    else:
        raise ValueError(f"unknown wave {wave}")
    if inverted:
        v = -v
    return F.least(F.greatest(v * amplitude + offset, F.lit(0.0)), F.lit(1.0))


def monotone_ticks(df: DataFrame, keys: Sequence[str], n: str, tick: str, strict: bool = True, size: int = BLOCK) -> DataFrame:
    """Force ticks upwards along `n`. Strict: a tick not above its predecessor becomes predecessor + 1, which in
    closed form is n + running max of (tick - n). Otherwise the first tick becomes 0 and the running max holds."""
    if strict:
        out = running(df, keys, [n], block_of(n, size), {"_m": ("max", F.col(tick) - F.col(n))})
        return out.withColumn(tick, (F.col("_m") + F.col(n)).cast("long")).drop("_m")
    raised = F.when(F.col(n) == 0, 0).otherwise(F.col(tick))
    return running(df, keys, [n], block_of(n, size), {"_m": ("max", raised)}).withColumn(tick, F.col("_m").cast("long")).drop("_m")


def scale_nodes(df: DataFrame, keys: Sequence[str], n: str, factor_x: float, factor_y: float, offset_y: float, centre: float, top: int = 64) -> DataFrame:
    """Scale `tick` (cut to whole ticks, then strictly increasing) and `value` (about a centre, negative factors
    turn the values over first; rounded into 0..top)."""
    out = df
    if factor_x > 0 and factor_x != 1:
        out = monotone_ticks(df.withColumn("tick", F.floor(F.col("tick") * factor_x).cast("long")), keys, n, "tick")
    if factor_y != 1 or offset_y != 0:
        v = (F.lit(top) - F.col("value")) if factor_y < 0 else F.col("value")
        moved = (v - centre) * abs(factor_y) + centre + offset_y
        out = out.withColumn("value", F.round(F.least(F.greatest(moved, F.lit(0.0)), F.lit(float(top)))).cast("long"))
    return out


def wet_dry_mix(dry: DataFrame, wet: DataFrame, percent: int) -> DataFrame:
    """dry * (1 - w) + wet * w by position; 100 or more is wet only, 0 or less is dry only."""
    if percent >= 100:
        return wet
    if percent <= 0:
        return dry
    w = percent / 100.0
    both = dry.join(wet.withColumnRenamed("x", "_wet"), [*KEYS, "n"])
    return both.withColumn("x", F.col("x") * (1 - w) + F.col("_wet") * w).drop("_wet")


def convolve_taps(df: DataFrame, taps: Sequence[float], size: int = BLOCK) -> DataFrame:
    """y[n] = sum of h[k] x[n-k] with silence before the start; for short filters, as one window of lags."""
    w = halo_window(KEYS, ["n"])
    y = sum((F.coalesce(F.lag("x", k).over(w), F.lit(0.0)) * h for k, h in enumerate(taps) if h != 0), F.lit(0.0))
    return core_only(with_halo(df, "n", len(taps) - 1, 0, max(size, len(taps))).withColumn("y", y))


def window_frames(df: DataFrame, length: int, hop: int) -> DataFrame:
    """Overlapping frames in long form: `frame, i` beside the sample. Only frames that are complete by position
    0 .. N-1 exist; each row is copied to the frames it belongs to (about length / hop)."""
    sized = attach_by_block(df, lengths(df))
    lo = F.greatest(F.ceil((F.col("n") - (length - 1)) / hop), F.lit(0)).cast("long")
    hi = F.least(F.floor(F.col("n") / hop), F.floor((F.col("frames") - length) / hop)).cast("long")
    out = sized.filter(hi >= lo).withColumn("frame", F.explode(F.sequence(lo, hi)))
    return out.withColumn("i", F.col("n") - F.col("frame") * hop).drop("frames")


def _outputs(df: DataFrame, rate_in: int, rate_out: int, around: tuple[int, int]) -> DataFrame:
    """Every source sample with its neighbours and the output positions that fall on it or right after it:
    `i` (output), `frac` (0..1 to the next sample) and `_x{offset}`."""
    sized = attach_by_block(df, lengths(df))
    cols = {f"_x{o}": ("x", o) for o in range(around[0], around[1] + 1) if o != 0}
    near = shifted(sized, KEYS, "n", cols).withColumn("_x0", F.col("x"))
    count = F.greatest(F.round(F.col("frames") * rate_out / rate_in), F.lit(1)).cast("long")
    lo = F.floor((F.col("n") * rate_out + (rate_in - 1)) / rate_in).cast("long")
    hi = F.least(F.floor(((F.col("n") + 1) * rate_out + (rate_in - 1)) / rate_in).cast("long"), count) - 1
    out = near.filter(hi >= lo).withColumn("i", F.explode(F.sequence(lo, hi)))
    return out.withColumn("frac", (F.col("i") * rate_in - F.col("n") * rate_out) / float(rate_out))


def resample_linear(df: DataFrame, rate_in: int, rate_out: int) -> DataFrame:
    """Linear interpolation at i * in / out, the last sample held; output length round(N * out / in), at least 1.
    Each source row makes its own outputs, so the only exchange is the one for its right neighbour."""
    if rate_in <= 0 or rate_out <= 0:
        raise ValueError("rates must be positive")
    o = _outputs(df, rate_in, rate_out, (0, 1))
    nxt = F.coalesce("_x1", "x")
    return o.select(*KEYS, F.col("i").alias("n"), (F.col("x") * (1 - F.col("frac")) + nxt * F.col("frac")).alias("x"))


# Cosine coefficients of the eight window types.
WINDOWS = {
    "hann": (0.50, 0.50),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.50, 0.08),
    "blackman3_61": (0.44959, 0.49364, 0.05677),
    "blackman3_67": (0.42323, 0.49755, 0.07922),
    "blackman4_92": (0.35875, 0.48829, 0.14128, 0.01168),
    "blackman4_74": (0.40217, 0.49703, 0.09392, 0.00183),
    "kaiser4": (0.40243, 0.49804, 0.09831, 0.00122),
}


def window_curve(name: str) -> Curve:
    """A window as a function of the position 0..1 (alternating cosine sum)."""
    terms = WINDOWS[name]
    return lambda p: sum((F.cos(p * (2 * math.pi * k)) * ((-1) ** k * a) for k, a in enumerate(terms)), F.lit(0.0))


def resample_sinc(df: DataFrame, rate_in: int, rate_out: int, window: str | Curve = "kaiser4", cutoff: float = 0.9, taps: int = 8) -> DataFrame:
    """Windowed-sinc interpolation with `taps` neighbours, coefficients normalised to sum 1, silence outside."""
    curve = window_curve(window) if isinstance(window, str) else window
    back, ahead = -(taps // 2 - 1), taps // 2
    o = _outputs(df, rate_in, rate_out, (back, ahead))
    total, gain = F.lit(0.0), F.lit(0.0)
    for c, off in enumerate(range(back, ahead + 1)):
        u = F.lit(c + 0.5) - F.col("frac")  # position inside the window, 0 .. taps - 1
        pos = u - (taps - 1) / 2
        arc = pos * math.pi
        value = F.when(F.abs(pos) < 1e-8, F.lit(cutoff)).otherwise(curve(u / (taps - 1)) * F.sin(arc * cutoff) / arc)
        gain = gain + value
        total = total + value * F.coalesce(f"_x{off}", F.lit(0.0))
    return o.select(*KEYS, F.col("i").alias("n"), (total / gain).alias("x"))


def grain_stretch(df: DataFrame, grain: int, ratio: float, pitch: float) -> DataFrame:
    """Cyclic time stretch. A grain starts every M = ceil(0.8 grain / pitch) outputs, round(0.8 grain / (ratio pitch))
    source samples further on; while the previous grain still sounds the two are cross-faded. Both source positions
    of an output follow in closed form, so the work is two equi joins. Sources are linearly interpolated."""
    start = 0.8 * grain
    every = max(math.ceil(start / pitch - 1e-9), 1)
    step = math.floor(start / (ratio * pitch) + 0.5)
    size = lengths(df).withColumn("count", F.round(F.col("frames") * ratio).cast("long"))
    out = positions(size, KEYS, "count", "n")
    k = F.floor(F.col("n") / every).cast("long")
    new_pos = (F.col("n") - k * every) * pitch
    old_pos = new_pos + every * pitch
    active = (k > 0) & (old_pos < grain)
    out = out.withColumns(
        {
            "_p": k * step + new_pos,
            "_q": F.when(active, (k - 1) * step + old_pos),
            "_fade": F.when(active, (old_pos - start) / (grain - start)),
        }
    )
    src = shifted(df, KEYS, "n", {"_next": ("x", 1)}).select(*KEYS, "n", "x", F.coalesce("_next", "x").alias("_next"))

    def fetch(rows: DataFrame, pos: str, name: str) -> DataFrame:
        side = src.select(*KEYS, F.col("n").alias("_i"), F.col("x").alias("_a"), F.col("_next").alias("_b"))
        hit = rows.withColumn("_i", F.floor(pos).cast("long")).join(side, [*KEYS, "_i"], "left")
        frac = F.col(pos) - F.col("_i")
        value = F.coalesce(F.col("_a") + (F.col("_b") - F.col("_a")) * frac, F.lit(0.0))
        return hit.withColumn(name, value).drop("_i", "_a", "_b")

    new = fetch(out, "_p", "_new")
    crossing = fetch(new.filter(F.col("_q").isNotNull()), "_q", "_old")
    mixed = crossing.withColumn("x", F.col("_old") + (F.col("_new") - F.col("_old")) * F.col("_fade"))
    plain = new.filter(F.col("_q").isNull()).withColumn("x", F.col("_new"))
    return mixed.select(*KEYS, "n", "x").unionByName(plain.select(*KEYS, "n", "x"))


def _bounds(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Attach the range [a, b) computed from `frames`."""
    return attach_by_block(df, lengths(df)).withColumns({"_a": a.cast("long"), "_b": b.cast("long")})


def unroll_pingpong(df: DataFrame, loop_start: Column, loop_end: Column) -> DataFrame:
    """Follow the loop by its mirror image; later samples move back by the loop length."""
    r = _bounds(df, loop_start, loop_end)
    span = F.col("_b") - F.col("_a")
    moved = r.withColumn("n", F.when(F.col("n") >= F.col("_b"), F.col("n") + span).otherwise(F.col("n")))
    mirror = r.filter((F.col("n") >= F.col("_a")) & (F.col("n") < F.col("_b"))).withColumn("n", F.col("_b") + F.col("_b") - 1 - F.col("n"))
    return moved.unionByName(mirror).drop("_a", "_b", "frames")


def crossfade_loop(df: DataFrame, loop_start: Column, loop_end: Column, fade_len: int, law: str | Curve = "linear") -> DataFrame:
    """Blend the last `fade_len` samples of the loop into those before its start: sample j of the fade (1-based)
    takes the share law(j / fade_len) of the earlier material."""
    curve = FADE_LAWS[law] if isinstance(law, str) else law
    r = _bounds(df, loop_start, loop_end)
    before = r.filter((F.col("n") < F.col("_a")) & (F.col("n") >= F.col("_a") - fade_len)).select(
        *KEYS, (F.col("n") + F.col("_b") - F.col("_a")).alias("n"), F.col("x").alias("_pre")
    )
    w = curve((F.col("n") - (F.col("_b") - fade_len) + 1) / fade_len)
    out = r.join(before, [*KEYS, "n"], "left")
    mixed = F.when(F.col("_pre").isNotNull(), F.col("x") * (1 - w) + F.col("_pre") * w).otherwise(F.col("x"))
    return out.withColumn("x", mixed).drop("_pre", "_a", "_b", "frames")


def stereo_separation(left: Column, right: Column, percent: float) -> tuple[Column, Column]:
    """Scale the side component; -200 .. 200 percent."""
    s = max(-200.0, min(200.0, percent)) / 100.0
    mid, side = (left + right) / 2, (left - right) / 2 * s
    return mid + side, mid - side


def reverse_range(df: DataFrame, a: Column, b: Column) -> DataFrame:
    r = _bounds(df, a, b)
    inside = (F.col("n") >= F.col("_a")) & (F.col("n") < F.col("_b"))
    return r.withColumn("n", F.when(inside, F.col("_a") + F.col("_b") - 1 - F.col("n")).otherwise(F.col("n"))).drop("_a", "_b", "frames")


def invert_range(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return _map_range(df, a, b, -F.col("x"))


def silence_range(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return _map_range(df, a, b, F.lit(0.0))


def _map_range(df: DataFrame, a: Column, b: Column, value: Column) -> DataFrame:
    r = _bounds(df, a, b)
    inside = (F.col("n") >= F.col("_a")) & (F.col("n") < F.col("_b"))
    return r.withColumn("x", F.when(inside, value).otherwise(F.col("x"))).drop("_a", "_b", "frames")


def insert_silence(df: DataFrame, at: Column, length: int) -> DataFrame:
    r = _bounds(df, at, at)
    moved = r.withColumn("n", F.when(F.col("n") >= F.col("_a"), F.col("n") + length).otherwise(F.col("n"))).select(*KEYS, "n", "x")
    gap = lengths(df).withColumns({"_at": at.cast("long"), "_len": F.lit(length).cast("long")})
    zeros = positions(gap, KEYS, "_len", "_j").select(*KEYS, (F.col("_at") + F.col("_j")).alias("n"), F.lit(0.0).alias("x"))
    return moved.unionByName(zeros)


def remove_range(df: DataFrame, a: Column, b: Column) -> DataFrame:
    r = _bounds(df, a, b).filter((F.col("n") < F.col("_a")) | (F.col("n") >= F.col("_b")))
    span = F.col("_b") - F.col("_a")
    return r.withColumn("n", F.when(F.col("n") >= F.col("_b"), F.col("n") - span).otherwise(F.col("n"))).drop("_a", "_b", "frames")


def adjust_points(points: Column, start: Column, ratio: float) -> Column:
    """Loop and cue points after a stretch that begins at `start`."""
    return F.transform(points, lambda p: F.when(p > start, start + F.round((p - start) * ratio)).otherwise(p).cast("long"))


# Pitch estimation. 32 bins per note, notes 24 to 96, one octave is 384 bins.
SIGNAL = ["signal_id", "channel"]
BINS_PER_NOTE, START_BIN, END_BIN, OCTAVE_BINS = 32, 24 * 32, 96 * 32, 384


def candidate_shifts(rate: int, reference: float = 440.0) -> list[tuple[int, int]]:
    """(bin number, lag in samples) of every candidate pitch."""
    out = []
    for note in range(START_BIN, END_BIN):
        hz = reference * 2.0 ** ((note / BINS_PER_NOTE - 69.0) / 12.0)
        out.append((note, max(math.floor(rate / hz + 0.5), 1)))
    return out


def pitch_input(df: DataFrame, rate: int) -> DataFrame:
    """A signal ready for the pitch search: its channels added up into channel 0, and, if it is shorter than a second, repeated until
    it lasts one, so that the largest lag fits."""
    mono = df.groupBy("signal_id", "n").agg(F.sum("x").alias("x"))
    frames = mono.groupBy("signal_id").agg((F.max("n") + 1).alias("_frames"))
    turns = F.ceil(F.lit(rate) / F.col("_frames")).cast("long")
    long = mono.join(frames, "signal_id").withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1)))
    return long.select("signal_id", F.lit(0).alias("channel"), (F.col("n") + F.col("_turn") * F.col("_frames")).alias("n"), "x")


SHIFT_BLOCK = 16_384


def self_shift_diff(df: DataFrame, shifts: Sequence[int], size: int = SHIFT_BLOCK) -> DataFrame:
    """`signal_id, channel, shift, cost`: sum of squared differences with the signal moved by each lag, over the first
    N - max(lag) samples. One pass: a block gathers its samples and the `max(lag)` after them, gets the costs of all lags from two energies and a
    fast correlation, and the blocks' costs are added up. Samples without a value take no part."""
    lags = [int(s) for s in shifts]
    top = max(lags)
    wide = with_halo(df, "n", 0, top, max(min(size, SHIFT_BLOCK), 1))
    kind = "double" if isinstance(df.schema["x"].dataType, (T.DoubleType, T.FloatType)) else "bigint"
    samples = F.transform(F.sort_array(F.collect_list(F.struct("n", "x"))), lambda s: s["x"].cast(kind))
    blocks = wide.groupBy(*SIGNAL, "_block").agg(samples.alias("xs"), F.count_if("_core").alias("own"))
    costs = blocks.select(*SIGNAL, F.posexplode(shift_cost_udf(lags, kind)("xs", "own")).alias("_at", "cost"))
    named = costs.select(*SIGNAL, F.get(F.array(*[F.lit(s) for s in lags]), F.col("_at")).alias("shift"), "cost")
    return named.groupBy(*SIGNAL, "shift").agg(F.sum("cost").alias("cost"))


def folded_histogram(df: DataFrame, rate: int, reference: float = 440.0, size: int = SHIFT_BLOCK) -> DataFrame:
    """`signal_id, channel, bin, cost`: shift costs of all candidates, added up by octave-folded bin. Equal lags are computed
    once and then weighted by the number of candidates they stand for."""
    weight: dict[int, dict[int, int]] = {}
    for note, shift in candidate_shifts(rate, reference):
        bins = weight.setdefault(shift, {})
        bins[note % OCTAVE_BINS] = bins.get(note % OCTAVE_BINS, 0) + 1
    costs = self_shift_diff(df, sorted(weight), size)
    # A constant: at most one entry per lag, 2304 uses in all.
    uses = json.dumps({str(s): [{"bin": b, "times": k} for b, k in sorted(bins.items())] for s, bins in weight.items()})
    table = F.from_json(F.lit(uses), "map<string,array<struct<bin:int,times:int>>>")
    spread = costs.select(*SIGNAL, "cost", F.inline(F.element_at(table, F.col("shift").cast("string"))))
    return spread.groupBy(*SIGNAL, "bin").agg(F.sum(F.col("cost") * F.col("times")).alias("cost"))


def smooth_circular(hist: DataFrame, bins: int = OCTAVE_BINS, width: int = 4) -> DataFrame:
    """Circular smoothing in whole numbers: for k = width .. 0, v = v div 2 + (h[i-k] + h[i+k]) div 2, starting from
    the bin itself. All bins of a signal must be present, as `folded_histogram` makes them; the first and last few
    are copied around the circle, so a window sees `bins` + 2 `width` rows per signal."""
    b = F.col("bin")
    spots = F.when(b < width, F.array(b, b + bins)).when(b >= bins - width, F.array(b, b - bins)).otherwise(F.array(b))
    ring = hist.select(*SIGNAL, F.explode(spots).alias("bin"), F.col("cost").cast("long").alias("cost"))
    w = W.partitionBy(*SIGNAL).orderBy("bin")
    near = {f"_{o}": (F.lag("cost", -o) if o < 0 else F.lead("cost", o)).over(w) for o in range(-width, width + 1)}
    wide = ring.withColumns(near).filter(b.between(0, bins - 1))
    v = F.col("cost")
    for k in range(width, -1, -1):
        v = F.shiftright(v, 1) + F.shiftright(F.col(f"_{-k}") + F.col(f"_{k}"), 1)  # costs are never negative
    return wide.select(*SIGNAL, "bin", v.alias("cost"))


def argmin_bin(hist: DataFrame, target_note: int = 0) -> DataFrame:
    """First bin of least cost, moved by octaves to lie around the target note."""
    t = target_note - 12 if target_note >= 6 else target_note
    best = hist.groupBy(*SIGNAL).agg(F.min(F.struct("cost", "bin")).alias("_b")).select(*SIGNAL, F.col("_b.bin").cast("long").alias("bin"))
    off = F.col("bin") - t * BINS_PER_NOTE
    off = F.when(off >= 6 * BINS_PER_NOTE, off - 12 * BINS_PER_NOTE).otherwise(off)
    return best.withColumn("centred", off + t * BINS_PER_NOTE)


def tuned_rate(best: DataFrame, rate: int, target_note: int = 0, reference: float = 440.0) -> DataFrame:
    """New sample rate from the centred bin."""
    t = target_note - 12 if target_note >= 6 else target_note
    hz = F.lit(reference) * F.pow(F.lit(2.0), (F.lit(-float(t)) + F.col("centred") / BINS_PER_NOTE) / 12.0)
    return best.withColumn("rate", F.round(F.lit(rate * reference) / hz).cast("long"))
