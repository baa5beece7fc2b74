"""Arrays of samples and option maps as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigframe.functions.pcm import clip


def deinterleave(xs: Column, channels: int, k: int) -> Column:
    """Channel `k` of an interleaved array."""
    return F.filter(xs, lambda x, i: i % channels == k)


def interleave(a: Column, b: Column) -> Column:
    return F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y)))


def mix_to_mono(xs: Column, channels: int) -> Column:
    """Mean of the channels of each frame of an interleaved array; an incomplete last frame is left out."""
    frames = F.floor(F.size(xs) / channels).cast("int")
    idx = F.when(frames > 0, F.sequence(F.lit(0), frames - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda f: sum((F.get(xs, f * channels + k).cast("double") for k in range(channels)), F.lit(0.0)) / channels)


def scale_array(xs: Column, gain: float) -> Column:
    return F.transform(xs, lambda x: x.cast("double") * gain)


def scale_and_clamp_array(xs: Column, gain: float) -> Column:
    return F.transform(xs, lambda x: clip(x.cast("double") * gain))


def subtract_array(xs: Column, ys: Column) -> Column:
    return F.zip_with(xs, ys, lambda x, y: x.cast("double") - y.cast("double"))


def keymap_transpose(keymap: Column, amount: int, low: int = 1, high: int = 128) -> Column:
    return F.transform(keymap, lambda k: F.least(F.greatest(k + amount, F.lit(low)), F.lit(high)))


def options_merge(*maps: Column) -> Column:
    """Later maps win."""

    def over(base: Column, top: Column) -> Column:
        return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)

    return reduce(over, maps)


def option(options: Column, key: str, kind: str) -> Column:
    """Typed getter: boolean, bigint, double or string; NULL if absent or malformed."""
    return F.element_at(options, F.lit(key)).try_cast(kind)
