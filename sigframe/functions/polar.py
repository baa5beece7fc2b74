"""Phasor arithmetic on (re, im) pairs as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGNITUDE_FLOOR = 1e-30  # fixed value: below this a magnitude counts as zero
ANTIPODE_EPS = 1e-9  # fixed value
_PI, _TAU = math.pi, 2.0 * math.pi


def to_polar(re: Column, im: Column) -> tuple[Column, Column]:
    return F.hypot(re, im), F.atan2(im, re)


def from_polar(r: Column, theta: Column) -> tuple[Column, Column]:
    return r * F.cos(theta), r * F.sin(theta)


def shortest_arc(start: Column, end: Column) -> Column:
    """Signed angle from start to end in (-pi, pi]; exact opposites give +pi. `%` keeps the sign of its left side."""
    d = (end - start) % F.lit(_TAU)
    return F.when(d > _PI, d - _TAU).when(d <= -_PI, d + _TAU).otherwise(d)


def polar_lerp(a_re: Column, a_im: Column, b_re: Column, b_im: Column, t: float) -> Column:
    """Arithmetic mean of the magnitudes with the phase of the plain blend, as struct(re, im). Where the blend
    cancels out, the louder side gives the phase (the first one if equal); both silent gives 0."""
    ra, rb = F.hypot(a_re, a_im), F.hypot(b_re, b_im)
    mix_re, mix_im = a_re * (1 - t) + b_re * t, a_im * (1 - t) + b_im * t
    loud = F.when(ra >= rb, F.atan2(a_im, a_re)).otherwise(F.atan2(b_im, b_re))
    theta = F.when(F.hypot(mix_re, mix_im) < MAGNITUDE_FLOOR, loud).otherwise(F.atan2(mix_im, mix_re))
    silent = (ra < MAGNITUDE_FLOOR) & (rb < MAGNITUDE_FLOOR)
    r = F.when(silent, 0.0).otherwise(ra * (1 - t) + rb * t)
    return F.struct((r * F.cos(theta)).alias("re"), (r * F.sin(theta)).alias("im"))


def polar_slerp(a_re: Column, a_im: Column, b_re: Column, b_im: Column, t: float) -> Column:
    """Geometric mean of the magnitudes along the shorter arc, as struct(re, im). A silent side gives a linear
    magnitude with the other side's phase; exact opposites fall back to the plain blend."""
    ra, rb = F.hypot(a_re, a_im), F.hypot(b_re, b_im)
    ta, tb = F.atan2(a_im, a_re), F.atan2(b_im, b_re)
    arc = shortest_arc(ta, tb)
    quiet_a, quiet_b = ra < MAGNITUDE_FLOOR, rb < MAGNITUDE_FLOOR
    opposite = F.abs(F.abs(arc) - _PI) < ANTIPODE_EPS
    line = ra * (1 - t) + rb * t
    geo = F.exp(F.log(ra) * (1 - t) + F.log(rb) * t)
    r = F.when(quiet_a & quiet_b, 0.0).when(quiet_a | quiet_b, line).otherwise(geo)
    theta = F.when(quiet_a, tb).when(quiet_b, ta).otherwise(ta + arc * t)
    flat = opposite & ~quiet_a & ~quiet_b
    re = F.when(flat, a_re * (1 - t) + b_re * t).otherwise(r * F.cos(theta))
    im = F.when(flat, a_im * (1 - t) + b_im * t).otherwise(r * F.sin(theta))
    return F.struct(re.alias("re"), im.alias("im"))


def geomean(m: Column) -> Column:
    """Aggregate: exp of the mean log of the magnitudes (floored); nothing gives 0, one value gives itself."""
    logs = F.exp(F.avg(F.log(F.greatest(m, F.lit(MAGNITUDE_FLOOR)))))
    return F.when(F.count(m) == 0, 0.0).when(F.count(m) == 1, F.max(m)).otherwise(logs)


def circular_mean(theta: Column) -> tuple[Column, Column]:
    """Aggregates: mean direction and resultant length (0..1)."""
    s, c = F.sum(F.sin(theta)), F.sum(F.cos(theta))
    return F.atan2(s, c), F.hypot(s, c) / F.count(theta)
