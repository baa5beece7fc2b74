"""Sample value conversions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sample formats and their width in bits.
INT_BITS = {"u8": 8, "i8": 8, "i16": 16, "i24": 24, "i32": 32, "i64": 64}
FLOATS = ("f32", "f64")


def clip(c: Column, limit: float = 1.0) -> Column:
    """Limit to [-limit, limit]."""
    return F.least(F.greatest(c, F.lit(-limit)), F.lit(limit))


def _float_to_int(c: Column, bits: int) -> Column:
    """Clamp to +-1, scale by 2^(bits-1), round half away from zero, saturate."""
    top = 1 << (bits - 1)
    scaled = F.round(clip(c.cast("double")) * F.lit(float(top)))
    if bits < 64:
        return F.least(scaled, F.lit(float(top - 1))).cast("long")
    return F.when(scaled >= F.lit(float(top)), F.lit(top - 1)).otherwise(scaled.cast("long"))


def pcm_convert(c: Column, src: str, dst: str) -> Column:
    """Convert between sample formats. Integers come and go as LONG; u8 is 0..255 with 128 as zero."""
    for f in (src, dst):
        if f not in INT_BITS and f not in FLOATS:
            raise ValueError(f"unknown sample format {f}")
    if src in FLOATS:
        if dst in FLOATS:
            return c.cast("float" if dst == "f32" else "double")
        v = _float_to_int(c, INT_BITS[dst])
        return v + 128 if dst == "u8" else v
    signed = c.cast("long") - 128 if src == "u8" else c.cast("long")
    bits = INT_BITS[src]
    if dst in FLOATS:
        v = signed.cast("double") / F.lit(float(1 << (bits - 1)))
        return v.cast("float") if dst == "f32" else v
    to = INT_BITS[dst]
    if to >= bits:
        v = F.shiftleft(signed, to - bits)
    else:
        v = F.shiftright(signed, bits - to)
    return v + 128 if dst == "u8" else v


def bit_crush(c: Column, bits: int, precision: int = 28) -> Column:
    """Keep the top `bits` of a `precision`-bit integer by masking the low ones; bits out of range: unchanged."""
    if bits <= 0 or bits > precision:
        return c
    return c.bitwiseAND(F.lit(~((1 << (precision - bits)) - 1)))


def scale(c: Column, gain: float | Column) -> Column:
    return c * gain


def scale_and_clamp(c: Column, gain: float | Column, limit: float = 1.0) -> Column:
    return clip(c * gain, limit)


def ulaw_decode(code: Column) -> Column:
    """mu-law byte (0..255) to a 16-bit value, in closed form."""
    u = F.lit(255) - code
    step = F.shiftright(u, 4).bitwiseAND(F.lit(7))
    mag = (u.bitwiseAND(F.lit(15)) * 8 + 132) * F.pow(F.lit(2), step).cast("long") - 132
    return F.when(u >= 128, -mag).otherwise(mag).cast("long")


def alaw_decode(code: Column) -> Column:
    """A-law byte (0..255) to a 16-bit value, in closed form."""
    a = code.bitwiseXOR(F.lit(85))
    step = F.shiftright(a, 4).bitwiseAND(F.lit(7))
    base = a.bitwiseAND(F.lit(15)) * 16 + 8
    mag = F.when(step == 0, base).otherwise((base + 256) * F.pow(F.lit(2), F.greatest(step - 1, F.lit(0))).cast("long"))
    return F.when(a >= 128, mag).otherwise(-mag).cast("long")


def _top_bit(c: Column) -> Column:
    """Index of the highest set bit of a positive integer."""
    return F.length(F.bin(c)) - 1


def ulaw_encode(sample: Column) -> Column:
    """16-bit value to mu-law byte."""
    s = sample.cast("long")
    x = F.least(F.abs(s) + 132, F.lit(32767))
    step = F.greatest(_top_bit(x) - 7, F.lit(0))
    mant = F.floor(x / F.pow(F.lit(2), step + 3)).cast("long").bitwiseAND(F.lit(15))
    sign = F.when(s < 0, F.lit(128)).otherwise(F.lit(0))
    return (F.lit(255) - (sign + step * 16 + mant)).cast("long")


def alaw_encode(sample: Column) -> Column:
    """16-bit value to A-law byte."""
    s = F.greatest(F.least(sample.cast("long"), F.lit(32767)), F.lit(-32767))
    x = F.abs(s)
    step = F.greatest(_top_bit(F.greatest(x, F.lit(1))) - 7, F.lit(0))
    mant = F.floor(x / F.pow(F.lit(2), F.greatest(step + 3, F.lit(4)))).cast("long").bitwiseAND(F.lit(15))
    sign = F.when(s < 0, F.lit(0)).otherwise(F.lit(128))
    return (sign + step * 16 + mant).bitwiseXOR(F.lit(85)).cast("long")
