"""Pitch, cutoff and time conversions as Column expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_RATE = 8363  # fixed value: rate assumed where none is given
CUE_FRAMES_PER_SECOND = 75  # fixed value


def note_to_freq(note: Column, reference: float = 440.0) -> Column:
    """Equal temperament around the reference pitch (note 69)."""
    return F.lit(reference) * F.pow(F.lit(2.0), (note - 69.0) / 12.0)


def freq_to_note(freq: Column, reference: float = 440.0) -> Column:
    return F.log2(freq / F.lit(reference / 2.0)) * 12.0 + 57.0


def cutoff_to_freq(cutoff: Column, modifier: Column | int, rate: float, extended: bool = False) -> Column:
    """Filter cutoff 0..127 with envelope modifier -256..256 to Hz, within 120..20000 and below half the rate."""
    span = (20.0 if extended else 24.0) * 512.0
    m = F.lit(modifier) if isinstance(modifier, int) else modifier
    hz = F.lit(110.0) * F.pow(F.lit(2.0), F.lit(0.25) + cutoff * (m + 256) / span)
    return F.least(F.greatest(hz, F.lit(120.0)), F.lit(20000.0), F.lit(rate * 0.5))


def freq_to_cutoff(freq: Column, extended: bool = False) -> Column:
    """Inverse of the above with a neutral modifier, rounded into 0..127."""
    span = 20.0 if extended else 24.0
    raw = (F.log2(freq / 110.0) - 0.25) * span
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(127.0))).cast("long")


def samples_to_ms(samples: Column, rate: Column) -> Column:
    """Milliseconds; a rate of 0 counts as 8363."""
    return samples * 1000.0 / F.when(rate <= 0, F.lit(DEFAULT_RATE)).otherwise(rate)


def cue_to_samples(minutes: Column, seconds: Column, frames: Column, rate: int = 44100) -> Column:
    """MM:SS:FF to samples; 75 frames make one second."""
    total = (minutes * 60 + seconds) * CUE_FRAMES_PER_SECOND + frames
    return F.floor(total * rate / CUE_FRAMES_PER_SECOND).cast("long")


def stretch_ratio(samples: Column, rate: Column, percent: float, row_ms: Column) -> dict[str, Column]:
    """Original and new length in milliseconds, samples and rows for a stretch in percent."""
    ms = samples_to_ms(samples, rate)
    return {
        "ms": ms,
        "new_ms": ms * percent / 100.0,
        "new_samples": F.round(samples * percent / 100.0).cast("long"),
        "rows": ms / row_ms,
        "new_rows": ms / row_ms * percent / 100.0,
    }


def format_clock(seconds: Column) -> Column:
    """`MM:SS`; negative times show as 00:00."""
    total = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.format_string("%02d:%02d", F.floor(total / 60), total % 60)


def format_position(order: Column, row: Column) -> Column:
    return F.format_string("Ord:%03d Row:%03d", order, row)


