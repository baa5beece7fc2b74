"""Per-signal statistics over the long form `signal_id, channel, n, x`. All are algebraic, so Spark combines them
map-side and a hot signal costs one partial row per input partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigframe.plans.blocked import BLOCK, block_of

KEYS = ("signal_id", "channel")
MIN_RMS = 1e-10
MIN_ENVELOPE_PEAK = 1e-6


def lengths(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Frames per key: last position + 1."""
    return df.groupBy(*keys).agg((F.max("n") + 1).alias("frames"))


def attach_by_block(
    df: DataFrame, per_key: DataFrame, keys: Sequence[str] = KEYS, n: str = "n", size: int = BLOCK
) -> DataFrame:
    """Join one row per key (it must hold `frames`) to the samples. The small side is expanded to one row per
    block, so a hot key is spread over its blocks instead of meeting in one task."""
    last = F.floor((F.col("frames") - 1) / F.lit(size)).cast("long")
    wide = per_key.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return df.withColumn("_block", block_of(n, size)).join(wide, [*keys, "_block"]).drop("_block")


def peak(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest |x| and whether the signal is silent."""
    return df.groupBy(*keys).agg(F.max(F.abs("x")).alias("peak")).withColumn("silent", F.coalesce(F.col("peak") == 0, F.lit(True)))


def rms(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def normalise_rms(df: DataFrame, target: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Scale each signal to the target RMS; signals at or below 1e-10 are left alone."""
    stat = df.groupBy(*keys).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("_rms"), (F.max("n") + 1).alias("frames"))
    gain = F.when(F.col("_rms") > MIN_RMS, F.lit(target) / F.col("_rms")).otherwise(1.0)
    return attach_by_block(df, stat, keys).withColumn("x", F.col("x") * gain).drop("_rms", "frames")


def normalise_peak(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Scale each signal so that its largest |x| is 1; silent signals are left alone."""
    stat = df.groupBy(*keys).agg(F.max(F.abs("x")).alias("_peak"), (F.max("n") + 1).alias("frames"))
    gain = F.when(F.col("_peak") > 0, 1 / F.col("_peak")).otherwise(1.0)
    return attach_by_block(df, stat, keys).withColumn("x", F.col("x") * gain).drop("_peak", "frames")


def dc_offset(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("x").alias("sum_x"), F.avg("x").alias("dc"))


def remove_dc(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Subtract the mean, then normalise to peak 1. The peak after the shift follows from min and max."""
    stat = df.groupBy(*keys).agg(
        F.avg("x").alias("_dc"), F.min("x").alias("_lo"), F.max("x").alias("_hi"), (F.max("n") + 1).alias("frames")
    )
    top = F.greatest(F.abs(F.col("_hi") - F.col("_dc")), F.abs(F.col("_lo") - F.col("_dc")))
    moved = F.col("x") - F.col("_dc")
    return (
        attach_by_block(df, stat, keys)
        .withColumn("x", F.when(top > 0, moved / top).otherwise(moved))
        .drop("_dc", "_lo", "_hi", "frames")
    )


def min_max(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"))


def signal_stats(x: Column) -> Column:
    """All of peak, rms, mean, sum, min, max as one struct of built-in aggregates."""
    return F.struct(
        F.max(F.abs(x)).alias("peak"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.avg(x).alias("mean"),
        F.sum(x).alias("sum"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.count(x).alias("samples"),
    )


def clip_count(df: DataFrame, limit: float, signal: str = "signal_id") -> DataFrame:
    """Frames with any channel beyond `limit`."""
    frame = df.groupBy(signal, "n").agg(F.bool_or(F.abs("x") > limit).alias("_clipped"))
    return frame.groupBy(signal).agg(F.sum(F.col("_clipped").cast("long")).alias("clips"), F.count(F.lit(1)).alias("frames"))


def rms_envelope(df: DataFrame, points: int, signal: str = "signal_id") -> DataFrame:
    """RMS of the mono mix in at most `points` windows, scaled so that the loudest is 1 (if above 1e-6)."""
    mono = df.groupBy(signal, "n").agg(F.avg("x").alias("x"))
    size = lengths(df, [signal])
    framed = attach_by_block(mono, size, [signal])
    goal = F.least(F.col("frames"), F.lit(points))
    width = F.greatest(F.expr(f"frames div least(frames, {int(points)}L)"), F.lit(1))
    win = (
        framed.withColumn("_goal", goal)
        .withColumn("win", F.floor(F.col("n") / width).cast("long"))
        .filter(F.col("win") < F.col("_goal"))
        .groupBy(signal, "win")
        .agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("level"))
    )
    top = F.max("level").over(W.partitionBy(signal))  # at most `points` rows per signal
    return win.withColumn("level", F.when(top > MIN_ENVELOPE_PEAK, F.col("level") / top).otherwise(F.col("level")))


def topk_per_group(df: DataFrame, keys: Sequence[str], value: str, k: int, tie: str) -> DataFrame:
    """The `k` largest rows per key; ties go to the smaller `tie`. Spark trims each input partition to k rows per
    key before the shuffle (window group limit)."""
    w = W.partitionBy(*keys).orderBy(F.desc(value), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
