"""Catalogue work: deduplication, signatures, outcome reports, eligibility and numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.plans.blocked import dense_index, shifted

OUTPUT_RATE = 48000  # fixed value: output rate of the enhancement engines
CHECKPOINT_RATES = [8000, 12000, 16000, 24000]  # fixed values
ALIGN_SAMPLES = 245760  # fixed value: 5.12 s at 48 kHz
BATCH = 5  # fixed value: items per batch


def dedupe_identical(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Each row's representative: the smallest key with the same payload (`key, keep, copies`). Copies are found
    by SHA-256 and length; the count and minimum are combined before the shuffle, so a huge group of copies
    costs one row per task."""
    sig = [F.sha2(payload, 256).alias("_h"), F.length(payload).alias("_n")]
    tagged = df.select(key, *sig)
    groups = tagged.groupBy("_h", "_n").agg(F.min(key).alias("keep"), F.count(F.lit(1)).alias("copies"))
    return tagged.join(groups, ["_h", "_n"]).select(key, "keep", "copies")


def tree_signature(leaves: DataFrame, group: str, path: Column, content: Column) -> DataFrame:
    """One hash per group over all (path, content), independent of row order. Leaf hashes are gathered in a tree
    keyed by the leading hex digits of the path's hash (6, then 3, then none), so that no list grows with the
    group: at most 4096 children per inner node."""
    spot = F.sha2(path, 256)
    rows = leaves.select(group, spot.alias("_spot"), F.sha2(F.concat_ws("\n", spot, F.sha2(content, 256)), 256).alias("_hash"))
    for digits in (6, 3, 0):
        node = F.substring("_spot", 1, digits) if digits else F.lit("")
        rows = rows.groupBy(group, node.alias("_node")).agg(
            F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_spot", "_hash"))), lambda s: s["_hash"])), 256).alias("_hash"),
            F.count(F.lit(1)).alias("_n"),
        ).select(group, F.col("_node").alias("_spot"), "_hash")
    return rows.select(group, F.col("_hash").alias("signature"))


def batch_outcome(df: DataFrame, engine: str, ok: Column) -> DataFrame:
    """Counts per engine and the two verdicts: `strict` fails on any failure, `lenient` only if nothing succeeded."""
    out = df.groupBy(engine).agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    return out.withColumns({"strict_ok": F.col("failed") == 0, "lenient_ok": (F.col("succeeded") > 0) | (F.col("failed") == 0)})


def verify_summary(df: DataFrame, stored: Column, content: Column) -> DataFrame:
    """Counts of match, mismatch, none (no stored digest) and error (no content)."""
    verdict = F.when(content.isNull(), "error").when(stored.isNull(), "none").when(stored == F.md5(content), "match").otherwise("mismatch")
    return df.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("files"))


def concat_check(parts: DataFrame, keys: Sequence[str], params: Sequence[str], total: str) -> DataFrame:
    """Can the parts of each key be joined? All parameters must agree; the total is NULL if any part's is."""
    p = F.struct(*params)
    return parts.groupBy(*keys).agg(
        (F.min(p) == F.max(p)).alias("consistent"),
        F.when(F.count(total) == F.count(F.lit(1)), F.sum(total)).alias("total"),
    )


def supports_rate(rate: Column, output_rate: int | Column = OUTPUT_RATE) -> Column:
    return rate < output_rate


def pick_checkpoint_rate(rate: Column, rates: Sequence[int] = CHECKPOINT_RATES) -> Column:
    """Largest rate not above the given one, else the smallest."""
    best = F.lit(min(rates))
    for r in sorted(rates):
        best = F.when(rate >= r, r).otherwise(best)
    return best


def pad_to_alignment(samples: Column, align: int = ALIGN_SAMPLES) -> Column:
    """Length rounded up to a whole number of alignment units; exact multiples stay."""
    return (F.floor((samples + (align - 1)) / align) * align).cast("long")


def clamp_cutoff(cutoff: Column, rate: Column) -> Column:
    """max(20, min(cutoff, 95 % of Nyquist))."""
    return F.greatest(F.lit(20.0), F.least(cutoff, rate * 0.5 * 0.95))


def clamp_cutoff_8k(cutoff: Column) -> Column:
    return F.least(cutoff, F.lit(8000.0))


def sample_flags(length: Column, loop_end: Column, loop_start: Column, sustain_end: Column, sustain_start: Column,
                 loop: Column, sustain: Column, pingpong: Column, bits: Column, channels: Column) -> dict[str, Column]:
    """Loop flags hold only for non-empty loops inside the sample; bytes per frame from width and channels."""
    has_loop = loop & (loop_end > loop_start) & (loop_end <= length)
    has_sustain = sustain & (sustain_end > sustain_start) & (sustain_end <= length)
    return {
        "has_loop": has_loop,
        "has_sustain": has_sustain,
        "has_pingpong": has_loop & pingpong,
        "bytes_per_frame": F.floor(bits / 8).cast("long") * channels,
    }


def validate_stream_header(rate: Column, channels: Column, bits: Column, block: Column, want: dict[str, Column]) -> Column:
    """Array of reject codes for a frame header, alone and against the stream's parameters `want`
    (rate, channels, bits, max_block)."""
    return F.array_compact(
        F.array(
            F.when((rate <= 0) | (rate > 655350), "InvalidSampleRate"),
            F.when(rate != want["rate"], "SampleRateMismatch"),
            F.when(channels > 8, "ExcessiveChannels"),
            F.when(channels != want["channels"], "ChannelsMismatch"),
            F.when((bits < 4) | (bits > 32), "InvalidBitsPerSample"),
            F.when(bits != want["bits"], "BitsPerSampleMismatch"),
            F.when(block < 1, "InvalidBlockSize"),
            F.when(block > want["max_block"], "BlockSizeMismatch"),
        )
    )


def sort_ci(df: DataFrame, name: str, path: str) -> DataFrame:
    """Case-insensitive order by name, ties by path; a range-partitioned sort."""
    return df.orderBy(F.lower(name), path)


def stable_order(df: DataFrame, controller: str, ord: str) -> DataFrame:
    return df.orderBy(controller, ord)


def batch_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None, size: int = BATCH) -> DataFrame:
    """Number fixed-size batches along an order."""
    out = dense_index(df, keys, order, bucket, out="_i")
    return out.withColumn("batch", F.floor(F.col("_i") / size).cast("long")).drop("_i")


def frame_sizes(frames: DataFrame, key: str, length: str) -> DataFrame:
    """Bytes to the next frame; the last frame ends with the file; before a failed frame the size is 0."""
    nxt = shifted(frames, [key], "n", {"_next": ("offset", 1), "_ok": ("ok", 1)})
    size = F.when(F.col("_next").isNull(), F.col(length) - F.col("offset")).when(~F.col("_ok"), 0).otherwise(F.col("_next") - F.col("offset"))
    return nxt.filter("ok").withColumn("size", size.cast("long")).drop("_next", "_ok")


def merge_history(a: DataFrame, b: DataFrame, order: Sequence[str]) -> DataFrame:
    """Both histories, equal entries once, sorted."""
    return a.unionByName(b).distinct().orderBy(*order)
