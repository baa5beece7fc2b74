"""Proportional stratified interleaving into shards.

Rows of each source are put in a seeded order (MD5 of seed and id) and get the fractional rank (rank + 1/2) / rows of the source.
Sorted by it, every stretch of the order holds each source in proportion, so equal cuts of the order match the mixture.

Ranks inside a source and positions in the order are made in two steps, a row number inside a bucket and the rows of the buckets
before it. Buckets are ranges of uniform values (the hash, the fractional rank), so a source with a third of all rows is
spread over all buckets like any other. Texts are read once, for size and checksum; only narrow rows are shuffled.

Nulls: a null source is a source of its own, a null id is an empty one, a null text is empty. Rows that agree in id and source are
ordered by size and checksum; beyond that they are alike. Each input row gives one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigframe.session import materialize

SHARDS, SEED, BUCKETS = 24, "42", 1024


def numbered(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """0-based positions along `order` inside `keys`; `bucket` must not decrease along `order`."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offset = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_bucket") == F.col("_b")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return (
        rows.withColumn("_local", F.row_number().over(inside).cast("long") - 1)
        .join(offset, on)
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_bucket", "_b", "_before", "_local", *[f"_{k}" for k in keys])
    )


def interleave(
    docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, source, size (UTF-8 bytes + 8), text_crc32, shard, slot (gapless from 0 in a shard).
    Row counts of shards differ by one at most."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), "UTF-8")).alias("order"),
    )
    narrow = materialize(narrow, "narrow")
    per = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "_s")
    bucket = F.floor(F.conv(F.substring("order", 1, 6), 16, 10).cast("long") * BUCKETS / F.lit(1 << 24)).cast("int")
    ranked = numbered(narrow, ["source"], bucket, ["order", "doc_id", "size", "text_crc32"], "rank")
    ranked = ranked.join(per, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = ranked.withColumn("part", (F.col("rank") + F.lit(0.5)) / F.col("n")).drop("rank", "n")
    ordered = numbered(placed, [], F.floor(F.col("part") * BUCKETS).cast("int"), ["part", "source", "order", "doc_id", "size", "text_crc32"], "place")
    total = narrow.agg(F.count(F.lit(1)).alias("total")).scalar()
    return (
        ordered.withColumn("total", total)
        .withColumn("shard", F.expr(f"cast(place * {shards} div total as int)"))
        .withColumn("slot", F.expr(f"place - (cast(shard as long) * total + {shards - 1}) div {shards}"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )
