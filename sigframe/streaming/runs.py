"""Running a streaming plan to the end of its input and reading the result back.

Sinks and checkpoints live in the session's shared folder. `available_now` is for bounded replays and tests; a live
deployment starts the same plan with its own trigger and sink.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.session import materialize, shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store, which also keeps state off the heap. Changes are committed as logs instead of whole files, and
    rows are not counted, which would cost a lookup for each write."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")


FILE_ROWS = 1_000_000


def stage(df: DataFrame, slice_of: Column | str, label: str = "stage") -> tuple[str, int]:
    """Write the rows of each value of `slice_of`, in ascending order, to one folder, so that a file stream replays the slices
    in that order. The input is read once. Every slice gets the same number of files, about `FILE_ROWS` rows each in the
    largest (empty files fill up a small one); returns the folder and that number, to be used as the files per
    micro-batch. Rows without a slice come last."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    cut = materialize(df.withColumn("_slice", F.expr(slice_of) if isinstance(slice_of, str) else slice_of), label)
    sizes = sorted(((r["_slice"] is None, r["_slice"]), r["n"]) for r in cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect())
    files = max((-(-n // FILE_ROWS) for _, n in sizes), default=1)
    for (_, value), n in sizes:
        some = cut.filter(F.col("_slice").eqNullSafe(F.lit(value))).drop("_slice")
        full = -(-n // FILE_ROWS)
        some.repartition(full).write.mode("append").parquet(path)
        for _ in range(files - full):
            some.limit(0).coalesce(1).write.mode("append").parquet(path)
    if not sizes:
        cut.drop("_slice").write.parquet(path)
    return path, files


def replay(spark: SparkSession, path: str, schema, files_per_batch: int = 1, **options: str) -> DataFrame:
    """A file stream. `files_per_batch` (or `maxBytesPerTrigger`) bounds a micro-batch, and with it the rows of one
    key that a stateful step sorts at a time."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    for k, val in options.items():
        reader = reader.option(k, val)
    return reader.parquet(path)


def append_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode plan over all available input into parquet and read it back."""
    spark = stream.sparkSession
    path, state = shared_path(spark, label), shared_path(spark, f"{label}-checkpoint")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def update_to_table(stream: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Run an update-mode plan: every micro-batch's changed rows are written under its batch number (rewritten if the
    batch is retried), and the table read back holds the latest row per key."""
    spark = stream.sparkSession
    path, state = shared_path(spark, label), shared_path(spark, f"{label}-checkpoint")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])
