"""File listing, classification, guards, header probing and the sinks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sigframe.functions.text import decode_int
from sigframe.plans.blocked import BLOCK, block_of

# File extensions of modules and archives.
MODULE_EXTENSIONS = (
    "mod s3m xm it mptm stm nst m15 stk wow ult 669 mtm med far mdl ams dsm amf okt dmf ptm psm mt2 dbm digi imf j2b "
    "gdm umx plm mo3 xpk ppm mmcmp"
).split()
ARCHIVE_EXTENSIONS = "zip 7z rar tar gz tgz bz2 tbz2 xz txz zst lha lzh cab iso".split()
DOUBLE_SUFFIXES = [".tar.gz", ".tar.bz2", ".tar.xz", ".tar.zst"]
MAX_BYTES = 128 * 1024 * 1024  # fixed value: inclusive size limit
MAX_ENTRIES = 2048  # fixed value: candidates per archive


def scan_files(spark: SparkSession, root: str, glob: str = "*", recurse: bool = True) -> DataFrame:
    """One row per file: path, length, modificationTime. The content column is never read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    return reader.option("recursiveFileLookup", str(recurse).lower()).load(root).select("path", "length", "modificationTime")


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([^.]*)$", 1)


def classify_path(path: Column) -> Column:
    """module, archive or other, by the last suffix (or one of the double suffixes)."""
    ext = extension(path)
    doubled = F.lit(False)
    for s in DOUBLE_SUFFIXES:
        doubled = doubled | path.endswith(s)
    return F.when(ext.isin(MODULE_EXTENSIONS), "module").when(ext.isin(ARCHIVE_EXTENSIONS) | doubled, "archive").otherwise("other")


def size_guard(df: DataFrame, size: str, limit: int = MAX_BYTES) -> DataFrame:
    """Add `accepted` and `reason`; exactly the limit still passes."""
    over = F.col(size) > limit
    why = F.concat(F.col(size).cast("string"), F.lit(f" bytes exceeds the {limit} byte safety limit"))
    return df.withColumns({"accepted": ~over, "reason": F.when(over, why)})


def archive_candidates(entries: DataFrame, cap: int = MAX_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(`archive, path, filename, rank`, rejected `archive, candidates`). Only module files count; an archive with
    more than `cap` of them is refused as a whole. Ranks are by lower-cased file name, ties by path; the ranking
    window holds at most `cap` rows because refused archives are dropped before it."""
    cand = entries.filter(classify_path(F.col("path")) == "module")
    counts = cand.groupBy("archive").agg(F.count(F.lit(1)).alias("candidates"))
    kept = cand.join(counts.filter(F.col("candidates") <= cap).select("archive"), "archive", "left_semi")
    name = F.element_at(F.split("path", "/"), -1)
    w = W.partitionBy("archive").orderBy(F.lower("filename"), "path")
    ranked = kept.select("archive", "path", name.alias("filename")).withColumn("rank", F.row_number().over(w))
    return ranked, counts.filter(F.col("candidates") > cap)


@dataclass(frozen=True)
class Field:
    """One header field; kind is text (NUL- and space-trimmed), le or be."""

    name: str
    offset: int
    width: int
    kind: str


# The scalar fields of four module headers.
IT_HEADER = [
    Field("magic", 0, 4, "text"),
    Field("name", 4, 26, "text"),
    Field("orders", 32, 2, "le"),
    Field("instruments", 34, 2, "le"),
    Field("samples", 36, 2, "le"),
    Field("patterns", 38, 2, "le"),
    Field("made_with", 40, 2, "le"),
    Field("speed", 50, 1, "le"),
    Field("tempo", 51, 1, "le"),
]
S3M_HEADER = [
    Field("name", 0, 28, "text"),
    Field("kind", 29, 1, "le"),
    Field("orders", 32, 2, "le"),
    Field("samples", 34, 2, "le"),
    Field("patterns", 36, 2, "le"),
    Field("flags", 38, 2, "le"),
    Field("made_with", 40, 2, "le"),
    Field("version", 42, 2, "le"),
    Field("magic", 44, 4, "text"),
    Field("volume", 48, 1, "le"),
    Field("speed", 49, 1, "le"),
    Field("tempo", 50, 1, "le"),
    Field("master", 51, 1, "le"),
    Field("panning", 53, 1, "le"),
]
IMF_HEADER = [
    Field("name", 0, 32, "text"),
    Field("orders", 32, 2, "le"),
    Field("patterns", 34, 2, "le"),
    Field("instruments", 36, 2, "le"),
    Field("flags", 38, 2, "le"),
    Field("speed", 48, 1, "le"),
    Field("tempo", 49, 1, "le"),
    Field("master", 50, 1, "le"),
    Field("amplification", 51, 1, "le"),
    Field("magic", 60, 4, "text"),
]
XM_HEADER = [
    Field("magic", 0, 17, "text"),
    Field("name", 17, 20, "text"),
    Field("tool", 38, 20, "text"),
    Field("version", 58, 2, "le"),
    Field("size", 60, 4, "le"),
    Field("orders", 64, 2, "le"),
    Field("channels", 68, 2, "le"),
    Field("patterns", 70, 2, "le"),
    Field("instruments", 72, 2, "le"),
    Field("speed", 76, 2, "le"),
    Field("tempo", 78, 2, "le"),
]


def decode_header(content: Column, layout: Sequence[Field]) -> list[Column]:
    """Typed columns of a fixed layout; NULL where the content is too short."""
    out = []
    for f in layout:
        fits = F.octet_length(content) >= f.offset + f.width
        if f.kind == "text":
            raw = F.decode(F.substring(content, f.offset + 1, f.width), "ISO-8859-1")
            value = F.regexp_replace(raw, "[\x00 ]+$", "")
        else:
            value = decode_int(content, f.offset, f.width, "little" if f.kind == "le" else "big")
        out.append(F.when(fits, value).alias(f.name))
    return out


def decode_headers(spark: SparkSession, root: str, layout: Sequence[Field], limit: int = MAX_BYTES) -> DataFrame:
    """`path, error` and the layout's columns for every file below `root`, from as many bytes of each as the layout reaches. Files over the size limit
    are not opened; they and unreadable ones give a row with an error."""
    from sigframe.sources.probing import heads

    files = scan_files(spark, root)
    small = heads(files.filter(F.col("length") <= limit), max(f.offset + f.width for f in layout)).select("path", "error", *decode_header(F.col("head"), layout))
    large = files.filter(F.col("length") > limit).select("path", F.concat(F.col("length"), F.lit(f" bytes exceeds the {limit} byte safety limit")).alias("error"))
    return small.unionByName(large, allowMissingColumns=True)


MANIFEST = T.StructType(
    [
        T.StructField(
            "items",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("stem", T.StringType()),
                        T.StructField("conditioning_wav_path", T.StringType()),
                        T.StructField("conditioning_rate_hz", T.LongType()),
                        T.StructField("conditioning_lowpass_hz", T.DoubleType()),
                        T.StructField("original_rate_hz", T.LongType()),
                    ]
                )
            ),
        )
    ]
)


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per job item of JSON manifest files: a manifest per file, or with `lines` one per line."""
    return spark.read.schema(MANIFEST).json(path, multiLine=not lines).select(F.inline("items"))


def parse_manifest(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """The same for manifests held in a string column."""
    return df.select(*keep, F.from_json(column, MANIFEST).alias("_m")).select(*keep, F.inline("_m.items"))


def collect_outputs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Match outputs to jobs: the file name is the stem, then `_` or `.`, and ends in `.wav`; the smallest path wins,
    a job without output gets an error. Each file offers every prefix that ends before `_` or `.` as a stem, so the
    match is an equi join."""
    name = F.element_at(F.split("path", "/"), -1)
    cuts = F.filter(F.sequence(F.lit(1), F.length("_name")), lambda i: F.substr(F.col("_name"), i, F.lit(1)).isin("_", "."))
    stems = F.transform(cuts, lambda i: F.substr(F.col("_name"), F.lit(1), i - 1))
    offers = (
        files.withColumn("_name", name)
        .filter(F.col("_name").endswith(".wav"))
        .select("path", F.explode(F.array_distinct(stems)).alias("stem"))
        .groupBy("stem")
        .agg(F.min("path").alias("path"))
    )
    error = F.when(F.col("path").isNull(), F.concat(F.lit("no output for "), F.col("stem")))
    return jobs.join(offers, "stem", "left").withColumn("error", error)


def write_trace_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", "true").csv(path)


def write_blocks(df: DataFrame, path: str, buckets: int = 16, size: int = BLOCK) -> None:
    """Parquet, partitioned by a hash bucket of the signal. Rows are spread over tasks by (signal, block), so a hot
    signal is written by many tasks, and sorted inside each file."""
    (
        df.withColumn("_block", block_of("n", size))
        .withColumn("bucket", F.pmod(F.xxhash64("signal_id"), F.lit(buckets)))
        .repartition("bucket", "signal_id", "_block")
        .sortWithinPartitions("bucket", "signal_id", "n")
        .drop("_block")
        .write.partitionBy("bucket")
        .parquet(path)
    )


BACKUP_NAME = r"^(.*)\.AutoSave\.(\d{8})\.(\d{6})\.([^.]*)$"  # fixed format


def parse_backup_name(name: Column) -> dict[str, Column]:
    """Base, time stamp and extension of `{base}.AutoSave.YYYYMMDD.HHMMSS.{ext}`; NULLs where the name is another."""
    ok = name.rlike(BACKUP_NAME)
    stamp = F.concat(F.regexp_extract(name, BACKUP_NAME, 2), F.regexp_extract(name, BACKUP_NAME, 3))
    return {
        "base": F.when(ok, F.regexp_extract(name, BACKUP_NAME, 1)),
        "saved_at": F.when(ok, F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss"))),
        "ext": F.when(ok, F.regexp_extract(name, BACKUP_NAME, 4)),
    }


def retention(backups: DataFrame, keep: int, max_age_seconds: int, now: Column) -> DataFrame:
    """`keep_it`: among the newest `keep` of its base and younger than the limit. Spark prunes the ranking to `keep`
    rows per base and task before the shuffle; the other rows are joined back by their identity."""
    w = W.partitionBy("base").orderBy(F.desc("saved_at"), F.desc("name"))
    newest = backups.select("base", "name", "saved_at").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("saved_at").cast("timestamp"))
    out = backups.join(newest.select("base", "name", F.lit(True).alias("_new")), ["base", "name"], "left")
    return out.withColumn("keep_it", F.coalesce("_new", F.lit(False)) & (age < max_age_seconds)).drop("_new")
