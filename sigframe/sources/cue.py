"""Cue sheets in a string column: tracks, index points, and the rules a sheet must follow.

A sheet is one row of text, so the windows below are bounded by the size of a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigframe.functions.pitch import CUE_FRAMES_PER_SECOND

INDEX = r"^INDEX\s+(\d{2})\s+(\d+):(\d{2}):(\d{2})$"
TRACK = r"^TRACK\s+(\d{1,2})\s+(\S+)$"
ISRC = r"^[A-Za-z]{2}-?[A-Za-z0-9]{3}-?\d{2}-?\d{5}$"
CATALOG = r"^\d{13}$"


def cue_lines(sheets: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-empty line with its command word and the track it belongs to (0 before the first)."""
    by_line = W.partitionBy("id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    lines = (
        sheets.select("id", F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line", "raw"))
        .withColumn("raw", F.trim("raw"))
        .filter("raw <> ''")
        .withColumn("word", F.upper(F.regexp_extract("raw", r"^(\S+)", 1)))
    )
    return lines.withColumn("track_no", F.sum(F.when(F.col("word") == "TRACK", 1).otherwise(0)).over(by_line))


def _number(pattern: str, group: int) -> Column:
    return F.expr(f"try_cast(regexp_extract(raw, r'{pattern}', {group}) AS BIGINT)")


def index_frame() -> Column:
    """Position of an INDEX line in 1/75 s; NULL if malformed (seconds under 60, frames under 75)."""
    mm, ss, ff = _number(INDEX, 2), _number(INDEX, 3), _number(INDEX, 4)
    good = F.col("raw").rlike(INDEX) & (ss < 60) & (ff < CUE_FRAMES_PER_SECOND)
    return F.when(good, (mm * 60 + ss) * CUE_FRAMES_PER_SECOND + ff)


def read_cue(sheets: DataFrame, text: str = "text", rate: int = 44100) -> DataFrame:
    """Index points: `id, track, index, frame, sample`, the track number carried forward from its TRACK line (NULL behind a malformed one)."""
    by_line = W.partitionBy("id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    lines = cue_lines(sheets, text).withColumn(
        "track", F.last(F.when(F.col("word") == "TRACK", F.struct(_number(TRACK, 1).alias("no"))), ignorenulls=True).over(by_line)["no"]
    )
    points = lines.filter(F.col("word") == "INDEX").select("id", "track", _number(INDEX, 1).alias("index"), index_frame().alias("frame"))
    return points.withColumn("sample", F.floor(F.col("frame") * rate / CUE_FRAMES_PER_SECOND).cast("long"))


def validate_cue(sheets: DataFrame, text: str = "text") -> DataFrame:
    """First error per sheet, or `ok`: `id, status`. The names of the errors are fixed values.

    Catalogue: one line at most, 13 digits. Flags and ISRC belong to a track, once, before its index points; ISRC
    has 12 characters with optional dashes. Index points are well formed, start at 0 or 1 (a track must have
    index 1), go up by one and forward in time; the very first point is at zero. Tracks count up from the first
    one, move forward in time, and each has an index; there is at least one track.
    """
    sheets = sheets.repartition("id")  # sheets are shuffled once, before they are cut into lines; all that follows stays in place
    lines = cue_lines(sheets, text)
    w = W.partitionBy("id").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    in_track = W.partitionBy("id", "track_no").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    word, raw, before_tracks = F.col("word"), F.col("raw"), F.col("track_no") == 0

    def seen(name: str, win) -> Column:
        return F.coalesce(F.count_if(F.col("word") == name).over(win), F.lit(0))

    marks = lines.withColumns(
        {
            "_frame": F.when(word == "INDEX", index_frame()),
            "_index": F.when(word == "INDEX", _number(INDEX, 1)),
            "_track": F.when(word == "TRACK", _number(TRACK, 1)),
        }
    ).withColumns(
        {
            "_catalogs": seen("CATALOG", w),
            "_points": seen("INDEX", w),
            "_t_flags": seen("FLAGS", in_track),
            "_t_isrc": seen("ISRC", in_track),
            "_t_points": seen("INDEX", in_track),
            "_last_frame": F.last("_frame", ignorenulls=True).over(w),
            "_last_index": F.last("_index", ignorenulls=True).over(in_track),
            "_last_track": F.last("_track", ignorenulls=True).over(w),
        }
    )
    value = F.trim(F.regexp_replace(raw, r"^\S+", ""))
    value = F.regexp_replace(value, '"', "")
    error = (
        F.when((word == "CATALOG") & (F.col("_catalogs") > 0), "MultipleCatalogNumber")
        .when((word == "CATALOG") & (value == ""), "CatalogMissingNumber")
        .when((word == "CATALOG") & ~value.rlike(CATALOG), "InvalidCatalogNumber")
        .when((word == "FLAGS") & before_tracks, "PrematureFlags")
        .when((word == "FLAGS") & (F.col("_t_points") > 0), "LateFlags")
        .when((word == "FLAGS") & (F.col("_t_flags") > 0), "MultipleFlags")
        .when((word == "ISRC") & before_tracks, "PrematureISRC")
        .when((word == "ISRC") & (F.col("_t_points") > 0), "LateISRC")
        .when((word == "ISRC") & (F.col("_t_isrc") > 0), "MultipleISRC")
        .when((word == "ISRC") & ~value.rlike(ISRC), "InvalidISRC")
        .when((word == "INDEX") & before_tracks, "PrematureIndex")
        .when((word == "INDEX") & F.col("_frame").isNull(), "InvalidIndexPoint")
        .when((word == "INDEX") & F.col("_last_index").isNull() & (F.col("_index") > 1), "IndexPointsOutOfSequence")
        .when((word == "INDEX") & (F.col("_index") != F.col("_last_index") + 1), "IndexPointsOutOfSequence")
        .when((word == "INDEX") & (F.col("_points") == 0) & (F.col("_frame") != 0), "NonZeroFirstIndex")
        .when(
            (word == "INDEX") & (F.col("_frame") <= F.col("_last_frame")),
            F.when(F.col("_t_points") > 0, "IndexPointsOutOfSequence").otherwise("TracksOutOfSequence"),
        )
        .when((word == "TRACK") & F.col("_track").isNull(), "InvalidTrack")
        .when((word == "TRACK") & (F.col("_track") != F.col("_last_track") + 1), "TracksOutOfSequence")
    )
    per_track = (
        marks.withColumn("error", error)
        .groupBy("id", "track_no")
        .agg(
            F.min(F.when(F.col("error").isNotNull(), F.struct(F.col("line").cast("double").alias("line"), "error"))).alias("_first"),
            F.max("line").alias("line"), F.count("_index").alias("_n"), F.max("_index").alias("_top"),
        )
    )
    at_end = F.when(F.col("_n") == 0, "InvalidTrack").when(F.col("_top") < 1, "IndexPointsOutOfSequence")
    behind = F.when((F.col("track_no") > 0) & at_end.isNotNull(), F.struct((F.col("line") + 0.5).alias("line"), at_end.alias("error")))
    found = per_track.groupBy("id").agg(F.min(F.least("_first", behind))["error"].alias("error"), F.max("track_no").alias("tracks"))
    out = sheets.select("id").join(found, "id", "left")
    none = F.when(F.coalesce("tracks", F.lit(0)) == 0, "NoTracks")
    return out.select("id", F.coalesce("error", none, F.lit("ok")).alias("status"))
