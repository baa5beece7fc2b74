"""Queries over sampled signals: statistics, conversion, element-wise work, click detection and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.catalog.registry import query, r6
from sigframe.functions import pcm
from sigframe.operators import clicks
from sigframe.operators import signal_stats as st
from sigframe.plans import views as v
from sigframe.plans.views import oracle

SIG_KEYS = ["signal_id", "channel"]


@query("peak", "G1", oracle("sig", """SELECT signal_id, channel, round(max(abs(x)), 6) AS peak,
    max(abs(x)) = 0 AS silent FROM sig GROUP BY ALL"""))
def _(spark, d):
    return st.peak(v.sig(spark, d)).withColumn("peak", r6(F.col("peak")))


@query("rms", "G2", oracle("sig", "SELECT signal_id, channel, round(sqrt(avg(x * x)), 6) AS rms FROM sig GROUP BY ALL"))
def _(spark, d):
    return st.rms(v.sig(spark, d)).withColumn("rms", r6(F.col("rms")))


@query("normalise_rms", "G2", oracle("sig", "g AS (SELECT signal_id, sqrt(avg(x * x)) AS r FROM sig GROUP BY 1)",
    """SELECT signal_id, channel, n, round(x * CASE WHEN r > 1e-10 THEN 0.25 / r ELSE 1 END, 6) + 0.0 AS x
    FROM sig JOIN g USING (signal_id)"""))
def _(spark, d):
    return st.normalise_rms(v.sig(spark, d), 0.25).withColumn("x", r6(F.col("x")))


@query("dc_offset", "G3", oracle("sig", """SELECT signal_id, channel, round(sum(x), 6) + 0.0 AS sum_x,
    round(avg(x), 9) + 0.0 AS dc FROM sig GROUP BY ALL"""))
def _(spark, d):
    return st.dc_offset(v.sig(spark, d)).withColumns({"sum_x": r6(F.col("sum_x")), "dc": r6(F.col("dc"), 9)})


@query("remove_dc", "G3", oracle("sig",
    "g AS (SELECT signal_id, avg(x) AS dc FROM sig GROUP BY 1)",
    "m AS (SELECT signal_id, channel, n, x - dc AS y FROM sig JOIN g USING (signal_id))",
    "p AS (SELECT signal_id, max(abs(y)) AS top FROM m GROUP BY 1)",
    """SELECT signal_id, channel, n, round(CASE WHEN top > 0 THEN y / top ELSE y END, 6) + 0.0 AS x
    FROM m JOIN p USING (signal_id)"""))
def _(spark, d):
    return st.remove_dc(v.sig(spark, d)).withColumn("x", r6(F.col("x")))


@query("min_max", "G4", oracle("sig", """SELECT signal_id, channel, round(min(x), 6) + 0.0 AS min_x,
    round(max(x), 6) + 0.0 AS max_x FROM sig GROUP BY ALL"""))
def _(spark, d):
    return st.min_max(v.sig(spark, d)).withColumns({"min_x": r6(F.col("min_x")), "max_x": r6(F.col("max_x"))})


@query("normalise_peak", "G1", oracle("sig", "g AS (SELECT signal_id, max(abs(x)) AS p FROM sig GROUP BY 1)",
    """SELECT signal_id, channel, n, round(CASE WHEN p > 0 THEN x * (1 / p) ELSE x END, 6) + 0.0 AS x
    FROM sig JOIN g USING (signal_id)"""))
def _(spark, d):
    return st.normalise_peak(v.sig(spark, d)).withColumn("x", r6(F.col("x")))


@query("signal_stats", "E4", oracle("siglong", """SELECT signal_id, channel, round(max(abs(x)), 4) AS peak,
    round(sqrt(avg(x * x)), 4) AS rms, round(avg(x), 4) + 0.0 AS mean, round(min(x), 4) AS min_x,
    round(max(x), 4) AS max_x, count(x) AS samples FROM siglong GROUP BY ALL"""))
def _(spark, d):
    s = v.siglong(spark, d).groupBy(*SIG_KEYS).agg(st.signal_stats(F.col("x")).alias("s"))
    return s.select(
        *SIG_KEYS,
        r6(F.col("s.peak"), 4).alias("peak"),
        r6(F.col("s.rms"), 4).alias("rms"),
        r6(F.col("s.mean"), 4).alias("mean"),
        r6(F.col("s.min"), 4).alias("min_x"),
        r6(F.col("s.max"), 4).alias("max_x"),
        F.col("s.samples").alias("samples"),
    )


@query("clip_count", "G9", oracle("stereo", """SELECT signal_id,
    CAST(sum(CASE WHEN greatest(abs(l), abs(r)) > 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS clips,
    count(*) AS frames FROM stereo GROUP BY 1"""))
def _(spark, d):
    s = v.stereo(spark, d)
    long = s.select("signal_id", "n", F.explode(F.array("l", "r")).alias("x"))
    return st.clip_count(long, 0.2)


@query("rms_envelope", "G10", oracle("sig",
    "f AS (SELECT signal_id, max(n) + 1 AS frames FROM sig GROUP BY 1)",
    "w AS (SELECT signal_id, n // greatest(frames // least(frames, 16), 1) AS win, x, least(frames, 16) AS goal FROM sig JOIN f USING (signal_id))",
    "e AS (SELECT signal_id, win, sqrt(avg(x * x)) AS level FROM w WHERE win < goal GROUP BY 1, 2)",
    """SELECT signal_id, win, round(CASE WHEN max(level) OVER (PARTITION BY signal_id) > 1e-6
    THEN level / max(level) OVER (PARTITION BY signal_id) ELSE level END, 6) AS level FROM e"""))
def _(spark, d):
    return st.rms_envelope(v.sig(spark, d), 16).withColumn("level", r6(F.col("level")))


@query("topk_per_group", "K4", oracle("sig",
    "f AS (SELECT signal_id, max(n) + 1 AS frames FROM sig GROUP BY 1)",
    "w AS (SELECT signal_id, n // greatest(frames // least(frames, 16), 1) AS win, x, least(frames, 16) AS goal FROM sig JOIN f USING (signal_id))",
    "e AS (SELECT signal_id, win, round(sqrt(avg(x * x)), 6) AS level FROM w WHERE win < goal GROUP BY 1, 2)",
    "k AS (SELECT signal_id, win, level, row_number() OVER (PARTITION BY signal_id ORDER BY level DESC, win) AS rank FROM e)",
    "SELECT signal_id, win, level, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3"))
def _(spark, d):
    s = v.sig(spark, d)
    mono = st.attach_by_block(s, st.lengths(s, ["signal_id"]), ["signal_id"])
    width = F.expr("greatest(frames div least(frames, 16L), 1)")
    env = (
        mono.withColumn("win", F.floor(F.col("n") / width).cast("long"))
        .filter(F.col("win") < F.least("frames", F.lit(16)))
        .groupBy("signal_id", "win")
        .agg(r6(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("level"))
    )
    return st.topk_per_group(env, ["signal_id"], "level", 3, "win")


@query("pcm_convert", "X1", oracle("sig", """SELECT signal_id, n,
    CAST(least(round(greatest(least(x, 1), -1) * 128), 127) AS BIGINT) AS i8,
    CAST(least(round(greatest(least(x, 1), -1) * 128), 127) AS BIGINT) + 128 AS u8,
    CAST(least(round(greatest(least(x, 1), -1) * 32768), 32767) AS BIGINT) AS i16,
    CAST(least(round(greatest(least(x, 1), -1) * 8388608), 8388607) AS BIGINT) AS i24,
    CAST(least(round(greatest(least(x, 1), -1) * 2147483648), 2147483647) AS BIGINT) AS i32,
    CAST(least(CAST(round(greatest(least(x, 1), -1) * 9223372036854775808.0::DOUBLE) AS HUGEINT), 9223372036854775807) AS BIGINT) AS i64,
    CAST(least(round(greatest(least(x, 1), -1) * 32768), 32767) AS BIGINT) >> 8 AS i16_to_i8,
    CAST(least(round(greatest(least(x, 1), -1) * 32768), 32767) AS BIGINT) * 256 AS i16_to_i24,
    CAST(least(round(greatest(least(x, 1), -1) * 32768), 32767) AS BIGINT) / 32768.0::DOUBLE + 0.0 AS i16_to_f64 FROM sig"""))
def _(spark, d):
    x = F.col("x")
    i16 = pcm.pcm_convert(x, "f64", "i16")
    return v.sig(spark, d).select(
        "signal_id",
        "n",
        *[pcm.pcm_convert(x, "f64", t).alias(t) for t in ("i8", "u8", "i16", "i24", "i32", "i64")],
        pcm.pcm_convert(i16, "i16", "i8").alias("i16_to_i8"),
        pcm.pcm_convert(i16, "i16", "i24").alias("i16_to_i24"),
        (pcm.pcm_convert(i16, "i16", "f64") + F.lit(0.0)).alias("i16_to_f64"),
    )


@query("clip", "X2", oracle("sig", "SELECT signal_id, n, round(greatest(least(x * 1.5, 1), -1), 6) + 0.0 AS y FROM sig"))
def _(spark, d):
    return v.sig(spark, d).select("signal_id", "n", r6(pcm.clip(F.col("x") * 1.5)).alias("y"))


_RESIDUAL = [
    "m AS (SELECT *, median(x) OVER (PARTITION BY signal_id ORDER BY n ROWS BETWEEN 31 PRECEDING AND 31 FOLLOWING) AS med FROM sig)",
    "dv AS (SELECT *, abs(x - med) AS dev FROM m)",
    "md AS (SELECT *, median(dev) OVER (PARTITION BY signal_id ORDER BY n ROWS BETWEEN 31 PRECEDING AND 31 FOLLOWING) AS mad FROM dv)",
    "zz AS (SELECT *, dev / greatest(mad, 1e-12) AS z FROM md)",
]
_ISLANDS = [
    "h AS (SELECT *, n - row_number() OVER (PARTITION BY signal_id ORDER BY n) AS g FROM zz WHERE z >= 2.0)",
    "reg AS (SELECT signal_id, min(n) AS start_n, max(n) AS end_n, max(z) AS top_z FROM h GROUP BY signal_id, g HAVING max(z) >= 3.0 AND max(n) - min(n) + 1 <= 8)",
]
_MERGED = [
    "cov AS (SELECT DISTINCT signal_id, unnest(range(greatest(start_n - 1, 0), end_n + 1 + 2 + 1)) AS n FROM reg)",
    "cg AS (SELECT signal_id, n, n - row_number() OVER (PARTITION BY signal_id ORDER BY n) AS g FROM cov)",
    "mr AS (SELECT signal_id, min(n) AS start_n, max(n) - 2 AS end_n FROM cg GROUP BY signal_id, g)",
    "lastn AS (SELECT signal_id, max(n) AS last_n FROM sig GROUP BY 1)",
    "regions AS (SELECT signal_id, start_n, least(end_n, last_n) AS end_n FROM mr JOIN lastn USING (signal_id))",
]
# The test signals are noise-like, so the thresholds here are lower than the presets to give regions to look at.
LOOSE = clicks.DetectParams(window=63, z_hi=3.0, z_lo=2.0, max_len=8, pad=1, merge_gap=2)


@query("robust_residual", "W2", oracle("sig", *_RESIDUAL,
    "SELECT signal_id, channel, n, round(med, 6) + 0.0 AS med, round(mad, 6) AS mad, round(z, 6) AS z FROM zz"))
def _(spark, d):
    out = clicks.robust_residual(v.sig(spark, d), 63)
    return out.select("signal_id", "channel", "n", *[r6(F.col(c)).alias(c) for c in ("med", "mad", "z")])


@query("hysteresis_mask", "W3", oracle("sig", *_RESIDUAL, *_ISLANDS,
    "SELECT signal_id, 0 AS channel, start_n, end_n, round(top_z, 6) AS top_z FROM reg"))
def _(spark, d):
    z = clicks.robust_residual(v.sig(spark, d), 63)
    return clicks.hysteresis_mask(z, 3.0, 2.0, 8).withColumn("top_z", r6(F.col("top_z")))


@query("merge_regions", "W4", oracle("sig", *_RESIDUAL, *_ISLANDS, *_MERGED, "SELECT signal_id, start_n, end_n FROM mr"))
def _(spark, d):
    z = clicks.robust_residual(v.sig(spark, d), 63)
    return clicks.merge_regions(clicks.hysteresis_mask(z, 3.0, 2.0, 8), 1, 2)


@query("clicks_per_stream", "W2-W4,G1,G2", oracle("sig", *_RESIDUAL, *_ISLANDS, *_MERGED,
    "loud AS (SELECT signal_id, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms FROM sig GROUP BY 1)",
    """SELECT signal_id, start_n, end_n, round(peak, 6) AS peak, round(rms, 6) AS rms
    FROM regions JOIN loud USING (signal_id)"""))
def _(spark, d):
    out = clicks.clicks_per_stream(v.sig(spark, d), LOOSE)
    return out.withColumns({"peak": r6(F.col("peak")), "rms": r6(F.col("rms"))})


@query("repair_median", "W5", oracle("sig", *_RESIDUAL, *_ISLANDS, *_MERGED,
    "bad AS (SELECT signal_id, unnest(range(start_n, end_n + 1)) AS n FROM regions)",
    """fill AS (SELECT r.signal_id, r.start_n, median(s.x) AS f FROM regions r JOIN sig s ON s.signal_id = r.signal_id
        AND s.n BETWEEN r.start_n - 8 AND r.end_n + 8 WHERE (s.signal_id, s.n) NOT IN (SELECT signal_id, n FROM bad) GROUP BY 1, 2)""",
    "fx AS (SELECT r.signal_id, unnest(range(r.start_n, r.end_n + 1)) AS n, f FROM regions r JOIN fill USING (signal_id, start_n))",
    """SELECT s.signal_id, s.channel, s.n, round(coalesce(f, x), 6) + 0.0 AS x, f IS NOT NULL AS repaired
    FROM sig s LEFT JOIN fx ON fx.signal_id = s.signal_id AND fx.n = s.n"""))
def _(spark, d):
    s = v.sig(spark, d)
    out = clicks.repair_median(s, clicks.detect_regions(s, LOOSE), 8)
    return out.select("signal_id", "channel", "n", r6(F.col("x")).alias("x"), "repaired")


@query("repair_ar", "W6")
def _(spark, d):
    s = v.sig(spark, d)
    out = clicks.repair_ar(s, clicks.detect_regions(s, LOOSE), 24, order=4)
    return out.select("signal_id", "channel", "n", r6(F.col("x")).alias("x"), "repaired")


# The chain of `repair_median` under the click preset of 16 kHz, with its context of 64.
_PRESET = [p.replace("31 PRECEDING", "32 PRECEDING").replace("31 FOLLOWING", "32 FOLLOWING") for p in _RESIDUAL] + [
    p.replace("z >= 2.0", "z >= 4.5").replace(">= 3.0", ">= 10.0").replace("<= 8", "<= 16") for p in _ISLANDS
]


@query("apply_cleanup", "E2", oracle("sig", *_PRESET, *_MERGED,
    "bad AS (SELECT signal_id, unnest(range(start_n, end_n + 1)) AS n FROM regions)",
    """fill AS (SELECT r.signal_id, r.start_n, median(s.x) AS f FROM regions r JOIN sig s ON s.signal_id = r.signal_id
        AND s.n BETWEEN r.start_n - 64 AND r.end_n + 64 WHERE (s.signal_id, s.n) NOT IN (SELECT signal_id, n FROM bad) GROUP BY 1, 2)""",
    "fx AS (SELECT r.signal_id, unnest(range(r.start_n, r.end_n + 1)) AS n, f FROM regions r JOIN fill USING (signal_id, start_n))",
    "SELECT s.signal_id, s.channel, s.n, round(coalesce(f, x), 6) + 0.0 AS x FROM sig s LEFT JOIN fx ON fx.signal_id = s.signal_id AND fx.n = s.n"))
def _(spark, d):
    mode = clicks.CleanupSettings(clicks.CleanupMode.DECLICK_MEDIAN, clicks.CleanupVersion.V1)
    return clicks.apply_cleanup(v.sig(spark, d), 16000, mode).select("signal_id", "channel", "n", r6(F.col("x")).alias("x"))
