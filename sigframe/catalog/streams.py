"""Queries that replay the events as a stream: staged in time order to the shared folder, read as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.catalog.registry import query, r6
from sigframe.operators import scans
from sigframe.plans import views as v
from sigframe.plans.views import oracle
from sigframe.streaming import operators as so
from sigframe.streaming.runs import append_to_table, replay, stage, update_to_table


def _samples(spark, d):
    """The numbered samples as a stream of `stream, seq, x, ts`, in two micro-batches, so that state is carried."""
    n = v.numbered_events(spark, d).select(
        F.col("user_id").alias("stream"), F.col("n").alias("seq"), (F.col("value") / 250.0 - 1).alias("x"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"
    )
    path, files = stage(n, F.col("seq") >= 40)
    return replay(spark, path, n.schema, files)


def _events(spark, d, copies: int = 1):
    """The events as a stream, a micro-batch for each ten days; further copies of a row come ten days later each."""
    e = v.table(spark, d, "events").select(
        F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), (F.col("value") / 250.0 - 1).alias("x"), F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )
    e = e.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    path, files = stage(e, F.floor(F.unix_micros("ts") / 864_000_000_000) + F.col("copy"), "events")
    return replay(spark, path, e.schema, files).drop("copy")


@query("reblock", "T1", oracle("sig",
    "b AS (SELECT signal_id AS stream, n // 16 AS block_no, round(sum(x), 6) + 0.0 AS total, count(*) AS samples FROM sig GROUP BY 1, 2)",
    "SELECT stream, block_no, total, CAST(samples AS INTEGER) AS samples, CAST(NULL AS VARCHAR) AS error FROM b WHERE samples = 16"))
def _(spark, d):
    out = append_to_table(so.reblock(_samples(spark, d), 16), "reblock")
    total = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x)
    return out.select("stream", "block_no", r6(total).alias("total"), F.size("xs").alias("samples"), "error")


@query("meter", "T2", """SELECT user_id AS stream, strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d %H:%M:%S') AS start, round(sqrt(avg(pow(value / 250.0 - 1, 2))), 6) AS rms,
    round(max(abs(value / 250.0 - 1)), 6) AS peak, count(*) AS samples FROM events GROUP BY 1, 2""")
def _(spark, d):
    out = update_to_table(so.meter(_events(spark, d), "1 day"), ["stream", "start"], "meter")
    start = F.date_format("start", "yyyy-MM-dd HH:mm:ss")
    return out.select("stream", start.alias("start"), r6(F.col("rms")).alias("rms"), r6(F.col("peak")).alias("peak"), "samples")


@query("sliding_meter", "T2", """WITH s AS (SELECT user_id AS stream, value / 250.0 - 1 AS x, time_bucket(INTERVAL 1 day, ts) - to_days(CAST(k AS INTEGER)) AS start FROM events, range(2) t(k))
    SELECT stream, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, round(sqrt(avg(x * x)), 6) AS rms, round(max(abs(x)), 6) AS peak, count(*) AS samples FROM s GROUP BY 1, 2""")
def _(spark, d):
    out = update_to_table(so.meter(_events(spark, d), "2 days", "1 day"), ["stream", "start"], "sliding")
    start = F.date_format("start", "yyyy-MM-dd HH:mm:ss")
    return out.select("stream", start.alias("start"), r6(F.col("rms")).alias("rms"), r6(F.col("peak")).alias("peak"), "samples")


@query("sessions", "T3", """WITH g AS (SELECT user_id AS stream, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 hour THEN 1 ELSE 0 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
    a AS (SELECT stream, min(ts) AS start, max(ts) + INTERVAL 6 hour AS stop, count(*) AS events FROM s GROUP BY stream, k)
    SELECT stream, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(stop, '%Y-%m-%d %H:%M:%S') AS stop, events, stop <= (SELECT max(ts) FROM events) - INTERVAL 1 hour AS closed FROM a""")
def _(spark, d):
    out = update_to_table(so.sessions(_events(spark, d), "6 hours"), ["stream", "start"], "sessions").filter("status <> 'merged'")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("stream", stamp("start").alias("start"), stamp("end").alias("stop"), "events", (F.col("status") == "closed").alias("closed"))


@query("stream_limiter", "T4", oracle("sig",
    "p AS (SELECT *, max(abs(x * 1.7)) OVER (PARTITION BY signal_id ORDER BY n) AS pk FROM sig)",
    "SELECT signal_id AS stream, n AS seq, round(x * 1.7 / greatest(pk, 1), 6) + 0.0 AS y FROM p"))
def _(spark, d):
    s = _samples(spark, d).withColumn("x", F.col("x") * 1.7)
    out = append_to_table(so.stream_limiter(s.select("stream", "seq", "x")), "limiter")
    return out.withColumn("y", r6(F.col("y")))


_AGC = """rec(stream, seq, y, gain, held, attack, quiet, at_n, clips) AS (
    SELECT DISTINCT signal_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 1024, 1024, 0, 0, 0, 0 FROM sig UNION ALL
    SELECT stream, seq, y, CASE WHEN fin THEN h2 ELSE g2 END, h2, a3, q2, CASE WHEN fin THEN 0 ELSE at2 END, CASE WHEN fin THEN 0 ELSE c2 END FROM (
      SELECT *, CASE WHEN fin AND g2 >= held AND held < 1024 THEN CASE WHEN quiet + 8 >= 16 THEN held + 1 ELSE held END WHEN fin THEN g2 ELSE held END AS h2,
        CASE WHEN fin AND g2 >= held AND held < 1024 THEN CASE WHEN quiet + 8 >= 16 THEN 0 ELSE quiet + 8 END WHEN fin THEN 0 ELSE quiet END AS q2 FROM (
        SELECT *, at2 = 8 AS fin, CASE WHEN at2 = 8 AND c2 = 0 THEN 0 ELSE a2 END AS a3 FROM (
          SELECT stream, seq, y, held, quiet, at_n + 1 AS at2, clips + CASE WHEN abs(y) > 20000 THEN 1 ELSE 0 END AS c2, gain - CASE WHEN abs(y) > 20000 AND attack + 1 >= 4 THEN 1 ELSE 0 END AS g2,
            CASE WHEN abs(y) > 20000 THEN CASE WHEN attack + 1 >= 4 THEN attack + 1 - 4 ELSE attack + 1 END ELSE attack END AS a2 FROM (
            SELECT r.stream, s.n AS seq, (CAST(round(s.x * 30000) AS BIGINT) * r.gain) >> 10 AS y, r.gain, r.held, r.attack, r.quiet, r.at_n, r.clips
            FROM rec r JOIN sig s ON s.signal_id = r.stream AND s.n = r.seq + 1)))))"""


@query("gain_control", "T5", oracle("sig", _AGC, "SELECT stream, seq, y FROM rec WHERE seq >= 0"))
def _(spark, d):
    s = _samples(spark, d).select("stream", "seq", F.round(F.col("x") * 30000).cast("long").alias("x"))
    return append_to_table(so.gain_control(s, 20000, 8, 16, "gentle"), "gain")


_FOLLOW = """lv AS (SELECT signal_id AS stream, n AS seq, x, CASE WHEN x = 0 THEN 0 ELSE greatest(1 + log2(abs(x)) / 32, 0) END AS v FROM sig),
    rec(stream, seq, x, peak) AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE FROM lv UNION ALL
    SELECT l.stream, l.seq, l.x, l.v + (r.peak - l.v) * CASE WHEN r.peak <= l.v THEN 0.2::DOUBLE ELSE 0.9::DOUBLE END FROM rec r JOIN lv l ON l.stream = r.stream AND l.seq = r.seq + 1)"""


@query("follower", "T6", oracle("sig", _FOLLOW, """SELECT stream, seq, round(peak, 6) AS peak,
    round(x * pow(2, 32 * ((0.97::DOUBLE - greatest(peak, 0.97::DOUBLE)) * 0.5 + 0.9999999::DOUBLE - 1)), 6) + 0.0 AS y FROM rec WHERE seq >= 0"""))
def _(spark, d):
    s = _samples(spark, d).select("stream", "seq", "x")
    out = append_to_table(so.follower(s, 0.2, 0.9, 0.97, 0.5), "follower")
    return out.select("stream", "seq", r6(F.col("peak")).alias("peak"), r6(F.col("y")).alias("y"))


_LENGTH = "CASE WHEN {s} // 16 IN (12, 13) THEN 2 WHEN {s} IN (241, 243) THEN 2 WHEN {s} = 242 THEN 3 WHEN {s} >= 240 THEN 1 ELSE 3 END"
_STATUS = f"""rec(stream, seq, last, cur, need, out) AS (
    SELECT DISTINCT stream, CAST(-1 AS BIGINT), 0::BIGINT, []::BIGINT[], 0::BIGINT, NULL::BIGINT[] FROM byte_stream UNION ALL
    SELECT stream, seq, CASE WHEN done AND c[1] < 240 THEN c[1] ELSE last END, CASE WHEN done THEN [] ELSE c END, CASE WHEN done THEN 0 ELSE n END, CASE WHEN done THEN c END FROM (
      SELECT *, len(c) > 0 AND (len(c) = n OR (n = 0 AND b = 247)) AS done FROM (
        SELECT r.stream, s.seq, s.b, last,
          CASE WHEN len(cur) > 0 THEN list_append(cur, s.b) WHEN s.b < 128 AND last = 0 THEN [] WHEN s.b < 128 THEN [last, s.b] ELSE [s.b] END AS c,
          CASE WHEN len(cur) = 1 AND need = -1 THEN CASE WHEN s.b IN (240, 241) THEN 4 ELSE 0 END WHEN len(cur) > 0 THEN need WHEN s.b = 240 THEN -1
            WHEN s.b < 128 AND last = 0 THEN need WHEN s.b < 128 THEN {_LENGTH.format(s="last")} ELSE {_LENGTH.format(s="s.b")} END AS n
        FROM rec r JOIN byte_stream s ON s.stream = r.stream AND s.seq = r.seq + 1)))"""


@query("running_status", "T7", oracle("byte_stream", _STATUS,
    "SELECT stream, seq, array_to_string(list_transform(out, lambda x: printf('%02x', x)), '') AS message FROM rec WHERE out IS NOT NULL"))
def _(spark, d):
    s = _samples(spark, d).select("stream", "seq", (F.col("event_id") % 256).alias("b"))
    return append_to_table(so.running_status(s), "status")


@query("follower_blocks", "T6", oracle("sig", _FOLLOW, """SELECT stream, seq, round(peak, 6) AS peak,
    round(x * pow(2, 32 * ((0.97::DOUBLE - greatest(peak, 0.97::DOUBLE)) * 0.5 + 0.9999999::DOUBLE - 1)), 6) + 0.0 AS y FROM rec WHERE seq >= 0"""))
def _(spark, d):
    s = v.sig(spark, d).select(F.col("signal_id").alias("stream"), F.col("n").alias("seq"), "x")
    out = scans.follower(s, 0.2, 0.9, 0.97, 0.5, size=64)
    return out.select("stream", "seq", r6(F.col("peak")).alias("peak"), r6(F.col("y")).alias("y"))


@query("running_status_blocks", "T7", oracle("byte_stream", _STATUS,
    "SELECT stream, seq, array_to_string(list_transform(out, lambda x: printf('%02x', x)), '') AS message FROM rec WHERE out IS NOT NULL"))
def _(spark, d):
    s = v.numbered_events(spark, d).select(F.col("user_id").alias("stream"), F.col("n").alias("seq"), (F.col("event_id") % 256).alias("b"))
    return scans.running_status(s, size=64)


@query("stream_paired_controller", "T8", oracle("controls",
    "c AS (SELECT stream, seq, (word >> 8) & 63 AS cc, ((word >> 16) & 127) AS v FROM controls)",
    "l AS (SELECT *, lag(cc) OVER w AS pcc, lag(v) OVER w AS pv FROM c WINDOW w AS (PARTITION BY stream ORDER BY seq))",
    "SELECT stream, seq, cc, CASE WHEN pcc < 32 AND cc = pcc + 32 THEN v | (pv << 7) ELSE v << 7 END AS value FROM l"))
def _(spark, d):
    s = _samples(spark, d).select("stream", "seq", (F.col("event_id") % 64).alias("cc"), (F.floor("value").cast("long") % 128).alias("v"))
    return append_to_table(so.stream_paired_controller(s), "paired")


@query("dedupe_stream", "T9", "SELECT user_id AS stream, event_id AS seq, round(value / 250.0 - 1, 6) + 0.0 AS x FROM events")
def _(spark, d):
    return append_to_table(so.dedupe_stream(_events(spark, d, copies=2), "25 days"), "dedupe").select("stream", "seq", r6(F.col("x")).alias("x"))


# Errors are delivered one slice after the others of their week, so they come late.
_SLICES = """sl AS (SELECT event_id, ts, floor(epoch(ts - (SELECT date_trunc('day', min(ts)) FROM events)) / 691200) + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS k FROM events),
    mx AS (SELECT k, max(ts) AS top FROM sl GROUP BY 1),
    wm AS (SELECT k, max(top) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 day AS lim FROM mx)"""


def _late(spark, d):
    e = v.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    first = e.agg(F.date_trunc("day", F.min("ts")).alias("_t")).scalar()
    week = F.floor((F.unix_micros("ts") - F.unix_micros(first)) / 691200000000)
    e = e.withColumn("k", (week + F.when(F.col("event_type") == "error", 1).otherwise(0)).cast("long"))
    path, files = stage(e, "k", "slices")
    return so.late_split(replay(spark, path, e.schema, files), "ts", "1 DAY")


@query("late_rows", "T10", f"WITH {_SLICES} SELECT event_id, CAST(k AS BIGINT) AS k FROM sl JOIN wm USING (k) WHERE ts < lim")
def _(spark, d):
    return _late(spark, d)[1].select("event_id", "k")


@query("on_time_rows", "T10", f"WITH {_SLICES} SELECT event_id, CAST(k AS BIGINT) AS k FROM sl JOIN wm USING (k) WHERE coalesce(ts >= lim, true)")
def _(spark, d):
    return _late(spark, d)[0].select("event_id", "k")
