"""Queries for position-wise signal operators: running values, envelopes, resampling, edits, pitch."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sigframe.catalog.registry import query, r6
from sigframe.operators import signal_ops as so
from sigframe.operators.signal_stats import attach_by_block, lengths
from sigframe.plans import views as v
from sigframe.plans.views import oracle

LEN = "len AS (SELECT signal_id, max(n) + 1 AS frames FROM sig GROUP BY 1)"
SG = "sg AS (SELECT s.*, frames FROM sig s JOIN len USING (signal_id))"


PI_SIG = "ps0 AS (SELECT signal_id, channel, n, x * pi() AS x FROM sig)"


def _scaled(spark, d):
    """The signal times pi, so that no exact result ends in a 5 at the rounding digit."""
    return v.sig(spark, d).withColumn("x", F.col("x") * F.lit(math.pi))


def _x(df, name="x"):
    return df.select("signal_id", "channel", "n", r6(F.col(name), 9).alias(name))


@query("delta_decode", "W1", oracle("cell", """s AS (SELECT pattern, "row", sum(note) OVER (PARTITION BY pattern ORDER BY "row") % 256 AS u FROM cell)""",
    'SELECT pattern, "row", CAST(CASE WHEN u >= 128 THEN u - 256 ELSE u END AS BIGINT) AS decoded FROM s'))
def _(spark, d):
    return so.delta_decode(v.cell(spark, d), ["pattern"], "row", "note", 8).select("pattern", "row", "decoded")


@query("running_limiter", "W7", oracle("stereo",
    "lg AS (SELECT signal_id, 0 AS channel, n, l * 6 AS x FROM stereo UNION ALL SELECT signal_id, 1, n, r * 6 FROM stereo)",
    "p AS (SELECT *, max(abs(x)) OVER (PARTITION BY signal_id ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pk FROM lg)",
    "SELECT signal_id, channel, n, round(CASE WHEN pk > 1 THEN x * (1 / pk) ELSE x END, 9) + 0.0 AS y FROM p"))
def _(spark, d):
    s = v.stereo(spark, d).select("signal_id", "n", F.posexplode(F.array(F.col("l") * 6, F.col("r") * 6)).alias("channel", "x"))
    return _x(so.running_limiter(s), "y")


_LAW_SQL = {
    "linear": "p",
    "pow": "p * p",
    "sqrt": "sqrt(p)",
    "log": "log10(1 + p * 99) * 0.5",
    "quarter_sine": "sin(0.5 * pi() * p)",
    "half_sine": "(1 + cos(pi() + pi() * p)) * 0.5",
}


@query("fade", "W8", oracle("sig", LEN, PI_SIG, "sg AS (SELECT s.*, frames FROM ps0 s JOIN len USING (signal_id))", "ps AS (SELECT *, CASE WHEN frames > 1 THEN n / (frames - 1)::DOUBLE ELSE 1 END AS p FROM sg)",
    " UNION ALL ".join(f"SELECT '{k}' AS law, signal_id, channel, n, round(x * ({e}), 9) + 0.0 AS y FROM ps" for k, e in _LAW_SQL.items())))
def _(spark, d):
    s = _scaled(spark, d)
    sized = attach_by_block(s, lengths(s))
    pos = F.when(F.col("frames") > 1, F.col("n") / (F.col("frames") - 1)).otherwise(1.0)
    laws = F.array(*[F.struct(F.lit(k).alias("law"), r6(F.col("x") * f(pos), 9).alias("y")) for k, f in so.FADE_LAWS.items()])
    return sized.select("signal_id", "channel", "n", F.inline(laws)).select("law", "signal_id", "channel", "n", "y")


@query("fade_out", "W8", oracle("sig", LEN, PI_SIG, "sg AS (SELECT s.*, frames FROM ps0 s JOIN len USING (signal_id))", "SELECT signal_id, channel, n, round(x * pow(1 - n / (frames - 1)::DOUBLE, 2), 9) + 0.0 AS y FROM sg"))
def _(spark, d):
    return _x(so.fade(_scaled(spark, d), "pow", fade_in=False), "y")


@query("custom_curve", "E3", oracle("sig", LEN, PI_SIG, "sg AS (SELECT s.*, frames FROM ps0 s JOIN len USING (signal_id))", "SELECT signal_id, channel, n, round(x * pow(n / (frames - 1)::DOUBLE, 3), 9) + 0.0 AS y FROM sg"))
def _(spark, d):
    return _x(so.fade(_scaled(spark, d), lambda p: p * p * p), "y")


@query("tremolo_gate", "W16", oracle("sig", """SELECT signal_id, n, round(CASE WHEN n % 14 < 7 THEN x ELSE 0 END, 6) + 0.0 AS square,
    round(x * CASE WHEN n % 14 < 7 THEN n % 14 ELSE 14 - n % 14 END / 7.0::DOUBLE, 6) + 0.0 AS triangle FROM sig"""))
def _(spark, d):
    sq = so.tremolo_gate(v.sig(spark, d), 7, False).withColumnRenamed("y", "square")
    both = so.tremolo_gate(sq, 7, True).withColumnRenamed("y", "triangle")
    return both.select("signal_id", "n", r6(F.col("square")).alias("square"), r6(F.col("triangle")).alias("triangle"))


@query("lfo", "W17", oracle("sig", """ph AS (SELECT signal_id, n, (n % 20) / 20.0::DOUBLE AS p FROM sig)""",
    """SELECT signal_id, n, round(least(greatest(sin(p * 2 * pi()) * 0.5 + 0.5, 0), 1), 6) AS sine, round(least(greatest((1 - 4 * abs(p - 0.5)) * 0.8 + 0.5, 0), 1), 6) AS triangle,
    round(least(greatest(-(2 * p - 1) * 0.5 + 0.4, 0), 1), 6) AS saw, least(greatest(CASE WHEN p < 0.5 THEN -0.3::DOUBLE ELSE 0.3::DOUBLE END + 0.5, 0), 1) AS square FROM ph"""))
def _(spark, d):
    p = F.pmod("n", F.lit(20)) / 20.0
    return v.sig(spark, d).select(
        "signal_id",
        "n",
        r6(so.lfo(p, "sine", 0.5, 0.5)).alias("sine"),
        r6(so.lfo(p, "triangle", 0.8, 0.5)).alias("triangle"),
        r6(so.lfo(p, "saw", 0.5, 0.4, inverted=True)).alias("saw"),
        so.lfo(p, "square", 0.3, 0.5).alias("square"),
    )


@query("lfo_noise", "W17", oracle("sig",
    "ph AS (SELECT signal_id, n, (n % 20) / 20.0::DOUBLE AS p, n // 20 AS c FROM sig)",
    "pt AS (SELECT *, CAST('0x' || substr(md5(CAST(c AS VARCHAR)), 1, 5) AS BIGINT) / 524288.0::DOUBLE - 1 AS a, CAST('0x' || substr(md5(CAST(c + 1 AS VARCHAR)), 1, 5) AS BIGINT) / 524288.0::DOUBLE - 1 AS b FROM ph)",
    "wt AS (SELECT *, p * p * p * (p * (p * 6.0::DOUBLE - 15.0::DOUBLE) + 10.0::DOUBLE) AS w FROM pt)",
    """SELECT signal_id, n, round(least(greatest(a * 0.5::DOUBLE + 0.5::DOUBLE, 0), 1), 9) AS hold,
    round(least(greatest((b * w + a * (1 - w)) * 0.5::DOUBLE + 0.5::DOUBLE, 0), 1), 9) AS smooth FROM wt"""))
def _(spark, d):
    p, c = F.pmod("n", F.lit(20)) / 20.0, F.floor(F.col("n") / 20)
    return v.sig(spark, d).select(
        "signal_id", "n", F.round(so.lfo(p, "hold_noise", 0.5, 0.5, cycle=c), 9).alias("hold"), F.round(so.lfo(p, "smooth_noise", 0.5, 0.5, cycle=c), 9).alias("smooth")
    )


_TICKS = """t AS (SELECT pattern, "row" AS i, (vol * 7) % 40 + "row" * 3 AS tick, note % 65 AS value FROM cell)"""


def _nodes(spark, d):
    return v.cell(spark, d).select(
        "pattern", F.col("row").alias("i"), ((F.col("vol") * 7) % 40 + F.col("row") * 3).alias("tick"), (F.col("note") % 65).alias("value")
    )


@query("monotone_ticks", "W21", oracle("cell", _TICKS, """SELECT pattern, i, value, i + max(tick - i) OVER (PARTITION BY pattern ORDER BY i) AS tick FROM t"""))
def _(spark, d):
    return so.monotone_ticks(_nodes(spark, d), ["pattern"], "i", "tick")


@query("sanitize_ticks", "W21", oracle("cell", _TICKS, """SELECT pattern, i, value, max(CASE WHEN i = 0 THEN 0 ELSE tick END) OVER (PARTITION BY pattern ORDER BY i) AS tick FROM t"""))
def _(spark, d):
    return so.monotone_ticks(_nodes(spark, d), ["pattern"], "i", "tick", strict=False)


@query("scale_nodes", "W22", oracle("cell", _TICKS, """SELECT pattern, i, CAST(i + max(CAST(floor(tick * 0.4::DOUBLE) AS BIGINT) - i) OVER (PARTITION BY pattern ORDER BY i) AS BIGINT) AS tick,
    CAST(round(least(greatest((64 - value - 32) * 1.3::DOUBLE + 32 + 2, 0), 64)) AS BIGINT) AS value FROM t"""))
def _(spark, d):
    return so.scale_nodes(_nodes(spark, d), ["pattern"], "i", 0.4, -1.3, 2.0, 32.0)


@query("wet_dry_mix", "J13", oracle("sig", PI_SIG, "SELECT signal_id, channel, n, round(x * 0.7 + (-x * x) * 0.3, 9) + 0.0 AS x FROM ps0"))
def _(spark, d):
    s = _scaled(spark, d)
    return _x(so.wet_dry_mix(s, s.withColumn("x", -F.col("x") * F.col("x")), 30))


@query("convolve_taps", "J16", oracle("sig", """SELECT signal_id, channel, n, round(x * 0 - 0.5::DOUBLE * coalesce(lag(x, 1) OVER w, 0) + coalesce(lag(x, 2) OVER w, 0)
    + 0.25::DOUBLE * coalesce(lag(x, 3) OVER w, 0), 9) + 0.0 AS y FROM sig WINDOW w AS (PARTITION BY signal_id ORDER BY n)"""))
def _(spark, d):
    return _x(so.convolve_taps(v.sig(spark, d), [0, -0.5, 1, 0.25]), "y")


@query("window_frames", "J17", oracle("sig", LEN, SG,
    "f AS (SELECT signal_id, k AS frame, n - k * 8 AS i, x FROM sg, range(2000) t(k) WHERE n BETWEEN k * 8 AND k * 8 + 19 AND k * 8 + 20 <= frames)",
    "SELECT signal_id, frame, count(*) AS samples, round(sum(x * i), 5) + 0.0 AS moment FROM f GROUP BY 1, 2"))
def _(spark, d):
    f = so.window_frames(v.sig(spark, d), 20, 8)
    return f.groupBy("signal_id", "frame").agg(F.count(F.lit(1)).alias("samples"), r6(F.sum(F.col("x") * F.col("i")), 5).alias("moment"))


@query("resample_linear", "W9", oracle("sig", LEN, PI_SIG,
    "o AS (SELECT signal_id, frames, unnest(range(CAST(greatest(round(frames * 480 / 441.0::DOUBLE), 1) AS BIGINT))) AS i FROM len)",
    "p AS (SELECT *, i * 441 // 480 AS a, (i * 441 % 480) / 480.0::DOUBLE AS fr FROM o)",
    """SELECT p.signal_id, 0 AS channel, p.i AS n, round(s.x * (1 - fr) + z.x * fr, 9) + 0.0 AS x FROM p JOIN ps0 s ON s.signal_id = p.signal_id AND s.n = p.a
    JOIN ps0 z ON z.signal_id = p.signal_id AND z.n = least(p.a + 1, frames - 1)"""))
def _(spark, d):
    return _x(so.resample_linear(_scaled(spark, d), 441, 480))


@query("resample_linear_down", "W9", oracle("sig", LEN, PI_SIG,
    "o AS (SELECT signal_id, frames, unnest(range(CAST(greatest(round(frames * 3 / 10.0::DOUBLE), 1) AS BIGINT))) AS i FROM len)",
    "p AS (SELECT *, i * 10 // 3 AS a, (i * 10 % 3) / 3.0::DOUBLE AS fr FROM o)",
    """SELECT p.signal_id, 0 AS channel, p.i AS n, round(s.x * (1 - fr) + z.x * fr, 9) + 0.0 AS x FROM p JOIN ps0 s ON s.signal_id = p.signal_id AND s.n = p.a
    JOIN ps0 z ON z.signal_id = p.signal_id AND z.n = least(p.a + 1, frames - 1)"""))
def _(spark, d):
    return _x(so.resample_linear(_scaled(spark, d), 10, 3))


def _sinc_sql(taps: int, window: str, cutoff: float) -> str:
    def coef(c: int) -> str:
        u = f"({c + 0.5}::DOUBLE - fr)"
        pos = f"({u} - {(taps - 1) / 2}::DOUBLE)"
        win = " + ".join(f"({(-1) ** k * a}::DOUBLE) * cos(2 * pi() * {k} * {u} / {taps - 1})" for k, a in enumerate(so.WINDOWS[window]))
        return f"CASE WHEN abs({pos}) < 1e-8 THEN {cutoff}::DOUBLE ELSE ({win}) * sin(pi() * {pos} * {cutoff}) / (pi() * {pos}) END"

    back = -(taps // 2 - 1)
    top = " + ".join(f"({coef(c)}) * coalesce(x{c}, 0)" for c in range(taps))
    low = " + ".join(f"({coef(c)})" for c in range(taps))
    lags = ", ".join(f"{'lag' if back + c < 0 else 'lead'}(x, {abs(back + c)}) OVER w AS x{c}" for c in range(taps))
    return oracle("sig", LEN,
        "o AS (SELECT signal_id, frames, unnest(range(CAST(greatest(round(frames * 160 / 147.0::DOUBLE), 1) AS BIGINT))) AS i FROM len)",
        f"nb AS (SELECT signal_id, n, {lags} FROM sig WINDOW w AS (PARTITION BY signal_id ORDER BY n))",
        "p AS (SELECT nb.*, o.i, (o.i * 147 % 160) / 160.0::DOUBLE AS fr FROM o JOIN nb ON nb.signal_id = o.signal_id AND nb.n = o.i * 147 // 160)",
        f"SELECT signal_id, 0 AS channel, i AS n, round(({top}) / ({low}), 9) + 0.0 AS x FROM p")


@query("resample_sinc", "W10", _sinc_sql(8, "kaiser4", 0.9))
def _(spark, d):
    return _x(so.resample_sinc(v.sig(spark, d), 147, 160))


@query("grain_stretch", "W31", oracle("sig", LEN,
    "o AS (SELECT signal_id, frames, unnest(range(CAST(round(frames * 1.5::DOUBLE) AS BIGINT))) AS i FROM len)",
    "g AS (SELECT *, i // 16 AS k, (i % 16) * 1.0::DOUBLE AS np FROM o)",
    "h AS (SELECT *, k * 11 + np AS p, CASE WHEN k > 0 AND np + 16 < 20 THEN (k - 1) * 11 + np + 16 END AS q, np + 16 AS op FROM g)",
    "xs AS (SELECT signal_id, n, x FROM sig)",
    """SELECT h.signal_id, 0 AS channel, h.i AS n, round(CASE WHEN q IS NULL THEN coalesce(a.x, 0) ELSE coalesce(b.x, 0) + (coalesce(a.x, 0) - coalesce(b.x, 0)) * (op - 16) / 4.0::DOUBLE END, 9) + 0.0 AS x
    FROM h LEFT JOIN xs a ON a.signal_id = h.signal_id AND a.n = CAST(h.p AS BIGINT) LEFT JOIN xs b ON b.signal_id = h.signal_id AND b.n = CAST(h.q AS BIGINT)"""))
def _(spark, d):
    return _x(so.grain_stretch(v.sig(spark, d), 20, 1.5, 1.0))


def _quarter():
    return F.floor(F.col("frames") / 4), F.floor(F.col("frames") / 2)


@query("unroll_pingpong", "W32", oracle("sig", LEN, SG, "ab AS (SELECT *, frames // 4 AS a, frames // 2 AS b FROM sg)",
    """SELECT signal_id, channel, CASE WHEN n >= b THEN n + b - a ELSE n END AS n, round(x, 9) + 0.0 AS x FROM ab
    UNION ALL SELECT signal_id, channel, 2 * b - 1 - n, round(x, 9) + 0.0 FROM ab WHERE n >= a AND n < b"""))
def _(spark, d):
    return _x(so.unroll_pingpong(v.sig(spark, d), *_quarter()))


@query("crossfade_loop", "W33", oracle("sig", LEN, SG, "ab AS (SELECT *, frames // 4 AS a, frames // 2 AS b FROM sg)",
    "pre AS (SELECT signal_id, n + b - a AS n, x AS y FROM ab WHERE n < a AND n >= a - 8)",
    """SELECT ab.signal_id, channel, ab.n, round(CASE WHEN y IS NOT NULL THEN x * (1 - sqrt((ab.n - b + 9) / 8.0::DOUBLE)) + y * sqrt((ab.n - b + 9) / 8.0::DOUBLE) ELSE x END, 9) + 0.0 AS x
    FROM ab LEFT JOIN pre ON pre.signal_id = ab.signal_id AND pre.n = ab.n"""))
def _(spark, d):
    return _x(so.crossfade_loop(v.sig(spark, d), *_quarter(), 8, "sqrt"))


@query("stereo_separation", "W34", oracle("stereo", "SELECT signal_id, n, round((l + r) / 2 + (l - r) / 2 * 1.5, 6) + 0.0 AS l, round((l + r) / 2 - (l - r) / 2 * 1.5, 6) + 0.0 AS r FROM stereo"))
def _(spark, d):
    left, right = so.stereo_separation(F.col("l"), F.col("r"), 150)
    return v.stereo(spark, d).select("signal_id", "n", r6(left).alias("l"), r6(right).alias("r"))


_EDITS = {
    "reverse_range": (so.reverse_range, "CASE WHEN n >= a AND n < b THEN a + b - 1 - n ELSE n END", "x", ""),
    "invert_range": (so.invert_range, "n", "CASE WHEN n >= a AND n < b THEN -x ELSE x END", ""),
    "silence_range": (so.silence_range, "n", "CASE WHEN n >= a AND n < b THEN 0 ELSE x END", ""),
    "remove_range": (so.remove_range, "CASE WHEN n >= b THEN n - (b - a) ELSE n END", "x", "WHERE n < a OR n >= b"),
}


def _edit_query(name, fn, pos, val, cond):
    sql = oracle("sig", LEN, SG, "ab AS (SELECT *, frames // 4 AS a, frames // 2 AS b FROM sg)",
        f"SELECT signal_id, channel, {pos} AS n, round({val}, 9) + 0.0 AS x FROM ab {cond}")

    @query(name, "W35", sql)
    def _(spark, d):
        return _x(fn(v.sig(spark, d), *_quarter()))


for _name, _spec in _EDITS.items():
    _edit_query(_name, *_spec)


@query("insert_silence", "W35", oracle("sig", LEN, SG, """SELECT signal_id, channel, CASE WHEN n >= frames // 4 THEN n + 5 ELSE n END AS n, round(x, 9) + 0.0 AS x FROM sg
    UNION ALL SELECT signal_id, 0, frames // 4 + j, 0.0 FROM len, range(5) t(j)"""))
def _(spark, d):
    return _x(so.insert_silence(v.sig(spark, d), _quarter()[0], 5))


@query("adjust_points", "W36", """SELECT p_partkey, CAST(i AS INTEGER) AS i, CAST(CASE WHEN c > p_size THEN p_size + round((c - p_size) * 1.25::DOUBLE) ELSE c END AS BIGINT) AS point
    FROM (SELECT p_partkey, p_size, i, (p_partkey * 13) % 100 + i * 7 AS c FROM part, range(9) t(i))""")
def _(spark, d):
    cues = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: (F.col("p_partkey") * 13) % 100 + i * 7)
    pts = so.adjust_points(cues, F.col("p_size"), 1.25)
    return v.table(spark, d, "part").select("p_partkey", F.posexplode(pts).alias("i", "point"))


_I16 = "q AS (SELECT signal_id, n, CAST(round(x * 1000) AS BIGINT) AS x FROM sig)"
RATE = 1000
_SHIFTS = so.candidate_shifts(RATE)
_TOP = max(s for _, s in _SHIFTS)
_DIFF = f"""df AS (SELECT a.signal_id, s.shift, sum((b.x - a.x) * (b.x - a.x)) AS cost FROM (SELECT DISTINCT shift FROM notes) s JOIN q a ON true JOIN q b ON b.signal_id = a.signal_id AND b.n = a.n + s.shift
    JOIN len ON len.signal_id = a.signal_id WHERE a.n < len.frames - {_TOP} GROUP BY 1, 2)"""
_NOTES = f"""notes AS (SELECT k AS note, CAST(greatest(floor({RATE} / (440.0::DOUBLE * pow(2.0::DOUBLE, (k / 32.0::DOUBLE - 69) / 12)) + 0.5), 1) AS BIGINT) AS shift FROM range(768, 3072) t(k))"""
_HIST = "hi AS (SELECT signal_id, note % 384 AS bin, CAST(sum(cost) AS BIGINT) AS cost FROM df JOIN notes USING (shift) GROUP BY 1, 2)"


def _smooth_sql() -> str:
    e = "h.cost"
    for k in range(4, -1, -1):
        pair = f"(c[(h.bin - {k} + 384) % 384 + 1] + c[(h.bin + {k}) % 384 + 1])"
        e = f"(({e}) // 2 + {pair} // 2)"
    return f"sm AS (SELECT h.signal_id, h.bin, CAST({e} AS BIGINT) AS cost FROM hi h JOIN (SELECT signal_id, list(cost ORDER BY bin) AS c FROM hi GROUP BY 1) l USING (signal_id))"


def _pcm(spark, d):
    return v.sig(spark, d).withColumn("x", F.round(F.col("x") * 1000).cast("long"))


@query("self_shift_diff", "J12", oracle("sig", LEN, _I16, _NOTES, _DIFF, "SELECT signal_id, 0 AS channel, CAST(shift AS INTEGER) AS shift, CAST(cost AS BIGINT) AS cost FROM df"))
def _(spark, d):
    return so.self_shift_diff(_pcm(spark, d), sorted({s for _, s in _SHIFTS}))


@query("folded_histogram", "G12", oracle("sig", LEN, _I16, _NOTES, _DIFF, _HIST, "SELECT signal_id, 0 AS channel, CAST(bin AS INTEGER) AS bin, cost FROM hi"))
def _(spark, d):
    return so.folded_histogram(_pcm(spark, d), RATE)


@query("smooth_circular", "W30", oracle("sig", LEN, _I16, _NOTES, _DIFF, _HIST, _smooth_sql(), "SELECT signal_id, 0 AS channel, CAST(bin AS INTEGER) AS bin, cost FROM sm"))
def _(spark, d):
    return so.smooth_circular(so.folded_histogram(_pcm(spark, d), RATE))


@query("argmin_bin", "K2", oracle("sig", LEN, _I16, _NOTES, _DIFF, _HIST, _smooth_sql(),
    "b AS (SELECT signal_id, arg_min(bin, cost * 1000 + bin) AS bin FROM sm GROUP BY 1)",
    "c AS (SELECT signal_id, bin, CASE WHEN bin + 96 >= 192 THEN bin - 384 ELSE bin END AS centred FROM b)",
    f"SELECT signal_id, 0 AS channel, bin, centred, CAST(round({RATE} * 440 / (440.0::DOUBLE * pow(2.0::DOUBLE, (3 + centred / 32.0::DOUBLE) / 12))) AS BIGINT) AS rate FROM c"))
def _(spark, d):
    best = so.argmin_bin(so.smooth_circular(so.folded_histogram(_pcm(spark, d), RATE)), target_note=9)
    return so.tuned_rate(best, RATE, target_note=9)


@query("paired_controller", "T8", oracle("controls",
    "c AS (SELECT stream, seq, (word >> 8) & 63 AS cc, ((word >> 16) & 127) AS v FROM controls)",
    "l AS (SELECT *, lag(cc) OVER w AS pcc, lag(v) OVER w AS pv FROM c WINDOW w AS (PARTITION BY stream ORDER BY seq))",
    "SELECT stream, seq, cc, CASE WHEN pcc < 32 AND cc = pcc + 32 THEN v | (pv << 7) ELSE v << 7 END AS value FROM l"))
def _(spark, d):
    from sigframe.operators.lookups import paired_controller

    w = v.controls(spark, d)
    c = w.select("stream", "seq", F.shiftright("word", 8).bitwiseAND(F.lit(63)).alias("cc"), F.shiftright("word", 16).bitwiseAND(F.lit(127)).alias("v"))
    return paired_controller(c).select("stream", "seq", "cc", "value")
