"""Queries for recursive filters, transforms and long convolutions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from sigframe.catalog.registry import query, r6
from sigframe.operators import filters as fl
from sigframe.operators import transforms
from sigframe.operators.signal_ops import window_frames
from sigframe.plans import views as v
from sigframe.plans.views import oracle

BLOCK = 48  # short blocks, so that the test signals span several


def _out(df, digits=6):
    return df.select("signal_id", "channel", "n", r6(F.col("y"), digits).alias("y"))


def _recursion(sections, src="sig"):
    """Oracle: one recursive step per sample, all sections inside it."""
    cols, init, step = ["signal_id", "n", "x0", "x1"], ["signal_id", "n", "x", "0.0::DOUBLE"], ["s.signal_id", "s.n", "s.x", "r.x0"]
    cur, hist = ("s.x", "x"), ("r.x0", "r.x1")
    for i, s in enumerate(sections):
        a, b = f"y{i}", f"z{i}"
        cols += [a, b]
        rec = f"({s.b0}::DOUBLE * {cur[0]} + {s.b1}::DOUBLE * {hist[0]} + {s.b2}::DOUBLE * {hist[1]} + {s.a1}::DOUBLE * r.{a} + {s.a2}::DOUBLE * r.{b})"
        start = f"({s.b0}::DOUBLE * {cur[1]})"
        init += [start, "0.0::DOUBLE"]
        step += [rec, f"r.{a}"]
        direct = f" + {s.direct}::DOUBLE * "
        cur = (f"({rec}{direct}{cur[0]})", f"({start}{direct}{cur[1]})") if s.direct else (rec, start)
        hist = (f"r.{a}", f"r.{b}")
    cols.append("outp")
    return f"""rec({', '.join(cols)}) AS (SELECT {', '.join(init)}, {cur[1]} FROM {src} WHERE n = 0 UNION ALL
        SELECT {', '.join(step)}, {cur[0]} FROM rec r JOIN {src} s ON s.signal_id = r.signal_id AND s.n = r.n + 1)"""


def _oracle(sections, digits=6):
    """The input is the signal times pi, so that no exact result ends in a 5 at the rounding digit."""
    scaled = "ps AS (SELECT signal_id, n, x * pi() AS x FROM sig)"
    return oracle("sig", scaled, _recursion(sections, "ps"), f"SELECT signal_id, 0 AS channel, n, round(outp, {digits}) + 0.0 AS y FROM rec")


def _input(spark, d):
    return v.sig(spark, d).withColumn("x", F.col("x") * F.lit(math.pi))


@query("affine_scan", "W11", _oracle([fl.Section(b0=0.5, a1=0.97)]))
def _(spark, d):
    return _out(fl.affine_scan(_input(spark, d), 0.97, 0.5, size=BLOCK))


@query("affine_scan_two_pole", "W11", _oracle([fl.Section(b0=0.1, a1=1.6, a2=-0.8)]))
def _(spark, d):
    return _out(fl.affine_scan(_input(spark, d), 1.6, 0.1, -0.8, size=BLOCK))


@query("dc_block", "W12", _oracle([fl.Section(b0=1 - 2**-10, b1=-(1 - 2**-10), a1=1 - 2**-9)]))
def _(spark, d):
    return _out(fl.dc_block(_input(spark, d), size=BLOCK))


BANDS = [(120.0, 1.5), (600.0, 1.0), (1200.0, 0.5), (3000.0, 2.0), (6000.0, 0.8), (21000.0, 1.7)]


@query("eq6", "W13", _oracle([s for s in (fl.eq_section(f, g, 44100) for f, g in BANDS) if s]))
def _(spark, d):
    return _out(fl.eq6(_input(spark, d), BANDS, 44100, size=BLOCK))


@query("resonant_filter", "W14", _oracle(fl.resonant_sections(90, 60, 44100)))
def _(spark, d):
    return _out(fl.resonant_filter(_input(spark, d), 90, 60, 44100, size=BLOCK))


@query("resonant_high_pass", "W14", _oracle(fl.resonant_sections(70, 30, 44100, True), 3))
def _(spark, d):
    return _out(fl.resonant_filter(_input(spark, d), 70, 30, 44100, True, size=BLOCK), 3)


@query("resonant_classic", "W14", _oracle(fl.resonant_sections(90, 60, 44100, modifier=-40, classic=True)))
def _(spark, d):
    return _out(fl.resonant_filter(_input(spark, d), 90, 60, 44100, modifier=-40, classic=True, size=BLOCK))


@query("resonant_open", "W14", oracle("sig", "SELECT signal_id, channel, n, round(x, 6) + 0.0 AS y FROM sig"))
def _(spark, d):
    return _out(fl.resonant_filter(v.sig(spark, d), 127, 0, 44100, modifier=256, classic=True, size=BLOCK))


_G = math.sqrt(1 - 0.25)


@query("echo", "W15", oracle("sig",
    f"""rec(signal_id, n, x, dl) AS (SELECT signal_id, n, x, {_G}::DOUBLE * x FROM sig WHERE n < 7 UNION ALL
      SELECT s.signal_id, s.n, s.x, {_G}::DOUBLE * s.x + 0.5 * r.dl FROM rec r JOIN sig s ON s.signal_id = r.signal_id AND s.n = r.n + 7)""",
    "SELECT a.signal_id, 0 AS channel, a.n, round(a.x * 0.6 + coalesce(b.dl, 0) * 0.4, 6) + 0.0 AS y FROM rec a LEFT JOIN rec b ON b.signal_id = a.signal_id AND b.n = a.n - 7"))
def _(spark, d):
    return _out(fl.echo(v.sig(spark, d), 7, 0.5, 0.4, size=BLOCK))


@query("cross_echo", "W15", oracle("stereo",
    f"""rec(signal_id, n, l, r, dl, dr) AS (SELECT signal_id, n, l, r, {_G}::DOUBLE * l, {_G}::DOUBLE * r FROM stereo WHERE n < 5 UNION ALL
      SELECT s.signal_id, s.n, s.l, s.r, {_G}::DOUBLE * s.l + 0.5 * q.dr, {_G}::DOUBLE * s.r + 0.5 * q.dl FROM rec q JOIN stereo s ON s.signal_id = q.signal_id AND s.n = q.n + 5)""",
    "j AS (SELECT a.signal_id, a.n, a.l, a.r, coalesce(b.dl, 0) AS dl, coalesce(b.dr, 0) AS dr FROM rec a LEFT JOIN rec b ON b.signal_id = a.signal_id AND b.n = a.n - 5)",
    """SELECT signal_id, 0 AS channel, n, round(l * 0.6 + dr * 0.4, 6) + 0.0 AS y FROM j UNION ALL SELECT signal_id, 1, n, round(r * 0.6 + dl * 0.4, 6) + 0.0 FROM j"""))
def _(spark, d):
    s = v.stereo(spark, d).select("signal_id", "n", F.posexplode(F.array("l", "r")).alias("channel", "x"))
    return _out(fl.echo(s, 5, 0.5, 0.4, cross=True, size=BLOCK))


_TAPS = [float(x) for x in np.hanning(22)[1:-1] / 10]


@query("convolve_blocks", "J16", oracle("sig", "tp AS (SELECT k, [" + ", ".join(f"{t}::DOUBLE" for t in _TAPS) + "][k + 1] AS h FROM range(20) t(k))",
    "SELECT s.signal_id, s.channel, s.n + 0 AS n, round(sum(h * p.x), 6) + 0.0 AS y FROM sig s JOIN tp ON true JOIN sig p ON p.signal_id = s.signal_id AND p.n = s.n - k GROUP BY 1, 2, 3"))
def _(spark, d):
    return _out(fl.convolve_blocks(v.sig(spark, d), _TAPS, size=BLOCK))


@query("dft", "A8", """WITH x AS (SELECT vec_id, k, embedding[k + 1]::DOUBLE AS x FROM embeddings, range(64) t(k))
    SELECT vec_id, CAST(b AS INTEGER) AS bin, round(sum(x * cos(2 * pi() * b * k / 64)), 5) + 0.0 AS re, round(-sum(x * sin(2 * pi() * b * k / 64)), 5) + 0.0 AS im FROM x, range(33) t(b) GROUP BY 1, 2""")
def _(spark, d):
    e = v.table(spark, d, "embeddings").select("vec_id", transforms.dft(F.col("embedding")).alias("z"))
    return e.select("vec_id", F.posexplode("z").alias("bin", "z")).select("vec_id", "bin", r6(F.col("z.re"), 5).alias("re"), r6(F.col("z.im"), 5).alias("im"))


@query("idft", "A8", "SELECT vec_id, CAST(k AS INTEGER) AS k, round(embedding[k + 1]::DOUBLE, 6) + 0.0 AS x FROM embeddings, range(64) t(k)")
def _(spark, d):
    z = v.table(spark, d, "embeddings").select("vec_id", transforms.dft(F.col("embedding")).alias("z"))
    back = transforms.idft(F.transform("z", lambda c: c["re"]), F.transform("z", lambda c: c["im"]))
    return z.select("vec_id", F.posexplode(back).alias("k", "x")).withColumn("x", r6(F.col("x")))


@query("dft_any_length", "A8", """WITH f AS (SELECT vec_id, 3 + vec_id % 61 AS n, embedding[1 : 3 + vec_id % 61] AS e FROM embeddings), x AS (SELECT vec_id, n, k, e[k + 1]::DOUBLE AS x FROM f, range(64) t(k) WHERE k < n)
    SELECT vec_id, CAST(b AS INTEGER) AS bin, round(sum(x * cos(2 * pi() * ((b * k) % n) / n)), 5) + 0.0 AS re, round(-sum(x * sin(2 * pi() * ((b * k) % n) / n)), 5) + 0.0 AS im FROM x, range(33) t(b) WHERE b <= n // 2 GROUP BY 1, 2""")
def _(spark, d):
    e = v.table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, (F.col("vec_id") % 61 + 3).cast("int")).alias("e"))
    z = e.select("vec_id", F.posexplode(transforms.dft(F.col("e"))).alias("bin", "z"))
    return z.select("vec_id", "bin", r6(F.col("z.re"), 5).alias("re"), r6(F.col("z.im"), 5).alias("im"))


@query("overlap_add", "A8", oracle("sig",
    "len AS (SELECT signal_id, max(n) + 1 AS frames FROM sig GROUP BY 1)",
    "f AS (SELECT signal_id, n, x FROM sig JOIN len USING (signal_id), range(2000) t(k) WHERE n BETWEEN k * 8 AND k * 8 + 15 AND k * 8 + 16 <= frames)",
    "SELECT signal_id, n, round(sum(x), 6) + 0.0 AS x FROM f GROUP BY 1, 2"))
def _(spark, d):
    f = window_frames(v.sig(spark, d), 16, 8)
    return fl.overlap_add(f, 8, ["signal_id"]).withColumn("x", r6(F.col("x")))
