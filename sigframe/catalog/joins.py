"""Queries for lookups, remapping, routing, planning and module appending."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.catalog.registry import query, r6
from sigframe.functions import cells as c
from sigframe.operators import lookups as lk
from sigframe.operators.clicks import CleanupSettings
from sigframe.operators.modules import Module, append_modules
from sigframe.plans import views as v
from sigframe.plans.views import oracle
from sigframe.session import materialize


@query("instrument_samples", "J1", """SELECT DISTINCT vec_id AS instr, s AS sample FROM (SELECT vec_id, CAST(floor(abs(embedding[k + 1]::DOUBLE) * 100) AS BIGINT) % 30 AS s FROM embeddings, range(64) t(k))
    JOIN part ON p_partkey = s WHERE s <> 0""")
def _(spark, d):
    e = v.table(spark, d, "embeddings")
    keys = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("long") % 30)
    ins = e.select(F.col("vec_id").alias("instr"), keys.alias("keymap"))
    return lk.instrument_samples(ins, v.table(spark, d, "part").select(F.col("p_partkey").alias("sample")), "instr", "keymap", "sample")


_MISS = """refs AS (SELECT doc_id AS ref_id, 'Smp' || (doc_id * 3) % 400 || '.wav' AS name FROM documents),
    fl AS (SELECT 'lib' || page_id % 3 || '/SMP' || page_id % 200 || '.WAV' AS path FROM pages)"""


def _missing(spark, d):
    refs = v.table(spark, d, "documents").select(
        F.col("doc_id").alias("ref_id"), F.concat(F.lit("Smp"), (F.col("doc_id") * 3) % 400, F.lit(".wav")).alias("name")
    )
    k = F.col("page_id")
    fl = v.table(spark, d, "pages").select(F.concat(F.lit("lib"), k % 3, F.lit("/SMP"), k % 200, F.lit(".WAV")).alias("path"))
    return lk.resolve_missing(refs, fl)


@query("resolve_missing", "J3", f"""WITH {_MISS} SELECT ref_id, name, min(path) AS path FROM refs JOIN fl ON lower(name) = lower(string_split(path, '/')[-1]) GROUP BY 1, 2""")
def _(spark, d):
    return _missing(spark, d)[0]


@query("still_missing", "J3", f"""WITH {_MISS} SELECT ref_id, name FROM refs WHERE lower(name) NOT IN (SELECT lower(string_split(path, '/')[-1]) FROM fl)""")
def _(spark, d):
    return _missing(spark, d)[1]


@query("remap_ids", "J4", """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey = 0 THEN 0 ELSE coalesce(s.nw, 0) END AS l_suppkey FROM lineitem
    LEFT JOIN (SELECT s_suppkey AS k, s_suppkey * 10 + 1 AS nw FROM supplier WHERE s_acctbal > 2000) s ON s.k = l_suppkey""")
def _(spark, d):
    li = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    m = v.table(spark, d, "supplier").filter("s_acctbal > 2000").select("s_suppkey", (F.col("s_suppkey") * 10 + 1).alias("nw"))
    return lk.remap_ids(li, "l_suppkey", m, "s_suppkey", "nw")


@query("rate_band", "J7", "SELECT p_partkey, CASE WHEN p_size * 2000 <= 44100 THEN 44100 WHEN p_size * 2000 <= 72000 THEN 48000 ELSE 96000 END AS native FROM part")
def _(spark, d):
    return v.table(spark, d, "part").select("p_partkey", lk.rate_band(F.col("p_size") * 2000).alias("native"))


def _directions(spark, d):
    e = v.table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")])


@query("nearest_direction", "J6", """WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
    c AS (SELECT q.vec_id, g.vec_id AS grid_id, (q.x - g.x) * (q.x - g.x) + (q.y - g.y) * (q.y - g.y) + (q.z - g.z) * (q.z - g.z) AS d FROM v q JOIN v g ON g.label = 3 AND q.label <> 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, grid_id) AS k FROM c) SELECT vec_id, grid_id, round(sqrt(d), 6) AS dist FROM r WHERE k = 1""")
def _(spark, d):
    p = _directions(spark, d)
    grid = p.filter("label = 3").select(F.col("vec_id").alias("grid_id"), "x", "y", "z")
    out = lk.nearest_direction(p.filter("label <> 3"), grid, ["x", "y", "z"], "vec_id", "grid_id")
    return out.withColumn("dist", r6(F.col("dist")))


RULES = [
    lk.Directive(11, 0, 7, 1, 10, False, True),
    lk.Directive(11, 3, 5, 2, 11, True, True),
    lk.Directive(11, 0, 5, 3, 12, False, False),
    lk.Directive(11, 0, 20, 4, 13, False, True),
    lk.Directive(11, 0, 7, 5, 14, True, True),
    lk.Directive(11, 0, 7, 6, 15, False, True),
    lk.Directive(13, 0, 0, 7, 16, False, True),
    lk.Directive(11, 0, 39, 8, 17, False, True),
]
_RULES_SQL = "ru(kind, channel, controller, plugin, param, capture, edit, ord) AS (VALUES " + ", ".join(
    f"({r.kind}, {r.channel}, {r.controller}, {r.plugin}, {r.param}, {str(r.capture).lower()}, {str(r.pattern_edit).lower()}, {i})"
    for i, r in enumerate(sorted(RULES, key=lambda r: r.controller))
) + ")"


@query("route_controls", "J8", oracle("controls", _RULES_SQL,
    "ev AS (SELECT stream, seq, (word >> 4) & 15 AS kind, word & 15 AS ch, (word >> 8) & 255 AS d1, (word >> 16) & 127 AS d2 FROM controls)",
    """hit AS (SELECT e.*, r.plugin, r.param, r.capture, r.edit, r.ord FROM ev e JOIN ru r ON r.kind = e.kind AND (r.channel = 0 OR r.channel = e.ch + 1)
      AND (e.kind <> 11 OR r.controller = e.d1 OR (r.controller < 32 AND r.controller + 32 = e.d1)))""",
    "cp AS (SELECT *, min(CASE WHEN capture THEN ord END) OVER (PARTITION BY stream, seq) AS cut FROM hit)",
    "kp AS (SELECT * FROM cp WHERE cut IS NULL OR ord <= cut)",
    """ag AS (SELECT stream, seq, CAST(count(*) AS INTEGER) AS matches, bool_or(capture) AS captured, arg_max(plugin, CASE WHEN edit THEN ord END) AS plugin, min(ord) AS first_ord, max(CASE WHEN edit THEN ord END) AS edit_ord,
      arg_max(param, CASE WHEN edit THEN ord END) AS param FROM kp GROUP BY 1, 2)""",
    "bf AS (SELECT stream, seq, lag(d1) OVER w AS pc, lag(d2) OVER w AS pv FROM ev JOIN ag USING (stream, seq) WHERE kind = 11 WINDOW w AS (PARTITION BY stream ORDER BY seq))",
    """SELECT e.stream, e.seq, coalesce(matches, 0) AS matches, coalesce(captured, false) AS captured, plugin, param,
      CASE WHEN plugin IS NOT NULL THEN CASE WHEN e.kind = 13 THEN e.d1 << 7
      WHEN pc < 32 AND e.d1 = pc + 32 AND first_ord = edit_ord THEN e.d2 | (pv << 7) ELSE e.d2 << 7 END END AS value FROM ev e LEFT JOIN ag USING (stream, seq) LEFT JOIN bf USING (stream, seq)"""))
def _(spark, d):
    from sigframe.functions.text import word_parts

    ev = v.controls(spark, d).select("stream", "seq", *[x.alias(k) for k, x in word_parts(F.col("word")).items()])
    return lk.route_controls(ev, RULES).select("stream", "seq", "matches", "captured", "plugin", "param", "value")


ENGINES = [
    lk.EngineSpec("wide", "wide-1", 48000, 5, 5.12),
    lk.EngineSpec("narrow", "narrow-2", 16000, 5, 0.0),
    lk.EngineSpec("mid", "mid-1", 24000, 4, 1.0),
]


@query("plan_jobs", "J9", """SELECT p_partkey, name, cache_id, round(greatest(p_size / 10.0::DOUBLE, mins), 6) AS padded_seconds FROM part,
    (VALUES ('wide', 'wide-1', 48000, 5.12::DOUBLE), ('narrow', 'narrow-2', 16000, 0.0::DOUBLE), ('mid', 'mid-1', 24000, 1.0::DOUBLE)) e(name, cache_id, rate, mins) WHERE p_size * 1000 < rate""")
def _(spark, d):
    items = v.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 1000).alias("rate"), (F.col("p_size") / 10.0).alias("seconds"))
    return lk.plan_jobs(items, "rate", "seconds", ENGINES).select("p_partkey", "name", "cache_id", r6(F.col("padded_seconds")).alias("padded_seconds"))


@query("pending_jobs", "J10", """WITH j AS (SELECT doc_id, md5(text) AS content_hash, 'wide-1' AS cache_id, CAST(doc_id % 7 AS INTEGER) AS cleanup_tag FROM documents)
    SELECT doc_id, content_hash, cache_id, cleanup_tag FROM j WHERE (content_hash, cleanup_tag) NOT IN (SELECT md5(text), 1 FROM documents JOIN labels USING (doc_id) WHERE quality = 1)""")
def _(spark, d):
    t = v.table(spark, d, "documents")
    jobs = t.select("doc_id", F.md5("text").alias("content_hash"), F.lit("wide-1").alias("cache_id"), (F.col("doc_id") % 7).cast("int").alias("cleanup_tag"))
    tag = CleanupSettings.all_active()[0].tag
    good = t.join(v.table(spark, d, "labels").filter("quality = 1"), "doc_id")
    done = good.select(F.md5("text").alias("content_hash"), F.lit("wide-1").alias("cache_id"), F.lit(tag).alias("cleanup_tag"))
    return lk.pending_jobs(jobs, done)


@query("envelope_at", "J11", oracle("sig",
    "nd AS (SELECT signal_id, n AS i, n * 5 + (n * n) % 3 AS tick, CAST(floor((x + 1) * 32) AS BIGINT) AS val FROM sig)",
    "asq AS (SELECT signal_id, n * 6 AS at_tick FROM sig)",
    "f AS (SELECT a.signal_id, at_tick, min(i) AS i FROM asq a JOIN nd ON nd.signal_id = a.signal_id AND nd.tick >= at_tick GROUP BY 1, 2)",
    "la AS (SELECT signal_id, max(tick) AS tick, arg_max(val, i) AS val FROM nd GROUP BY 1)",
    """y AS (SELECT f.signal_id, at_tick, CASE WHEN at_tick = b.tick THEN b.val ELSE coalesce(p.val, 0) + (b.val - coalesce(p.val, 0)) * (at_tick - coalesce(p.tick, 0)) / (b.tick - coalesce(p.tick, 0))::DOUBLE END AS y
      FROM f JOIN nd b USING (signal_id, i) LEFT JOIN nd p ON p.signal_id = f.signal_id AND p.i = f.i - 1
      UNION ALL SELECT a.signal_id, at_tick, val FROM asq a JOIN la USING (signal_id) WHERE at_tick > tick)""",
    "SELECT signal_id, at_tick AS \"at\", round(least(greatest(y / 64.0::DOUBLE, 0), 1), 6) AS level FROM y"))
def _(spark, d):
    s = v.sig(spark, d)
    n = F.col("n")
    nodes = s.select("signal_id", n.alias("i"), (n * 5 + (n * n) % 3).alias("tick"), F.floor((F.col("x") + 1) * 32).cast("long").alias("value"))
    return lk.envelope_at(nodes, s.select("signal_id", (n * 6).alias("at")), "signal_id", slot=16).withColumn("level", r6(F.col("level")))


@query("play_length_trim", "G11", """WITH s AS (SELECT p_partkey AS sample, CAST(p_size * 40 AS BIGINT) AS length, CASE WHEN p_size % 2 = 0 THEN 2000 END AS le, p_size % 4 + 1 AS fb FROM part),
    p AS (SELECT l_partkey AS sample, max(CAST(l_quantity AS BIGINT) * 40) AS mx FROM lineitem GROUP BY 1 HAVING mx > 0),
    b AS (SELECT s.sample, length, fb, CASE WHEN coalesce(mx = le, false) THEN mx ELSE least(mx + 4, length) END AS nl FROM s JOIN p USING (sample))
    SELECT sample, length, nl AS new_length, length > nl AS trimmable, CAST(CASE WHEN length > nl THEN (length - nl) * fb ELSE 0 END AS BIGINT) AS saved FROM b""")
def _(spark, d):
    plays = v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("sample"), (F.col("l_quantity").cast("long") * 40).alias("position"))
    size = F.col("p_size")
    samples = v.table(spark, d, "part").select(
        F.col("p_partkey").alias("sample"),
        (size * 40).cast("long").alias("length"),
        F.when(size % 2 == 0, F.lit(2000)).alias("loop_end"),
        (size % 4 + 1).alias("frame_bytes"),
    )
    return lk.play_length_trim(plays, samples, 4)


@query("default_map_check", "A5", oracle("cell",
    'k AS (SELECT pattern AS instr, instr % 3 AS sample, "row" AS i, CASE WHEN pattern % 3 = 0 THEN note ELSE "row" + 1 + instr % 3 - 1 END AS note FROM cell)',
    "p AS (SELECT instr, sample, min(note - i - 1) AS lo, max(note - i - 1) AS hi FROM k WHERE sample <> 0 AND note <> 0 GROUP BY 1, 2)",
    'SELECT instr, sample, lo AS "offset" FROM p WHERE instr NOT IN (SELECT instr FROM p WHERE lo <> hi) AND lo <> 0'))
def _(spark, d):
    cells = v.cell(spark, d)
    sample = F.col("instr") % 3
    note = F.when(F.col("pattern") % 3 == 0, F.col("note")).otherwise(F.col("row") + 1 + sample - 1)
    return lk.default_map_check(cells.select(F.col("pattern").alias("instr"), sample.alias("sample"), F.col("row").alias("i"), note.alias("note")))


@query("candidate_score", "G5", oracle("frames",
    "m AS (SELECT item, engine, bin, sqrt(re * re + im * im) AS m FROM frames WHERE bin < 24)",
    "SELECT a.item, a.engine, round(corr(a.m, s.m), 6) + 0.0 AS score FROM m a JOIN m s ON s.item = a.item AND s.bin = a.bin AND s.engine = 0 WHERE a.engine <> 0 GROUP BY 1, 2"))
def _(spark, d):
    f = v.frames(spark, d)
    return lk.candidate_score(f.filter("engine <> 0"), f.filter("engine = 0").drop("engine"), 24).withColumn("score", r6(F.col("score")))


# The target is the grid with its order lists and the parts as instruments; the source is the same grid with other
# effects, one long order list, and the suppliers with a good balance as instruments.
_APPEND = [
    "cc AS (SELECT pattern, \"row\", channel, note, instr, volcmd, vol, CASE WHEN command IN (9, 13) THEN 12 ELSE command END AS command, param FROM cell)",
    "od AS (SELECT seq * 8 + ord AS o, (seq * 8 + ord) * 29 % 15000 AS pattern FROM orders_seq)",
    'hd AS (SELECT pattern, max("row") + 1 AS "rows" FROM cc GROUP BY 1)',
    "us AS (SELECT pattern, min(o) AS f FROM od GROUP BY 1)",
    'pm AS (SELECT pattern, "rows", row_number() OVER (ORDER BY f) + (SELECT max(pattern) FROM cell) AS np FROM us JOIN hd USING (pattern))',
    "pl AS (SELECT o, np, row_number() OVER (ORDER BY o) - 1 AS no FROM od JOIN pm USING (pattern))",
    "mc AS (SELECT cc.*, np FROM cc JOIN pm USING (pattern))",
    "im AS (SELECT s_suppkey AS instr, row_number() OVER (ORDER BY s_suppkey) + (SELECT max(p_partkey) FROM part) AS ni FROM supplier WHERE s_acctbal > 1000 AND s_suppkey IN (SELECT instr FROM mc WHERE instr <> 0 AND note NOT IN (251, 252)))",
    """jb AS (SELECT mc.np AS pattern, "row", channel, note, CASE WHEN note IN (251, 252) THEN mc.instr WHEN mc.instr = 0 THEN 0 ELSE coalesce(ni, 0) END AS instr, volcmd, vol,
      CASE WHEN command = 12 AND note NOT IN (251, 252) AND param < (SELECT max(o) + 1 FROM od) AND no IS NULL THEN 0 ELSE command END AS command,
      CASE WHEN command = 12 AND note NOT IN (251, 252) AND no IS NOT NULL THEN no ELSE param END AS param FROM mc LEFT JOIN im ON im.instr = mc.instr LEFT JOIN pl ON pl.o = mc.param)""",
]


def _appended(spark, d) -> Module:
    cells = materialize(v.cell(spark, d), "cells")  # used many times below
    other = cells.withColumn("command", F.when(F.col("command").isin(9, 13), 12).otherwise(F.col("command")).cast("long"))
    heads = cells.groupBy("pattern").agg((F.max("row") + 1).alias("rows"))
    o = v.orders_seq(spark, d)
    one = o.withColumn("ord", F.col("seq") * 8 + F.col("ord")).select(
        F.lit(0).cast("long").alias("seq"), "ord", (F.col("ord") * 29 % 15000).alias("pattern"), F.lit("pattern").alias("kind")
    )
    ins = v.table(spark, d, "supplier").filter("s_acctbal > 1000").select(F.col("s_suppkey").alias("instr"), F.col("s_name").alias("name"))
    base = v.table(spark, d, "part").select(F.col("p_partkey").alias("instr"), F.col("p_name").alias("name"))
    return append_modules(Module(cells, heads, o, base), Module(other, heads, one, ins), 4, min_rows=3)


@query("append_orders", "U1", oracle("cell orders_seq", *_APPEND,
    "SELECT seq, ord, pattern, kind FROM orders_seq UNION ALL SELECT (SELECT max(seq) + 1 FROM orders_seq), no, np, 'pattern' FROM pl"))
def _(spark, d):
    return _appended(spark, d).orders


@query("append_instruments", "U1", oracle("cell orders_seq", *_APPEND,
    "SELECT p_partkey AS instr, p_name AS name FROM part UNION ALL SELECT ni, s_name FROM im JOIN supplier ON s_suppkey = instr"))
def _(spark, d):
    return _appended(spark, d).instruments


@query("append_cells", "U1", oracle("cell orders_seq", *_APPEND,
    'sh AS (SELECT np AS pattern, "rows" - 1 AS f FROM pm WHERE "rows" < 3)',
    'sl AS (SELECT pattern, r AS "row", ch AS channel FROM sh, range(3) t(r), range(4) u(ch) WHERE r >= f)',
    'rk AS (SELECT sl.*, CASE WHEN coalesce(command, 0) = 14 THEN 0 WHEN coalesce(command, 0) = 0 THEN 1 WHEN command IN (13, 9) THEN 2 END AS rank FROM sl LEFT JOIN jb USING (pattern, "row", channel))',
    'bs AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY "row", rank, channel) AS k FROM rk WHERE rank IS NOT NULL)',
    "pt AS (SELECT * FROM bs WHERE k = 1 AND rank = 1)",
    """SELECT pattern, "row", channel, coalesce(note, 0) AS note, coalesce(instr, 0) AS instr, coalesce(volcmd, 0) AS volcmd, coalesce(vol, 0) AS vol,
      CASE WHEN rank IS NOT NULL THEN 14 ELSE command END AS command, CASE WHEN rank IS NOT NULL THEN 0 ELSE param END AS param FROM jb FULL JOIN pt USING (pattern, "row", channel)
      UNION ALL SELECT pattern, "row", channel, note, instr, volcmd, vol, command, param FROM cell"""))
def _(spark, d):
    return _appended(spark, d).cells.select("pattern", "row", "channel", *c.FIELDS)
