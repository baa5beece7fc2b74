"""Queries over event grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.catalog.registry import query, r6
from sigframe.functions import cells as c
from sigframe.operators import grid as g
from sigframe.plans import views as v
from sigframe.plans.views import oracle

NORM = """nc AS (SELECT pattern, "row", channel, note, instr, volcmd,
    CASE WHEN volcmd = 0 AND note NOT IN (251, 252) THEN 0 ELSE vol END AS vol, command,
    CASE WHEN command = 0 AND note NOT IN (251, 252) THEN 0 ELSE param END AS param FROM cell)"""
HEAD = 'head AS (SELECT pattern, max("row") + 1 AS "rows" FROM cell GROUP BY 1)'


@query("cell_class", "P1", oracle("cell", """SELECT pattern, "row", CASE
    WHEN note = 0 AND instr = 0 AND volcmd = 0 AND command = 0 THEN 'empty'
    WHEN note BETWEEN 1 AND 128 THEN 'note' WHEN note IN (251, 252) THEN 'param_note'
    WHEN note BETWEEN 251 AND 255 THEN 'special' WHEN note = 0 THEN 'no_note' ELSE 'invalid' END AS class FROM cell"""))
def _(spark, d):
    return v.cell(spark, d).select("pattern", "row", c.cell_class().alias("class"))


@query("cell_predicates", "P2", oracle("cell", """SELECT pattern, "row",
    command IN (4, 6, 55) OR volcmd = 11 AS tone_porta, command IN (11, 7, 6) AS volume_slide,
    NOT (note BETWEEN 1 AND 128) OR (note >= 49 AND note < 85) AS amiga_note FROM cell"""))
def _(spark, d):
    return v.cell(spark, d).select(
        "pattern",
        "row",
        c.is_tone_porta().alias("tone_porta"),
        c.is_volume_slide().alias("volume_slide"),
        c.is_amiga_note().alias("amiga_note"),
    )


@query("pack_value", "P3", oracle("cell", """SELECT pattern, "row", volcmd * 256 + vol AS vol_col, command * 256 + param AS fx_col,
    command AS fx_back, param AS param_back FROM cell"""))
def _(spark, d):
    fx = c.pack_value(F.col("command"), F.col("param"))
    return v.cell(spark, d).select(
        "pattern",
        "row",
        c.pack_value(F.col("volcmd"), F.col("vol")).alias("vol_col"),
        fx.alias("fx_col"),
        c.unpack_high(fx).alias("fx_back"),
        c.unpack_low(fx).alias("param_back"),
    )


@query("cell_key", "P4", oracle("cell", NORM, """SELECT note, instr, volcmd, vol, command, param, count(*) AS cells
    FROM nc GROUP BY ALL"""))
def _(spark, d):
    keyed = v.cell(spark, d).select(c.cell_key().alias("k")).select("k.*")
    return keyed.groupBy(*c.FIELDS).agg(F.count(F.lit(1)).alias("cells"))


@query("valid_signature", "P5", """SELECT p_partkey, p_size % 9 AS rpb, p_size AS rpm,
    p_size % 9 > 0 AND p_size % 9 <= 8 AND p_size % 9 <= p_size AND p_size <= 40 AS ok FROM part""")
def _(spark, d):
    p = v.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 9).alias("rpb"), F.col("p_size").alias("rpm"))
    return p.withColumn("ok", c.valid_signature(F.col("rpb"), F.col("rpm"), 8, 40))


SPEC = g.FindSpec(note=(20, 90), vol=(5, 40), channel=(1, 3), selection=(0, 5, 0, 3))


@query("find_cells", "P6", oracle("cell", """SELECT * FROM cell WHERE note BETWEEN 20 AND 90 AND vol BETWEEN 5 AND 40
    AND channel BETWEEN 1 AND 3 AND "row" BETWEEN 0 AND 5"""))
def _(spark, d):
    return g.find_cells(v.cell(spark, d), SPEC)


@query("replace_cells", "P7", oracle("cell", """SELECT pattern, "row", channel,
    CAST(CASE WHEN hit AND note BETWEEN 1 AND 128 THEN least(greatest(note + 12, 1), 128) ELSE note END AS BIGINT) AS note,
    CASE WHEN hit THEN 7 ELSE instr END AS instr, volcmd,
    CAST(CASE WHEN hit THEN least((vol * 150 + 50) // 100, 255) ELSE vol END AS BIGINT) AS vol, command,
    CASE WHEN hit THEN least(greatest(param - 100, 0), 255) ELSE param END AS param
    FROM (SELECT *, note BETWEEN 20 AND 90 AND vol BETWEEN 5 AND 40 AND channel BETWEEN 1 AND 3 AND "row" BETWEEN 0 AND 5 AS hit FROM cell)"""))
def _(spark, d):
    repl = {
        "note": g.Replace("relative", g.OCTAVE_UP),
        "instr": g.Replace("set", 7),
        "vol": g.Replace("multiply", 150),
        "param": g.Replace("relative", -100),
    }
    return g.replace_cells(v.cell(spark, d), SPEC, repl)


@query("map_cells", "E6", oracle("cell", """SELECT pattern, "row", channel, note, instr, volcmd,
    least(vol * 2, 64) AS vol, command, param FROM cell"""))
def _(spark, d):
    return g.map_cells(v.cell(spark, d), lambda x: {"vol": F.least(x["vol"] * 2, F.lit(64)).cast("long")})


@query("expand", "W18", oracle("cell", HEAD, """SELECT pattern, CASE WHEN "rows" * 2 <= 12 THEN "row" * 2 ELSE "row" END AS "row",
    channel, note, instr, volcmd, vol, command, param FROM cell JOIN head USING (pattern)"""))
def _(spark, d):
    cells = v.cell(spark, d)
    return g.expand(cells, g.pattern_rows(cells), 12)


@query("shrink", "W18", oracle("cell", HEAD,
    'sc AS (SELECT * FROM cell JOIN head USING (pattern))',
    """pr AS (SELECT coalesce(a.pattern, b.pattern) AS pattern, coalesce(a."row" // 2, b."row" // 2) AS "row", coalesce(a.channel, b.channel) AS channel,
      coalesce(a.note, 0) AS an, coalesce(a.instr, 0) AS ai, coalesce(a.volcmd, 0) AS avc, coalesce(a.vol, 0) AS av, coalesce(a.command, 0) AS ac, coalesce(a.param, 0) AS ap,
      coalesce(b.note, 0) AS bn, coalesce(b.instr, 0) AS bi, coalesce(b.volcmd, 0) AS bvc, coalesce(b.vol, 0) AS bv, coalesce(b.command, 0) AS bc, coalesce(b.param, 0) AS bp
      FROM (SELECT * FROM sc WHERE "rows" >= 4 AND "row" // 2 < "rows" // 2 AND "row" % 2 = 0) a
      FULL JOIN (SELECT * FROM sc WHERE "rows" >= 4 AND "row" // 2 < "rows" // 2 AND "row" % 2 = 1) b
      ON a.pattern = b.pattern AND a.channel = b.channel AND a."row" // 2 = b."row" // 2)""",
    """al AS (SELECT pattern, "row", channel, note, instr, volcmd, vol, command, param FROM sc WHERE "rows" < 4 UNION ALL
      SELECT pattern, "row", channel, CASE WHEN f THEN bn ELSE an END, CASE WHEN f THEN bi ELSE ai END,
      CASE WHEN f AND bvc <> 0 THEN bvc ELSE avc END, CASE WHEN f AND bvc <> 0 THEN bv ELSE av END,
      CASE WHEN f AND ac = 0 THEN bc ELSE ac END, CASE WHEN f AND ac = 0 THEN bp ELSE ap END FROM (SELECT *, an = 0 AND ai = 0 AS f FROM pr))""",
    "SELECT * FROM al WHERE NOT (note = 0 AND instr = 0 AND volcmd = 0 AND command = 0)"))
def _(spark, d):
    cells = v.cell(spark, d)
    return g.shrink(cells, g.pattern_rows(cells), 2)


@query("resize_pattern", "W19", oracle("cell", HEAD, """SELECT pattern, "row" + 4 - "rows" AS "row", channel, note, instr, volcmd, vol,
    command, param FROM cell JOIN head USING (pattern) WHERE "row" + 4 - "rows" BETWEEN 0 AND 3"""))
def _(spark, d):
    cells = v.cell(spark, d)
    out, _ = g.resize_pattern(cells, g.pattern_rows(cells), 4, 1, 64, at_end=False)
    return out


_MASK = """mk AS (SELECT *,
    CASE WHEN note <> coalesce(lag(note) OVER w, 0) THEN 1 ELSE 0 END + CASE WHEN instr <> coalesce(lag(instr) OVER w, 0) THEN 2 ELSE 0 END
    + CASE WHEN volcmd <> coalesce(lag(volcmd) OVER w, 0) THEN 4 ELSE 0 END + CASE WHEN vol <> coalesce(lag(vol) OVER w, 0) THEN 8 ELSE 0 END
    + CASE WHEN command <> coalesce(lag(command) OVER w, 0) THEN 16 ELSE 0 END + CASE WHEN param <> coalesce(lag(param) OVER w, 0) THEN 32 ELSE 0 END AS mask
    FROM cell WINDOW w AS (PARTITION BY pattern, channel ORDER BY "row"))"""


@query("change_mask", "W20", oracle("cell", _MASK, "SELECT * REPLACE (CAST(mask AS BIGINT) AS mask) FROM mk"))
def _(spark, d):
    return g.change_mask(v.cell(spark, d))


@query("forward_fill", "W20", oracle("cell", _MASK, "SELECT * REPLACE (CAST(mask AS BIGINT) AS mask) FROM mk"))
def _(spark, d):
    masked = g.change_mask(v.cell(spark, d))
    blanked = masked.withColumns(
        {f: F.when(F.col("mask").bitwiseAND(F.lit(b)) != 0, F.col(f)).otherwise(0).cast("long") for f, b in g.MASK_BITS.items()}
    )
    return g.forward_fill(blanked)


@query("duplicate_patterns", "G13", oracle("cell",
    """gs AS (SELECT pattern, string_agg("row" || ':' || (1 + vol % 3), ',' ORDER BY "row") AS grid FROM cell GROUP BY 1)""",
    "tw AS (SELECT pattern, min(pattern) OVER (PARTITION BY grid) AS same_as, count(*) OVER (PARTITION BY grid) AS members FROM gs)",
    "SELECT * FROM tw WHERE members > 1"))
def _(spark, d):
    zero = F.lit(0).cast("long")
    blank = {k: zero for k in ("channel", "instr", "volcmd", "command", "param")}
    coarse = v.cell(spark, d).withColumns({**blank, "note": 1 + F.col("vol") % 3}).withColumn("vol", zero)
    return g.duplicate_patterns(coarse)


@query("common_cells", "U2", oracle("cell", NORM,
    """SELECT "row", channel, note, instr, volcmd, vol, command, param FROM nc WHERE note <= 80
    INTERSECT SELECT "row", channel, note, instr, volcmd, vol, command, param FROM nc WHERE note > 40"""))
def _(spark, d):
    cells = v.cell(spark, d)
    return g.common_cells(cells.filter("note <= 80"), cells.filter("note > 40"))


@query("only_in_a", "U2", oracle("cell", NORM,
    "SELECT \"row\", channel, note, instr, volcmd, vol, command, param FROM nc EXCEPT ALL SELECT \"row\", channel, note, instr, volcmd, vol, command, param FROM nc WHERE note > 64"))
def _(spark, d):
    cells = v.cell(spark, d)
    return g.only_in_a(cells, cells.filter("note > 64"))


@query("trace_diff", "J14", oracle("cell",
    'ta AS (SELECT pattern, "row", note, vol FROM cell WHERE vol <= 45)',
    'tb AS (SELECT pattern, "row", CASE WHEN pattern % 5 = 0 THEN note + 1 ELSE note END AS note, vol FROM cell WHERE vol >= 5)',
    """SELECT pattern, "row", CASE WHEN tb.vol IS NULL THEN 'only_a' WHEN ta.vol IS NULL THEN 'only_b' ELSE 'changed' END AS status,
    ta.note AS a_note, tb.note AS b_note, ta.vol AS a_vol, tb.vol AS b_vol FROM ta FULL JOIN tb USING (pattern, "row")
    WHERE ta.note IS DISTINCT FROM tb.note OR ta.vol IS DISTINCT FROM tb.vol"""))
def _(spark, d):
    cells = v.cell(spark, d)
    a = cells.filter("vol <= 45")
    b = cells.filter("vol >= 5").withColumn(
        "note", F.when(F.col("pattern") % 5 == 0, F.col("note") + 1).otherwise(F.col("note"))
    )
    return g.trace_diff(a, b, ["pattern", "row"], ["note", "vol"])


@query("unused_entities", "J15", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(spark, d):
    refs = v.table(spark, d, "lineitem").filter("l_quantity > 45")
    return g.unused_entities(v.table(spark, d, "part").select("p_partkey"), refs, "p_partkey", "l_partkey")


@query("used_entities", "J15", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(spark, d):
    refs = v.table(spark, d, "lineitem").filter("l_quantity > 45")
    return g.used_entities(v.table(spark, d, "part").select("p_partkey"), refs, "p_partkey", "l_partkey")


@query("usage_cube", "G20", oracle("cell", """SELECT pattern, channel, kind, count(*) AS uses, CAST(grouping(pattern, channel, kind) AS BIGINT) AS level
    FROM (SELECT pattern % 50 AS pattern, channel, CASE command % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'global' WHEN 2 THEN 'volume'
    WHEN 3 THEN 'panning' ELSE 'pitch' END AS kind FROM cell) GROUP BY CUBE (pattern, channel, kind)"""))
def _(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in g.EFFECT_TYPES]), (F.col("command") % 5).cast("int") + 1)
    return g.usage_cube(v.cell(spark, d).withColumn("pattern", F.col("pattern") % 50), kind)


@query("entity_counts", "G22", oracle("cell", """SELECT count(DISTINCT channel) AS channels, count(DISTINCT pattern) AS patterns,
    count(DISTINCT instr) AS instrs, count(DISTINCT note) AS notes FROM cell"""))
def _(spark, d):
    return g.entity_counts(v.cell(spark, d))


_STATE = [
    HEAD,
    'ev AS (SELECT h.pattern, r AS "row" FROM head h, range(0, 1000) t(r) WHERE r < h."rows")',
    """mk AS (SELECT pattern, "row", arg_max(param, CASE WHEN command = 16 AND param > 0 THEN channel END) AS sp,
        arg_max(param, CASE WHEN command = 17 AND param > 0 THEN channel END) AS te FROM cell GROUP BY 1, 2)""",
    """st AS (SELECT pattern, "row", coalesce(last_value(sp IGNORE NULLS) OVER w, 6) AS speed, coalesce(last_value(te IGNORE NULLS) OVER w, 125) AS tempo
        FROM ev LEFT JOIN mk USING (pattern, "row") WINDOW w AS (PARTITION BY pattern ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "ln AS (SELECT *, speed * 2.5::DOUBLE / tempo AS seconds FROM st)",
    """tl AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY pattern ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ln)""",
]


@query("timeline", "W23", oracle("cell", *_STATE,
    'SELECT pattern, "row", speed, tempo, round(seconds, 6) AS seconds, round(start, 6) AS start FROM tl'))
def _(spark, d):
    cells = v.cell(spark, d)
    t = g.timeline(cells, g.pattern_rows(cells))
    return t.select("pattern", "row", "speed", "tempo", r6(F.col("seconds")).alias("seconds"), r6(F.col("start")).alias("start"))


@query("position_at", "W24", oracle("cell", *_STATE,
    "q AS (SELECT pattern, (pattern % 7) * 0.0701::DOUBLE AS sec FROM head)",
    'SELECT q.pattern, round(sec, 6) AS sec, tl."row" FROM q JOIN tl ON tl.pattern = q.pattern AND sec >= start AND sec < start + seconds'))
def _(spark, d):
    cells = v.cell(spark, d)
    head = g.pattern_rows(cells)
    asked = head.select("pattern", ((F.col("pattern") % 7) * F.lit(0.0701)).alias("sec"))
    return g.position_at(g.timeline(cells, head), asked).withColumn("sec", r6(F.col("sec")))


# Test limits in the shape of a format table: note range, special notes, one character per command.
FORMATS = [
    ("small", 37, 96, False, False, False, False, " abcdefghi?klmnop" + "?" * 41, " vpc??a?????????"),
    ("large", 1, 120, True, True, True, False, " " + "x" * 40 + "?" * 17, " vpc?ab?hl??????"),
    ("full", 1, 120, True, True, True, True, " " + "x" * 57, " abcdefgh??ijk?l"),
]


@query("conformance", "J5", oracle("cell",
    "specs(format, note_min, note_max, note_cut, note_off, note_fade, param_notes, commands, volcommands) AS (VALUES "
    + ", ".join(str(f).replace("True", "true").replace("False", "false") for f in FORMATS) + ")",
    """v1 AS (SELECT format, pattern, "row", channel, unnest(list_filter([
    CASE WHEN NOT (note = 0 OR note BETWEEN note_min AND note_max OR CASE note WHEN 254 THEN note_cut WHEN 255 THEN note_off WHEN 253 THEN note_fade
      WHEN 252 THEN param_notes WHEN 251 THEN param_notes ELSE false END) THEN 'note' END,
    CASE WHEN substr(commands, command + 1, 1) IN ('?', '') THEN 'command' END,
    CASE WHEN substr(volcommands, volcmd + 1, 1) IN ('?', '') THEN 'volcmd' END], lambda x: x IS NOT NULL)) AS violation FROM cell, specs)""",
    "SELECT * FROM v1"))
def _(spark, d):
    return g.conformance(v.cell(spark, d), [g.FormatSpec(*f) for f in FORMATS])


@query("next_on_free_row", "U9", oracle("cell", HEAD,
    'ta AS (SELECT pattern, least("rows" - 1, pattern % 3) AS f, "rows" FROM head)',
    'sl AS (SELECT pattern, r AS "row", ch AS channel FROM ta, range(0, 1000) t(r), range(4) c(ch) WHERE r >= f AND r < "rows")',
    """rk AS (SELECT sl.pattern, sl."row", sl.channel, CASE WHEN coalesce(command, 0) = 14 THEN 0 WHEN coalesce(command, 0) = 0 THEN 1
       WHEN coalesce(command, 0) IN (13, 9) THEN 2 END AS rank FROM sl LEFT JOIN cell USING (pattern, "row", channel))""",
    'be AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY "row", rank, channel) AS k FROM rk WHERE rank IS NOT NULL)',
    """SELECT pattern, "row", channel, CASE rank WHEN 0 THEN 'present' WHEN 1 THEN 'free' ELSE 'moved_to_volume' END AS action, 14 AS command, 0 AS param FROM be WHERE k = 1"""))
def _(spark, d):
    cells = v.cell(spark, d)
    head = g.pattern_rows(cells)
    target = head.select("pattern", F.least(F.col("rows") - 1, F.col("pattern") % 3).alias("row"))
    return g.write_effect(cells, head, target, c.FX_PATTERN_BREAK, 0, 4)


# One effect per mode of the search.
_MODES = {
    "effect_previous_row": g.Effect(c.FX_SPEED, 6, retry="previous"),
    "effect_fixed_channel": g.Effect(c.FX_TEMPO, 125, channel=2, retry="next"),
    "effect_same_row_only": g.Effect(c.FX_PATTERN_BREAK, 0, retry="none", multiple=True),
    "effect_converted": g.Effect(c.FX_PANNING8, 130, retry="next", channel=1),
    "volume_effect_converted": g.Effect(c.VOL_VOLUME, 40, volume=True, retry="previous", channel=0),
}


def _mode_sql(e: g.Effect) -> str:
    lo, hi = (0, 3) if e.channel is None else (e.channel, e.channel)
    ways, values = [], []
    for kind, forms in enumerate(e.forms()):
        tests = []
        for x in forms:
            own, name = "volcmd" if x.volume else "command", "" if x.volume == e.volume else "converted_"
            if not x.multiple:
                tests.append((f"coalesce({own}, 0) = {x.command}", name + "present", x))
            tests.append((f"coalesce({own}, 0) = 0", name + "free", x))
            if x is forms[0] and not x.volume:
                tests.append((f"coalesce({own}, 0) IN (13, 9)", name + "moved_to_volume", x))
        for rank, (test, action, x) in enumerate(tests):
            ways.append(f"CASE WHEN kind = {kind} AND {test} THEN {10 * kind + rank} END")
            values.append(f"({10 * kind + rank}, '{action}', {x.command}, {x.param}, {str(x.volume).lower()})")
    step = {"next": "r >= f", "previous": "r <= f", "none": "r = f"}[e.retry]
    return oracle("cell", HEAD,
        'ta AS (SELECT pattern, least("rows" - 1, pattern % 3 + 3) AS f, "rows" FROM head)',
        f"""sl AS (SELECT pattern, r AS row_no, abs(r - f) AS far, CASE WHEN r = f THEN 0 WHEN abs(r - f) % 2 = 1 THEN 1 ELSE 2 END AS kind, ch AS channel FROM ta, range(0, 1000) t(r), range({lo}, {hi + 1}) c(ch)
        WHERE r < "rows" AND {step})""",
        f"""ca AS (SELECT sl.pattern, far, row_no, sl.channel, unnest([{', '.join(ways)}]) AS way FROM sl LEFT JOIN cell ON cell.pattern = sl.pattern AND cell."row" = row_no AND cell.channel = sl.channel)""",
        "ok AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY far, way, channel) AS k FROM ca WHERE way IS NOT NULL)",
        f"w(way, action, command, param, in_volume) AS (VALUES {', '.join(values)})",
        'SELECT pattern, row_no AS "row", channel, action, command, param, in_volume FROM ok JOIN w USING (way) WHERE k = 1')


def _register_mode(name: str, e: g.Effect) -> None:
    @query(name, "U9", _mode_sql(e))
    def _(spark, d):
        cells = v.cell(spark, d)
        head = g.pattern_rows(cells)
        target = head.select("pattern", F.least(F.col("rows") - 1, F.col("pattern") % 3 + 3).alias("row"))
        return g.place_effect(cells, head, target, e, 4)


for _name, _effect in _MODES.items():
    _register_mode(_name, _effect)
