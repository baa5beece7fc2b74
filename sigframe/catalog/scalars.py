"""Queries for scalar, text, byte, phasor and array functions."""

from __future__ import annotations


from pyspark.sql import functions as F

from sigframe.catalog.registry import query, r6
from sigframe.functions import arrays as ar
from sigframe.functions import pcm, pitch, polar, text
from sigframe.plans import views as v
from sigframe.plans.views import oracle


@query("ulaw_alaw", "X4", """WITH p AS (SELECT p_partkey, p_partkey % 256 AS code, (p_partkey * 37) % 65536 - 32768 AS s FROM part),
    m AS (SELECT *, 255 - code AS u, xor(code, 85) AS a, least(abs(s) + 132, 32767) AS ux, abs(greatest(s, -32767)) AS ax FROM p),
    e AS (SELECT *, (u >> 4) & 7 AS ue, (a >> 4) & 7 AS ae,
      greatest(CAST(floor(log2(ux)) AS BIGINT) - 7, 0) AS ee, greatest(CAST(floor(log2(greatest(ax, 1))) AS BIGINT) - 7, 0) AS fe FROM m)
    SELECT p_partkey,
      CASE WHEN u >= 128 THEN -1 ELSE 1 END * ((((u & 15) << 3) + 132) * (1 << ue) - 132) AS ulaw,
      CASE WHEN a >= 128 THEN 1 ELSE -1 END * CASE WHEN ae = 0 THEN ((a & 15) << 4) + 8 ELSE (((a & 15) << 4) + 264) * (1 << (ae - 1)) END AS alaw,
      255 - (CASE WHEN s < 0 THEN 128 ELSE 0 END + ee * 16 + ((ux >> (ee + 3)) & 15)) AS ulaw_code,
      xor(CASE WHEN s < 0 THEN 0 ELSE 128 END + fe * 16 + ((ax >> greatest(fe + 3, 4)) & 15), 85) AS alaw_code FROM e""")
def _(spark, d):
    code = F.col("p_partkey") % 256
    s = (F.col("p_partkey") * 37) % 65536 - 32768
    return v.table(spark, d, "part").select(
        "p_partkey",
        pcm.ulaw_decode(code).alias("ulaw"),
        pcm.alaw_decode(code).alias("alaw"),
        pcm.ulaw_encode(s).alias("ulaw_code"),
        pcm.alaw_encode(s).alias("alaw_code"),
    )


@query("bit_crush", "X5", """SELECT l_orderkey, CAST(l_extendedprice * 100 AS BIGINT) & ~((CAST(1 AS BIGINT) << 20) - 1) AS crushed FROM lineitem""")
def _(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return v.table(spark, d, "lineitem").select("l_orderkey", pcm.bit_crush(cents, 8).alias("crushed"))


@query("note_to_freq", "X6", """SELECT p_partkey, round(440 * pow(2, (p_size - 69) / 12.0::DOUBLE), 6) AS hz,
    round(12 * log2(p_retailprice / 220.0::DOUBLE) + 57, 6) + 0.0 AS note FROM part""")
def _(spark, d):
    return v.table(spark, d, "part").select(
        "p_partkey", r6(pitch.note_to_freq(F.col("p_size"))).alias("hz"), r6(pitch.freq_to_note(F.col("p_retailprice"))).alias("note")
    )


@query("cutoff_to_freq", "X7", """WITH f AS (SELECT p_partkey, p_partkey % 128 AS cut, least(greatest(110 * pow(2, 0.25::DOUBLE + (p_partkey % 128) * (p_size + 256) / 12288.0::DOUBLE), 120), 20000, 22050) AS hz FROM part)
    SELECT p_partkey, round(hz, 6) AS hz, CAST(round(least(greatest((log2(hz * 1.01::DOUBLE / 110) - 0.25::DOUBLE) * 24, 0), 127)) AS BIGINT) AS back FROM f""")
def _(spark, d):
    hz = pitch.cutoff_to_freq(F.col("p_partkey") % 128, F.col("p_size"), 44100)
    return v.table(spark, d, "part").select("p_partkey", r6(hz).alias("hz"), pitch.freq_to_cutoff(hz * 1.01).alias("back"))


_PAIR = "pr AS (SELECT item, bin, max(re) FILTER (engine = 0) AS ar, max(im) FILTER (engine = 0) AS ai, max(re) FILTER (engine = 1) AS br, max(im) FILTER (engine = 1) AS bi FROM frames GROUP BY 1, 2)"


def _pairs(spark, d):
    f = v.frames(spark, d)
    pick = {f"{s}{p[0]}": F.max(F.when(F.col("engine") == e, F.col(p))) for e, s in ((0, "a"), (1, "b")) for p in ("re", "im")}
    return f.groupBy("item", "bin").agg(*[c.alias(k) for k, c in pick.items()])


@query("to_polar", "X10", oracle("frames", """SELECT item, engine, bin, round(sqrt(re * re + im * im), 6) AS r, round(atan2(im, re), 6) + 0.0 AS theta,
    round(re, 6) + 0.0 AS re_back, round(im, 6) + 0.0 AS im_back FROM frames"""))
def _(spark, d):
    r, th = polar.to_polar(F.col("re"), F.col("im"))
    x, y = polar.from_polar(F.col("r"), F.col("theta"))
    f = v.frames(spark, d).withColumns({"r": r, "theta": th})
    return f.select("item", "engine", "bin", *[r6(c).alias(k) for k, c in (("r", F.col("r")), ("theta", F.col("theta")), ("re_back", x), ("im_back", y))])


_ARC = "CASE WHEN dd > pi() THEN dd - 2 * pi() WHEN dd <= -pi() THEN dd + 2 * pi() ELSE dd END"


@query("shortest_arc", "X8", oracle("frames", _PAIR, "q AS (SELECT *, fmod(3 * atan2(bi, br) - atan2(ai, ar), 2 * pi()) AS dd FROM pr)",
    f"SELECT item, bin, round({_ARC}, 6) + 0.0 AS arc FROM q"))
def _(spark, d):
    arc = polar.shortest_arc(F.atan2("ai", "ar"), F.atan2("bi", "br") * 3)
    return _pairs(spark, d).select("item", "bin", r6(arc).alias("arc"))


@query("polar_lerp", "X9", oracle("frames", _PAIR,
    """q AS (SELECT *, sqrt(ar * ar + ai * ai) * 0.7 + sqrt(br * br + bi * bi) * 0.3 AS r, atan2(ai * 0.7 + bi * 0.3, ar * 0.7 + br * 0.3) AS th FROM pr)""",
    "SELECT item, bin, round(r * cos(th), 6) + 0.0 AS re, round(r * sin(th), 6) + 0.0 AS im FROM q"))
def _(spark, d):
    z = polar.polar_lerp(F.col("ar"), F.col("ai"), F.col("br"), F.col("bi"), 0.3)
    return _pairs(spark, d).select("item", "bin", z.alias("z")).select("item", "bin", r6(F.col("z.re")).alias("re"), r6(F.col("z.im")).alias("im"))


@query("polar_slerp", "X9", oracle("frames", _PAIR,
    """q AS (SELECT *, exp(ln(sqrt(ar * ar + ai * ai)) * 0.7 + ln(sqrt(br * br + bi * bi)) * 0.3) AS r, fmod(atan2(bi, br) - atan2(ai, ar), 2 * pi()) AS dd FROM pr)""",
    f"w AS (SELECT *, atan2(ai, ar) + 0.3 * {_ARC} AS th FROM q)",
    "SELECT item, bin, round(r * cos(th), 6) + 0.0 AS re, round(r * sin(th), 6) + 0.0 AS im FROM w"))
def _(spark, d):
    z = polar.polar_slerp(F.col("ar"), F.col("ai"), F.col("br"), F.col("bi"), 0.3)
    return _pairs(spark, d).select("item", "bin", z.alias("z")).select("item", "bin", r6(F.col("z.re")).alias("re"), r6(F.col("z.im")).alias("im"))


@query("geomean", "G6", oracle("frames", """SELECT item, bin, round(exp(avg(ln(greatest(sqrt(re * re + im * im), 1e-30)))), 6) AS mag FROM frames GROUP BY 1, 2"""))
def _(spark, d):
    return v.frames(spark, d).groupBy("item", "bin").agg(r6(polar.geomean(F.hypot("re", "im"))).alias("mag"))


@query("circular_mean", "G7", oracle("frames", """SELECT item, bin, round(atan2(sum(sin(atan2(im, re))), sum(cos(atan2(im, re)))), 5) + 0.0 AS theta,
    round(sqrt(pow(sum(sin(atan2(im, re))), 2) + pow(sum(cos(atan2(im, re))), 2)) / count(*), 6) AS length FROM frames GROUP BY 1, 2"""))
def _(spark, d):
    th, length = polar.circular_mean(F.atan2("im", "re"))
    return v.frames(spark, d).groupBy("item", "bin").agg(r6(th, 5).alias("theta"), r6(length).alias("length"))


@query("hashes", "X11", """SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents""")
def _(spark, d):
    t = F.col("text")
    return v.table(spark, d, "documents").select("doc_id", F.md5(t).alias("md5"), F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"))


def _crc_table(width: int, poly: int, reflected: bool = False) -> str:
    """The 256 steps of a CRC as an SQL list, made from its polynomial."""
    top, rest, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        c = byte if reflected else byte << (width - 8)
        for _ in range(8):
            c = (c >> 1) ^ (poly if c & 1 else 0) if reflected else ((c << 1) ^ (poly if c & top else 0)) & rest
        out.append(c)
    return "[" + ", ".join(map(str, out)) + "]"


_CHECKSUMS = f"""WITH h AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents),
    y AS (SELECT doc_id, text, [16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 for i in range(length(h) // 2)] AS b FROM h)
    SELECT doc_id, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, {_crc_table(32, 0xEDB88320, True)}[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS BIGINT) AS crc32,
    CAST(list_reduce(list_prepend(0::BIGINT, b), lambda c, x: {_crc_table(8, 0x07)}[xor(c, x) + 1]) AS BIGINT) AS crc8,
    CAST(list_reduce(list_prepend(0::BIGINT, b), lambda c, x: xor((c << 8) & 65535, {_crc_table(16, 0x8005)}[xor(c >> 8, x) + 1])) AS BIGINT) AS crc16 FROM y"""


@query("checksums", "X11", _CHECKSUMS)
def _(spark, d):
    raw = F.encode("text", "UTF-8")
    return v.table(spark, d, "documents").select(
        "doc_id", F.crc32(raw).alias("crc32"), text.crc8(raw).cast("long").alias("crc8"), text.crc16(raw).cast("long").alias("crc16")
    )


@query("sha512", "X11")  # DuckDB has no sha512
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.sha2("text", 512).alias("sha512"))


@query("base64_hex", "X12", """SELECT doc_id, md5(base64(encode(text))) AS b64, md5(hex(encode(text))) AS hex, true AS same FROM documents""")
def _(spark, d):
    raw = F.encode("text", "UTF-8")
    coded = F.base64(raw)
    flat = F.replace(coded, F.lit("\r\n"), F.lit(""))
    same = (F.unbase64(coded) == raw) & (F.unhex(F.hex(raw)) == raw)
    return v.table(spark, d, "documents").select("doc_id", F.md5(flat).alias("b64"), F.md5(F.hex(raw)).alias("hex"), same.alias("same"))


@query("strings", "X13", """SELECT p_partkey, trim('  ' || p_name || ' ') AS both_sides, ltrim('  ' || p_name) AS left_side, rtrim(p_name || '  ') AS right_side,
    starts_with(p_name, 'red') AS starts, ends_with(p_name, 'ing') AS ends, replace(p_name, 'e', '3') AS swapped, substr(p_name, 1, 5) AS cut,
    lower(p_brand) AS low, upper(p_name) AS up, split_part(p_name, ' ', 1) AS head, array_to_string(string_split(p_name, ' '), '_') AS joined FROM part""")
def _(spark, d):
    n = F.col("p_name")
    return v.table(spark, d, "part").select(
        "p_partkey",
        F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("both_sides"),
        F.ltrim(F.concat(F.lit("  "), n)).alias("left_side"),
        F.rtrim(F.concat(n, F.lit("  "))).alias("right_side"),
        n.startswith("red").alias("starts"),
        n.endswith("ing").alias("ends"),
        F.replace(n, F.lit("e"), F.lit("3")).alias("swapped"),
        text.truncate(n, 5).alias("cut"),
        text.ascii_lower(F.col("p_brand")).alias("low"),
        text.ascii_upper(n).alias("up"),
        F.split_part(n, F.lit(" "), F.lit(1)).alias("head"),
        F.concat_ws("_", F.split(n, " ")).alias("joined"),
    )


@query("split_parse", "X14", """SELECT page_id, i, TRY_CAST(p AS BIGINT) AS value FROM (SELECT page_id, unnest(string_split(url, '/')) AS p,
    CAST(unnest(range(len(string_split(url, '/')))) AS INTEGER) AS i FROM pages)""")
def _(spark, d):
    parts = text.split_parse(F.col("url"), "/", "bigint")
    return v.table(spark, d, "pages").select("page_id", F.posexplode(parts).alias("i", "value"))


_NL = """nl AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10))
    WHEN 2 THEN replace(text, chr(10), chr(13)) ELSE chr(13) || replace(text, ' the', chr(13) || chr(10)) END AS t FROM documents)"""


def _newlines(spark, d):
    t = F.col("text")
    k = F.col("doc_id") % 4
    made = (
        F.when(k == 0, t)
        .when(k == 1, F.replace(t, F.lit("\n"), F.lit("\r\n")))
        .when(k == 2, F.replace(t, F.lit("\n"), F.lit("\r")))
        .otherwise(F.concat(F.lit("\r"), F.replace(t, F.lit(" the"), F.lit("\r\n"))))
    )
    return v.table(spark, d, "documents").select("doc_id", made.alias("t"))


@query("normalise_newlines", "X15", f"""WITH {_NL}, c AS (SELECT doc_id, t, length(t) - length(replace(t, chr(13), '')) AS cr, length(t) - length(replace(t, chr(10), '')) AS lf,
    (length(t) - length(replace(t, chr(13) || chr(10), ''))) / 2 AS crlf FROM nl),
    k AS (SELECT *, CASE WHEN cr = lf AND cr = crlf THEN 'crlf' WHEN cr > 0 AND lf = 0 THEN 'cr' WHEN cr = 0 AND lf > 0 THEN 'lf' ELSE 'mixed' END AS kind FROM c)
    SELECT doc_id, kind, md5(CASE kind WHEN 'crlf' THEN replace(t, chr(13) || chr(10), chr(10)) WHEN 'cr' THEN translate(translate(t, chr(10), ' '), chr(13), chr(10))
    WHEN 'lf' THEN translate(t, chr(13), ' ') ELSE translate(t, chr(13), chr(10)) END) AS digest FROM k""")
def _(spark, d):
    t = F.col("t")
    return _newlines(spark, d).select("doc_id", text.line_ending(t).alias("kind"), F.md5(text.normalise_newlines(t)).alias("digest"))


@query("split_fixed", "X16", """WITH s AS (SELECT doc_id, text, unnest(range((length(text) - 1) // 42 + 1)) AS i FROM documents WHERE length(text) > 0)
    SELECT doc_id, CAST(i AS INTEGER) AS line, translate(substr(text, i * 42 + 1, 40), chr(10) || chr(13), '  ') AS content FROM s""")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.posexplode(text.split_fixed(F.col("text"), 40, 2)).alias("line", "content"))


@query("display_name", "X17", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || ' (by ' || p_brand || ')' END AS label FROM part""")
def _(spark, d):
    artist = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_brand"))
    return v.table(spark, d, "part").select("p_partkey", text.display_name(F.col("p_name"), artist).alias("label"))


@query("control_word", "X18", oracle("controls", """SELECT stream, seq, (word >> 4) & 15 AS kind, word & 15 AS channel, (word >> 8) & 255 AS data1,
    (word >> 16) & 255 AS data2, word AS again, CASE WHEN (word & 240) IN (192, 208) THEN 2 WHEN (word & 240) = 240 THEN CASE WHEN (word & 255) IN (241, 243) THEN 2
    WHEN (word & 255) = 242 THEN 3 ELSE 1 END ELSE 3 END AS length FROM controls"""))
def _(spark, d):
    w = v.controls(spark, d)
    parts = text.word_parts(F.col("word"))
    return w.select(
        "stream",
        "seq",
        *[c.alias(k) for k, c in parts.items()],
        text.pack_word(*parts.values()).alias("again"),
        text.message_length(F.col("word").bitwiseAND(F.lit(255))).alias("length"),
    )


@query("uuid_parts", "X19", """WITH h AS (SELECT doc_id, md5(text) AS h FROM documents), n AS (SELECT *, strpos('0123456789abcdef', substr(h, 17, 1)) - 1 AS q,
    strpos('0123456789abcdef', substr(h, 13, 1)) - 1 AS ver FROM h) SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid,
    CAST(ver AS INTEGER) AS version, CASE WHEN q < 8 THEN 0 WHEN q < 12 THEN 2 WHEN q < 14 THEN 6 ELSE 7 END AS variant FROM n""")
def _(spark, d):
    parts = text.uuid_parts(F.concat(F.lit("{"), F.md5("text"), F.lit("}")))
    return v.table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in parts.items()])


@query("format_clock", "X20", """WITH t AS (SELECT event_id, value - 20 AS s, event_id % 300 AS o, user_id AS r FROM events)
    SELECT event_id, lpad(CAST(CAST(floor(greatest(s, 0)) AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(greatest(s, 0)) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock,
    'Ord:' || lpad(CAST(o AS VARCHAR), 3, '0') || ' Row:' || lpad(CAST(r AS VARCHAR), CAST(greatest(3, length(CAST(r AS VARCHAR))) AS INTEGER), '0') AS position FROM t""")
def _(spark, d):
    e = v.table(spark, d, "events")
    return e.select(
        "event_id",
        pitch.format_clock(F.col("value") - 20).alias("clock"),
        pitch.format_position(F.col("event_id") % 300, F.col("user_id")).alias("position"),
    )


@query("unit_conversions", "X21", """SELECT p_partkey, round(p_size * 1000 / CASE WHEN p_partkey % 5 = 0 THEN 8363 ELSE 44100.0::DOUBLE END, 6) AS ms,
    (((p_size * 60 + p_partkey % 60) * 75 + p_partkey % 75) * 44100) // 75 AS samples FROM part""")
def _(spark, d):
    k = F.col("p_partkey")
    return v.table(spark, d, "part").select(
        "p_partkey",
        r6(pitch.samples_to_ms(F.col("p_size"), F.when(k % 5 == 0, 0).otherwise(44100))).alias("ms"),
        pitch.cue_to_samples(F.col("p_size"), k % 60, k % 75).alias("samples"),
    )


@query("decode_bytes", "X3", """WITH b AS (SELECT doc_id, [strpos('0123456789ABCDEF', substr(hex(encode(text)), i, 1)) - 1 for i in range(1, 9)] AS h, octet_length(encode(text)) AS n FROM documents),
    y AS (SELECT doc_id, CASE WHEN n >= 1 THEN h[1] * 16 + h[2] END AS a, CASE WHEN n >= 2 THEN h[3] * 16 + h[4] END AS b, CASE WHEN n >= 3 THEN h[5] * 16 + h[6] END AS c, CASE WHEN n >= 4 THEN h[7] * 16 + h[8] END AS e FROM b)
    SELECT doc_id, a AS u8, a + b * 256 AS le16, b + a * 256 AS be16, a + b * 256 + c * 65536 AS le24, CASE WHEN c + b * 256 + a * 65536 >= 8388608 THEN c + b * 256 + a * 65536 - 16777216 ELSE c + b * 256 + a * 65536 END AS be24s,
    a + b * 256 + c * 65536 + e * 16777216 AS le32, CASE WHEN e + c * 256 + b * 65536 + a * 16777216 >= 2147483648 THEN e + c * 256 + b * 65536 + a * 16777216 - 4294967296 ELSE e + c * 256 + b * 65536 + a * 16777216 END AS be32s FROM y""")
def _(spark, d):
    raw = F.encode("text", "UTF-8")
    spec = {"u8": (1, "little", False), "le16": (2, "little", False), "be16": (2, "big", False), "le24": (3, "little", False),
            "be24s": (3, "big", True), "le32": (4, "little", False), "be32s": (4, "big", True)}
    return v.table(spark, d, "documents").select("doc_id", *[text.decode_int(raw, 0, *s).alias(k) for k, s in spec.items()])


@query("interleave", "A1", """SELECT vec_id, CAST(k AS INTEGER) AS k, embedding[2 * k + 1] AS l, embedding[2 * k + 2] AS r, true AS same FROM embeddings, range(32) t(k)""")
def _(spark, d):
    e = v.table(spark, d, "embeddings")
    l, r = ar.deinterleave(F.col("embedding"), 2, 0), ar.deinterleave(F.col("embedding"), 2, 1)
    z = e.select("vec_id", (ar.interleave(l, r) == F.col("embedding")).alias("same"), F.arrays_zip(l.alias("l"), r.alias("r")).alias("z"))
    return z.select("vec_id", "same", F.posexplode("z").alias("k", "p")).select("vec_id", "k", "p.l", "p.r", "same")


@query("mix_to_mono", "A2", """SELECT vec_id, CAST(k AS INTEGER) AS k, round((embedding[2 * k + 1]::DOUBLE + embedding[2 * k + 2]::DOUBLE) / 2, 7) + 0.0 AS m FROM embeddings, range(32) t(k)""")
def _(spark, d):
    e = v.table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(ar.mix_to_mono(F.col("embedding"), 2)).alias("k", "m")).withColumn("m", r6(F.col("m"), 7))


@query("scale_and_subtract", "A3", """SELECT vec_id, CAST(k AS INTEGER) AS k, round(embedding[k + 1]::DOUBLE * 3, 6) + 0.0 AS scaled,
    round(greatest(least(embedding[k + 1]::DOUBLE * 8, 1), -1), 6) + 0.0 AS clamped, round(embedding[k + 1]::DOUBLE - embedding[64 - k]::DOUBLE, 6) + 0.0 AS diff FROM embeddings, range(64) t(k)""")
def _(spark, d):
    x = F.col("embedding")
    z = F.arrays_zip(
        ar.scale_array(x, 3.0).alias("a"), ar.scale_and_clamp_array(x, 8.0).alias("b"), ar.subtract_array(x, F.reverse(x)).alias("c")
    )
    e = v.table(spark, d, "embeddings").select("vec_id", F.posexplode(z).alias("k", "z"))
    return e.select("vec_id", "k", r6(F.col("z.a")).alias("scaled"), r6(F.col("z.b")).alias("clamped"), r6(F.col("z.c")).alias("diff"))


@query("keymap_transpose", "A4", """SELECT vec_id, CAST(k AS INTEGER) AS k, CAST(least(greatest(CAST(floor(abs(embedding[k + 1]::DOUBLE) * 400) AS BIGINT) + 24, 1), 128) AS BIGINT) AS note FROM embeddings, range(64) t(k)""")
def _(spark, d):
    keys = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 400).cast("long"))
    out = ar.keymap_transpose(keys, 24)
    return v.table(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(out, lambda x: x.cast("long"))).alias("k", "note"))


@query("options_merge", "A6", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS gain,
    event_type AS name, NULL::BOOLEAN AS missing FROM events""")
def _(spark, d):
    e = v.table(spark, d, "events")
    base = F.create_map(F.lit("gain"), F.lit("1.0"), F.lit("name"), F.lit("x"))
    extra = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("gain"), F.lit("0.5"), F.lit("name"), F.col("event_type"))).otherwise(
        F.create_map(F.lit("name"), F.col("event_type"))
    )
    props = F.from_json("props", "map<string,string>")
    m = e.select("event_id", ar.options_merge(base, extra, props).alias("o"))
    o = F.col("o")
    return m.select(
        "event_id",
        ar.option(o, "k", "bigint").alias("k"),
        ar.option(o, "gain", "double").alias("gain"),
        ar.option(o, "name", "string").alias("name"),
        ar.option(o, "absent", "boolean").alias("missing"),
    )


@query("json_field", "A7", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(spark, d):
    return v.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
