"""Queries over files, names, manifests and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.catalog.registry import query, r6
from sigframe.operators import catalogue as cat
from sigframe.plans import views as v
from sigframe.plans.blocked import range_bucket
from sigframe.plans.views import oracle
from sigframe.session import shared_path
from sigframe.sources import cue, files, probing

_EXT = ["xm", "IT", "zip", "html", "S3M", "tar.gz", "txt", "mod", "7z", "mo3"]
_EXT_SQL = "['" + "', '".join(_EXT) + "']"
_MOD_SQL = "('" + "', '".join(files.MODULE_EXTENSIONS) + "')"
_ARC_SQL = "('" + "', '".join(files.ARCHIVE_EXTENSIONS) + "')"
_PATHS = f"paths AS (SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS archive, url || '/T' || page_id || '.' || {_EXT_SQL}[page_id % 10 + 1] AS path FROM pages)"
_CLASS = f"""CASE WHEN regexp_extract(lower(path), '\\.([^.]*)$', 1) IN {_MOD_SQL} THEN 'module' WHEN regexp_extract(lower(path), '\\.([^.]*)$', 1) IN {_ARC_SQL} THEN 'archive' ELSE 'other' END"""


def _paths(spark, d):
    p = v.table(spark, d, "pages")
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("page_id") % 10).cast("int") + 1)
    host = F.regexp_extract("url", "//([^/]*)", 1)
    return p.select("page_id", host.alias("archive"), F.concat("url", F.lit("/T"), F.col("page_id"), F.lit("."), ext).alias("path"))


@query("scan_files", "S1")
def _(spark, d):
    f = files.scan_files(spark, d, "*.parquet")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("classify_path", "S2", f"WITH {_PATHS} SELECT page_id, path, {_CLASS} AS kind FROM paths")
def _(spark, d):
    return _paths(spark, d).select("page_id", "path", files.classify_path(F.col("path")).alias("kind"))


@query("size_guard", "S3", """SELECT doc_id, n_chars <= 3000 AS accepted, CASE WHEN n_chars > 3000 THEN n_chars || ' bytes exceeds the 3000 byte safety limit' END AS reason FROM documents""")
def _(spark, d):
    return files.size_guard(v.table(spark, d, "documents"), "n_chars", 3000).select("doc_id", "accepted", "reason")


_CAND = f"c AS (SELECT archive, path, string_split(path, '/')[-1] AS filename, count(*) OVER (PARTITION BY archive) AS n FROM paths WHERE {_CLASS} = 'module')"


@query("archive_candidates", "S4", f"WITH {_PATHS}, {_CAND} SELECT archive, path, filename, CAST(row_number() OVER (PARTITION BY archive ORDER BY lower(filename), path) AS INTEGER) AS rank FROM c WHERE n <= 4")
def _(spark, d):
    return files.archive_candidates(_paths(spark, d), 4)[0]


@query("archive_rejects", "S4", f"WITH {_PATHS}, {_CAND} SELECT DISTINCT archive, n AS candidates FROM c WHERE n > 4")
def _(spark, d):
    return files.archive_candidates(_paths(spark, d), 4)[1]


@query("probe_magic", "S5")
def _(spark, d):
    p = probing.probe_files(spark, d)
    return p.select(F.element_at(F.split("path", "/"), -1).alias("name"), "result", "format")


# Heads made of part columns: version, last order, rows per beat, channels and counts that are now and then out of range, or cut short.
_HEADS = """h AS (SELECT p_partkey AS k, p_size AS version, p_partkey % 140 AS orders, p_partkey % 70 AS beats, p_partkey % 35 AS channels, p_size % 9 AS samples, p_partkey % 7 AS tracks, p_partkey % 11 AS patterns,
    p_partkey % 300 AS comment, CASE WHEN p_partkey % 13 = 0 THEN p_partkey % 66 ELSE 66 END AS have, 1000 + p_partkey % 2000 AS length, p_partkey % 17 <> 0 AS signed FROM part)"""


@query("probe_heads", "S5", f"""WITH {_HEADS}, r AS (SELECT k, CASE WHEN NOT signed AND have > 0 THEN 'failure' WHEN have < 66 THEN 'want_more' WHEN version < 32 AND orders <= 127 AND beats <= 64 AND channels BETWEEN 1 AND 32
    AND length >= 66 + 37 * samples + 128 + 192 * tracks + 64 * (patterns + 1) + comment THEN 'success' ELSE 'failure' END AS result FROM h)
    SELECT k, result, CASE WHEN result = 'success' THEN 'mtm' END AS format FROM r""")
def _(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    le = lambda c: F.concat(byte(c % 256), byte(F.floor(c / 256)))
    sign = F.when(k % 17 != 0, "4D544D").otherwise("544D4D")
    digits = F.concat(sign, byte(size), F.repeat(F.lit("41"), 20), le(k % 7), byte(k % 11), byte(k % 140), le(k % 300), byte(size % 9), F.lit("00"), byte(k % 70), byte(k % 35), F.repeat(F.lit("08"), 32))
    head = F.substr(F.unhex(digits), F.lit(1), F.when(k % 13 == 0, k % 66).otherwise(66).cast("int"))
    only = [f for f in probing.FORMATS if f.name == "mtm"]
    rows = v.table(spark, d, "part").select(k.alias("k"), head.alias("head"), (1000 + k % 2000).alias("length"))
    return rows.select("k", probing.probe(F.col("head"), F.col("length"), only).alias("p")).select("k", "p.result", "p.format")


@query("decode_header", "S6", """WITH h AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
    y AS (SELECT doc_id, n, [16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 for i in range(64, 80)] AS b FROM h)
    SELECT doc_id, CASE WHEN n >= 66 THEN b[1] + b[2] * 256 END AS orders, CASE WHEN n >= 70 THEN b[5] + b[6] * 256 END AS channels, CASE WHEN n >= 80 THEN b[15] + b[16] * 256 END AS tempo FROM y""")
def _(spark, d):
    t = v.table(spark, d, "documents")
    return t.select("doc_id", *files.decode_header(F.encode("text", "UTF-8"), files.XM_HEADER)).select("doc_id", "orders", "channels", "tempo")


@query("decode_more_headers", "S6", """WITH h AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
    y AS (SELECT doc_id, n, [16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 for i in range(64)] AS b FROM h)
    SELECT doc_id, CASE WHEN n >= 34 THEN b[33] + b[34] * 256 END AS orders, CASE WHEN n >= 36 THEN b[35] + b[36] * 256 END AS s3m_samples, CASE WHEN n >= 44 THEN b[43] + b[44] * 256 END AS s3m_version,
    CASE WHEN n >= 51 THEN b[51] END AS s3m_tempo, CASE WHEN n >= 36 THEN b[35] + b[36] * 256 END AS imf_patterns, CASE WHEN n >= 50 THEN b[50] END AS imf_tempo, CASE WHEN n >= 52 THEN b[52] END AS imf_amplification FROM y""")
def _(spark, d):
    raw = F.encode("text", "UTF-8")
    named = lambda layout, short: [c.alias(f"{short}_{f.name}") for c, f in zip(files.decode_header(raw, layout), layout)]
    t = v.table(spark, d, "documents").select("doc_id", *named(files.S3M_HEADER, "s3m"), *named(files.IMF_HEADER, "imf"))
    return t.select("doc_id", F.col("s3m_orders").alias("orders"), "s3m_samples", "s3m_version", "s3m_tempo", "imf_patterns", "imf_tempo", "imf_amplification")


@query("decode_file_header", "S6")
def _(spark, d):
    layout = [files.Field("magic", 0, 4, "text"), files.Field("word", 4, 4, "le"), files.Field("half", 4, 2, "be")]
    return files.decode_headers(spark, d, layout).withColumn("path", F.element_at(F.split("path", "/"), -1)).withColumnRenamed("path", "name")


@query("read_manifest", "S7", """SELECT event_id, 'ev' || event_id AS stem, 'in/' || event_id || '.wav' AS conditioning_wav_path, CAST(json_extract_string(props, '$.k') AS BIGINT) AS conditioning_rate_hz,
    value AS conditioning_lowpass_hz, user_id AS original_rate_hz FROM events UNION ALL SELECT event_id, 'ev' || event_id || 'b', NULL, NULL, NULL, 1 FROM events""")
def _(spark, d):
    e = v.table(spark, d, "events")
    stem = F.concat(F.lit("ev"), F.col("event_id"))
    null = F.lit(None)
    first = F.struct(
        stem.alias("stem"),
        F.concat(F.lit("in/"), F.col("event_id"), F.lit(".wav")).alias("conditioning_wav_path"),
        F.get_json_object("props", "$.k").cast("long").alias("conditioning_rate_hz"),
        F.col("value").alias("conditioning_lowpass_hz"),
        F.col("user_id").alias("original_rate_hz"),
    )
    second = F.struct(
        F.concat(stem, F.lit("b")).alias("stem"),
        null.cast("string").alias("conditioning_wav_path"),
        null.cast("long").alias("conditioning_rate_hz"),
        null.cast("double").alias("conditioning_lowpass_hz"),
        F.lit(1).cast("long").alias("original_rate_hz"),
    )
    path = shared_path(spark, "manifests")
    e.select(F.to_json(F.struct(F.array(first, second).alias("items"))).alias("manifest")).write.text(path)
    return files.read_manifest(spark, path, lines=True).withColumn("event_id", F.regexp_extract("stem", r"\d+", 0).cast("long"))


_OUT = "outs AS (SELECT doc_id, 'out/' || source || '_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.wav' WHEN 1 THEN '_48k.wav' WHEN 2 THEN '_48k.flac' ELSE 'x.wav' END AS path FROM documents)"


@query("collect_outputs", "S8", f"""WITH {_OUT}, jobs AS (SELECT doc_id, source || '_' || doc_id AS stem FROM documents)
    SELECT stem, doc_id, CASE WHEN doc_id % 4 < 2 THEN path END AS path, CASE WHEN doc_id % 4 >= 2 THEN 'no output for ' || stem END AS error FROM jobs JOIN outs USING (doc_id)""")
def _(spark, d):
    t = v.table(spark, d, "documents")
    stem = F.concat("source", F.lit("_"), F.col("doc_id"))
    tail = F.element_at(F.array(*[F.lit(x) for x in (".wav", "_48k.wav", "_48k.flac", "x.wav")]), (F.col("doc_id") % 4).cast("int") + 1)
    outs = t.select(F.concat(F.lit("out/"), stem, tail).alias("path"))
    return files.collect_outputs(t.select("doc_id", stem.alias("stem")), outs)


@query("write_trace_tsv", "S9", oracle("sig", "SELECT signal_id, n, round(x, 6) + 0.0 AS x FROM sig"))
def _(spark, d):
    path = shared_path(spark, "trace")
    files.write_trace_tsv(v.sig(spark, d).select("signal_id", "n", r6(F.col("x")).alias("x")), path)
    return spark.read.option("sep", "\t").option("header", "true").schema("signal_id long, n long, x double").csv(path)


@query("write_blocks", "S10", oracle("sig", "SELECT signal_id, channel, n, round(x, 6) + 0.0 AS x FROM sig"))
def _(spark, d):
    path = shared_path(spark, "blocks")
    files.write_blocks(v.sig(spark, d), path)
    return spark.read.parquet(path).select("signal_id", "channel", "n", r6(F.col("x")).alias("x"))


_BACKUPS = """bk AS (SELECT event_id, CASE WHEN event_id % 6 = 5 THEN 'song' || user_id || '.bak' ELSE 'song.' || user_id || '.AutoSave.' || strftime(ts, '%Y%m%d.%H%M%S') || '.it' END AS name FROM events)"""


def _backups(spark, d):
    e = v.table(spark, d, "events")
    auto = F.concat(F.lit("song."), F.col("user_id"), F.lit(".AutoSave."), F.date_format("ts", "yyyyMMdd.HHmmss"), F.lit(".it"))
    other = F.concat(F.lit("song"), F.col("user_id"), F.lit(".bak"))
    return e.select("event_id", F.when(F.col("event_id") % 6 == 5, other).otherwise(auto).alias("name"))


@query("parse_backup_name", "S11", f"""WITH {_BACKUPS} SELECT event_id, CASE WHEN event_id % 6 <> 5 THEN 'song.' || user_id END AS base,
    CASE WHEN event_id % 6 <> 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS saved_at, CASE WHEN event_id % 6 <> 5 THEN 'it' END AS ext FROM bk JOIN events USING (event_id)""")
def _(spark, d):
    p = files.parse_backup_name(F.col("name"))
    p["saved_at"] = F.date_format(p["saved_at"], "yyyy-MM-dd HH:mm:ss")
    return _backups(spark, d).select("event_id", *[c.alias(k) for k, c in p.items()])


@query("retention", "W28", """WITH b AS (SELECT event_id, user_id, date_trunc('second', ts) AS s, event_id AS k FROM events WHERE event_id % 6 <> 5),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, k DESC) AS rn FROM b)
    SELECT event_id, rn <= 5 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(s) < 864000 AS keep_it FROM r""")
def _(spark, d):
    p = files.parse_backup_name(F.col("name"))
    b = _backups(spark, d).select("event_id", "name", p["base"].alias("base"), p["saved_at"].alias("saved_at")).filter("base IS NOT NULL")
    b = b.withColumn("name", F.format_string("%012d", "event_id"))
    return files.retention(b, 5, 864000, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("event_id", "keep_it")


# A sheet per order: three tracks whose times follow from the key; every ninth kind of sheet has one planted fault.
_FAULTS = ["ok", "NoTracks", "PrematureIndex", "LateFlags", "InvalidISRC", "NonZeroFirstIndex", "InvalidTrack", "TracksOutOfSequence", "CatalogMissingNumber"]


def _sheets(spark, d):
    o = v.table(spark, d, "orders")
    k = F.col("o_orderkey")
    kind = k % 9
    nl = "\n"
    stamp = F.format_string("%02d:%02d:%02d", k % 90, k % 60, k % 75)
    later = F.format_string("%02d:%02d:%02d", k % 90 + 3, k % 60, k % 75)
    text = F.concat(
        F.when(kind == 8, "CATALOG\n").otherwise("CATALOG 2718281828459\n"),
        F.lit('FILE "a.wav" WAVE\n'),
        F.when(kind == 2, "INDEX 00 00:00:00\n").otherwise(""),
        F.when(
            kind != 1,
            F.concat(
                F.when(kind == 6, "  TRACK zz AUDIO\n").otherwise("  TRACK 01 AUDIO\n"),
                F.when(kind == 4, "    ISRC ABC\n").otherwise("    ISRC QZK9M2400817\n"),
                F.when(kind == 5, "    INDEX 01 00:00:01\n").otherwise("    INDEX 01 00:00:00\n"),
                F.when(kind == 3, "    FLAGS PRE\n").otherwise(""),
                F.when(kind == 7, "  TRACK 03 AUDIO\n").otherwise("  TRACK 02 AUDIO\n"),
                F.lit("    INDEX 00 00:00:40\n    INDEX 01 "),
                F.format_string("%02d:%02d:%02d", F.lit(1), k % 60, k % 75),
                F.lit(nl + "  TRACK 03 AUDIO\n    FLAGS DCP\n    INDEX 01 "),
                F.format_string("%02d:%02d:%02d", k % 90 + 3, k % 60, k % 75),
                F.lit(nl),
            ),
        ).otherwise(""),
    )
    return o.select(k.alias("id"), text.alias("text"))


@query("read_cue", "S12", """WITH g AS (SELECT o_orderkey AS id, o_orderkey % 9 AS k, 60 * 75 + (o_orderkey % 60) * 75 + o_orderkey % 75 AS b, ((o_orderkey % 90 + 3) * 60 + o_orderkey % 60) * 75 + o_orderkey % 75 AS c FROM orders),
    p AS (SELECT id, NULL AS track, 0 AS i, 0 AS frame FROM g WHERE k = 2 UNION ALL SELECT id, CASE WHEN k <> 6 THEN 1 END, 1, CASE WHEN k = 5 THEN 1 ELSE 0 END FROM g WHERE k <> 1
      UNION ALL SELECT id, CASE WHEN k = 7 THEN 3 ELSE 2 END, 0, 40 FROM g WHERE k <> 1 UNION ALL SELECT id, CASE WHEN k = 7 THEN 3 ELSE 2 END, 1, b FROM g WHERE k <> 1 UNION ALL SELECT id, 3, 1, c FROM g WHERE k <> 1)
    SELECT id, CAST(track AS BIGINT) AS track, CAST(i AS BIGINT) AS "index", CAST(frame AS BIGINT) AS frame, CAST(frame * 588 AS BIGINT) AS sample FROM p""")
def _(spark, d):
    return cue.read_cue(_sheets(spark, d))


@query("validate_cue", "P15", "SELECT o_orderkey AS id, ['" + "', '".join(_FAULTS) + "'][o_orderkey % 9 + 1] AS status FROM orders")
def _(spark, d):
    return cue.validate_cue(_sheets(spark, d))


@query("dedupe_identical", "G14", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def _(spark, d):
    return cat.dedupe_identical(v.table(spark, d, "documents"), "doc_id", "text")


@query("tree_signature", "G15", """WITH l AS (SELECT source, sha256('f' || doc_id) AS spot, sha256(sha256('f' || doc_id) || chr(10) || sha256(text)) AS h FROM documents WHERE lang IN ('en', 'de')),
    a AS (SELECT source, substr(spot, 1, 6) AS spot, sha256(string_agg(h, chr(10) ORDER BY l.spot)) AS h FROM l GROUP BY source, substr(l.spot, 1, 6)),
    b AS (SELECT source, substr(a.spot, 1, 3) AS spot, sha256(string_agg(h, chr(10) ORDER BY a.spot)) AS h FROM a GROUP BY source, substr(a.spot, 1, 3))
    SELECT source, sha256(string_agg(h, chr(10) ORDER BY spot)) AS signature FROM b GROUP BY 1""")
def _(spark, d):
    t = v.table(spark, d, "documents").filter(F.col("lang").isin("en", "de"))
    return cat.tree_signature(t, "source", F.concat(F.lit("f"), F.col("doc_id")), F.col("text"))


@query("batch_outcome", "G16", """SELECT doc_id % 7 AS engine, count(*) FILTER (quality = 1) AS succeeded, count(*) FILTER (quality <> 1) AS failed,
    count(*) FILTER (quality <> 1) = 0 AS strict_ok, count(*) FILTER (quality = 1) > 0 OR count(*) FILTER (quality <> 1) = 0 AS lenient_ok FROM labels GROUP BY 1""")
def _(spark, d):
    t = v.table(spark, d, "labels").withColumn("engine", F.col("doc_id") % 7)
    return cat.batch_outcome(t, "engine", F.col("quality") == 1)


@query("verify_summary", "G17", """SELECT CASE WHEN doc_id % 11 = 3 THEN 'error' WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'match' END AS verdict, count(*) AS files FROM documents GROUP BY 1""")
def _(spark, d):
    k = F.col("doc_id")
    stored = F.when(k % 5 != 0, F.when(k % 7 == 0, F.lit("0")).otherwise(F.md5("text")))
    return cat.verify_summary(v.table(spark, d, "documents"), stored, F.when(k % 11 != 3, F.col("text")))


@query("concat_check", "G18", """SELECT o_custkey, min(o_orderstatus) = max(o_orderstatus) AS consistent, CASE WHEN count(*) FILTER (o_orderkey % 20 = 0) = 0 THEN CAST(sum(o_orderkey) AS BIGINT) END AS total FROM orders GROUP BY 1""")
def _(spark, d):
    o = v.table(spark, d, "orders").withColumn("frames", F.when(F.col("o_orderkey") % 20 != 0, F.col("o_orderkey")))
    return cat.concat_check(o, ["o_custkey"], ["o_orderstatus"], "frames")


@query("supports_rate", "P8", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey * 40 < 48000")
def _(spark, d):
    li = v.table(spark, d, "lineitem")
    return li.filter(cat.supports_rate(F.col("l_partkey") * 40)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("pick_checkpoint_rate", "P9", """SELECT p_partkey, CASE WHEN p_size * 700 >= 24000 THEN 24000 WHEN p_size * 700 >= 16000 THEN 16000 WHEN p_size * 700 >= 12000 THEN 12000 ELSE 8000 END AS rate FROM part""")
def _(spark, d):
    return v.table(spark, d, "part").select("p_partkey", cat.pick_checkpoint_rate(F.col("p_size") * 700).alias("rate"))


@query("pad_to_alignment", "P10", "SELECT doc_id, CAST(ceil(n_chars * 100 / 245760.0::DOUBLE) * 245760 AS BIGINT) AS padded FROM documents")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", cat.pad_to_alignment(F.col("n_chars") * 100).alias("padded"))


@query("clamp_cutoff", "P11", """SELECT l_orderkey, l_linenumber, round(greatest(20, least(l_extendedprice / 4, l_quantity * 500 * 0.5 * 0.95::DOUBLE)), 4) AS a, round(least(l_extendedprice / 4, 8000), 4) AS b FROM lineitem""")
def _(spark, d):
    c = F.col("l_extendedprice") / 4
    return v.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(cat.clamp_cutoff(c, F.col("l_quantity") * 500), 4).alias("a"), r6(cat.clamp_cutoff_8k(c), 4).alias("b")
    )


@query("stretch_ratio", "P12", """WITH r AS (SELECT p_partkey, p_partkey * 100 AS n, CASE WHEN p_size % 5 = 0 THEN 8363 ELSE p_size * 1000 END AS rate FROM part)
    SELECT p_partkey, round(n * 1000.0::DOUBLE / rate, 4) AS ms, round(n * 1000.0::DOUBLE / rate * 1.5::DOUBLE, 4) AS new_ms, CAST(round(n * 1.5::DOUBLE) AS BIGINT) AS new_samples, round(n * 1000.0::DOUBLE / rate / 120, 4) AS rows_old, round(n * 1000.0::DOUBLE / rate / 80, 4) AS rows_new FROM r""")
def _(spark, d):
    rate = F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size") * 1000)
    from sigframe.functions.pitch import stretch_ratio

    out = stretch_ratio(F.col("p_partkey") * 100, rate, 150.0, F.lit(120.0))
    names = {"ms": "ms", "new_ms": "new_ms", "rows": "rows_old", "new_rows": "rows_new"}
    return v.table(spark, d, "part").select(
        "p_partkey", out["new_samples"].alias("new_samples"), *[r6(out[k], 4).alias(n) for k, n in names.items()]
    )


@query("sample_flags", "P13", """SELECT p_partkey, p_partkey % 2 = 0 AND p_size > 10 AND p_size <= 40 AS has_loop, p_partkey % 3 = 0 AND p_size + 5 > 20 AND p_size + 5 <= 40 AS has_sustain,
    p_partkey % 2 = 0 AND p_size > 10 AND p_size <= 40 AND p_partkey % 5 = 0 AS has_pingpong, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END * (p_partkey % 2 + 1) AS bytes_per_frame FROM part""")
def _(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    flags = cat.sample_flags(
        F.lit(40), s, F.lit(10), s + 5, F.lit(20), k % 2 == 0, k % 3 == 0, k % 5 == 0, F.when(k % 4 == 0, 16).otherwise(8), k % 2 + 1
    )
    return v.table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in flags.items()])


@query("validate_stream_header", "P14", """WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 * 200000 AS rate, l_linenumber * 2 AS ch, l_suppkey % 40 AS bits, CAST(l_quantity AS BIGINT) - 1 AS blk FROM lineitem)
    SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN rate <= 0 OR rate > 655350 THEN 'InvalidSampleRate' END, CASE WHEN rate <> 200000 THEN 'SampleRateMismatch' END,
    CASE WHEN ch > 8 THEN 'ExcessiveChannels' END, CASE WHEN ch <> 2 THEN 'ChannelsMismatch' END, CASE WHEN bits < 4 OR bits > 32 THEN 'InvalidBitsPerSample' END,
    CASE WHEN bits <> 16 THEN 'BitsPerSampleMismatch' END, CASE WHEN blk < 1 THEN 'InvalidBlockSize' END, CASE WHEN blk > 40 THEN 'BlockSizeMismatch' END], lambda x: x IS NOT NULL)) AS code FROM h""")
def _(spark, d):
    codes = cat.validate_stream_header(
        F.col("l_partkey") % 5 * 200000,
        F.col("l_linenumber") * 2,
        F.col("l_suppkey") % 40,
        F.col("l_quantity").cast("long") - 1,
        {"rate": F.lit(200000), "channels": F.lit(2), "bits": F.lit(16), "max_block": F.lit(40)},
    )
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(codes).alias("code"))


@query("sort_ci", "K1", f"WITH {_PATHS} SELECT path, string_split(path, '/')[-1] AS filename FROM paths ORDER BY lower(filename), path")
def _(spark, d):
    p = _paths(spark, d).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"))
    return cat.sort_ci(p, "filename", "path")


@query("stable_order", "K3", "SELECT l_linenumber AS controller, l_orderkey AS ord FROM lineitem ORDER BY 1, 2")
def _(spark, d):
    li = v.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("controller"), F.col("l_orderkey").alias("ord"))
    return cat.stable_order(li, "controller", "ord")


@query("batch_of", "K5", "SELECT p_brand, p_partkey, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 5 AS BIGINT) AS batch FROM part")
def _(spark, d):
    p = v.table(spark, d, "part").select("p_brand", "p_partkey")
    return cat.batch_of(p, ["p_brand"], ["p_partkey"], range_bucket(p, "p_partkey"))


@query("frame_sizes", "W29", oracle("cell", """f AS (SELECT pattern AS file, "row" AS n, "row" * 1000 + vol AS ofs, note <> 255 AS ok FROM cell)""",
    "g AS (SELECT *, lead(ofs) OVER w AS nx, lead(ok) OVER w AS nok FROM f WINDOW w AS (PARTITION BY file ORDER BY n))",
    'SELECT file, n, ofs AS "offset", ok, 20000 AS file_len, CAST(CASE WHEN nx IS NULL THEN 20000 - ofs WHEN NOT nok THEN 0 ELSE nx - ofs END AS BIGINT) AS size FROM g WHERE ok'))
def _(spark, d):
    f = v.cell(spark, d).select(
        F.col("pattern").alias("file"), F.col("row").alias("n"), (F.col("row") * 1000 + F.col("vol")).alias("offset"), (F.col("note") != 255).alias("ok")
    )
    return cat.frame_sizes(f.withColumn("file_len", F.lit(20000)), "file", "file_len")


@query("merge_history", "U10", """SELECT user_id, event_type FROM events WHERE value < 60 UNION SELECT user_id, event_type FROM events WHERE event_type <> 'error'""")
def _(spark, d):
    e = v.table(spark, d, "events")
    a, b = e.filter("value < 60"), e.filter("event_type <> 'error'")
    return cat.merge_history(a.select("user_id", "event_type"), b.select("user_id", "event_type"), ["user_id", "event_type"])
