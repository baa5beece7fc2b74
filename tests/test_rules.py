"""Rules with known answers: edges, guards, phasors, cue sheets, streams."""

import hashlib
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import column, signal
from sigframe import catalog
from sigframe.functions import pcm, polar, text
from sigframe.operators import clicks, sequences, signal_ops, signal_stats
from sigframe.operators.sequences import FNV_BASIS, FNV_PRIME, loop_state_hash
from sigframe.sources import cue, files
from sigframe.streaming import operators as so
from verify import compare


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_empty_null_and_single_rows(spark):
    assert signal_stats.peak(signal(spark, [])).count() == 0
    nulls = signal(spark, [None, None])
    assert signal_stats.peak(nulls).first().silent is True
    assert signal_stats.rms(nulls).first().rms is None
    assert signal_ops.fade(signal(spark, [0.5]), "linear").first().y == 0.5
    flat = clicks.robust_residual(signal(spark, [0.25] * 20), 7)
    assert set(column(flat, "z")) == {0.0}
    assert clicks.detect_regions(signal(spark, []), clicks.click_params(16000)).count() == 0


def test_one_click_in_a_sine_is_repaired_in_both_channels(spark):
    left = np.sin(2 * np.pi * 440 * np.arange(1024) / 16000) * 0.5
    right = left * 0.5
    hurt = left.copy()
    hurt[320] = 1.0
    s = signal(spark, hurt).unionByName(signal(spark, right, channel=1))
    # The sine itself is smooth but large against its local median, so look at the second difference.
    params = clicks.DetectParams(window=63, z_hi=3.0, z_lo=2.0, max_len=8, pad=1, merge_gap=2)
    diff = signal_ops.convolve_taps(s, [1.0, -2.0, 1.0]).withColumn("x", F.col("y")).drop("y")
    found = clicks.detect_regions(diff.filter("n > 1").withColumn("n", F.col("n") - 2), params).collect()
    assert [(r.start_n + 1 >= 317, r.end_n + 1 <= 323) for r in found] == [(True, True)]
    regions = spark.createDataFrame([(1, 319, 321)], "signal_id long, start_n long, end_n long")
    for fix in (clicks.repair_median, clicks.repair_ar):
        out = fix(s, regions, 32)
        touched = out.filter("repaired").select("channel", "n").collect()
        assert {(r.channel, r.n) for r in touched} == {(c, n) for c in (0, 1) for n in (319, 320, 321)}
    ar = {r.n: r.x for r in clicks.repair_ar(s, regions, 32).filter("channel = 0").collect()}
    assert max(abs(ar[n] - left[n]) for n in range(1024)) < 1e-6


def test_cleanup_tags():
    tags = [s.tag for s in clicks.CleanupSettings.all_active()]
    assert tags == [1, 2, 3, 4, 5, 6] and clicks.CleanupSettings().tag == 0


def test_size_guard_boundary_and_entry_cap(spark):
    df = spark.createDataFrame([(files.MAX_BYTES,), (files.MAX_BYTES + 1,)], "size long")
    assert [r.accepted for r in files.size_guard(df, "size").orderBy("size").collect()] == [True, False]
    names = [("a", f"mods/track-{i}.xm") for i in range(2049)] + [("b", f"mods/track-{i}.xm") for i in range(2048)] + [("b", "x.txt")]
    kept, refused = files.archive_candidates(spark.createDataFrame(names, "archive string, path string"))
    assert [r.archive for r in refused.collect()] == ["a"]
    assert kept.count() == 2048 and {r.archive for r in kept.select("archive").distinct().collect()} == {"b"}


def test_resample_keeps_identity_and_length(spark):
    taps = [0.0, 0.25, 1.0, 0.25, 0.0]
    assert column(signal_ops.resample_linear(signal(spark, taps), 48000, 48000)) == taps
    assert len(column(signal_ops.resample_linear(signal(spark, taps), 44100, 96000))) == round(5 * 96000 / 44100)


def phasor(r, th):
    return F.lit(r * math.cos(th)), F.lit(r * math.sin(th))


@pytest.mark.parametrize("fn", [polar.polar_lerp, polar.polar_slerp])
def test_blend_ends_and_conjugates(spark, fn):
    a, b = phasor(0.7, 0.3), phasor(1.9, 2.0)
    z0, z1 = one(spark, fn(*a, *b, 0.0), fn(*a, *b, 1.0))
    assert z0.re == pytest.approx(0.7 * math.cos(0.3)) and z1.im == pytest.approx(1.9 * math.sin(2.0))
    z, c = one(spark, fn(*a, *b, 0.4), fn(a[0], -a[1], b[0], -b[1], 0.4))
    assert (z.re, z.im) == pytest.approx((c.re, -c.im))


def test_blend_special_cases(spark):
    z = one(spark, polar.polar_slerp(F.lit(1.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0), 0.5))[0]
    assert abs(z.re) < 1e-12 and abs(z.im) < 1e-12
    z = one(spark, polar.polar_lerp(F.lit(1.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0), 0.5))[0]
    assert z.re == pytest.approx(1.0)
    z = one(spark, polar.polar_slerp(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), 0.25))[0]
    assert (z.re, z.im) == pytest.approx((0.0, 0.5))
    arcs = one(spark, polar.shortest_arc(F.lit(0.0), F.lit(math.pi)), polar.shortest_arc(F.lit(3.0), F.lit(-3.0)))
    assert arcs[0] == pytest.approx(math.pi) and arcs[1] == pytest.approx(2 * math.pi - 6)
    df = spark.createDataFrame([(1, 5.0)], "k int, m double")
    assert df.groupBy("k").agg(polar.geomean(F.col("m"))).first()[1] == 5.0
    assert df.filter("k = 2").agg(polar.geomean(F.col("m"))).first()[0] == 0.0


def test_companded_codes_round_trip(spark):
    df = spark.range(256).select("id", pcm.ulaw_encode(pcm.ulaw_decode(F.col("id"))).alias("u"), pcm.alaw_encode(pcm.alaw_decode(F.col("id"))).alias("a"))
    assert df.filter("a <> id").count() == 0
    assert [r.id for r in df.filter("u <> id").collect()] == [127]  # the two zeros of mu-law share a code


def test_hash_vectors(spark):
    assert one(spark, F.crc32(F.lit(b"123456789")))[0] == 0xCBF43926
    assert list(text.crc_many([b"123456789"], 8, 0x07)) == [0xF4]
    assert list(text.crc_many([b"123456789"], 16, 0x8005)) == [0xFEE8]
    flipped = bytearray(b"x" * 700)
    flipped[350] ^= 4
    assert len(set(text.crc_many([b"x" * 700, bytes(flipped)], 16, 0x8005))) == 2


def test_loop_hash(spark):
    pairs = [(0, 0), (3, 2), (7, 1)]
    h = FNV_BASIS
    for c, k in pairs:
        for b in (c, k) if k else ():
            h = ((h ^ b) * FNV_PRIME) % (1 << 64)
    df = spark.createDataFrame([(pairs,)], "p array<struct<channel:int,count:int>>")
    assert int(df.select(loop_state_hash(F.col("p"))).first()[0]) == h


HEAD = 'FILE "a.wav" WAVE\n'
T1 = "TRACK 01 AUDIO\n"
OK_TRACK = T1 + "INDEX 01 00:00:00\n"
# The keys are the fixed names of the errors; the sheets are our own.
SHEETS = {
    "ok": HEAD + T1 + "FLAGS PRE\nISRC QZ-K9M-24-00817\nINDEX 00 00:00:00\nINDEX 01 00:03:15\nTRACK 02 AUDIO\nINDEX 01 01:10:05\n",
    "MultipleCatalogNumber": "CATALOG 2718281828459\nCATALOG 2718281828459\n" + HEAD + OK_TRACK,
    "CatalogMissingNumber": "CATALOG\n" + HEAD + OK_TRACK,
    "InvalidCatalogNumber": "CATALOG 12x\n" + HEAD + OK_TRACK,
    "PrematureFlags": "FLAGS PRE\n" + HEAD + OK_TRACK,
    "LateFlags": HEAD + OK_TRACK + "FLAGS PRE\n",
    "MultipleFlags": HEAD + T1 + "FLAGS PRE\nFLAGS 4CH\nINDEX 01 00:00:00\n",
    "PrematureIndex": HEAD + "INDEX 00 00:00:00\n" + OK_TRACK,
    "InvalidIndexPoint": HEAD + T1 + "INDEX 01 00:75:10\n",
    "IndexPointsOutOfSequence": HEAD + T1 + "INDEX 01 00:00:00\nINDEX 03 00:12:40\n",
    "MultipleISRC": HEAD + T1 + "ISRC QZK9M2400817\nISRC QZK9M2400817\nINDEX 01 00:00:00\n",
    "PrematureISRC": "ISRC QZK9M2400817\n" + HEAD + OK_TRACK,
    "LateISRC": HEAD + OK_TRACK + "ISRC QZK9M2400817\n",
    "InvalidISRC": HEAD + T1 + "ISRC QZK9M240081Z\nINDEX 01 00:00:00\n",
    "InvalidTrack": HEAD + T1 + "TRACK 02 AUDIO\nINDEX 01 00:07:30\n",
    "TracksOutOfSequence": HEAD + OK_TRACK + "INDEX 02 00:07:30\nTRACK 02 AUDIO\nINDEX 01 00:06:71\n",
    "NoTracks": HEAD,
    "NonZeroFirstIndex": HEAD + T1 + "INDEX 01 00:07:30\n",
}


def test_cue_rules(spark):
    df = spark.createDataFrame(list(SHEETS.items()), "id string, text string")
    assert {r.id: r.status for r in cue.validate_cue(df).collect()} == {k: k for k in SHEETS}
    only_zero = spark.createDataFrame([("z", HEAD + T1 + "INDEX 00 00:00:00\n")], "id string, text string")
    assert cue.validate_cue(only_zero).first().status == "IndexPointsOutOfSequence"
    points = cue.read_cue(df.filter("id = 'ok'")).orderBy("track", "index").collect()
    assert [(r["track"], r["index"], r["frame"], r["sample"]) for r in points] == [(1, 0, 0, 0), (1, 1, 240, 141120), (2, 1, 5255, 3089940)]


def test_points_behind_a_malformed_track_have_no_track(spark):
    sheet = HEAD + T1 + "INDEX 01 00:00:00\nTRACK zz AUDIO\nINDEX 01 00:09:00\nTRACK 03 AUDIO\nINDEX 01 00:11:00\n"
    points = cue.read_cue(spark.createDataFrame([("x", sheet)], "id string, text string")).orderBy("frame").collect()
    assert [p["track"] for p in points] == [1, None, 3]


def test_text_helpers(spark):
    lit = F.lit
    row = one(
        spark,
        text.split_parse(lit(""), ",", "int"),
        text.split_parse(lit("1,x,3"), ",", "int"),
        text.normalise_newlines(lit("a\r\nb\r\n\x00\x00")),
        text.normalise_newlines(lit("a\rb\nc")),
        text.split_fixed(lit("abcd\nef"), 3, 1),
        text.ascii_lower(lit("ÄbC")),
    )
    assert list(row) == [[], [1, None, 3], "a\nb\n", "a\nb\nc", ["abc", " ef"], "Äbc"]


def test_streams_do_not_depend_on_chunking():
    x = np.random.default_rng(8).integers(-60000, 60000, 400)
    whole = so.gain_control_step({}, x, 20000, 16, 64, 4)
    state, parts = {}, []
    for a in range(0, 400, 37):
        state, y = so.gain_control_step(state, x[a : a + 37], 20000, 16, 64, 4)
        parts.append(y)
    assert np.array_equal(whole[1], np.concatenate(parts)) and whole[0] == state
    data = list(enumerate(int(b) for b in np.random.default_rng(9).integers(0, 256, 300)))
    want = so.split_messages({}, data)
    state, got = {}, []
    for a in range(0, 300, 11):
        state, m = so.split_messages(state, data[a : a + 11])
        got += m
    assert got == want[1] and state == want[0]


def test_running_status_rules():
    state, msgs = so.split_messages({}, list(enumerate([0x10, 0x90, 60, 100, 61, 101, 0xC0, 5, 0xF0, 1, 2, 0xF7, 62, 0xF0, 0xF0, 7, 8])))
    assert [m for _, m in msgs] == [[0x90, 60, 100], [0x90, 61, 101], [0xC0, 5], [0xF0, 1, 2, 0xF7], [0xC0, 62], [0xF0, 0xF0, 7, 8]]
    assert state["cur"] == []


def test_follower_rises_and_falls():
    x = np.array([0.0, 1.0, 1.0, 0.0, 0.0])
    _, peaks, y = so.follower_step(0.0, x, 0.5, 0.9, 0.6, 0.0)
    assert peaks.tolist() == pytest.approx([0.0, 0.5, 0.75, 0.675, 0.6075])
    assert y[1] == pytest.approx(2 ** (32 * -1e-7))


def test_staged_slices_have_equal_file_counts(spark, monkeypatch):
    from sigframe.streaming import runs

    monkeypatch.setattr(runs, "FILE_ROWS", 100)
    df = spark.range(605).withColumn("k", F.when(F.col("id") < 600, 0).when(F.col("id") < 602, 40))
    path, files = runs.stage(df, "k")
    assert files == 6 and spark.read.parquet(path).count() == 605
    parts = sorted(Path(path.removeprefix("file:")).glob("part-*"), key=lambda f: f.stat().st_mtime_ns)
    sizes = [spark.read.parquet(str(f)).count() for f in parts]
    assert len(sizes) == 18 and sum(sizes[:6]) == 600 and sum(sizes[6:12]) == 2 and sum(sizes[12:]) == 3
    assert spark.read.parquet(*map(str, parts[12:])).filter("k is not null").isEmpty()
    path, files = runs.stage(df.filter("false"), "k")
    assert files == 1 and spark.read.parquet(path).isEmpty()


def test_paired_controls_join_for_their_first_rule(spark):
    from sigframe.operators import lookups as lk

    rules = [lk.Directive(11, 0, 7, 1, 10, False, True), lk.Directive(11, 0, 20, 2, 11, False, True), lk.Directive(11, 0, 39, 3, 12, False, False)]
    rows = [(1, 0, 11, 0, 7, 100), (1, 1, 11, 0, 50, 1), (1, 2, 11, 0, 39, 5), (1, 3, 11, 0, 39, 6), (1, 4, 11, 0, 20, 9), (1, 5, 11, 0, 52, 3), (2, 0, 11, 0, 39, 5)]
    events = spark.createDataFrame(rows, "stream long, seq long, kind int, channel int, data1 int, data2 int")
    got = {(r.stream, r.seq): (r.matches, r.value) for r in lk.route_controls(events, rules).collect()}
    assert got[1, 2] == (2, 5 | 100 << 7) and got[1, 3] == (2, 6 << 7) and got[1, 5] == (1, 3 | 9 << 7) and got[2, 0] == (2, 5 << 7)
    assert got[1, 1] == (0, None) and got[1, 0] == (1, 100 << 7)


def test_sha512_of_every_document(spark, tmp_path):
    catalog.load()
    texts = ["", "abc", "ß 日本 😀", None, "x" * 10_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.sha512 for r in catalog.QUERIES["sha512"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else hashlib.sha512(t.encode()).hexdigest() for i, t in enumerate(texts)}


def test_decode_bytes_of_short_texts(spark, tmp_path):
    catalog.load()
    rows = list(enumerate([None, "", "A", "AB", "ABC", "ABCD"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[1:] for r in catalog.QUERIES["decode_bytes"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    widths = [(1, "little", False), (2, "little", False), (2, "big", False), (3, "little", False), (3, "big", True), (4, "little", False), (4, "big", True)]
    raw = [(t or "").encode() for _, t in rows]
    assert got == [tuple(int.from_bytes(b[:n], e, signed=s) if len(b) >= n else None for n, e, s in widths) for b in raw]


def test_cue_sheets_are_shuffled_before_they_are_cut(spark):
    from sigframe.sources import cue

    texts = [None, "", "\n \n", 'FILE "a" WAVE\n', "TRACK 01 AUDIO\nINDEX 01 00:00:00\n", "TRACK 01 AUDIO\n", "TRACK 01 AUDIO\nINDEX 00 00:00:00\nTRACK 03 AUDIO\nINDEX 01 00:01:00", "INDEX 01 00:00:00\nTRACK 01 AUDIO\n"]
    out = cue.validate_cue(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL") > 0
    assert [r.status for r in out.orderBy("id").collect()] == ["NoTracks"] * 4 + ["ok", "InvalidTrack", "IndexPointsOutOfSequence", "PrematureIndex"]


def test_ensure_unique_of_odd_lists_equals_its_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sequences, "ORD_BLOCK", 4)
    rng = np.random.default_rng(12)
    rows = [(1, t, "user", "x" * int(rng.integers(9))) for t in range(-7, 40)]  # over many blocks
    rows += [(2, int(rng.integers(6)), "user", "x" * int(rng.integers(3))) for _ in range(40)]  # places and entries repeat
    rows += [(c, t, "user", x) for c in (3, None) for t in (5, 0, None, None, 9, 9) for x in ("", "x", "x", None, "xx")]
    rows += [(4, 0, "system", "xx"), (4, 1, None, "x"), (4, 2, "user", "x"), (5, 0, "system", ""), (6, 0, "user", None), (6, 7, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    catalog.load()
    status, _, note = compare(spark, con, "ensure_unique", str(tmp_path))
    assert status == "OK" and note.startswith("151 rows"), note
