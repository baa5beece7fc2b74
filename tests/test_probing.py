"""Probing by bounded heads."""

import os
import struct
import time

import pytest
from pyspark.sql import functions as F

from sigframe.sources import files, probing


def put(size, *parts):
    raw = bytearray(size)
    for offset, data in parts:
        raw[offset : offset + len(data)] = data
    return bytes(raw)


le16 = lambda x: struct.pack("<H", x)
COMPOSER = put(497, (0, b"if"), (2, b"hello"), (110, b"\x01\x01\x00"), (113, b"\x00" + b"\xff" * 127), (241, b"\x04"), (369, b"\x3f"))

# A whole header of each format and the smallest size of its file.
GOOD = [
    ("669", COMPOSER, 497 + 25 + 1536),
    ("669", b"JN" + COMPOSER[2:], 497 + 25 + 1536),
    ("it", put(192, (0, b"IMPM"), (32, le16(3)), (34, le16(2)), (36, le16(1)), (38, le16(5))), 192 + 3 + 4 * 8),
    ("xm", put(80, (0, b"Extended Module: "), (68, le16(4))), 80),
    ("s3m", put(96, (29, b"\x10"), (32, le16(8)), (34, le16(2)), (36, le16(3)), (42, le16(2)), (44, b"SCRM")), 96 + 8 + 10),
    ("mtm", put(66, (0, b"MTM\x10"), (24, le16(2)), (26, b"\x01"), (30, b"\x03"), (33, b"\x04")), 66 + 37 * 3 + 128 + 192 * 2 + 128),
    ("far", put(98, (0, b"FAR\xfe"), (44, b"\r\n\x1a"), (47, le16(98))), 98),
    ("gdm", put(157, (0, b"GDM\xfe"), (68, b"\r\n\x1aGMFS\x01\x00"), (117, le16(3))), 157),
    ("ptm", put(608, (28, b"\x1a"), (30, b"\x02"), (32, le16(1)), (34, le16(2)), (36, le16(1)), (38, le16(4)), (44, b"PTMF")), 608 + 160),
    ("ult", put(48, (0, b"MAS_UTrack_V004"), (47, b"\x02")), 48 + 64 + 259),
    ("imf", put(576, (34, le16(1)), (36, le16(2)), (49, b"\x7d"), (51, b"\x30"), (60, b"IM10")), 576 + 256 + 4 + 768),
    ("plm", put(96, (0, b"PLM\x1a\x60\x10"), (54, b"\x04"), (92, b"\x01\x02"), (94, le16(3))), 96 + 24),
    ("digi", put(610, (0, b"DIGI Booster module\0V1.6"), (25, b"\x04")), 610),
    ("dtm", put(22, (0, b"D.T."), (4, b"\x00\x00\x00\x0e")), 22),
    ("dsm", b"RIFF\x00\x00\x00\x00DSMF", 12),
    ("wav", b"RIFF\x24\x00\x00\x00WAVE", 12),
    ("dbm", b"DBM0\x02\x00\x00\x00", 8),
    ("dmf", put(66, (0, b"DDMF\x08")), 66),
    ("amf", b"AMF\x0a\x00", 5),
    ("amf", put(32, (0, b"ASYLUM Music Format V1.0\0")), 32),
    ("ams", b"Extreme\x30\x01\x00", 10),
    ("ams", b"AMShdr\x1a\x00", 8),
    ("okt", b"OKTASONGCMOD\x00\x00\x00\x08", 16),
    ("mt2", put(64, (0, b"MT20")), 64),
    ("mdl", b"DMDL\x11", 5),
    ("psm", b"PSM \x00\x00\x00\x00FILE", 12),
    ("med", put(52, (0, b"MMD1")), 52),
    ("stm", put(48, (20, b"!Scream!\x1a\x02")), 48),
    ("mod", put(1084, (950, b"\x01"), (1080, b"M.K.")), 1084),
    ("flac", b"fLaC\x00\x00\x00\x22", 8),
    ("ogg", put(27, (0, b"OggS\0")), 27),
    ("parquet", b"PAR1", 12),
]


def ask(spark, rows, formats=tuple(probing.FORMATS)):
    df = spark.createDataFrame([(i, bytearray(h), n) for i, (h, n) in enumerate(rows)], "i int, head binary, length long")
    return {r.i: (r.result, r.format) for r in df.select("i", probing.probe(F.col("head"), F.col("length"), formats).alias("p")).select("i", "p.*").collect()}


def test_every_format_is_found_and_short_files_are_not(spark):
    assert len({f.name for f in probing.FORMATS}) >= 20 and {g[0] for g in GOOD} == {f.name for f in probing.FORMATS}
    got = ask(spark, [(h, n) for _, h, n in GOOD])
    assert [got[i] for i in range(len(GOOD))] == [("success", name) for name, *_ in GOOD]
    short = [k for k, (_, h, n) in enumerate(GOOD) if n > len(h)]
    got = ask(spark, [(GOOD[k][1], GOOD[k][2] - 1) for k in short])
    assert {g[0] for g in got.values()} == {"failure"} or all(g[1] is None for g in got.values())


def test_truncated_heads_want_more(spark):
    rows, own = [], []
    for (name, head, n), f in zip(GOOD, probing.FORMATS):
        assert name == f.name
        for cut in {0, 1, len(head) // 2, len(head) - 1}:
            rows.append((head[:cut], n))
            own.append(f)
    df = spark.createDataFrame([(i, bytearray(h), n) for i, (h, n) in enumerate(rows)], "i int, head binary, length long")
    for f in probing.FORMATS:
        got = {r.i: r.v for r in df.select("i", probing.verdict(F.col("head"), F.col("length"), f).alias("v")).collect()}
        assert {got[i] for i, g in enumerate(own) if g is f} == {"want_more"}


def test_structure_behind_the_magic(spark):
    bad = {
        "samples": put(497, (0, COMPOSER), (110, b"\x41")),
        "restart": put(497, (0, COMPOSER), (112, b"\x80")),
        "order": put(497, (0, COMPOSER), (114, b"\x80")),
        "no tempo": put(497, (0, COMPOSER), (241, b"\x00")),
        "tempo": put(497, (0, COMPOSER), (242, b"\x10")),
        "break": put(497, (0, COMPOSER), (370, b"\x40")),
        "message": put(497, (0, COMPOSER), (2, b"\x01" * 41)),
        "no channel": put(157, (0, GOOD[7][1]), (79, b"\xff")),
        "origin": put(157, (0, GOOD[7][1]), (117, b"\x09")),
        "version": put(66, (0, GOOD[5][1]), (3, b"\x20")),
        "channels": put(66, (0, GOOD[5][1]), (33, b"\x00")),
        "flags": put(608, (0, GOOD[8][1]), (40, b"\x01")),
        "bpm": put(576, (0, GOOD[10][1]), (49, b"\x1f")),
        "digit": put(48, (0, GOOD[9][1]), (14, b"5")),
    }
    got = ask(spark, [(h.ljust(1100, b"\0"), 10**6) for h in bad.values()], [f for f in probing.FORMATS if f.name not in ("mod", "stm")])
    assert {k: got[i][0] for i, k in enumerate(bad)} == dict.fromkeys(bad, "failure")
    assert ask(spark, [(put(1100, (0, COMPOSER), (2, b"\x01" * 40)), 10**6)])[0] == ("success", "669")


def test_heads_of_huge_and_lost_files(spark, tmp_path):
    with open(tmp_path / "huge one.it", "wb") as f:
        f.write(GOOD[2][1])
        f.truncate(1 << 40)
    (tmp_path / "empty.xm").write_bytes(b"")  # Spark lists no file without a byte
    (tmp_path / "cut.s3m").write_bytes(GOOD[4][1][:50])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "noise.bin").write_bytes(b"\x07" * 5000)
    began = time.time()
    got = {os.path.basename(r.path): (r.length, r.result, r.format) for r in probing.probe_files(spark, str(tmp_path)).collect()}
    assert got == {"huge one.it": (1 << 40, "success", "it"), "cut.s3m": (50, "want_more", None), "noise.bin": (5000, "failure", None)}
    assert time.time() - began < 60 and len(probing.read_head(str(tmp_path / "huge one.it"), 1 << 40, probing.HEAD)) == probing.HEAD <= 4096
    gone = spark.createDataFrame([(str(tmp_path / "gone"), 5)], "path string, length long")
    row = probing.heads(gone).first()
    assert row.head is None and "gone" in row.error


@pytest.mark.parametrize("layout, good", [(files.S3M_HEADER, 4), (files.IMF_HEADER, 10), (files.XM_HEADER, 3), (files.IT_HEADER, 2)])
def test_headers_are_read_from_heads(spark, tmp_path, layout, good):
    (tmp_path / "a").write_bytes(GOOD[good][1] + b"x" * 10**6)
    (tmp_path / "b").write_bytes(GOOD[good][1][:34])
    got = {os.path.basename(r.path): r for r in files.decode_headers(spark, str(tmp_path), layout, 2 * 10**6).collect()}
    raw = GOOD[good][1]
    for f in layout:
        part = raw[f.offset : f.offset + f.width]
        want = part.decode("latin-1").rstrip("\0 ") if f.kind == "text" else int.from_bytes(part, "little")
        assert got["a"][f.name] == want
        assert (got["b"][f.name] is None) == (f.offset + f.width > 34)
    assert files.decode_headers(spark, str(tmp_path), layout, 100).filter("path like '%/a'").first().error.endswith("safety limit")
