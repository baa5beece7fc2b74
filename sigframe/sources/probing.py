"""Probing of files by a bounded head: signatures, then the structure behind them.

Spark lists the files; tasks read at most `HEAD` bytes of each, wherever it lies, so the work per file does not depend on its size. The rules are
columns over the head and the file's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.functions.text import decode_int
from sigframe.sources.files import scan_files

HEAD = 2048


@dataclass(frozen=True)
class Number:
    """An unsigned integer in a header, allowed between `low` and `high`."""

    offset: int
    width: int = 1
    low: int = 0
    high: int = 2**32
    endian: str = "little"

    def value(self, head: Column) -> Column:
        return decode_int(head, self.offset, self.width, self.endian)


@dataclass(frozen=True)
class Format:
    """`signs`: (offset, bytes) that must all be there; `size`: bytes of the fixed header; `numbers`: allowed ranges; `runs`: (offset, bytes, pattern
    over their hex digits); `needs`: (factor, number) whose sum plus `least` is the smallest size of the file; `more`: any further rule."""

    name: str
    signs: tuple[tuple[int, bytes], ...]
    size: int = 0
    numbers: tuple[Number, ...] = ()
    runs: tuple[tuple[int, int, str], ...] = ()
    needs: tuple[tuple[int, Number], ...] = ()
    least: int = 0
    more: Callable[[Column], Column] | None = None


def _is_669(head: Column) -> Column:
    """At most 40 control characters in the message, and a tempo for every order that names a pattern."""
    text = F.decode(F.substring(head, 3, 108), "ISO-8859-1")
    controls = F.length(text) - F.length(F.translate(text, "".join(map(chr, range(1, 32))), ""))
    at = lambda i: decode_int(head, i, 1)
    played = F.forall(F.sequence(F.lit(0), F.lit(127)), lambda i: (at(113 + i) >= 128) | (at(241 + i) > 0))
    return (controls <= 40) & played


def _some_channel(head: Column) -> Column:
    return F.hex(F.substring(head, 80, 1)) != "FF"


def _u8(offset: int, low: int = 0, high: int = 255) -> Number:
    return Number(offset, 1, low, high)


def _u16(offset: int, low: int = 0, high: int = 65535) -> Number:
    return Number(offset, 2, low, high)


# Signatures, header sizes, ranges and record sizes of file formats.
_669_RULES = {
    "size": 497,
    "numbers": (_u8(110, 0, 64), _u8(111, 0, 128), _u8(112, 0, 127)),
    "runs": ((113, 128, "([0-7][0-9A-F]|F[EF])*"), (241, 128, "(0[0-9A-F])*"), (369, 128, "([0-3][0-9A-F])*")),
    "needs": ((25, _u8(110)), (1536, _u8(111))),
    "least": 497,
    "more": _is_669,
}
FORMATS = [
    Format("669", ((0, b"if"),), **_669_RULES),
    Format("669", ((0, b"JN"),), **_669_RULES),
    Format("it", ((0, b"IMPM"),), 192, (_u16(32, 0, 4000), _u16(34, 0, 4000), _u16(36, 0, 4000), _u16(38, 0, 4000)), needs=((1, _u16(32)), (4, _u16(34)), (4, _u16(36)), (4, _u16(38))), least=192),
    Format("xm", ((0, b"Extended Module: "),), 80, (_u16(68, 1, 127), _u16(64, 0, 256), _u16(70, 0, 256), _u16(72, 0, 255))),
    Format("s3m", ((44, b"SCRM"),), 96, (_u8(29, 16, 16), _u16(42, 1, 2)), needs=((1, _u16(32)), (2, _u16(34)), (2, _u16(36))), least=96),
    Format("mtm", ((0, b"MTM"),), 66, (_u8(3, 0, 31), _u8(27, 0, 127), _u8(32, 0, 64), _u8(33, 1, 32)), needs=((37, _u8(30)), (192, _u16(24)), (64, _u8(26)), (1, _u16(28))), least=66 + 128 + 64),
    Format("far", ((0, b"FAR\xfe"), (44, b"\r\n\x1a")), 98, (_u16(47, 98),), needs=((1, _u16(47)),)),
    Format("gdm", ((0, b"GDM\xfe"), (68, b"\r\n\x1aGMFS\x01\x00")), 157, (_u16(117, 1, 8),), more=_some_channel),
    Format("ptm", ((44, b"PTMF"), (28, b"\x1a")), 608, (_u8(30, 0, 2), _u16(32, 1, 256), _u16(34, 1, 255), _u16(36, 1, 128), _u16(38, 1, 32), _u16(40, 0, 0)), needs=((80, _u16(34)),), least=608),
    Format("ult", ((0, b"MAS_UTrack_V00"),), 48, (_u8(14, 0x31, 0x34),), needs=((32, _u8(47)),), least=48 + 3 + 256),
    Format("imf", ((60, b"IM10"),), 576, (_u16(32, 0, 256), _u16(36, 0, 255), _u8(49, 32), _u8(50, 0, 64), _u8(51, 4, 127)), needs=((4, _u16(34)), (384, _u16(36))), least=576 + 256),
    Format("plm", ((0, b"PLM\x1a"), (5, b"\x10")), 96, (_u8(54, 1, 32), _u8(4, 96)), needs=((1, _u8(4)), (4, _u16(94)), (4, _u8(93)), (4, _u8(92)))),
    Format("digi", ((0, b"DIGI Booster module\0"),), 610, (_u8(25, 1, 8), _u8(47, 0, 127)), least=610),
    Format("dtm", ((0, b"D.T."),), 22, (Number(4, 4, 14, 256, "big"), Number(8, 2, 0, 0, "big"))),
    Format("dsm", ((0, b"RIFF"), (8, b"DSMF")), 12),
    Format("wav", ((0, b"RIFF"), (8, b"WAVE")), 12, (Number(4, 4, 4),)),
    Format("dbm", ((0, b"DBM0"),), 8),
    Format("dmf", ((0, b"DDMF"),), 66, (_u8(4, 1, 10),)),
    Format("amf", ((0, b"AMF"),), 5, (_u8(3, 8, 14),)),
    Format("amf", ((0, b"ASYLUM Music Format V1.0\0"),), 32),
    Format("ams", ((0, b"Extreme"),), 10),
    Format("ams", ((0, b"AMShdr\x1a"),), 8),
    Format("okt", ((0, b"OKTASONG"),), 16),
    Format("mt2", ((0, b"MT20"),), 64),
    Format("mdl", ((0, b"DMDL"),), 5),
    Format("psm", ((0, b"PSM "), (8, b"FILE")), 12),
    Format("med", ((0, b"MMD"),), 52, (_u8(3, 0x30, 0x33),)),
    Format("stm", ((20, b"!Scream!"),), 48, (_u8(28, 26, 26),)),
    Format("mod", ((1080, b"M.K."),), 1084, (_u8(950, 1, 128),)),
    Format("flac", ((0, b"fLaC"),), 8, (Number(4, 1, 0, 0),)),
    Format("ogg", ((0, b"OggS\0"),), 27),
    Format("parquet", ((0, b"PAR1"),), 4, least=12),
]


def _all(rules: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, rules, F.lit(True))


def verdict(head: Column, length: Column, f: Format) -> Column:
    """success, failure or want_more. A head that ends inside the header asks for more unless what is there already differs."""
    have = F.octet_length(head)
    seen = []
    for offset, sign in f.signs:
        there = F.greatest(F.least(have - offset, F.lit(len(sign))), F.lit(0))
        seen.append(F.hex(F.substr(head, F.lit(offset + 1), there)) == F.left(F.lit(sign.hex().upper()), 2 * there))
    rules = [n.value(head).between(n.low, n.high) for n in f.numbers]
    rules += [F.hex(F.substring(head, o + 1, n)).rlike(f"^({p})$") for o, n, p in f.runs]
    if f.more is not None:
        rules.append(f.more(head))
    need = reduce(lambda a, b: a + b, [factor * n.value(head) for factor, n in f.needs], F.lit(f.least).cast("long"))
    size = max(f.size, *[o + len(s) for o, s in f.signs])
    good = F.coalesce(_all(rules) & (length >= need), F.lit(False))
    return F.when(~_all(seen), "failure").when(have < size, "want_more").when(good, "success").otherwise("failure")


def probe(head: Column, length: Column, formats: Sequence[Format] = tuple(FORMATS)) -> Column:
    """struct(result, format): the first format with success, else want_more if one asks for more, else failure."""
    each = F.array(*[F.struct(verdict(head, length, f).alias("result"), F.lit(f.name).alias("format")) for f in formats])
    found = F.get(F.filter(each, lambda x: x["result"] == "success"), F.lit(0))
    open_ = F.exists(each, lambda x: x["result"] == "want_more")
    result = F.when(found.isNotNull(), "success").when(open_, "want_more").otherwise("failure")
    return F.struct(result.alias("result"), found["format"].alias("format"))


def read_head(path: str, length: int, size: int) -> bytes:
    """The first bytes of a local file or of one in a store that Arrow knows (hdfs, s3, gs)."""
    from pyarrow import fs

    if path.startswith("file:") or ":" not in path.split("/", 1)[0]:
        store, inner = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        return f.read_at(min(size, length), 0)


def heads(files: DataFrame, size: int = HEAD) -> DataFrame:
    """`path, length, head, error` of every row of `path, length`; a file that cannot be read gives an error instead of a head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[bytes | None] = []
            errors: list[str | None] = []
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                try:
                    found.append(read_head(path, length, size))
                    errors.append(None)
                except (OSError, pa.ArrowException) as e:
                    found.append(None)
                    errors.append(str(e).splitlines()[0])
            yield pa.record_batch([b.column("path"), b.column("length"), pa.array(found, pa.binary()), pa.array(errors, pa.string())], ["path", "length", "head", "error"])

    return files.select("path", "length").mapInArrow(run, "path string, length long, head binary, error string")


def probe_files(spark: SparkSession, root: str, glob: str = "*", formats: Sequence[Format] = tuple(FORMATS)) -> DataFrame:
    """`path, length, result, format` of every file below `root` that has a byte; `unreadable` where a head cannot be read."""
    rows = heads(scan_files(spark, root, glob)).withColumn("p", probe(F.col("head"), F.col("length"), formats))
    return rows.select("path", "length", F.when(F.col("error").isNotNull(), "unreadable").otherwise(F.col("p.result")).alias("result"), "p.format")
