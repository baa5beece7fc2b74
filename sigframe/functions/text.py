"""Strings, bytes, hashes and packed words as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def truncate(c: Column, size: int) -> Column:
    return F.substring(c, 1, size)


def split_parse(c: Column, sep: str, kind: str) -> Column:
    """Literal-separator split into a typed array; an empty string is an empty array, a bad item is NULL."""
    parts = F.split(c, r"\Q" + sep + r"\E")
    return F.transform(F.when(c == "", F.array().cast("array<string>")).otherwise(parts), lambda p: p.try_cast(kind))


def _occurrences(c: Column, what: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)


def line_ending(c: Column) -> Column:
    """crlf, cr, lf or mixed, by counts."""
    cr, lf, crlf = _occurrences(c, "\r"), _occurrences(c, "\n"), _occurrences(c, "\r\n")
    return (
        F.when((cr == lf) & (cr == crlf), "crlf").when((cr > 0) & (lf == 0), "cr").when((cr == 0) & (lf > 0), "lf").otherwise("mixed")
    )


def normalise_newlines(c: Column) -> Column:
    """One `\\n` per line ending of the detected kind; stray other endings and NULs become spaces; trailing NULs go."""
    body = F.rtrim(c, F.lit("\x00"))
    kind = line_ending(body)
    crlf = F.replace(body, F.lit("\r\n"), F.lit("\n"))
    cr = F.translate(F.translate(body, "\n", " "), "\r", "\n")
    lf = F.translate(body, "\r", " ")
    mixed = F.translate(body, "\r", "\n")
    out = F.when(kind == "crlf", crlf).when(kind == "cr", cr).when(kind == "lf", lf).otherwise(mixed)
    return F.translate(out, "\x00", " ")


def split_fixed(c: Column, width: int, gap: int) -> Column:
    """Lines of `width` characters with `gap` characters between; line breaks and NULs inside become spaces."""
    step = width + gap
    starts = F.sequence(F.lit(0), F.floor((F.length(c) - 1) / step).cast("int"))
    lines = F.transform(starts, lambda i: F.translate(F.substr(c, i * step + 1, F.lit(width)), "\x00\n\r", "   "))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(lines)


def display_name(title: Column, artist: Column) -> Column:
    return F.when(F.coalesce(artist, F.lit("")) == "", title).otherwise(F.concat(title, F.lit(" (by "), artist, F.lit(")")))


def byte_at(content: Column, offset: int | Column) -> Column:
    """Unsigned byte at a 0-based offset of a binary; NULL past the end."""
    pos = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    return F.conv(F.hex(F.substr(content, pos, F.lit(1))), 16, 10).cast("long")


def decode_int(content: Column, offset: int | Column, width: int, endian: str = "little", signed: bool = False) -> Column:
    """1-, 2-, 3- or 4-byte integer from a binary; NULL where it does not fit."""
    order = range(width) if endian == "little" else range(width - 1, -1, -1)
    base = F.lit(offset) if isinstance(offset, int) else offset
    v = None
    for rank, i in enumerate(order):
        part = F.shiftleft(byte_at(content, base + i), 8 * rank)
        v = part if v is None else v + part
    if not signed:
        return v
    return F.when(v >= 1 << (8 * width - 1), v - (1 << (8 * width))).otherwise(v)


def crc_table(bits: int, poly: int) -> np.ndarray:
    """Byte table of a left-shifting CRC with the given polynomial."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        r = b << (bits - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly) & mask if r & top else (r << 1) & mask
        out.append(r)
    return np.array(out, dtype=np.int64)


_CHUNK = 64


def crc_many(contents: list[bytes], bits: int, poly: int) -> np.ndarray:
    """CRC (start 0) of many byte strings at once. Leading zeros do not change such a CRC, so every string is
    padded in front to 64 * 2^m bytes; chunks of equal m are advanced together and then joined pairwise, using
    that a CRC is linear."""
    table, mask = crc_table(bits, poly), (1 << bits) - 1

    def eat(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
        return ((state << 8) & mask) ^ table[(state >> (bits - 8)) ^ byte]

    skip = np.arange(1 << bits, dtype=np.int64)
    for _ in range(_CHUNK):
        skip = eat(skip, 0)
    need = np.array([max(-(-len(c) // _CHUNK) - 1, 0) for c in contents])
    level = np.array([int(x).bit_length() for x in need])
    out = np.zeros(len(contents), dtype=np.int64)
    for m in np.unique(level):
        rows = np.flatnonzero(level == m)
        size = _CHUNK << int(m)
        flat = b"".join(contents[r].rjust(size, b"\0") for r in rows)
        data = np.frombuffer(flat, dtype=np.uint8).reshape(-1, _CHUNK)
        state = np.zeros(len(data), dtype=np.int64)
        for i in range(_CHUNK):
            state = eat(state, data[:, i].astype(np.int64))
        jump = skip
        while len(state) > len(rows):
            state = jump[state[0::2]] ^ state[1::2]
            jump = jump[jump]
        out[rows] = state
    return out


def _crc_udf(bits: int, poly: int):
    @F.pandas_udf("int")
    def crc(content: pd.Series) -> pd.Series:
        some = content.notna()
        out = pd.Series([None] * len(content), dtype="Int32")
        if some.any():
            out[some.to_numpy()] = crc_many([bytes(c) for c in content[some]], bits, poly)
        return out

    return crc


def crc8(content: Column) -> Column:
    """CRC-8 with polynomial 0x07, whole content."""
    return _crc_udf(8, 0x07)(content)


def crc16(content: Column) -> Column:
    """CRC-16 with polynomial 0x8005, whole content."""
    return _crc_udf(16, 0x8005)(content)


def pack_word(kind: Column, channel: Column, data1: Column, data2: Column) -> Column:
    """Status nibble, channel nibble and two data bytes, low byte first."""
    return (
        F.shiftleft(kind, 4)
        .bitwiseOR(channel.bitwiseAND(F.lit(15)))
        .bitwiseOR(F.shiftleft(data1, 8))
        .bitwiseOR(F.shiftleft(data2, 16))
    )


def word_parts(word: Column) -> dict[str, Column]:
    return {
        "kind": F.shiftright(word, 4).bitwiseAND(F.lit(15)),
        "channel": word.bitwiseAND(F.lit(15)),
        "data1": F.shiftright(word, 8).bitwiseAND(F.lit(255)),
        "data2": F.shiftright(word, 16).bitwiseAND(F.lit(255)),
    }


def message_length(status: Column) -> Column:
    """Bytes of a message from its status byte, 1 to 3."""
    high = status.bitwiseAND(F.lit(0xF0))
    return (
        F.when(high.isin(0xC0, 0xD0), 2)
        .when(high == 0xF0, F.when(status.isin(0xF1, 0xF3), 2).when(status == 0xF2, 3).otherwise(1))
        .otherwise(3)
    )


def uuid_parts(text: Column) -> dict[str, Column]:
    """Canonical form, version and variant (2 = the standard one) of 32 hex digits, dashes and braces ignored;
    NULL where the text is no UUID."""
    h = F.lower(F.regexp_replace(text, "[-{}]", ""))
    ok = h.rlike("^[0-9a-f]{32}$")
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    canon = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    variant = F.when(nibble < 8, 0).when(nibble < 12, 2).when(nibble < 14, 6).otherwise(7)
    return {
        "uuid": F.when(ok, canon),
        "version": F.when(ok, F.conv(F.substring(h, 13, 1), 16, 10).cast("int")),
        "variant": F.when(ok, variant),
    }
