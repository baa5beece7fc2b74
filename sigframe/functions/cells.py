"""Predicates and packing for event-grid cells as Column expressions over
`note, instr, volcmd, vol, command, param`. The value 0 means "nothing" in every column of a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Note codes.
NOTE_NONE, NOTE_MIN, NOTE_MAX, NOTE_MIDDLE_C = 0, 1, 128, 61
NOTE_PARAM_SMOOTH, NOTE_PARAM, NOTE_FADE, NOTE_CUT, NOTE_OFF = 251, 252, 253, 254, 255
# Volume column codes.
VOL_NONE, VOL_VOLUME, VOL_PANNING, VOL_TONE_PORTA = 0, 1, 2, 11
# Effect codes used by the operators.
FX_NONE, FX_TONE_PORTA, FX_TONE_PORTA_VOL, FX_VIBRATO_VOL, FX_PANNING8 = 0, 4, 6, 7, 9
FX_VOLUME_SLIDE, FX_POSITION_JUMP, FX_VOLUME, FX_PATTERN_BREAK, FX_SPEED, FX_TEMPO = 11, 12, 13, 14, 16, 17
FX_TONE_PORTA_DURATION = 55

FIELDS = ["note", "instr", "volcmd", "vol", "command", "param"]


def is_param_note(note: Column) -> Column:
    return note.isin(NOTE_PARAM, NOTE_PARAM_SMOOTH)


def is_note(note: Column) -> Column:
    return note.between(NOTE_MIN, NOTE_MAX)


def is_empty() -> Column:
    return (F.col("note") == 0) & (F.col("instr") == 0) & (F.col("volcmd") == 0) & (F.col("command") == 0)


def cell_class() -> Column:
    note = F.col("note")
    return (
        F.when(is_empty(), "empty")
        .when(is_note(note), "note")
        .when(is_param_note(note), "param_note")
        .when(note.between(NOTE_PARAM_SMOOTH, NOTE_OFF), "special")
        .when(note == NOTE_NONE, "no_note")
        .otherwise("invalid")
    )


def is_tone_porta() -> Column:
    fx = F.col("command").isin(FX_TONE_PORTA, FX_TONE_PORTA_VOL, FX_TONE_PORTA_DURATION)
    return fx | (F.col("volcmd") == VOL_TONE_PORTA)


def is_volume_slide() -> Column:
    return F.col("command").isin(FX_VOLUME_SLIDE, FX_VIBRATO_VOL, FX_TONE_PORTA_VOL)


def is_amiga_note() -> Column:
    """Not a musical note, or inside the three octaves from one below middle C."""
    note = F.col("note")
    return ~is_note(note) | ((note >= NOTE_MIDDLE_C - 12) & (note < NOTE_MIDDLE_C + 24))


def pack_value(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 8) + low


def unpack_high(v: Column) -> Column:
    return F.shiftright(v, 8)


def unpack_low(v: Column) -> Column:
    return v.bitwiseAND(F.lit(255))


def comparable() -> dict[str, Column]:
    """The six columns with the ignored ones set to 0: `vol` without a volume command and `param` without an
    effect do not count, unless the cell is a parameter note."""
    pc = is_param_note(F.col("note"))
    return {
        "note": F.col("note"),
        "instr": F.col("instr"),
        "volcmd": F.col("volcmd"),
        "vol": F.when((F.col("volcmd") == VOL_NONE) & ~pc, F.lit(0)).otherwise(F.col("vol")).cast("long"),
        "command": F.col("command"),
        "param": F.when((F.col("command") == FX_NONE) & ~pc, F.lit(0)).otherwise(F.col("param")).cast("long"),
    }


def cell_key() -> Column:
    """A struct that is equal exactly when two cells are equal."""
    return F.struct(*[c.alias(k) for k, c in comparable().items()])


def valid_signature(rows_per_beat: Column, rows_per_measure: Column, max_beat: int, max_measure: int) -> Column:
    return (
        (rows_per_beat > 0)
        & (rows_per_beat <= max_beat)
        & (rows_per_beat <= rows_per_measure)
        & (rows_per_measure <= max_measure)
    )
