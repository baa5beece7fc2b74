"""Operators over event grids: one row per cell, `pattern, row, channel` plus the six cell columns. Empty cells may
be left out. `rows` of a pattern comes from a header table `pattern, rows`."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigframe.functions import cells as c
from sigframe.plans.blocked import block_of, is_one_of, islands, large_values, positions, running, running_whole
from sigframe.session import materialize

ROW_BLOCK = 4096


def pattern_rows(cells: DataFrame) -> DataFrame:
    """A header table for grids without one: rows = last used row + 1."""
    return cells.groupBy("pattern").agg((F.max("row") + 1).alias("rows"))


@dataclass(frozen=True)
class FindSpec:
    """Optional inclusive ranges and exact codes; all given ones must hold. `selection` is
    (row_min, row_max, channel_min, channel_max)."""

    note: tuple[int, int] | None = None
    instr: tuple[int, int] | None = None
    volcmd: int | None = None
    vol: tuple[int, int] | None = None
    command: int | None = None
    param: tuple[int, int] | None = None
    channel: tuple[int, int] | None = None
    selection: tuple[int, int, int, int] | None = None


def matches(spec: FindSpec) -> Column:
    cond = F.lit(True)
    for f in fields(spec):
        want = getattr(spec, f.name)
        if want is None:
            continue
        if f.name == "selection":
            cond = cond & F.col("row").between(*want[:2]) & F.col("channel").between(*want[2:])
        elif isinstance(want, tuple):
            cond = cond & F.col(f.name).between(*want)
        else:
            cond = cond & (F.col(f.name) == want)
    return cond


def find_cells(cells: DataFrame, spec: FindSpec) -> DataFrame:
    return cells.filter(matches(spec))


OCTAVE_UP, OCTAVE_DOWN = 12000, -12000  # fixed values: "one octave" markers for relative note replacement


@dataclass(frozen=True)
class Replace:
    """mode is set, relative or multiply (percent)."""

    mode: str
    value: int


def replace_cells(cells: DataFrame, find: FindSpec, repl: Mapping[str, Replace], octave: int = 12) -> DataFrame:
    """Change the matching cells. Relative notes move musical notes only and stay in 1..128, the octave markers
    move by `octave`; other columns are clamped to 0..255. Multiplication is in percent, rounded half up."""
    hit = matches(find)
    out = {}
    for name, r in repl.items():
        cur = F.col(name)
        lo, hi = (c.NOTE_MIN, c.NOTE_MAX) if name == "note" else (0, 255)
        if r.mode == "set":
            new = F.lit(r.value)
        elif r.mode == "relative":
            step = {OCTAVE_UP: octave, OCTAVE_DOWN: -octave}.get(r.value, r.value) if name == "note" else r.value
            new = F.least(F.greatest(cur + step, F.lit(lo)), F.lit(hi))
        elif r.mode == "multiply":
            new = F.least(F.greatest(F.floor((cur * r.value + 50) / 100), F.lit(lo)), F.lit(hi))
        else:
            raise ValueError(r.mode)
        allowed = hit & c.is_note(cur) if name == "note" and r.mode != "set" else hit
        out[name] = F.when(allowed, new).otherwise(cur).cast("long")
    return cells.withColumns(out)


def map_cells(cells: DataFrame, fn: Callable[[dict[str, Column]], dict[str, Column]]) -> DataFrame:
    """Apply a function of the cell columns to every cell; it returns the columns to change."""
    return cells.withColumns(fn({f: F.col(f) for f in [*c.FIELDS, "pattern", "row", "channel"]}))


def expand(cells: DataFrame, header: DataFrame, max_rows: int) -> DataFrame:
    """Double the row distance in patterns whose doubled length stays within `max_rows`."""
    ok = header.select("pattern", (F.col("rows") * 2 <= max_rows).alias("_ok"))
    return cells.join(ok, "pattern").withColumn("row", F.when(F.col("_ok"), F.col("row") * 2).otherwise(F.col("row"))).drop("_ok")


def shrink(cells: DataFrame, header: DataFrame, min_rows: int) -> DataFrame:
    """Fold row pairs: the even row stays; where it has neither note nor instrument it is filled from the odd row
    (note and instrument; volume if the odd row has a volume command; effect if the even row has none). A last odd
    row without partner is dropped. Patterns shorter than twice `min_rows` stay. Cells that end empty are left out."""
    sized = cells.join(header.select("pattern", "rows"), "pattern")
    small = F.col("rows") < 2 * min_rows
    lane = F.struct(*[F.col(f) for f in c.FIELDS])
    half = F.floor(F.col("row") / 2).cast("long")
    kept = sized.filter(small).select("pattern", "row", "channel", *c.FIELDS)
    pairs = (
        sized.filter(~small & (half < F.floor(F.col("rows") / 2)))
        .groupBy("pattern", "channel", half.alias("row"))
        .agg(F.max(F.when(F.col("row") % 2 == 0, lane)).alias("a"), F.max(F.when(F.col("row") % 2 == 1, lane)).alias("b"))
    )

    def get(side: str, f: str) -> Column:
        return F.coalesce(F.col(f"{side}.{f}"), F.lit(0).cast("long"))

    fill = (get("a", "note") == 0) & (get("a", "instr") == 0)
    vol = fill & (get("b", "volcmd") != 0)
    fx = fill & (get("a", "command") == 0)
    use = {"note": fill, "instr": fill, "volcmd": vol, "vol": vol, "command": fx, "param": fx}
    folded = pairs.select(
        "pattern", "row", "channel", *[F.when(use[f], get("b", f)).otherwise(get("a", f)).alias(f) for f in c.FIELDS]
    )
    return kept.unionByName(folded).filter(~c.is_empty())


def resize_pattern(
    cells: DataFrame, header: DataFrame, new_rows: int, min_rows: int, max_rows: int, at_end: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Pad or cut all patterns to `new_rows` at their end or start. Returns (cells, header); a length outside the
    limits changes nothing."""
    if new_rows < 1 or not min_rows <= new_rows <= max_rows:
        return cells, header
    sized = cells.join(header.select("pattern", "rows"), "pattern")
    row = F.col("row") if at_end else F.col("row") + new_rows - F.col("rows")
    out = sized.withColumn("row", row).filter(F.col("row").between(0, new_rows - 1)).drop("rows")
    return out, header.withColumn("rows", F.lit(new_rows).cast("long"))


MASK_BITS = {f: 1 << i for i, f in enumerate(c.FIELDS)}  # note 1, instr 2, volcmd 4, vol 8, command 16, param 32


def _along_channels(cells: DataFrame, cols: Mapping[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Running values of every channel. Patterns of ordinary size stay in the partition they are in already; only large ones are cut into blocks of rows."""
    large = large_values(cells, "pattern")
    keys, order = ["pattern", "channel"], ["row"]
    if not large:
        return running_whole(cells, keys, order, cols, inclusive)
    return running(cells, keys, order, block_of("row", ROW_BLOCK), cols, inclusive, large=is_one_of("pattern", large))


def change_mask(cells: DataFrame) -> DataFrame:
    """`mask` of the columns that differ from the previous cell of the channel (all zero before the first)."""
    whole = F.struct(*c.FIELDS)
    prev = _along_channels(cells, {"_prev": ("last", whole)}, inclusive=False)
    mask = sum(
        (F.when(F.col(f) != F.coalesce(F.col(f"_prev.{f}"), F.lit(0)), bit).otherwise(0) for f, bit in MASK_BITS.items()),
        F.lit(0),
    )
    return prev.withColumn("mask", mask.cast("long")).drop("_prev")


def forward_fill(masked: DataFrame) -> DataFrame:
    """Inverse of `change_mask`: columns whose bit is clear take the channel's last written value, or 0."""
    written = {
        f"_{f}": ("last", F.when(F.col("mask").bitwiseAND(F.lit(bit)) != 0, F.col(f))) for f, bit in MASK_BITS.items()
    }
    out = _along_channels(masked, written)
    return out.withColumns({f: F.coalesce(f"_{f}", F.lit(0)).cast("long") for f in c.FIELDS}).drop(*written)


SIGNATURE = ["sig_a", "sig_b", "sig_c", "sig_d", "cells"]


def grid_signature() -> list[Column]:
    """Order-free, combinable signature of a pattern: the sums of both halves of two independent 64-bit hashes of each cell
    and the number of cells. Sums of halves fit a long up to 2^31 cells."""
    where = [F.col("row"), F.col("channel")]
    parts = [*where, *c.comparable().values()]
    hashes = [F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)]
    halves = [x for h in hashes for x in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    return [*[F.sum(x).alias(k) for k, x in zip(SIGNATURE, halves)], F.count(F.lit(1)).alias("cells")]


def pattern_groups(cells: DataFrame) -> DataFrame:
    """`pattern, same_as`: the smallest pattern with an identical grid. Candidates come from the signature and are
    then compared cell by cell with that smallest pattern, so a hash collision cannot merge two patterns; each
    pattern is compared once, never pair by pair."""
    used = cells.filter(~c.is_empty())
    sigs = materialize(used.groupBy("pattern").agg(*grid_signature()), "signatures")
    first = sigs.groupBy(*SIGNATURE).agg(F.min("pattern").alias("same_as"))
    cand = materialize(sigs.join(first, SIGNATURE).select("pattern", "same_as", "cells"), "candidates")
    flat = used.select("pattern", "row", "channel", *[e.alias(k) for k, e in c.comparable().items()])
    others = cand.filter(F.col("pattern") != F.col("same_as"))
    mine = flat.join(others, "pattern")
    # Only the representatives that have a copy are needed, and each once.
    theirs = flat.join(others.select(F.col("same_as").alias("pattern")).distinct(), "pattern", "left_semi")
    theirs = theirs.withColumnRenamed("pattern", "same_as")
    equal = (
        mine.join(theirs, ["same_as", "row", "channel", *c.FIELDS], "left_semi")
        .groupBy("pattern", "same_as", "cells")
        .agg(F.count(F.lit(1)).alias("_hits"))
        .filter(F.col("_hits") == F.col("cells"))
        .select("pattern", F.col("same_as").alias("_twin"))
    )
    return cand.join(equal, "pattern", "left").select("pattern", F.coalesce("_twin", "pattern").alias("same_as"))


def duplicate_patterns(cells: DataFrame) -> DataFrame:
    """Only the groups of two or more: `pattern, same_as, members`."""
    groups = materialize(pattern_groups(cells), "groups")
    many = groups.groupBy("same_as").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return groups.join(many, "same_as").select("pattern", "same_as", "members")


def common_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct cells, position and content, found in both grids (`intersect` on normalised cells)."""
    return normalised(a).intersect(normalised(b))


def only_in_a(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of `a` not in `b`, with multiplicity (`exceptAll` on normalised cells)."""
    return normalised(a).exceptAll(normalised(b))


def normalised(cells: DataFrame) -> DataFrame:
    return cells.select("row", "channel", *[e.alias(k) for k, e in c.comparable().items()])


def trace_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows that are missing on one side or differ in a value (null-safe): keys, `status` and both values."""
    la = a.select(*keys, *[F.col(x).alias(f"a_{x}") for x in values], F.lit(1).alias("_a"))
    rb = b.select(*keys, *[F.col(x).alias(f"b_{x}") for x in values], F.lit(1).alias("_b"))
    same = F.lit(True)
    for x in values:
        same = same & F.col(f"a_{x}").eqNullSafe(F.col(f"b_{x}"))
    status = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("changed")
    return la.join(rb, list(keys), "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull() | ~same).select(
        *keys, status.alias("status"), *[f"{s}_{x}" for x in values for s in ("a", "b")]
    )


def unused_entities(entities: DataFrame, refs: DataFrame, key: str, ref: str) -> DataFrame:
    return entities.join(refs.select(F.col(ref).alias(key)), key, "left_anti")


def used_entities(entities: DataFrame, refs: DataFrame, key: str, ref: str) -> DataFrame:
    return entities.join(refs.select(F.col(ref).alias(key)), key, "left_semi")


EFFECT_TYPES = ["normal", "global", "volume", "panning", "pitch"]  # fixed values: effect kinds 0..4


def usage_cube(cells: DataFrame, kind: Column) -> DataFrame:
    """Cell counts by pattern, channel and effect kind with every subtotal; `level` is the grouping id."""
    return (
        cells.withColumn("kind", kind)
        .cube("pattern", "channel", "kind")
        .agg(F.count(F.lit(1)).alias("uses"), F.grouping_id().cast("long").alias("level"))
    )


def entity_counts(cells: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct channels, patterns, instruments and notes. Exact counting shuffles one row per distinct value and
    input partition; the approximate form keeps a fixed-size sketch instead."""
    if approximate:
        cnt = F.approx_count_distinct
        return cells.agg(*[cnt(x).alias(f"{x}s") for x in ("channel", "pattern", "instr", "note")])
    return cells.agg(*[F.count_distinct(F.col(x)).alias(f"{x}s") for x in ("channel", "pattern", "instr", "note")])


DEFAULT_SPEED, DEFAULT_TEMPO = 6, 125  # fixed values: initial ticks per row and tempo


def timeline(cells: DataFrame, header: DataFrame) -> DataFrame:
    """Start time of every row: a row lasts speed ticks of 2.5 / tempo seconds; speed and tempo effects (non-zero,
    the highest channel wins) hold from their row on. Rows without cells are generated from the header.

    Blocks of rows meet the effects inside them, and rows are generated behind that join. Patterns of one block need no more. In the others, until a block sets a
    speed or a tempo, its time is a multiple of the speed, of 1 / tempo or of both that it is entered
    with, so four sums and the last values of each block give all blocks their entries.
    """
    kinds = {"_speed": c.FX_SPEED, "_tempo": c.FX_TEMPO}
    marks = (
        cells.filter(F.col("command").isin(*kinds.values()) & (F.col("param") > 0))
        .groupBy("pattern", "row")
        .agg(*[F.max_by("param", F.when(F.col("command") == code, F.col("channel"))).cast("long").alias(name) for name, code in kinds.items()])
        .groupBy("pattern", block_of("row", ROW_BLOCK).alias("_at"))
        .agg(F.collect_list(F.struct(F.col("row").cast("long").alias("row"), *kinds, F.lit(True).alias("_mark"))).alias("_marks"))
    )
    inside = W.partitionBy("pattern", "_at").orderBy("row")

    def filled(some: DataFrame) -> DataFrame:
        last = F.floor((F.col("rows") - 1) / ROW_BLOCK).cast("long")
        blocks = some.filter("rows > 0").select("pattern", "rows", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_at"))
        top = F.least((F.col("_at") + 1) * ROW_BLOCK, F.col("rows").cast("long")) - 1
        none = F.lit(None).cast("long")
        own = F.transform(F.sequence(F.col("_at") * ROW_BLOCK, top), lambda n: F.struct(n.alias("row"), none.alias("_speed"), none.alias("_tempo"), F.lit(False).alias("_mark")))
        met = blocks.join(marks, ["pattern", "_at"], "left")
        rows = met.select("pattern", "_at", F.explode(F.when(F.col("_marks").isNull(), own).otherwise(F.concat("_marks", own))).alias("_r")).select("pattern", "_at", "_r.*")
        so_far = W.partitionBy("pattern", "_at").orderBy("row", F.desc("_mark")).rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumns({x: F.last(x, True).over(so_far) for x in kinds}).filter("not _mark").drop("_mark")

    def timed(rows: DataFrame, speed: Column, tempo: Column, start: Column) -> DataFrame:
        out = rows.withColumns({"speed": F.coalesce("_speed", speed).cast("long"), "tempo": F.coalesce("_tempo", tempo).cast("long"), "_start": start})
        out = out.withColumn("seconds", F.col("speed") * F.lit(2.5) / F.col("tempo"))
        run = F.coalesce(F.sum("seconds").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        return out.withColumn("start", F.col("_start") + run).select("pattern", "row", "speed", "tempo", "seconds", "start")

    whole = timed(filled(header.filter(F.col("rows") <= ROW_BLOCK)), F.lit(DEFAULT_SPEED), F.lit(DEFAULT_TEMPO), F.lit(0.0))
    local = filled(header.filter(F.col("rows") > ROW_BLOCK))
    ticks, pace = F.coalesce("_speed", F.lit(1)), F.coalesce("_tempo", F.lit(1))
    share = lambda s, t: F.coalesce(F.sum(F.when(F.col("_speed").isNull() == F.lit(s), F.when(F.col("_tempo").isNull() == F.lit(t), ticks * F.lit(2.5) / pace))), F.lit(0.0))
    blocks = local.groupBy("pattern", "_at").agg(
        F.max_by("_speed", "row").alias("_s"), F.max_by("_tempo", "row").alias("_t"),
        share(False, False).alias("_both"), share(True, False).alias("_by_speed"), share(False, True).alias("_by_tempo"), share(True, True).alias("_open"),
    )
    before = W.partitionBy("pattern").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    entry = blocks.withColumns({"_s": F.coalesce(F.last("_s", True).over(before), F.lit(DEFAULT_SPEED)), "_t": F.coalesce(F.last("_t", True).over(before), F.lit(DEFAULT_TEMPO))})
    spent = F.col("_both") + F.col("_by_speed") * F.col("_s") + F.col("_by_tempo") / F.col("_t") + F.col("_open") * F.col("_s") / F.col("_t")
    entry = entry.select("pattern", "_at", "_s", "_t", F.coalesce(F.sum(spent).over(before), F.lit(0.0)).alias("_from"))
    return whole.unionByName(timed(local.join(entry, ["pattern", "_at"]), F.col("_s"), F.col("_t"), F.col("_from")))


def position_at(rows: DataFrame, asked: DataFrame, width: float = 10.0) -> DataFrame:
    """The row playing at each asked `pattern, sec` (seconds): both sides meet in time slots of `width` seconds, so
    the as-of lookup is an equi join; times past the end give no row."""
    spans = rows.select("pattern", "row", "start", (F.col("start") + F.col("seconds")).alias("end")).withColumn(
        "_slot", F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long")))
    )
    q = asked.withColumn("_slot", F.floor(F.col("sec") / width).cast("long"))
    hit = (F.col("sec") >= F.col("start")) & (F.col("sec") < F.col("end"))
    return q.join(spans, ["pattern", "_slot"]).filter(hit).select("pattern", "sec", "row")


@dataclass(frozen=True)
class FormatSpec:
    """Limits of one format; a command is supported if its character in the command string is not `?`."""

    format: str
    note_min: int
    note_max: int
    note_cut: bool
    note_off: bool
    note_fade: bool
    param_notes: bool
    commands: str
    volcommands: str


def conformance(cells: DataFrame, specs: Sequence[FormatSpec]) -> DataFrame:
    """Violations per format and cell. The limits are a literal array, so the check stays in the scan's stage."""
    note = F.col("note")
    special = (
        F.when(note == c.NOTE_CUT, F.col("note_cut"))
        .when(note == c.NOTE_OFF, F.col("note_off"))
        .when(note == c.NOTE_FADE, F.col("note_fade"))
        .when(c.is_param_note(note), F.col("param_notes"))
        .otherwise(F.lit(False))
    )
    bad_note = ~((note == 0) | note.between(F.col("note_min"), F.col("note_max")) | special)

    def unsupported(names: str, code: str) -> Column:
        letter = F.substr(F.col(names), F.col(code).cast("int") + 1, F.lit(1))
        return (letter == "?") | (letter == "")

    found = F.array_compact(
        F.array(
            F.when(bad_note, "note"),
            F.when(unsupported("commands", "command"), "command"),
            F.when(unsupported("volcommands", "volcmd"), "volcmd"),
        )
    )
    limits = F.array(*[F.struct(*[F.lit(getattr(s, f.name)).alias(f.name) for f in fields(s)]) for s in specs])
    pairs = cells.select("*", F.inline(limits))
    return pairs.select("format", "pattern", "row", "channel", F.explode(found).alias("violation"))


@dataclass(frozen=True)
class Effect:
    """What to write: an effect with its parameter, or with `volume` a volume command with its value.

    `channel`: only there (else any); `multiple`: write although the same is already on the row; `retry`: rows to try if a row has no space ("none", "next",
    "previous", towards that end of the pattern). `s3m`: panning has 129 steps; `volume_column`: the format has volume commands there.
    """

    command: int
    param: int
    volume: bool = False
    channel: int | None = None
    multiple: bool = False
    retry: str = "next"
    s3m: bool = False
    volume_column: bool = True

    def converted(self) -> Effect | None:
        """The same in the other column; None if there is no such thing."""
        pan = 2 if self.s3m else 4
        if self.volume:
            table = {c.VOL_VOLUME: (c.FX_VOLUME, self.param), c.VOL_PANNING: (c.FX_PANNING8, min(self.param * pan, 255))}
        elif self.s3m and self.param > 0x80:
            table = {c.FX_VOLUME: (c.VOL_VOLUME, min(self.param, 64))}
        else:
            table = {c.FX_VOLUME: (c.VOL_VOLUME, min(self.param, 64)), c.FX_PANNING8: (c.VOL_PANNING, (self.param // 2) if self.s3m else min((self.param + 2) // 4, 64))}
        new = table.get(self.command)
        return new and replace(self, command=new[0], param=new[1], volume=not self.volume)

    def forms(self) -> list[list[Effect]]:
        """What is tried on the first row, on every second row from the next one, and on every second row from the one after that. A converted form stays for the next row, where the
        other one, converted back, comes second."""
        turned = self.converted()
        if turned is None:
            return [[self]] * 3
        back = turned.converted()
        return [[self, turned], [turned, back], [back, back.converted()]]


def _best(forms: list[Effect], original: Effect, lo: int, hi: int) -> Column:
    """The first way to write on a row with the cells `_c`: struct(channel, action, command, param, in_volume). Only the first form may
    move what is there."""
    every = F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))
    where = lambda test: F.transform(F.filter("_c", test), lambda x: x["channel"].cast("long"))
    code = lambda name, test: where(lambda x: test(x[name]))
    out = []
    for e in forms:
        own = "volcmd" if e.volume else "command"
        ways = [("free", F.array_min(F.array_except(every, code(own, lambda v: v != 0))))]
        if not e.multiple:
            wanted = F.lit(e.command)
            ways.insert(0, ("present", F.array_min(code(own, lambda v: v == wanted))))  # noqa: B023
        if e is forms[0] and not e.volume:
            ways.append(("moved_to_volume", F.array_min(where(_movable(e)))))
        out += [F.when(at.isNotNull(), _way(at, name, e, original)) for name, at in ways]
    return F.coalesce(*out)


def _movable(e: Effect):
    """Whether a cell's effect can go to its volume column."""
    volume, wide = F.lit(e.volume_column), F.lit(not e.s3m)
    return lambda x: (x["command"] == c.FX_VOLUME) & volume | (x["command"] == c.FX_PANNING8) & ((x["param"] <= 0x80) | wide)


def _way(channel: Column, action: str, e: Effect, original: Effect) -> Column:
    name = action if e.volume == original.volume else f"converted_{action}"
    return F.struct(channel.cast("long").alias("channel"), F.lit(name).alias("action"), F.lit(e.command).alias("command"), F.lit(e.param).alias("param"), F.lit(e.volume).alias("in_volume"))


def place_effect(cells: DataFrame, header: DataFrame, target: DataFrame, effect: Effect, channels: int) -> DataFrame:
    """Place one effect per pattern at `target` (`pattern, row`) or, failing that, on the nearest row in the direction of `retry` that has space.

    On a row: already there - nothing to do; else the first free channel; else the first channel holding a volume or panning effect, which
    moves to the volume column; else, converted to the other column, there or free in that column (see `Effect.forms` for further rows). Returns per pattern
    `pattern, row, channel, action` and what is written (`command, param, in_volume`); patterns with no possible row are absent.

    Only rows that have cells are looked at. Those without space are merged into runs of rows, so only the run around the target counts, however long it
    is.
    """
    lo, hi = (0, channels - 1) if effect.channel is None else (effect.channel, effect.channel)
    start = target.select("pattern", F.col("row").alias("_from")).join(header.select("pattern", "rows"), "pattern").filter(F.col("_from").between(0, F.col("rows") - 1))
    cell = F.struct("channel", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("command", "volcmd", "param")])
    rows = cells.filter(F.col("channel").between(lo, hi)).groupBy("pattern", "row").agg(F.collect_list(cell).alias("_c"))
    ahead = (F.col("row") - F.col("_from")) * (-1 if effect.retry == "previous" else 1)
    forms = effect.forms()
    which = lambda make: F.when(F.col("row") == F.col("_from"), make(forms[0])).when((F.col("row") - F.col("_from")) % 2 != 0, make(forms[1])).otherwise(make(forms[2]))
    rows = rows.join(start, "pattern").filter(ahead >= 0).select("pattern", "row", "_from", which(lambda f: _best(f, effect, lo, hi)).alias("best"))
    rows = rows.filter("row = _from") if effect.retry == "none" else rows
    full = islands(rows.filter("best is null").select("pattern", "row"), ["pattern"], "row")
    near = start.join(full, "pattern", "left").withColumn("_in", F.col("_from").between(F.col("start_n"), F.col("end_n")))
    past = {"next": F.col("end_n") + 1, "previous": F.col("start_n") - 1, "none": F.lit(-1)}[effect.retry]
    at = near.groupBy("pattern", "_from", "rows").agg(F.max(F.when(F.col("_in"), past)).alias("row")).withColumn("row", F.coalesce("row", "_from"))
    at = at.filter(F.col("row").between(0, F.col("rows") - 1))
    found = at.join(rows.select("pattern", "row", "best"), ["pattern", "row"], "left")
    empty = which(lambda f: _way(F.lit(lo), "free", f[0], effect))
    return found.withColumn("best", F.coalesce("best", empty)).select("pattern", "row", "best.*")


def write_effect(cells: DataFrame, header: DataFrame, target: DataFrame, command: int, param: int, channels: int) -> DataFrame:
    """`place_effect` on the next rows: `pattern, row, channel, action, command, param`."""
    return place_effect(cells, header, target, Effect(command, param), channels).drop("in_volume")
