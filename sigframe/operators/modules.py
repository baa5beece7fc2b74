"""Appending one module (cells, orders, patterns, instruments) to another."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.functions import cells as c
from sigframe.operators.grid import write_effect
from sigframe.operators.lookups import remap_ids
from sigframe.plans.blocked import block_of, dense_index, range_bucket
from sigframe.session import materialize


@dataclass(frozen=True)
class Module:
    """cells: `pattern, row, channel` + cell columns; header: `pattern, rows`; orders: `seq, ord, pattern, kind`;
    instruments: `instr, name`."""

    cells: DataFrame
    header: DataFrame
    orders: DataFrame
    instruments: DataFrame


def _above(df: DataFrame, column: str) -> Column:
    """Largest id of the target, as a scalar subquery."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("_top")).scalar()


def append_modules(target: Module, source: Module, channels: int, min_rows: int = 1) -> Module:
    """Union of two modules. Only source patterns used by its orders, and instruments used by those patterns, come
    along, under fresh ids above the target's. Sequences are added after the target's; order entries whose pattern
    does not exist are dropped and the rest renumbered. If the source has one sequence, position jumps follow
    their order entry, or are cleared when it was dropped. Source patterns shorter than `min_rows` are padded and
    get a pattern break on their last row (or where `write_effect` finds room)."""
    used = source.orders.filter(F.col("kind") == "pattern").groupBy("pattern").agg(F.min(F.struct("seq", "ord")).alias("_first"))
    valid = used.join(source.header, "pattern").select("pattern", "rows", F.col("_first.seq").alias("_s"), F.col("_first.ord").alias("_o"))
    valid = valid.withColumn("_at", F.shiftleft(F.col("_s").cast("long"), 32) + F.col("_o"))
    fresh = dense_index(valid, [], ["_at", "pattern"], range_bucket(valid, "_at"), out="_k")
    patterns = materialize(fresh.select("pattern", "rows", (F.col("_k") + 1 + _above(target.header, "pattern")).alias("new_pattern")), "patterns")

    kept = source.orders.join(patterns.select("pattern", "new_pattern"), "pattern", "left").filter(
        (F.col("kind") != "pattern") | F.col("new_pattern").isNotNull()
    )
    placed = dense_index(kept, ["seq"], ["ord"], block_of("ord", 4096), out="new_ord")
    orders = placed.select(
        (F.col("seq") + 1 + _above(target.orders, "seq")).alias("seq"),
        F.col("new_ord").alias("ord"),
        F.col("new_pattern").alias("pattern"),
        "kind",
    )

    cells = source.cells.join(patterns.select("pattern", "new_pattern"), "pattern")
    named = cells.filter(~c.is_param_note(F.col("note")) & (F.col("instr") != 0)).select("instr")
    brought = source.instruments.join(named, "instr", "left_semi")
    ranked = dense_index(brought, [], ["instr"], range_bucket(brought, "instr"), out="_k")
    new_instr = ranked.select("instr", "name", (F.col("_k") + 1 + _above(target.instruments, "instr")).alias("new_instr"))
    plain = remap_ids(cells.filter(~c.is_param_note(F.col("note"))), "instr", new_instr, "instr", "new_instr")
    moved = plain.unionByName(cells.filter(c.is_param_note(F.col("note"))))

    single = source.orders.agg((F.min("seq") == F.max("seq")).alias("_one")).scalar()
    jumps = placed.select(F.col("ord").alias("param"), F.col("new_ord").alias("_to"), F.lit(True).alias("_known"))
    is_jump = (F.col("command") == c.FX_POSITION_JUMP) & single & ~c.is_param_note(F.col("note"))
    length = source.orders.agg((F.max("ord") + 1).alias("_n")).scalar()
    inside = is_jump & (F.col("param") < length)
    # With several sequences no jump is rewritten, so the lookup only has to be unique per single-sequence source.
    target_of = jumps.groupBy("param").agg(F.min("_to").alias("_to"))
    jumps_inside = F.coalesce(inside, F.lit(False))
    led = moved.filter(jumps_inside).join(target_of, "param", "left").withColumns(
        {
            "command": F.when(F.col("_to").isNull(), 0).otherwise(F.col("command")).cast("long"),
            "param": F.coalesce("_to", "param").cast("long"),
        }
    )
    jumped = led.drop("_to").unionByName(moved.filter(~jumps_inside))
    body = jumped.select(F.col("new_pattern").alias("pattern"), "row", "channel", *c.FIELDS)
    header = patterns.select(F.col("new_pattern").alias("pattern"), F.greatest("rows", F.lit(min_rows)).cast("long").alias("rows"))

    short = patterns.filter(F.col("rows") < min_rows).select(F.col("new_pattern").alias("pattern"), (F.col("rows") - 1).alias("row"))
    marks = write_effect(body, header, short, c.FX_PATTERN_BREAK, 0, channels).filter(F.col("action").isin("free", "moved_to_volume"))
    put = marks.select("pattern", "row", "channel", F.col("action").alias("_act"), F.col("command").alias("_cmd"), F.col("param").alias("_par"))
    broken = body.join(put, ["pattern", "row", "channel"], "full_outer")
    write = F.col("_act").isNotNull()
    shift = F.coalesce(F.col("_act") == "moved_to_volume", F.lit(False))
    pan = F.col("command") == c.FX_PANNING8
    zero = F.lit(0).cast("long")
    final = broken.select(
        "pattern",
        "row",
        "channel",
        F.coalesce("note", zero).alias("note"),
        F.coalesce("instr", zero).alias("instr"),
        F.when(shift, F.when(pan, c.VOL_PANNING).otherwise(c.VOL_VOLUME)).otherwise(F.coalesce("volcmd", zero)).cast("long").alias("volcmd"),
        F.when(shift, F.when(pan, F.floor((F.col("param") + 2) / 4)).otherwise(F.col("param"))).otherwise(F.coalesce("vol", zero)).cast("long").alias("vol"),
        F.when(write, F.col("_cmd")).otherwise(F.coalesce("command", zero)).cast("long").alias("command"),
        F.when(write, F.col("_par")).otherwise(F.coalesce("param", zero)).cast("long").alias("param"),
    )
    return Module(
        target.cells.select("pattern", "row", "channel", *c.FIELDS).unionByName(final),
        target.header.select("pattern", "rows").unionByName(header),
        target.orders.select("seq", "ord", "pattern", "kind").unionByName(orders),
        target.instruments.select("instr", "name").unionByName(new_instr.select(F.col("new_instr").alias("instr"), "name")),
    )
