"""Lookups, remapping, routing and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.plans.blocked import block_of, running, shifted


def paired_controller(df: DataFrame) -> DataFrame:
    """`value` of a control change `stream, seq, cc, v`: v << 7, or, right after controller cc - 32 (below 32),
    v joined below the previous value's seven bits."""
    near = shifted(df, ["stream"], "seq", {"_cc": ("cc", -1), "_v": ("v", -1)})
    pair = (F.col("_cc") < 32) & (F.col("cc") == F.col("_cc") + 32)
    joined = F.col("v").bitwiseOR(F.shiftleft("_v", 7))
    return near.withColumn("value", F.when(pair, joined).otherwise(F.shiftleft("v", 7))).drop("_cc", "_v")


def instrument_samples(instruments: DataFrame, samples: DataFrame, key: str, keymap: str, sample: str) -> DataFrame:
    """Distinct non-zero samples of each instrument's keymap that exist. Duplicates inside one keymap are dropped
    before the explode, so nothing needs a distinct."""
    used = F.filter(F.array_distinct(keymap), lambda s: s != 0)
    return instruments.select(key, F.explode(used).alias(sample)).join(samples, sample).select(key, sample)


def resolve_missing(refs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found `ref_id, name, path`, left over `ref_id, name`). File names match regardless of case; the smallest
    path is the first hit."""
    offered = files.select(F.lower(F.element_at(F.split("path", "/"), -1)).alias("_name"), "path")
    first = offered.groupBy("_name").agg(F.min("path").alias("path"))
    asked = refs.withColumn("_name", F.lower("name"))
    return asked.join(first, "_name").drop("_name"), asked.join(first, "_name", "left_anti").drop("_name")


def remap_ids(df: DataFrame, column: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Rewrite a foreign key; 0 stays 0 and keys without an entry become 0. Spark broadcasts the mapping if its
    size allows, else joins by shuffle with skew handling."""
    m = mapping.select(F.col(old).alias(column), F.col(new).alias("_new"))
    value = F.when(F.col(column) == 0, F.lit(0)).otherwise(F.coalesce("_new", F.lit(0)))
    return df.join(m, column, "left").withColumn(column, value.cast("long")).drop("_new")


def rate_band(rate: Column) -> Column:
    """Native rate of the measured set to use: up to 44100, up to 72000, above (fixed values)."""
    return F.when(rate <= 44100, 44100).when(rate <= 72000, 48000).otherwise(96000)


LEVELS = 10  # halvings of the grid's extent


def nearest_direction(queries: DataFrame, grid: DataFrame, dims: Sequence[str], query_id: str, grid_id: str) -> DataFrame:
    """Nearest grid direction of every query, ties to the smaller id.

    Space is cut into cells on `LEVELS` + 1 levels, each level's twice as wide as the last one's; every cell that holds a direction has one representative. A query first meets the
    representatives of its own cell on all levels: the nearest of them bounds the answer. On the finest level whose cells are at least as wide as that bound, the answer
    lies in the query's cell or one beside it, so only the directions there are compared, and none can be missed. Queries whose bound exceeds the whole extent (far outside the grid)
    meet all directions. All of it is one plan of equi joins on (level, cell). Equal directions are merged first; rows with a null or NaN coordinate take no part.
    """
    names = [f"_x{i}" for i in range(len(dims))]
    cells = [f"_c{i}" for i in range(len(dims))]
    sound = lambda df: df.filter(reduce(lambda a, b: a & b, [F.col(x).isNotNull() & ~F.isnan(x) for x in names]))
    points = sound(grid.select(F.col(grid_id).alias("_id"), *[F.col(d).cast("double").alias(x) for d, x in zip(dims, names)]))
    points = points.groupBy(*names).agg(F.min("_id").alias("_id"))
    asked = sound(queries.select(F.col(query_id).alias("_q"), *[F.col(d).cast("double").alias(x) for d, x in zip(dims, names)]))
    low = [points.agg(F.min(x)).scalar() for x in names]
    span = points.agg(F.greatest(*[F.max(x) - F.min(x) for x in names], F.lit(0.0)).alias("e") if len(names) > 1 else (F.max(names[0]) - F.min(names[0])).alias("e")).scalar()
    extent = F.when(span > 0, span * (1 + 1e-9)).otherwise(1.0)
    cell = lambda x, lo: F.floor((x - lo) / (extent * F.pow(F.lit(2.0), F.col("_level") - LEVELS))).cast("long")
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("_level")

    on_cells = points.select("*", levels).withColumns({c: cell(F.col(x), lo) for c, x, lo in zip(cells, names, low)})
    key = ["_level", *cells]
    other = [f"_g{i}" for i in range(len(dims))]
    gap = sum(((F.col(x) - F.col(g)) * (F.col(x) - F.col(g)) for x, g in zip(names, other)), F.lit(0.0))
    named = on_cells.select(*key, "_id", *[F.col(x).alias(g) for x, g in zip(names, other)])
    one = named.groupBy(*key).agg(F.min(F.struct("_id", *other)).alias("_r")).select(*key, "_r.*").drop("_id")
    inside = lambda x, lo: F.least(F.greatest(F.col(x), lo), lo + span)
    own = asked.select("*", levels).withColumns({c: cell(inside(x, lo), lo) for c, x, lo in zip(cells, names, low)})
    bound = own.join(one, key).groupBy("_q", *names).agg(F.sqrt(F.min(gap)).alias("_u"))

    level = F.greatest(F.ceil(F.log2(F.col("_u") * (1 + 1e-9) / extent) + LEVELS), F.lit(0)).cast("int")
    bound = bound.withColumn("_level", F.when(F.col("_u") > 0, level).otherwise(0))
    step = [F.struct(*[F.lit(o).alias(c) for o, c in zip(offsets, cells)]) for offsets in product((-1, 0, 1), repeat=len(dims))]
    around = bound.withColumns({c: cell(F.col(x), lo) for c, x, lo in zip(cells, names, low)}).withColumn("_far", F.col("_level") > LEVELS)
    around = around.withColumn("_s", F.explode(F.when(F.col("_far"), F.array(F.struct(*[F.lit(0).alias(c) for c in cells]))).otherwise(F.array(*step))))
    around = around.withColumns({c: F.when(F.col("_far"), F.lit(0)).otherwise(F.col(c) + F.col(f"_s.{c}")).cast("long") for c in cells})
    around = around.withColumn("_level", F.least("_level", F.lit(LEVELS))).select("_q", *names, *key)
    # A cell's queries and directions make far more pairs than the shuffled bytes tell, so as many tasks as there are partitions share them, and a pair is three numbers.
    spread = around.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    pairs = spread.join(named, key).select("_q", F.struct(gap.alias("dist"), F.col("_id").alias("id")).alias("_pair"))
    best = pairs.groupBy("_q").agg(F.min("_pair").alias("_best"))
    return best.select(F.col("_q").alias(query_id), F.col("_best.id").alias(grid_id), F.sqrt("_best.dist").alias("dist"))


@dataclass(frozen=True)
class Directive:
    """A routing rule; channel 0 is any channel, events are numbered by their status nibble."""

    kind: int
    channel: int
    controller: int
    plugin: int
    param: int
    capture: bool
    pattern_edit: bool


CONTROL_CHANGE, CHANNEL_PRESSURE = 11, 13  # fixed values


def route_controls(events: DataFrame, directives: Sequence[Directive]) -> DataFrame:
    """Route control events (`stream, seq, kind, channel, data1, data2`). Rules are tried by controller, in given order within
    ties; a rule fits on kind, channel and, for control changes, the controller or its partner 32 above; the first
    capturing rule that fits ends the search. The last fitting rule that allows pattern edits gives plugin,
    parameter and value. Adds `matches, captured, plugin, param, value`; rules are literals, so there is no join.

    A control change that follows the one 32 below (of those that a rule fits, in the stream's order) joins its seven bits below
    that one's, for its first fitting rule; any further rule gets its own seven bits only."""
    ranked = sorted(directives, key=lambda r: r.controller)
    rules = F.array(*[F.struct(*[F.lit(getattr(r, f.name)).alias(f.name) for f in fields(r)]) for r in ranked])

    def fits(r: Column) -> Column:
        pair = (r["controller"] < 32) & (r["controller"] + 32 == F.col("data1"))
        controller = (F.col("kind") != CONTROL_CHANGE) | (r["controller"] == F.col("data1")) | pair
        return (r["kind"] == F.col("kind")) & ((r["channel"] == 0) | (r["channel"] == F.col("channel") + 1)) & controller

    hits = events.withColumn("_hits", F.filter(rules, fits))
    cut = F.array_position(F.transform("_hits", lambda r: r["capture"]), True)
    hits = hits.withColumn("_cut", cut)
    seen = F.when(F.col("_cut") > 0, F.slice("_hits", 1, F.col("_cut").cast("int"))).otherwise(F.col("_hits"))
    hits = hits.withColumns({"_seen": seen})
    heard = F.when((F.col("kind") == CONTROL_CHANGE) & (F.size("_seen") > 0), F.struct(F.col("data1").alias("cc"), F.col("data2").bitwiseAND(F.lit(127)).alias("v")))
    hits = running(hits, ["stream"], ["seq"], block_of("seq"), {"_before": ("last", heard)}, inclusive=False)
    hits = hits.withColumn("_last", F.get(F.reverse(F.filter("_seen", lambda r: r["pattern_edit"])), F.lit(0)))
    low = F.when(F.col("kind") == CHANNEL_PRESSURE, F.col("data1")).otherwise(F.col("data2").bitwiseAND(F.lit(127)))
    first_edits = ~F.exists(F.slice("_seen", 2, F.greatest(F.size("_seen") - 1, F.lit(0))), lambda r: r["pattern_edit"])
    pair = heard.isNotNull() & (F.col("_before.cc") < 32) & (F.col("data1") == F.col("_before.cc") + 32) & first_edits
    raw = F.when(pair, low.bitwiseOR(F.shiftleft("_before.v", 7))).otherwise(F.shiftleft(low, 7))
    return hits.withColumns(
        {
            "matches": F.size("_seen"),
            "captured": F.col("_cut") > 0,
            "plugin": F.col("_last.plugin"),
            "param": F.col("_last.param"),
            "value": F.when(F.col("_last").isNotNull(), raw),
        }
    ).drop("_hits", "_cut", "_seen", "_last", "_before")


@dataclass(frozen=True)
class EngineSpec:
    name: str
    cache_id: str
    output_rate: int
    max_batch: int
    min_seconds: float


def plan_jobs(items: DataFrame, rate: str, seconds: str, engines: Sequence[EngineSpec]) -> DataFrame:
    """Eligible (item, engine) pairs: the item's rate is below the engine's output rate. Engines are literals."""
    specs = F.array(*[F.struct(*[F.lit(getattr(e, f.name)).alias(f.name) for f in fields(e)]) for e in engines])
    pairs = items.select("*", F.inline(specs))
    return pairs.filter(F.col(rate) < F.col("output_rate")).withColumn("padded_seconds", F.greatest(F.col(seconds), F.col("min_seconds")))


def pending_jobs(jobs: DataFrame, done: DataFrame, key: Sequence[str] = ("content_hash", "cache_id", "cleanup_tag")) -> DataFrame:
    """Jobs without a stored result."""
    return jobs.join(done.select(*key), list(key), "left_anti")


def envelope_at(nodes: DataFrame, asked: DataFrame, key: str, top: int = 64, slot: int = 64) -> DataFrame:
    """Envelope value (0..1) at each asked tick. `nodes` has `key, i, tick, value` with ticks not decreasing.

    A tick takes the first node at or after it: exact there, else linear from the previous node; before the first
    node the line starts at tick 0, value 0; past the last node its value holds. Node spans and asked ticks meet in
    slots of `slot` ticks, an equi join.
    """
    near = shifted(nodes, [key], "i", {"_t1": ("tick", -1), "_v1": ("value", -1)})
    spans = near.select(
        key,
        F.col("tick").alias("_t2"),
        F.col("value").alias("_v2"),
        F.coalesce("_t1", F.lit(0)).alias("_t1"),
        F.coalesce("_v1", F.lit(0)).alias("_v1"),
        F.when(F.col("_t1").isNull(), F.lit(-1)).otherwise(F.col("_t1")).alias("_open"),
    ).filter(F.col("_t2") > F.col("_open"))
    slots = F.sequence(F.floor((F.col("_open") + 1) / slot), F.floor(F.col("_t2") / slot))
    spans = spans.withColumn("_slot", F.explode(slots))
    final = nodes.groupBy(key).agg(F.max_by("value", "i").alias("_hold"), F.max("tick").alias("_end"))
    q = asked.join(final, key)
    late = q.filter(F.col("at") > F.col("_end")).select(key, "at", F.col("_hold").alias("_y"))
    early = q.filter(F.col("at") <= F.col("_end")).withColumn("_slot", F.floor(F.col("at") / slot))
    hit = early.join(spans, [key, "_slot"]).filter((F.col("at") > F.col("_open")) & (F.col("at") <= F.col("_t2")))
    line = F.col("_v1") + (F.col("_v2") - F.col("_v1")) * (F.col("at") - F.col("_t1")) / (F.col("_t2") - F.col("_t1"))
    y = F.when(F.col("at") == F.col("_t2"), F.col("_v2")).otherwise(line)
    both = hit.select(key, "at", y.cast("double").alias("_y")).unionByName(late.withColumn("_y", F.col("_y").cast("double")))
    return both.select(key, "at", F.least(F.greatest(F.col("_y") / top, F.lit(0.0)), F.lit(1.0)).alias("level"))


def play_length_trim(plays: DataFrame, samples: DataFrame, lookahead: int) -> DataFrame:
    """Per sample: the last played position plus a look-ahead (not at a loop end), at most the length; how many
    frames and bytes can go. Samples never played are left out. `samples`: `sample, length, loop_end, frame_bytes`
    (loop_end NULL without a loop)."""
    used = plays.groupBy("sample").agg(F.max("position").alias("_max")).filter(F.col("_max") > 0)
    both = samples.join(used, "sample")
    at_loop = F.coalesce(F.col("_max") == F.col("loop_end"), F.lit(False))
    new = F.when(at_loop, F.col("_max")).otherwise(F.least(F.col("_max") + lookahead, F.col("length")))
    out = both.withColumn("new_length", new).withColumn("trimmable", F.col("length") > F.col("new_length"))
    saved = F.when(F.col("trimmable"), (F.col("length") - F.col("new_length")) * F.col("frame_bytes")).otherwise(0)
    return out.select("sample", "length", "new_length", "trimmable", saved.cast("long").alias("saved"))


def default_map_check(keys: DataFrame) -> DataFrame:
    """Constant transposition per (instrument, sample) from `instr, sample, i, note`, i 0-based. Entries without
    sample or note do not count. Instruments where any sample has two different offsets give no rows; offsets of
    zero are dropped."""
    offset = F.col("note") - (F.col("i") + 1)
    used = keys.filter((F.col("sample") != 0) & (F.col("note") != 0))
    per = used.groupBy("instr", "sample").agg(F.min(offset).alias("offset"), F.max(offset).alias("_hi"))
    mixed = per.filter(F.col("offset") != F.col("_hi")).select("instr").distinct()
    return per.join(mixed, "instr", "left_anti").filter(F.col("offset") != 0).drop("_hi")


def candidate_score(frames: DataFrame, source: DataFrame, nyquist_bin: int) -> DataFrame:
    """Pearson correlation of magnitude spectra with the source, below its Nyquist bin: `item, engine, score`."""
    ours = frames.filter(F.col("bin") < nyquist_bin).select("item", "engine", "bin", F.hypot("re", "im").alias("_m"))
    ref = source.filter(F.col("bin") < nyquist_bin).select("item", "bin", F.hypot("re", "im").alias("_s"))
    return ours.join(ref, ["item", "bin"]).groupBy("item", "engine").agg(F.corr("_m", "_s").alias("score"))
