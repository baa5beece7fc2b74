"""The block layout must not show in results: small blocks, large blocks and plain windows agree, also on hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import column, signal
from sigframe.functions import cells as c
from sigframe.operators import clicks, filters, signal_ops, transforms
from sigframe.operators import grid as g
from sigframe.operators.signal_stats import attach_by_block, lengths
from sigframe.plans import blocked, views
from sigframe.plans.blocked import block_of, dense_index, islands, positions, range_bucket, running, shifted

random.seed(3)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most of the rows."""
    rows = [(1 if i % 10 else i % 7 + 2, i, random.randint(-50, 50) if i % 5 else None) for i in range(1500)]
    return spark.createDataFrame(rows, "k long, t long, v long").cache()


@pytest.mark.parametrize("kind", ["sum", "max", "min", "count", "last"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_one_window(spark, skewed, kind, inclusive):
    got = running(skewed, ["k"], ["t"], block_of("t", 64), {"r": (kind, F.col("v"))}, inclusive=inclusive)
    name = {"last": "last_value(v) IGNORE NULLS"}.get(kind, f"{kind}(v)")
    end = "CURRENT ROW" if inclusive else "1 PRECEDING"
    skewed.createOrReplaceTempView("skewed")
    want = spark.sql(f"SELECT *, {name} OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND {end}) AS r FROM skewed")
    if kind in ("sum", "count"):
        want = want.withColumn("r", F.coalesce("r", F.lit(0)))
    assert got.select("k", "t", "r").exceptAll(want.select("k", "t", "r")).count() == 0
    assert got.count() == want.count()


def test_dense_index_with_buckets(spark, skewed):
    bucket = range_bucket(skewed, "t", 16)
    got = dense_index(skewed, ["k"], ["t"], bucket)
    want = dense_index(skewed, ["k"], ["t"], F.lit(0))
    assert got.select("k", "t", "n").exceptAll(want.select("k", "t", "n")).count() == 0
    all_rows = dense_index(skewed, [], ["t"], bucket)
    assert [r.n for r in all_rows.orderBy("t").collect()] == list(range(1500))


def test_shifted_crosses_blocks(spark):
    s = signal(spark, range(40))
    out = shifted(s, ["signal_id"], "n", {"a": ("x", -3), "b": ("x", 5)}, size=7)
    rows = out.orderBy("n").collect()
    assert [r.a for r in rows] == [None] * 3 + [float(i) for i in range(37)]
    assert [r.b for r in rows] == [float(i) for i in range(5, 40)] + [None] * 5


@pytest.mark.parametrize("size", [4, 16, 1 << 16])
def test_islands(spark, size):
    spots = [0, 1, 2, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 30, 31, 32]
    df = spark.createDataFrame([(1, n, float(n)) for n in spots], "k long, n long, z double")
    got = islands(df, ["k"], "n", {"top": ("max", F.col("z")), "rows": ("count", F.col("z"))}, size)
    assert sorted((r.start_n, r.end_n, r.top, r.rows) for r in got.collect()) == [(0, 2, 2.0, 3), (5, 5, 5.0, 1), (7, 17, 17.0, 11), (30, 32, 32.0, 3)]


def test_positions_and_attach(spark):
    per = spark.createDataFrame([(1, 0, 10), (2, 0, 3), (3, 0, 0)], "signal_id long, channel int, frames long")
    assert positions(per, ["signal_id"], "frames", "n", size=4).groupBy("signal_id").count().orderBy("signal_id").collect() == [(1, 10), (2, 3)]
    s = signal(spark, range(10))
    assert attach_by_block(s, lengths(s), size=3).filter("frames = 10").count() == 10


@pytest.mark.parametrize("size", [64, 1024])
def test_residual_block_size(spark, size):
    xs = np.random.default_rng(1).normal(size=700)
    s = signal(spark, xs)
    a = column(clicks.robust_residual(s, 15, size), "z")
    b = column(clicks.robust_residual(s, 15), "z")
    assert a == b
    med = [float(np.median(xs[max(0, i - 7) : i + 8])) for i in range(700)]
    dev = np.abs(xs - med)
    mad = [float(np.median(dev[max(0, i - 7) : i + 8])) for i in range(700)]
    assert np.allclose(a, dev / np.maximum(mad, 1e-12))


@pytest.mark.parametrize("size", [64, 257, 4096])
def test_cascade_equals_direct_loop(spark, size):
    x = np.random.default_rng(2).normal(size=1000)
    sections = [filters.Section(0.2, 0.1, -0.3, 1.2, -0.5), filters.Section(0.7, 0.2, 0.0, -0.4, 0.1)]
    want = x
    for s in sections:
        y = np.zeros(len(want))
        for n in range(len(want)):
            h = lambda a, k: a[n - k] if n >= k else 0.0
            y[n] = s.b0 * want[n] + s.b1 * h(want, 1) + s.b2 * h(want, 2) + s.a1 * h(y, 1) + s.a2 * h(y, 2)
        want = y
    got = column(filters.cascade_scan(signal(spark, x), sections, size=size), "y")
    assert np.abs(np.array(got) - want).max() < 1e-9


def test_two_level_fold(spark, monkeypatch):
    monkeypatch.setattr(filters, "FAN", 3)
    x = np.random.default_rng(4).normal(size=500)
    y, want = 0.0, []
    for v in x:
        y = 0.99 * y + v
        want.append(y)
    got = column(filters.affine_scan(signal(spark, x), 0.99, 1.0, size=16), "y")
    assert np.abs(np.array(got) - want).max() < 1e-10


def test_convolutions_agree(spark):
    x = np.random.default_rng(5).normal(size=600)
    h = np.random.default_rng(6).normal(size=200)
    got = column(filters.convolve_blocks(signal(spark, x), h, size=256), "y")
    assert np.abs(np.array(got) - np.convolve(x, h)[:600]).max() < 1e-9
    short = [0.0, 0.25, 1.0, 0.25, 0.0]
    a = column(signal_ops.convolve_taps(signal(spark, x), short, size=32), "y")
    b = column(filters.convolve_blocks(signal(spark, x), short, size=64), "y")
    assert np.allclose(a, b)


def test_numbering_cuts_only_large_keys(spark, skewed, monkeypatch):
    want = dense_index(skewed, ["k"], ["t"], F.lit(0))
    rows = [(None, t, 1) for t in range(300)] + [(1, None, 2), (2, 7, 3)]
    odd = spark.createDataFrame(rows, "k long, t long, v long").unionByName(skewed)
    for least in (10, 10**6):
        monkeypatch.setattr(blocked, "LARGE_KEY", least)
        got = dense_index(skewed, ["k"], ["t"], "t")
        assert got.exceptAll(want).isEmpty() and got.count() == want.count()
        numbered = dense_index(odd, ["k"], ["t", "v"], "t")
        assert numbered.exceptAll(dense_index(odd, ["k"], ["t", "v"], F.lit(0))).isEmpty() and numbered.count() == odd.count()
    assert dense_index(odd.filter("false"), ["k"], ["t"], "t").isEmpty()


@pytest.mark.parametrize("shifts", [[1, 5, 17], list(range(1, 60))])
@pytest.mark.parametrize("whole", [True, False])
def test_self_shift_block_size(spark, shifts, whole):
    x = np.random.default_rng(7).integers(-32768, 32768, 500) if whole else np.random.default_rng(7).normal(size=500)
    s = signal(spark, x)
    s = s.withColumn("x", F.col("x").cast("long")) if whole else s
    for size in (32, 200, 10_000):
        got = {r.shift: r.cost for r in signal_ops.self_shift_diff(s, shifts, size=size).collect()}
        m = 500 - max(shifts)
        want = {k: ((x[k : k + m].astype(object) - x[:m].astype(object)) ** 2).sum() for k in shifts}
        assert got == (want if whole else pytest.approx(want))
    assert signal_ops.self_shift_diff(s.filter(f"n < {max(shifts)}"), shifts).isEmpty()


def test_pitch_lags_of_a_full_rate_take_one_scan(spark):
    x = np.random.default_rng(8).integers(-32768, 32768, 45_000)
    s = spark.range(len(x)).select(F.lit(1).alias("signal_id"), F.lit(0).alias("channel"), F.col("id").alias("n"), F.get(F.array(*[F.lit(int(v)) for v in x[:1000]]), (F.col("id") % 1000).cast("int")).alias("x"))
    shifts = sorted({k for _, k in signal_ops.candidate_shifts(44_100)})
    assert len(shifts) > 1000
    out = signal_ops.self_shift_diff(s, shifts)
    got = {r.shift: r.cost for r in out.collect()}
    y = np.tile(x[:1000], 45)
    m = 45_000 - max(shifts)
    assert all(got[k] == ((y[k : k + m] - y[:m]) ** 2).sum() for k in shifts)
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (") <= 2  # the final and the initial plan


def test_transforms_match_the_definition(spark):
    rng = np.random.default_rng(9)
    frames = [rng.normal(size=n).tolist() for n in (1, 2, 3, 7, 8, 30, 64, 101)] + [[], None, [1.0, None]]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(frames)], "i int, f array<double>").withColumn("z", transforms.dft(F.col("f")))
    df = df.withColumn("b", transforms.idft(F.transform("z", lambda c: c["re"]), F.transform("z", lambda c: c["im"])))
    got = {r.i: r for r in df.collect()}
    for i, f in enumerate(frames[:8]):
        assert np.allclose([complex(c.re, c.im) for c in got[i].z], np.fft.rfft(f))
        if len(f) % 2 == 0:
            assert np.allclose(got[i].b, f)
    assert got[8].z == [] and got[9].z is None and [c.re for c in got[10].z] == [None, None]


def test_numbering_ignores_outliers_and_time_zones(spark):
    rows = [(1, i, 0) for i in range(2000)] + [(1, -(10**15), 0), (2, 5, 0), (2, None, 0)]
    df = spark.createDataFrame(rows, "k long, v long, x int").repartition(5)
    sizes = df.groupBy(range_bucket(df, "v", 16).alias("b")).count().collect()
    assert max(r["count"] for r in sizes) < 300
    out = dense_index(df, ["k"], ["v"], range_bucket(df, "v", 16))
    assert [r.n for r in out.filter("k = 1").orderBy("v").collect()] == list(range(2001))
    assert [(r.v, r.n) for r in out.filter("k = 2").orderBy("n").collect()] == [(None, 0), (5, 1)]
    whole = dense_index(df, [], ["v", "k"], range_bucket(df, "v", 16))
    assert [r.n for r in whole.orderBy("v", "k").collect()] == list(range(2003))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        stamps = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ'2024-03-31 00:00:00' + make_dt_interval(0, 0, 15 * id) AS ts, id FROM range(24)")
        got = dense_index(stamps, ["k"], ["ts"], range_bucket(stamps, "ts", 8))
        assert got.filter("n <> id").isEmpty()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    empty = df.filter("false")
    assert dense_index(empty, ["k"], ["v"], range_bucket(empty, "v")).isEmpty() and dense_index(empty, [], ["v"], range_bucket(empty, "v")).isEmpty()


def test_timeline_carries_over_blocks(spark, monkeypatch):
    from sigframe.functions import cells as c
    from sigframe.operators import grid

    monkeypatch.setattr(grid, "ROW_BLOCK", 4)
    r = random.Random(11)
    rows = {1: 50, 2: 3, 3: 17}
    cells = [(p, k, ch, r.choice([c.FX_SPEED, c.FX_TEMPO, 0]), r.choice([0, 3, 7, 90, 200])) for p, n in rows.items() for k in range(n) for ch in range(2) if r.random() < 0.15]
    df = spark.createDataFrame(cells, "pattern long, row long, channel long, command long, param long")
    head = spark.createDataFrame(list(rows.items()), "pattern long, rows long")
    got = {(x.pattern, x.row): (x.start, x.speed, x.tempo) for x in grid.timeline(df, head).collect()}
    for p, n in rows.items():
        at, speed, tempo = 0.0, 6, 125
        for k in range(n):
            for _, _, _, fx, v in sorted(x for x in cells if x[:2] == (p, k)):
                speed, tempo = v if fx == c.FX_SPEED and v else speed, v if fx == c.FX_TEMPO and v else tempo
            assert got[p, k] == (pytest.approx(at), speed, tempo)
            at += speed * 2.5 / tempo
    assert len(got) == sum(rows.values())


@pytest.mark.parametrize("groups", [1, 7])
def test_numbering_counts_single_keys_only_in_full_groups(spark, skewed, monkeypatch, groups):
    monkeypatch.setattr(blocked, "LARGE_KEY", 10)
    monkeypatch.setattr(blocked, "KEY_GROUPS", groups)
    got = dense_index(skewed, ["k"], ["t"], "t")
    want = dense_index(skewed, ["k"], ["t"], F.lit(0))
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_timeline_generates_rows_behind_the_join(spark, monkeypatch):
    from sigframe.functions import cells as c
    from sigframe.operators import grid

    monkeypatch.setattr(grid, "ROW_BLOCK", 4)
    cells = [(1, 1, 0, c.FX_SPEED, 3), (1, 1, 1, c.FX_SPEED, 4), (1, 2, 0, c.FX_TEMPO, 0), (1, 9, 0, c.FX_SPEED, 9), (1, -1, 0, c.FX_SPEED, 9), (2, 5, 0, c.FX_TEMPO, 250), (2, 7, 0, c.FX_SPEED, 9)]
    df = spark.createDataFrame(cells, "pattern long, row long, channel long, command long, param long")
    out = grid.timeline(df, spark.createDataFrame([(1, 3), (2, 7), (3, 0), (4, 1)], "pattern long, rows long"))
    got = {(r.pattern, r.row): (r.speed, r.tempo) for r in out.collect()}
    assert got == {(1, 0): (6, 125), (1, 1): (4, 125), (1, 2): (4, 125), **{(2, n): (6, 125 if n < 5 else 250) for n in range(7)}, (4, 0): (6, 125)}
    assert out.columns == ["pattern", "row", "speed", "tempo", "seconds", "start"]


def channel_cells(spark):
    """600 rows of pattern 1, 40 patterns of a few rows, and one without a name."""
    rng = np.random.default_rng(8)
    rows = [(p, r, int(rng.integers(2)), *(int(x) for x in rng.integers(0, 3, 6))) for p in [1, *range(2, 42), None] for r in range(600 if p == 1 else 5)]
    return rows, spark.createDataFrame(rows, "pattern long, row long, channel long, " + ", ".join(f"{f} long" for f in c.FIELDS))


def blanked(masked):
    return masked.withColumns({f: F.when(F.col("mask").bitwiseAND(F.lit(b)) != 0, F.col(f)).otherwise(0) for f, b in g.MASK_BITS.items()})


@pytest.mark.parametrize("limit", [100_000, 100])
def test_masks_and_fills_with_and_without_a_large_pattern(spark, monkeypatch, limit):
    monkeypatch.setattr(blocked, "LARGE_KEY", limit)
    monkeypatch.setattr(g, "ROW_BLOCK", 64)
    rows, cells = channel_cells(spark)
    assert blocked.large_values(cells, "pattern") == ([1] if limit == 100 else [])
    masked = g.change_mask(cells)
    last, want = {}, []
    for r in rows:
        before = last.get((r[0], r[2]), (0,) * 6)
        want.append((*r, sum(1 << i for i in range(6) if r[3 + i] != before[i])))
        last[r[0], r[2]] = r[3:]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in masked.select("pattern", "row", "channel", *c.FIELDS, "mask").collect()), key=key) == sorted(want, key=key)
    filled = g.forward_fill(blanked(masked)).select("pattern", "row", "channel", *c.FIELDS).collect()
    assert sorted((tuple(r) for r in filled), key=key) == sorted(rows, key=key)


def test_ordinary_patterns_are_masked_and_filled_behind_one_shuffle(spark):
    cells = channel_cells(spark)[1].repartition(4, "pattern")
    plan = g.forward_fill(blanked(g.change_mask(cells)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_a_table_of_lines_is_numbered_in_tasks_of_bounded_size(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(9)
    pdf = {k: rng.integers(0, n, 6000) for k, n in (("l_orderkey", 1500), ("l_partkey", 200), ("l_suppkey", 50), ("l_linenumber", 7))}
    rows = [(*(int(x) for x in r), float(q)) for r, q in zip(zip(*pdf.values()), rng.integers(1, 50, 6000))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = views.cell(spark, str(tmp_path))
    monkeypatch.setattr(blocked, "TASK_ROWS", 500)
    cells = views.cell(spark, str(tmp_path))
    per_task = [r[0] for r in cells.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(per_task) == 12 and max(per_task) < 1000
    assert cells.count() == 6000 and cells.exceptAll(whole).count() == 0


def test_signatures_of_repeated_and_of_swapped_cells_differ(spark):
    grids = {1: [(0, 5), (1, 6)], 2: [(0, 6), (1, 5)], 3: [(1, 6), (0, 5)], 4: [(0, 5), (0, 5)], 5: [(1, 6), (1, 6)], 6: [(1, 6), (1, 6)]}
    cells = spark.createDataFrame([(p, r, 0, n, 0, 0, 0, 0, 0) for p, x in grids.items() for r, n in x], "pattern long, row long, channel long, " + ", ".join(f"{f} long" for f in c.FIELDS))
    sigs = {r.pattern: tuple(r)[1:] for r in cells.groupBy("pattern").agg(*g.grid_signature()).collect()}
    assert sigs[1] == sigs[3] and sigs[5] == sigs[6] and len(set(sigs.values())) == 4
    assert sorted(map(tuple, g.duplicate_patterns(cells).collect())) == [(1, 1, 2), (3, 1, 2), (5, 5, 2), (6, 5, 2)]


def test_callers_may_name_their_columns_like_helpers(spark, skewed, monkeypatch):
    names = ["_k", "_b", "_block", "_v0", "_t0", "_c0", "_off", "_rows", "_n", "__k"]
    taken = skewed.withColumns({x: -F.col("t") for x in names})
    kept = F.expr(" AND ".join(f"{x} = -t" for x in names))
    block = block_of("t", 64)
    want = running(skewed, ["k"], ["t"], block, {"r": ("sum", F.col("v"))})
    got = running(taken, ["k"], ["t"], block, {"r": ("sum", F.col("v"))}).filter(kept)
    assert got.columns == [*taken.columns, "r"] and got.select("k", "t", "v", "r").exceptAll(want).isEmpty() and got.count() == 1500
    got = running(skewed, ["k"], ["t"], block, {x: ("sum", F.col("v")) for x in names}).withColumnRenamed("_k", "r").filter(" AND ".join(f"{x} = r" for x in names[1:]))
    assert got.select("k", "t", "v", "r").exceptAll(want).isEmpty() and got.count() == 1500
    want = dense_index(skewed, ["k"], ["t"], F.lit(0), out="r")
    got = dense_index(taken, ["k"], ["t"], block, out="r").filter(kept)
    assert got.columns == [*taken.columns, "r"] and got.select("k", "t", "v", "r").exceptAll(want).isEmpty() and got.count() == 1500
    monkeypatch.setattr(blocked, "LARGE_KEY", 10)
    for x in ("_k", "_n", "_off"):
        named = skewed.withColumnRenamed("k", x)
        assert dense_index(named, [x], ["t"], "t", out="r").exceptAll(want.withColumnRenamed("k", x)).isEmpty()
        assert dense_index(skewed, ["k"], ["t"], block, out=x).exceptAll(want.withColumnRenamed("r", x)).isEmpty()
        assert blocked.large_values(named, x) == [1]
