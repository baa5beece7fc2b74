"""Nearest directions through cells, effect placement on long patterns."""

import math
import random

import pytest

from sigframe.operators import grid, lookups
from sigframe.functions import cells as c


def nearest(queries, points):
    good = lambda p: all(x is not None and not math.isnan(x) for x in p)
    out = {}
    for q, *x in queries:
        if good(x):
            out[q] = min((math.dist(x, p), i) for i, *p in points if good(p))
    return out


def run(spark, queries, points, dims):
    kind = lambda n: f"{n} long, " + ", ".join(f"{d} double" for d in dims)
    rows = lookups.nearest_direction(spark.createDataFrame(queries, kind("q")), spark.createDataFrame(points, kind("g")), dims, "q", "g").collect()
    return {r.q: (r.dist, r.g) for r in rows}


@pytest.mark.parametrize("spread", ["uniform", "clusters", "sphere"])
def test_nearest_direction_equals_all_pairs(spark, spread):
    r = random.Random(spread)
    def point():
        if spread == "uniform":
            return [r.uniform(-1, 1) for _ in range(3)]
        if spread == "clusters":
            k = r.randrange(4)
            return [k * 10 + r.gauss(0, 10.0 ** -r.randrange(1, 6)) for _ in range(3)]
        x = [r.gauss(0, 1) for _ in range(3)]
        return [v / math.hypot(*x) for v in x]
    points = [(i, *point()) for i in range(400)]
    queries = [(i, *point()) for i in range(300)] + [(1000 + i, *[r.uniform(-500, 500) for _ in range(3)]) for i in range(20)] + [(2000 + i, *points[i][1:]) for i in range(20)]
    got, want = run(spark, queries, points, ["x", "y", "z"]), nearest(queries, points)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(got[k][0] == pytest.approx(want[k][0]) for k in want)


def test_nearest_direction_ties_and_odd_rows(spark):
    points = [(5, 0.0, 0.0), (3, 0.0, 0.0), (9, 2.0, 0.0), (1, None, 0.0), (2, math.nan, 0.0)]
    queries = [(1, 1.0, 0.0), (2, 0.0, 0.0), (3, None, 1.0), (4, 1e9, 0.0)]
    assert run(spark, queries, points, ["x", "y"]) == {1: (1.0, 3), 2: (0.0, 3), 4: (1e9 - 2, 9)}
    assert run(spark, queries, [(8, 4.0, 4.0), (7, 4.0, 4.0)], ["x", "y"])[2] == (pytest.approx(math.sqrt(32)), 7)
    assert run(spark, queries, points[3:], ["x", "y"]) == {}


def test_effect_on_a_long_full_pattern(spark):
    full = [(1, row, ch, 0, 0, c.VOL_NONE, 0, c.FX_VIBRATO_VOL, 1) for row in range(9000) for ch in range(2)]
    cells = spark.createDataFrame(full, "pattern long, row long, channel long, note long, instr long, volcmd long, vol long, command long, param long")
    head = spark.createDataFrame([(1, 9100), (2, 5)], "pattern long, rows long")
    target = spark.createDataFrame([(1, 4), (2, 3)], "pattern long, row long")
    put = lambda e: {r.pattern: (r.row, r.channel, r.action, r.in_volume) for r in grid.place_effect(cells, head, target, e, 2).collect()}
    assert put(grid.Effect(c.FX_SPEED, 3)) == {1: (9000, 0, "free", False), 2: (3, 0, "free", False)}
    assert put(grid.Effect(c.FX_SPEED, 3, retry="previous")) == {2: (3, 0, "free", False)}
    assert put(grid.Effect(c.FX_SPEED, 3, retry="none"))[2][0] == 3
    assert put(grid.Effect(c.FX_VOLUME, 80)) == {1: (4, 0, "converted_free", True), 2: (3, 0, "free", False)}
    assert grid.Effect(c.FX_PANNING8, 130).forms()[2][0].param == 132 and grid.Effect(c.FX_PANNING8, 0x90, s3m=True).converted() is None


def test_pairs_of_directions_are_spread_over_all_partitions(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0.0, 1.0]), r.random(), 0.5) for i in range(300)]
    p = spark.createDataFrame(rows, "q long, x double, y double, z double")
    out = lookups.nearest_direction(p.filter("q >= 100"), p.filter("q < 100").withColumnRenamed("q", "g"), ["x", "y", "z"], "q", "g")
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    want = {q: min((sum((a - b) ** 2 for a, b in zip(at, o)), g) for g, *o in rows[:100])[1] for q, *at in rows[100:]}
    assert {x.q: x.g for x in out.collect()} == want
