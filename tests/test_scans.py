"""Block scans against one pass over the whole stream."""

import random

import numpy as np
import pytest

from sigframe.operators import scans
from sigframe.streaming import operators as so


def test_peak_maps_are_the_steps():
    rng = np.random.default_rng(1)
    for attack, release in ((0.2, 0.9), (0.0, 1.0), (0.999, 0.9999), (1.0, 0.5)):
        level = rng.uniform(0, 1.2, 300)
        starts, slopes, offsets = scans.peak_map(level, attack, release)
        for peak in (0.0, 0.3, 0.999, 1.0, 5.0, 63.0):
            want = peak
            for v in level:
                want = v + (want - v) * (attack if want <= v else release)
            k = int(np.searchsorted(starts, peak, side="right")) - 1
            assert slopes[k] * peak + offsets[k] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_follower_in_blocks(spark, size):
    rng = np.random.default_rng(2)
    x = {s: rng.normal(size=n) * (rng.random(n) > 0.2) for s, n in ((1, 700), (2, 1), (3, 64))}
    df = spark.createDataFrame([(s, i, float(v)) for s, xs in x.items() for i, v in enumerate(xs)], "stream long, seq long, x double").repartition(5)
    got = scans.follower(df, 0.3, 0.95, 0.9, 0.5, size).toPandas().sort_values(["stream", "seq"])
    for s, xs in x.items():
        _, peaks, y = so.follower_step(0.0, xs, 0.3, 0.95, 0.9, 0.5)
        mine = got[got.stream == s]
        assert np.allclose(mine["peak"], peaks, atol=1e-12) and np.allclose(mine["y"], y)


@pytest.mark.parametrize("size", [1, 2, 5, 32, 10_000])
def test_running_status_in_blocks(spark, size):
    r = random.Random(3)
    wild = lambda n: [r.choice([r.randrange(128), r.randrange(256), 0xF0, 0xF7, 0x90, 0xC3, 0xF1, 0xF2, 0xF3, 0xF8]) for _ in range(n)]
    data = {1: wild(900), 2: [5, 6, 0x90, 1, 2, 3, 4], 3: [0xF0] + [1] * 150 + [0xF7, 7, 7], 4: [0xC1] + [9] * 120, 5: [0xF0, 0xF0], 6: [1]}
    df = spark.createDataFrame([(s, i, b) for s, bs in data.items() for i, b in enumerate(bs)], "stream long, seq long, b int").repartition(3)
    got = {}
    for m in scans.running_status(df, size).collect():
        got.setdefault(m.stream, []).append((m.seq, m.message))
    for s, bs in data.items():
        want = [(k, bytes(m).hex()) for k, m in so.split_messages({}, list(enumerate(bs)))[1]]
        assert sorted(got.get(s, [])) == want, s
