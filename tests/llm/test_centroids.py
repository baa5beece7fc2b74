"""Walsh-Hadamard k-means against plain rounds with unbounded integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sigframe.llm import centroids as op
from tests.llm.conftest import SMALL, clashing

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, k=8, rounds=10):
    x = [(v, [math.floor(Fraction(y) * 1024) for y in e]) for v, e, *_ in rows if e is not None and len(e) == 64 and all(y is not None and math.isfinite(y) for y in e)]
    mark = lambda v: hashlib.sha256(f"3:{'' if v is None else v}".encode()).hexdigest()
    cents = [e for _, e in sorted(x, key=lambda r: mark(r[0]))[:k]]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda e: min((gap(e, c), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        to = [near(e)[1] for _, e in x]
        for i in range(len(cents)):
            mine = [e for (_, e), t in zip(x, to) if t == i]
            if mine:
                cents[i] = [sum(c) // len(mine) for c in zip(*mine)]
    got = [(v, *near(e)) for v, e in x]
    cap = lambda d: min(d, 2**63 - 1)
    total = {i: sum(cap(d) for _, d, j in got if j == i) for i in range(len(cents))}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(v, i, cap(d), cap(total[i]), cap(sum(total.values())), text[i]) for v, d, i in got]


def check(df, **how):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    got = sorted((tuple(r) for r in op.cluster(df, **how).collect()), key=key)
    assert got == sorted(plain(rows, how.get("k", 8), how.get("rounds", 10)), key=key)
    return got


def test_given_vectors(spark):
    got = check(spark.read.parquet(f"{SMALL}/embeddings.parquet"))
    assert len(got) == 500 and {r[1] for r in got} == set(range(8))


def test_transform_is_exact_and_coarse_to_fine():
    r = random.Random(1)
    x = np.array([[r.randint(-(10**30), 10**30) for _ in range(64)] for _ in range(3)], object)
    w = op.coefficients(x)
    assert (op.components(w) == x).all()
    assert ((w[0] - w[1]) ** 2).sum() == 64 * ((x[0] - x[1]) ** 2).sum()
    assert (w[:, 0] == x.sum(1)).all()  # no sign change
    signs = (np.diff(op.coefficients(np.eye(64, dtype=np.int64)), axis=0) != 0).sum(0)
    assert signs.tolist() == list(range(64))


def test_search_keeps_ties_and_drops_only_worse():
    r = np.random.default_rng(2)
    x = r.integers(-3, 4, (400, 64))
    c = np.concatenate([x[:5], x[:5], x[7:9]])
    to, d = op.search(op.coefficients(x), op.coefficients(c))
    want = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (to == want.argmin(1)).all() and (d == want.min(1)).all()


def test_odd_vectors(spark):
    r = random.Random(3)
    v = lambda s=1.0: [r.uniform(-s, s) for _ in range(64)]
    same = v()
    rows = [(i, v(), 0) for i in range(60)] + [(100 + i, same, 1) for i in range(80)]
    rows += [(7, v(), 0), (7, v(), 0), (None, v(), 0), (None, same, None), (200, v(1e7), 0), (201, v(1e30), 0)]
    rows += [(202, None, 0), (203, [], 0), (204, v()[:63], 0), (205, v() + [0.0], 0), (206, [None] + v()[1:], 0), (207, [math.nan] + v()[1:], 0), (208, [-math.inf] + v()[1:], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = check(clashing(df, "near", "far", "cluster", "x", "distance").repartition(5))
    assert not {202, 203, 204, 205, 206, 207, 208} & {g[0] for g in got}
    assert len(got) == len(rows) - 7


def test_few_vectors_ties_and_no_rows(spark):
    df = spark.createDataFrame([(i, [float(i // 2)] * 64, 0) for i in range(5)], SCHEMA)
    assert len(check(df)) == 5
    check(df, k=2, rounds=1)
    none = spark.createDataFrame([], SCHEMA)
    assert check(none) == []


@pytest.mark.parametrize("width", ["float", "double"])
def test_floor_of_negative_and_single_precision(spark, width):
    df = spark.createDataFrame([(i, [(-1) ** (i + j) * (i + 0.3) / 512 for j in range(64)], 0) for i in range(30)], SCHEMA.replace("double", width))
    check(df, k=3)
