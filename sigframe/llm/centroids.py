"""Exact k-means on integer vectors with a Walsh-Hadamard progressive search.

A vector counts if it has exactly `SIZE` components, none null, NaN or infinite. A component x becomes the integer floor(1024 x).
The unnormalised Walsh-Hadamard transform of integers is exact, and squared distances between transforms are `SIZE` times those
between vectors. Coefficients are kept in order of sequency (sign changes of their row), coarse to fine. For each vector the search
adds up squared coefficient differences stage by stage (`STAGES`); after the first stage the distance to the leading centroid is
finished and is the bound from then on. A centroid whose part already exceeds the bound is strictly worse and goes; the others
are finished over all 64 coefficients, so ties are seen and the smaller number wins. The transform is linear: a round's sums are taken over
coefficients and transformed back, exactly.

Spark spreads the vectors; a round is one pass whose tasks send one sum per centroid and coefficient, added up by a shuffle of at most
64 k keys. Only k centroids ever reach the driver. Vectors are spread as they are read, not by cluster, so a cluster
with most of the rows is no hot key. The transformed vectors are written once to the shared folder.

Odd cases: null or short vectors give no row. Repeated rows count each. A null vec_id is hashed as `3:`; equal identifiers are taken in order of their
coefficients as start vectors. With fewer than k vectors every vector starts a centroid; an empty table gives no rows. Components
whose integer is 2^21 or more in size take an exact path with unbounded integers; a distance or sum beyond the long range is given as the largest long.
Other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.session import materialize

SIZE, SCALE = 64, 1024
STAGES = (4, 16, 64)
K, ROUNDS, SEED = 8, 10, 3
SMALL = 1 << 21  # below this, squared distances of transforms fit 64 bits
LIMB = 10**18
LONGEST = 2**63 - 1
_DECIMAL = pa.decimal128(38, 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised transform of each row, in natural order; integers of any size stay exact."""
    n = len(x)
    for h in (1 << i for i in range(SIZE.bit_length() - 1)):
        x = x.reshape(n, SIZE // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
    return x.reshape(n, SIZE)


_ROWS = hadamard(np.eye(SIZE, dtype=np.int64))
ORDER = np.argsort((np.diff(_ROWS, axis=1) != 0).sum(1), kind="stable")  # of the rows of the transform, by sign changes


def coefficients(x: np.ndarray) -> np.ndarray:
    return hadamard(x)[:, ORDER]


def components(w: np.ndarray) -> np.ndarray:
    """Back from coefficients; exact for sums of transforms."""
    natural = np.empty_like(w)
    natural[:, ORDER] = w
    return hadamard(natural) // SIZE


def search(w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest row of `c` for every row of `w`, both as coefficients, and the squared distance of the vectors."""
    n = len(w)
    at, to = np.repeat(np.arange(n), len(c)), np.tile(np.arange(len(c)), n)
    part, low, bound = np.zeros(len(at), w.dtype), 0, None
    for high in STAGES:
        part = part + ((w[at, low:high] - c[to, low:high]) ** 2).sum(1)
        if bound is None:
            lead = part.reshape(n, len(c)).argmin(1)
            bound = ((w - c[lead]) ** 2).sum(1)
        stay = part <= bound[at]
        at, to, part, low = at[stay], to[stay], part[stay], high
    order = np.lexsort((to, part, at))
    first = order[np.unique(at[order], return_index=True)[1]]
    return to[first], part[first] // SIZE


def _whole(x: float) -> int:
    return math.floor(Fraction(x) * SCALE)


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.array(b.column("x").flatten()).reshape(-1, SIZE)
        far = (np.abs(x) >= SMALL / SCALE).any(1)
        w = coefficients(np.floor(SCALE * np.where(far[:, None], 0, x)).astype(np.int64)).astype("<i4")
        near = [None if f else r.tobytes() for f, r in zip(far, w)]
        large = [",".join(map(str, coefficients(np.array([[_whole(y) for y in r]], object))[0])) if f else None for f, r in zip(far, x)]
        yield pa.record_batch([b.column("vec_id"), pa.array(near, pa.binary()), pa.array(large, pa.string())], ["vec_id", "near", "far"])


def prepare(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and coefficients (`near`: 64 little-endian 32-bit integers, or else `far`: decimal text) of every vector that counts."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.filter((F.size("x") == SIZE) & ~F.exists("x", bad))
    return rows.mapInArrow(_transformed, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, near binary, far string")


def _blocks(batch: pa.RecordBatch, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and coefficients, first of rows that fit 64 bits, then of the others."""
    near, far = batch.column("near"), batch.column("far")
    rows = np.flatnonzero(near.is_valid().to_numpy(zero_copy_only=False))
    if len(rows):
        w = np.frombuffer(b"".join(near.drop_null().to_pylist()), "<i4").reshape(-1, SIZE)
        yield rows, w.astype(object if exact else np.int64)
    rows = np.flatnonzero(far.is_valid().to_numpy(zero_copy_only=False))
    if len(rows):
        yield rows, np.array([[int(y) for y in t.split(",")] for t in far.drop_null().to_pylist()], object)


def _nearest(batch: pa.RecordBatch, c: np.ndarray, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for rows, w in _blocks(batch, exact):
        yield (rows, w, *search(w, c.astype(w.dtype)))


def _limbs(v: int) -> Iterator[tuple[int, int]]:
    sign, v, i = (-1 if v < 0 else 1), abs(v), 0
    while v:
        v, part = divmod(v, LIMB)
        if part:
            yield i, sign * part
        i += 1


def _sums(centroids: list[list[int]], exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, total = np.array(centroids, object), defaultdict(lambda: [0] * (SIZE + 1))
        for b in batches:
            for _, w, to, _ in _nearest(b, c, exact):
                for k in np.unique(to):
                    mine = w[to == k]
                    total[int(k)] = [int(x) + y for x, y in zip([*mine.sum(0), len(mine)], total[int(k)])]
        rows = [(k, i, limb, part) for k, t in total.items() for i, v in enumerate(t) for limb, part in _limbs(v)]
        kinds = (pa.int32(), pa.int32(), pa.int32())
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)] + [pa.array([Decimal(r[3]) for r in rows], _DECIMAL)]
        yield pa.record_batch(cols, ["cluster", "at", "limb", "part"])

    return run


def _assigned(centroids: list[list[int]], exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, object)
        for b in batches:
            cluster, distance = [0] * b.num_rows, [0] * b.num_rows
            for rows, _, to, d in _nearest(b, c, exact):
                for i, k, x in zip(rows, to, d):
                    cluster[i], distance[i] = int(k), min(int(x), LONGEST)
            yield pa.record_batch([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _read(row) -> list[int]:
    return np.frombuffer(row.near, "<i4").tolist() if row.near is not None else [int(y) for y in row.far.split(",")]


def _exact(centroids: list[list[int]]) -> bool:
    return any(abs(x) >= SMALL for c in components(np.array(centroids, object).reshape(-1, SIZE)) for x in c)


def fit(prepared: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """Coefficients of the centroids after `rounds` rounds, from a table made by `prepare`. Starts: the k vectors with the smallest
    lower-case hex SHA-256 of `seed:vec_id`. A round that changes no centroid is the last, as all later ones would repeat it."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [_read(r) for r in prepared.orderBy(mark, "near", "far").limit(k).collect()]
    for _ in range(rounds if centroids else 0):
        sums = prepared.mapInArrow(_sums(centroids, _exact(centroids)), "cluster int, at int, limb int, part decimal(38,0)")
        found: dict[int, list[int]] = defaultdict(lambda: [0] * (SIZE + 1))
        for r in sums.groupBy("cluster", "at", "limb").agg(F.sum("part").alias("part")).collect():
            found[r.cluster][r.at] += int(r.part) * LIMB**r.limb
        before, centroids = centroids, list(centroids)
        for c, t in found.items():
            means = [x // t[SIZE] for x in components(np.array([t[:SIZE]], object))[0]]
            centroids[c] = coefficients(np.array([means], object))[0].tolist()
        if centroids == before:
            break
    return centroids


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts."""
    prepared = materialize(prepare(vectors, id_col, vector_col), "coefficients")
    centroids = fit(prepared, k, rounds, seed)
    kind = prepared.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long"
    placed = materialize(prepared.mapInArrow(_assigned(centroids, _exact(centroids)), schema), "clusters")
    sums = {r.cluster: int(r.total) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    text = [",".join(map(str, c)) for c in components(np.array(centroids, object))] if centroids else [""]
    each = F.array(*[F.lit(min(sums.get(i, 0), LONGEST)).cast("long") for i in range(len(text))])
    marks = F.array(*[F.lit(hashlib.sha256(t.encode()).hexdigest()) for t in text])
    return placed.select(
        "vec_id", "cluster", "distance", F.get(each, F.col("cluster")).alias("cluster_inertia"), F.lit(min(sum(sums.values()), LONGEST)).cast("long").alias("inertia"),
        F.get(marks, F.col("cluster")).alias("centroid_sha256"),
    )
