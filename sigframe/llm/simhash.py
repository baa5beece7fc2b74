"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints within `RADIUS` = 3 bits are linked. Bit i has a code in 1..15; table t (1..15) keeps the bits whose code has odd
parity with t. Three differing bits span at most 3 of 4 dimensions, so some t is orthogonal to all their codes and its table
drops all three bits: every pair within the radius meets in a table, whatever the bits are. A table keeps 32 or more bits, so other
pairs seldom meet.

Only distinct fingerprints are hashed (copies share one). A crowded bucket is hashed again in the same way over the bits that
its table drops; such a second bucket agrees on 48 bits and more, so it holds at most 2^16 fingerprints whatever the data. Of a
bucket, edges to the smallest member of each of its groups are enough; groups are then joined into components.

Nulls and empty texts: fingerprint zero, linked like any other. A null id takes part, but is never a component's id unless all
its ids are null. Each input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigframe.llm.components import components
from sigframe.llm.words import pieces
from sigframe.session import materialize

RADIUS, WIDTH, SEED = 3, 3, 42
TABLES = 15
CROWDED = 1024
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Majority of every bit over the XXH64 of all word shingles, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(size)])
    width = min(WIDTH, len(words))
    begin, end = start[: len(words) - width + 1].tolist(), (start[width:] - 1).tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for k in range(0, len(begin), _BLOCK):
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(begin[k : k + _BLOCK], end[k : k + _BLOCK])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(begin)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            got = pa.array([fingerprint(t.as_py()) for t in part.column(1)], pa.int64())
            yield pa.record_batch([part.column(0), got], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; a doc_id is a number, or a struct that has an order."""
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType
    kind = kind.simpleString() if isinstance(kind, StructType) else "bigint"
    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _masks(bits: list[int]) -> list[int]:
    """The bits that each table keeps, as signed 64-bit masks."""
    codes = [(bit, k % TABLES + 1) for k, bit in enumerate(bits)]
    kept = [sum(1 << bit for bit, code in codes if (code & t).bit_count() % 2) for t in range(1, TABLES + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


FIRST = _masks(list(range(64)))
SECOND = [_masks([b for b in range(64) if not m >> b & 1]) for m in FIRST]


def _groups(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each member to the smallest of its group, groups being linked within the radius."""
    rest, edges = np.unique(fps), []
    while len(rest) > 1:
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count((rest ^ queue.pop()).view(np.uint64)) <= RADIUS  # of a signed number it counts the magnitude's bits
            if near.any():
                found = rest[near].tolist()
                queue += found
                edges += [(x, int(root)) for x in found]
                rest = rest[~near]
    return edges


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edges = []
        for fps in batch.column(0):
            x = fps.values.to_numpy(zero_copy_only=False)
            if len(x) == 2:
                if (int(x[0] ^ x[1]) & (1 << 64) - 1).bit_count() <= RADIUS:
                    edges.append((int(x.max()), int(x.min())))
            else:
                edges += _groups(x)
        a, b = zip(*edges) if edges else ((), ())
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly what links within the radius connect; `fps` holds distinct fingerprints in `fp`."""
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(FIRST)]))
    keyed = fps.select("fp", table.alias("x")).select("fp", "x.t", "x.key")
    met = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = keyed.join(met, ["t", "key"])
    second = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in SECOND])
    finer = F.transform(F.sequence(F.lit(1), F.lit(TABLES)), lambda i: F.struct(i.alias("t2"), F.col("fp").bitwiseAND(F.element_at(F.element_at(second, F.col("t") + 1), i)).alias("key2")))
    plain = F.array(F.struct(F.lit(0).alias("t2"), F.lit(0).cast("long").alias("key2")))
    split = rows.select("fp", "t", "key", F.explode(F.when(F.col("n") > CROWDED, finer).otherwise(plain)).alias("x"))
    buckets = split.groupBy("t", "key", "x.t2", "x.key2").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return buckets.select("fps").mapInArrow(_bucket_edges, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(links(distinct.select("fp")))
    rooted = distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marked.join(named, "fp").select("doc_id", digits, "component_id")
