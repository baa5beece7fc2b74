"""Bounded-task building blocks.

A window partitioned only by signal (or pattern, or stream) puts the whole of that signal in one task. The
helpers here keep every task bounded by a block of positions instead:

* `with_halo`    - copies the edge rows a frame needs into the neighbouring blocks, so framed windows and
                   `lag`/`lead` run per block;
* `running`      - running sum / count / max / min / last in two passes: per-block totals, a small ordered
                   scan over the totals, then the in-block running value plus its carry; told which keys are
                   large, it cuts only those;
* `dense_index`  - 0-based row numbers inside a key, in two passes over buckets of the order;
* `islands`      - maximal runs of consecutive positions, merged inside blocks first, so only runs that touch
                   a block edge (at most two per block) are looked at across blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

BLOCK = 1 << 16
_B = "_block"


def block_of(n: Column | str, size: int = BLOCK) -> Column:
    """Block number of position `n` (floor division, so negative positions are fine)."""
    c = F.col(n) if isinstance(n, str) else n
    return F.floor(c / F.lit(size)).cast("long")


def with_halo(df: DataFrame, n: str, before: int, after: int, size: int = BLOCK, first: int = 0) -> DataFrame:
    """Give every row its block in `_block`, and copy it to each block whose frames reach it.

    A frame is `[m - before, m + after]`. `_core` is true on the row's own block and false on copies.
    Blocks before the one of position `first` are not created.
    """
    own = block_of(n, size)
    lo = F.greatest(block_of(F.col(n) - after, size), F.lit(first // size).cast("long"))
    hi = block_of(F.col(n) + before, size)
    return df.withColumn(_B, F.explode(F.sequence(lo, hi))).withColumn("_core", F.col(_B) == own)


def halo_window(keys: Sequence[str], order: Sequence[str | Column]):
    """The window to use after `with_halo`."""
    return W.partitionBy(*keys, _B).orderBy(*order)


def core_only(df: DataFrame) -> DataFrame:
    """Drop the halo copies and the helper columns."""
    return df.filter("_core").drop(_B, "_core")


def shifted(
    df: DataFrame, keys: Sequence[str], n: str, cols: Mapping[str, tuple[Column | str, int]], size: int = BLOCK
) -> DataFrame:
    """`lag`/`lead` by row along dense positions: `{out: (col, offset)}`, offset < 0 looks back."""
    back = max([-o for _, o in cols.values() if o < 0], default=0)
    ahead = max([o for _, o in cols.values() if o > 0], default=0)
    w = halo_window(keys, [n])
    out = with_halo(df, n, back, ahead, size)
    return core_only(
        out.withColumns(
            {k: (F.lag(c, -o) if o < 0 else F.lead(c, o)).over(w) for k, (c, o) in cols.items()}
        )
    )


def _helper_prefix(df: DataFrame, *names: str) -> str:
    """A beginning for helper columns that no column of `df` and none of `names` has, so that callers may name theirs as they like."""
    prefix = "_"
    while any(c.startswith(prefix) for c in [*df.columns, *names]):
        prefix += "_"
    return prefix


_TOTAL = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _prefix(w, inclusive: bool, peers: bool):
    return (w.rangeBetween if peers else w.rowsBetween)(W.unboundedPreceding, 0 if inclusive else -1)


def _over(kind: str, v: Column | str, w) -> Column:
    return F.last(v, ignorenulls=True).over(w) if kind == "last" else _TOTAL[kind](v).over(w)


def running_whole(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, tuple[str, Column]], inclusive: bool = True, peers: bool = False
) -> DataFrame:
    """`running` for keys that are small enough for one task each."""
    w = _prefix(W.partitionBy(*keys).orderBy(*order), inclusive, peers)
    return df.withColumns({o: F.coalesce(_over(k, v, w), F.lit(0)) if k in ("sum", "count") else _over(k, v, w) for o, (k, v) in cols.items()})


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    cols: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
    peers: bool = False,
    large: Column | None = None,
) -> DataFrame:
    """Add running values along `order` inside `keys`.

    `cols` maps an output name to `(kind, value)`, kind one of sum, count, max, min, last (last non-null).
    `block` must not decrease along `order`; one block of one key is the unit of work of a task. With
    `inclusive=False` the current row is left out (and an empty prefix gives 0 for sum and count, else NULL).
    With `peers=True` all rows that tie on the order columns count as current.

    Where `large` is given (see `large_values`; equal in all rows of a key), only its keys are cut into blocks, and all others take one window
    without totals or a join.
    """
    keys, order = list(keys), list(order)
    if large is not None:
        small = running_whole(df.filter(~large), keys, order, cols, inclusive, peers)
        return small.unionByName(running(df.filter(large), keys, order, block, cols, inclusive, peers))
    own = _helper_prefix(df, *cols)
    at, key, key_at = f"{own}block", f"{own}k", f"{own}b"
    value, total, carried = ([f"{own}{x}{i}" for i in range(len(cols))] for x in "vtc")
    kinds = [kind for kind, _ in cols.values()]
    base = df.withColumns({at: block, **dict(zip(value, [v for _, v in cols.values()]))})
    stamp = F.struct(*order)
    totals = base.groupBy(*keys, at).agg(
        *[
            (F.max_by(F.col(v), F.when(F.col(v).isNotNull(), stamp)) if kind == "last" else _TOTAL[kind](v)).alias(t)
            for kind, v, t in zip(kinds, value, total)
        ]
    )
    prior = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)

    carry = totals.select(
        F.struct(*keys).alias(key), F.col(at).alias(key_at), *[_over("sum" if kind == "count" else kind, t, prior).alias(c) for kind, t, c in zip(kinds, total, carried)]
    )
    local = _prefix(W.partitionBy(*keys, at).orderBy(*order), inclusive, peers)
    joined = base.join(carry, F.struct(*keys).eqNullSafe(F.col(key)) & F.col(at).eqNullSafe(F.col(key_at)))
    out = {}
    for name, kind, v, c in zip(cols, kinds, value, carried):
        here = _over(kind, v, local)
        before = F.col(c)
        if kind in ("sum", "count"):
            out[name] = F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
        elif kind == "max":
            out[name] = F.greatest(before, here)
        elif kind == "min":
            out[name] = F.least(before, here)
        else:
            out[name] = F.coalesce(here, before)
    return joined.withColumns(out).drop(at, key, key_at, *value, *carried)


def _as_number(df: DataFrame, col: str) -> Column:
    """The column as a number in the same order, whatever the session's time zone."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.TimestampNTZType):
        c = F.col(col)  # whole seconds, from the fields, which no zone touches
        return F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(col))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(col))
    return F.col(col)


def range_bucket(df: DataFrame, col: str, parts: int | None = None) -> Column:
    """A non-decreasing bucket (-1 for NULL, else 0 .. `parts`) of a numeric or time column, with about as many rows in each.

    The limits are quantiles, taken by a one-row aggregate inside the plan, so outliers do not matter and a hot key is
    spread over as many buckets as the table is; by default there are as many as shuffle partitions. Rows that share one value share a bucket.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = _as_number(df, col)
    limits = df.agg(F.percentile_approx(v, [i / n for i in range(1, n)]).alias("_limits")).scalar()
    return F.coalesce(F.array_position(F.sort_array(F.array_append(limits, v)), v) - 1, F.lit(-1)).cast("long") if n > 1 else F.lit(0).cast("long")


LARGE_KEY = 100_000  # rows of a key that one task numbers in any case
KEY_GROUPS = 16_384  # groups of keys (by hash) that are counted first


TASK_ROWS = 1_000_000  # rows that one task numbers and sorts, where a table's size is known


def enough_partitions(table: DataFrame) -> int | None:
    """As many partitions as hold `TASK_ROWS` rows each, or None where the session's are enough. For a table of files; counting parquet reads footers only."""
    n = -(-table.count() // TASK_ROWS)
    return n if n > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _by_large_keys(df: DataFrame, keys: list[str], order: Sequence[str | Column], first: str, out: str, partitions: int | None) -> DataFrame:
    """Only keys with more rows than a partition's share of the table are cut into buckets; there are fewer of them than partitions. Groups of
    keys are counted first, and single keys only in groups with that many rows. All other keys are numbered in one shuffled and sorted pass that meets no join."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key, group = F.struct(*keys), F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS))
    n, k = (_helper_prefix(df) + x for x in "nk")
    groups = df.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    limit = groups.agg(F.greatest(F.lit(LARGE_KEY), F.coalesce(F.sum("_n"), F.lit(0)) / parts).alias("_limit")).scalar()
    full = groups.agg(F.collect_list(F.when(F.col("_n") > limit, F.col("_g"))).alias("_full")).scalar()
    per = df.filter(F.array_contains(full, group)).groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).withColumn(k, key)
    is_large = F.array_contains(per.agg(F.collect_list(F.when(F.col(n) > limit, F.col(k))).alias("_large")).scalar(), key)
    small = df.filter(~is_large)
    small = small.repartition(partitions, *keys) if partitions else small
    small = small.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    some = df.filter(is_large)
    return small.unionByName(dense_index(some, keys, order, range_bucket(some, first, parts), out))


def large_values(df: DataFrame, key: str) -> list:
    """The values of `key` with more rows than a partition's share of the table (and than `LARGE_KEY`): fewer of them than partitions. This runs a job that
    reads nothing but the key and brings back the sizes of `KEY_GROUPS` groups of keys, and a second one only if a group is that large."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS))
    sizes = dict(df.groupBy(group).agg(F.count(F.lit(1))).collect())
    limit = max(LARGE_KEY, sum(sizes.values()) // parts)
    full = [g for g, n in sizes.items() if n > limit]
    if not full:
        return []
    n = _helper_prefix(df) + "n"
    per = df.filter(group.isin(full)).groupBy(key).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > limit)
    return sorted((r[0] for r in per.collect()), key=lambda x: (x is None, x))


def is_one_of(col: str, values: Sequence) -> Column:
    """Whether a column has one of the values; NULL equals NULL."""
    found = F.coalesce(F.col(col).isin([x for x in values if x is not None]), F.lit(False))
    return found | F.col(col).isNull() if None in values else found


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column | str, out: str = "n", partitions: int | None = None
) -> DataFrame:
    """0-based row number inside `keys` along `order`.

    `bucket` is a non-decreasing function of the order: a block of positions, or a `range_bucket`, which it has to be without
    keys. A task numbers one bucket of one key; the offsets come from the bucket counts. With keys it can also be the name of the first order column; then
    only large keys are cut, and all others are dealt to `partitions` tasks (by default the session's number).
    """
    keys = list(keys)
    if isinstance(bucket, str):
        return _by_large_keys(df, keys, order, bucket, out, partitions)
    own = _helper_prefix(df, out)
    at, rows, key, key_at, off = (own + x for x in ("block", "rows", "k", "b", "off"))
    b = df.withColumn(at, bucket)
    local = b.withColumn(out, F.row_number().over(W.partitionBy(*keys, at).orderBy(*order)).cast("long") - 1)
    counts = b.groupBy(*keys, at).agg(F.count(F.lit(1)).alias(rows))
    if not keys:
        sizes = counts.agg(F.collect_list(F.struct(at, rows)).alias("s"))  # one entry per bucket

        def ahead(e: Column) -> Column:
            return F.aggregate(F.filter("s", lambda x: x[at] < e[at]), F.lit(0).cast("long"), lambda total, x: total + x[rows])

        offset = sizes.select(F.map_from_entries(F.transform("s", lambda e: F.struct(e[at], ahead(e)))).alias("o")).scalar()
        return local.withColumn(out, F.col(out) + F.element_at(offset, F.col(at))).drop(at)
    prior = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.struct(*keys).alias(key), F.col(at).alias(key_at), F.coalesce(F.sum(rows).over(prior), F.lit(0)).alias(off))
    joined = local.join(offsets, F.struct(*keys).eqNullSafe(F.col(key)) & (F.col(at) == F.col(key_at)))
    return joined.withColumn(out, F.col(out) + F.col(off)).drop(at, key, key_at, off)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    n: str,
    aggs: Mapping[str, tuple[str, Column]] | None = None,
    size: int = BLOCK,
) -> DataFrame:
    """Maximal runs of consecutive positions: `keys, start_n, end_n` and the aggregates `{out: (kind, col)}`,
    kind one of sum, count, max, min. Positions must be unique inside `keys`."""
    keys = list(keys)
    aggs = dict(aggs or {})
    joinable = {"count": F.sum}
    inside = W.partitionBy(*keys, _B).orderBy(n)
    runs = (
        df.withColumn(_B, block_of(n, size))
        .withColumn("_run", F.col(n) - F.row_number().over(inside))
        .groupBy(*keys, _B, "_run")
        .agg(F.min(n).alias("start_n"), F.max(n).alias("end_n"), *[_TOTAL[k](c).alias(o) for o, (k, c) in aggs.items()])
    )
    edge = (F.pmod("start_n", F.lit(size)) == 0) | (F.pmod("end_n", F.lit(size)) == size - 1)
    lane = F.when(edge, F.lit(-1).cast("long")).otherwise(F.col(_B))
    runs = runs.withColumn("_lane", lane)
    across = W.partitionBy(*keys, "_lane").orderBy("start_n")
    new = (F.col("_lane") >= 0) | F.lag("end_n").over(across).isNull() | (F.lag("end_n").over(across) != F.col("start_n") - 1)
    return (
        runs.withColumn("_new", new.cast("int"))
        .withColumn("_island", F.sum("_new").over(across))
        .groupBy(*keys, "_lane", "_island")
        .agg(
            F.min("start_n").alias("start_n"),
            F.max("end_n").alias("end_n"),
            *[joinable.get(k, _TOTAL[k])(o).alias(o) for o, (k, _) in aggs.items()],
        )
        .drop("_lane", "_island")
    )


def positions(per_key: DataFrame, keys: Sequence[str], count: str, out: str, size: int = BLOCK) -> DataFrame:
    """Rows `0 .. count-1` in `out` for every row of `per_key`. Blocks are generated first and spread over tasks, so
    one long key is not generated by one task."""
    first = F.lit(0).cast("long")
    blocks = per_key.filter(F.col(count) > 0).withColumn(
        _B, F.explode(F.sequence(first, F.floor((F.col(count) - 1) / size).cast("long")))
    )
    spread = blocks.repartition(*keys, _B)
    last = F.least((F.col(_B) + 1) * size, F.col(count)) - 1
    return spread.withColumn(out, F.explode(F.sequence(F.col(_B) * size, last))).drop(_B)
