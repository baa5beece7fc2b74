"""Queries over order lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigframe.catalog.registry import query
from sigframe.operators import sequences as q
from sigframe.plans import views as v
from sigframe.plans.blocked import range_bucket
from sigframe.plans.views import oracle


@query("expand_orders", "J2", oracle("orders_seq cell", """SELECT o.seq, o.ord, pattern, c."row", c.channel, c.note, c.command
    FROM orders_seq o JOIN cell c USING (pattern) WHERE kind = 'pattern'"""))
def _(spark, d):
    cells = v.cell(spark, d).select("pattern", "row", "channel", "note", "command")
    return q.expand_orders(v.orders_seq(spark, d), cells, ordered=True)


@query("split_subsongs", "U3", oracle("orders_seq", """SELECT seq, ord, pattern, kind, CAST(subsong AS BIGINT) AS subsong FROM (SELECT *, sum(CASE WHEN kind = 'stop' THEN 1 ELSE 0 END)
    OVER (PARTITION BY seq ORDER BY ord) AS subsong FROM orders_seq) WHERE kind <> 'stop'"""))
def _(spark, d):
    return q.split_subsongs(v.orders_seq(spark, d))


@query("merge_sequences", "U4", oracle("orders_seq", """SELECT seq % 7 AS module, seq, ord, pattern,
    row_number() OVER (PARTITION BY seq % 7 ORDER BY seq, ord) - 1 AS new_ord FROM orders_seq"""))
def _(spark, d):
    o = v.orders_seq(spark, d).withColumn("module", F.col("seq") % 7)
    return q.merge_sequences(o, "module", range_bucket(o, "seq")).select("module", "seq", "ord", "pattern", "new_ord")


@query("trim_orders", "U5", oracle("orders_seq", """SELECT seq, CAST(coalesce(max(CASE WHEN kind <> 'stop' THEN ord END) + 1, 0) AS BIGINT) AS trimmed,
    CAST(coalesce(min(CASE WHEN kind = 'stop' THEN ord END), max(ord) + 1) AS BIGINT) AS first_stop FROM orders_seq GROUP BY 1"""))
def _(spark, d):
    return q.trim_orders(v.orders_seq(spark, d))


@query("densify_ids", "U6", oracle("orders_seq",
    "f AS (SELECT seq, pattern, min(ord) AS first_ord FROM orders_seq WHERE kind <> 'stop' GROUP BY 1, 2)",
    "SELECT *, row_number() OVER (PARTITION BY seq ORDER BY first_ord) - 1 AS new_pattern FROM f"))
def _(spark, d):
    return q.densify_ids(v.orders_seq(spark, d))


@query("replace_ref", "U7", oracle("orders_seq", "SELECT seq, ord, CASE WHEN pattern = 13 THEN 77 ELSE pattern END AS pattern, kind FROM orders_seq"))
def _(spark, d):
    return q.replace_ref(v.orders_seq(spark, d), 13, 77)


@query("remove_ref", "U7", oracle("orders_seq", """SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY ord) - 1 AS ord, pattern, kind
    FROM orders_seq WHERE pattern <> 13"""))
def _(spark, d):
    return q.remove_ref(v.orders_seq(spark, d), 13)


@query("ensure_unique", "U8", oracle("orders_seq",
    "u AS (SELECT seq, ord, pattern % 3 AS pattern FROM orders_seq WHERE kind <> 'stop')",
    "r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY seq, pattern ORDER BY ord) > 1 THEN 1 ELSE 0 END AS again, max(pattern) OVER (PARTITION BY seq) AS top FROM u)",
    "SELECT seq, ord, pattern, CAST(CASE WHEN again = 1 THEN top + sum(again) OVER (PARTITION BY seq ORDER BY ord) ELSE pattern END AS BIGINT) AS new_pattern FROM r"))
def _(spark, d):
    return q.ensure_unique(v.orders_seq(spark, d).withColumn("pattern", F.col("pattern") % 3))


@query("visit_scan", "W25", oracle("orders_seq",
    "s AS (SELECT seq, ord AS step, pattern % 4 AS place, kind AS state FROM orders_seq)",
    "r AS (SELECT *, row_number() OVER (PARTITION BY seq, place, state ORDER BY step) > 1 AS revisit FROM s)",
    "l AS (SELECT *, min(CASE WHEN revisit THEN step END) OVER (PARTITION BY seq) AS loop_step FROM r)",
    "SELECT seq, step, place, state, revisit, loop_step, coalesce(step >= loop_step, false) AS loops FROM l"))
def _(spark, d):
    o = v.orders_seq(spark, d)
    steps = o.select("seq", F.col("ord").alias("step"), (F.col("pattern") % 4).alias("place"), F.col("kind").alias("state"))
    return q.visit_scan(steps, ["place", "state"])


@query("loop_state_hash", "W26", oracle("orders_seq",
    "b AS (SELECT seq, max(ord) > 255 AS wide, flatten(list([CAST(ord % 256 AS UTINYINT), CAST(pattern % 4 AS UTINYINT)] ORDER BY ord) FILTER (pattern % 4 <> 0)) AS bytes FROM orders_seq GROUP BY 1)",
    """SELECT seq, CASE WHEN wide THEN 'channel index above 255' END AS error, CASE WHEN NOT wide THEN CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(coalesce(bytes, []), lambda x: CAST(x AS UHUGEINT))),
    lambda h, x: CAST(xor(CAST(h AS UBIGINT), CAST(x AS UBIGINT)) AS UHUGEINT) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT) AS VARCHAR) END AS hash FROM b"""))
def _(spark, d):
    o = v.orders_seq(spark, d).withColumn("count", F.col("pattern") % 4)
    small = F.when(F.col("ord") < 256, F.struct(F.col("ord").alias("channel"), "count"))  # a channel index is one byte, so 256 pairs at most
    per = o.groupBy("seq").agg(F.array_sort(F.collect_list(small)).alias("p"), (F.max("ord") > 255).alias("wide"))
    error = F.when(F.col("wide"), "channel index above 255")
    return per.select("seq", error.alias("error"), F.when(~F.col("wide"), q.loop_state_hash(F.col("p")).cast("string")).alias("hash"))


@query("first_unvisited", "W27", oracle("orders_seq",
    "ok AS (SELECT seq, ord FROM orders_seq WHERE kind = 'pattern')",
    "vis AS (SELECT seq, ord FROM orders_seq WHERE ord < seq % 4)",
    "SELECT seq, min(ord) AS ord, CAST(0 AS BIGINT) AS \"row\" FROM ok WHERE (seq, ord) NOT IN (SELECT seq, ord FROM vis) GROUP BY 1"))
def _(spark, d):
    o = v.orders_seq(spark, d)
    heads = o.select("pattern").distinct().withColumn("rows", F.lit(4).cast("long"))
    played = o.filter("ord < seq % 4").select("seq", "ord", F.lit(1).cast("long").alias("row"))
    return q.first_unvisited(o, heads, played)


@query("first_unvisited_row", "W27", oracle("orders_seq",
    "ok AS (SELECT seq, ord, r AS \"row\" FROM orders_seq, range(4) t(r) WHERE kind = 'pattern')",
    "vis AS (SELECT seq, ord, r AS \"row\" FROM orders_seq, range(2) t(r) WHERE ord <= seq % 4)",
    "un AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ord, \"row\") AS k FROM ok WHERE (seq, ord, \"row\") NOT IN (SELECT seq, ord, \"row\" FROM vis))",
    'SELECT seq, ord, "row" FROM un WHERE k = 1'))
def _(spark, d):
    o = v.orders_seq(spark, d)
    heads = o.select("pattern").distinct().withColumn("rows", F.lit(4).cast("long"))
    played = o.filter("ord <= seq % 4").select("seq", "ord", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("row"))
    return q.first_unvisited(o, heads, played, whole_patterns=False)


@query("block_policy", "G19", """WITH a AS (SELECT conv_id AS seq, count(*) FILTER (role = 'user' AND turn % 4 = 0) AS h,
    arg_min(CASE WHEN role = 'user' AND turn % 4 = 0 THEN 'head' ELSE role END, turn) AS f, count(*) FILTER (role = 'assistant') AS c FROM conversations GROUP BY 1)
    SELECT seq, CASE WHEN h = 0 OR f <> 'head' THEN 'missing_header' WHEN h > 1 THEN 'multiple_header'
    WHEN c > 1 THEN 'multiple_assistant' ELSE 'ok' END AS status FROM a""")
def _(spark, d):
    t = v.table(spark, d, "conversations")
    kind = F.when((F.col("role") == "user") & (F.col("turn") % 4 == 0), "head").otherwise(F.col("role"))
    return q.block_policy(t.select(F.col("conv_id").alias("seq"), F.col("turn").alias("ord"), kind.alias("kind")), "head", ["assistant"])


@query("total_duration", "G21", oracle("orders_seq",
    "s AS (SELECT seq, sum(CASE WHEN kind = 'stop' THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY ord) AS subsong, pattern, kind FROM orders_seq)",
    "p AS (SELECT seq, subsong, sum(pattern * 0.12::DOUBLE) AS duration FROM s WHERE kind <> 'stop' GROUP BY 1, 2)",
    "SELECT seq, round(sum(duration), 6) AS duration, count(*) AS subsongs FROM p GROUP BY 1"))
def _(spark, d):
    songs = q.split_subsongs(v.orders_seq(spark, d)).groupBy("seq", "subsong").agg(F.sum(F.col("pattern") * F.lit(0.12)).alias("duration"))
    return q.total_duration(songs, ["seq"]).withColumn("duration", F.round("duration", 6))
