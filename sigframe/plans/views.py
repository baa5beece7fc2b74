"""The driver's tables seen as signals, cells, order lists, frames and byte streams, and the same views as SQL
text for the oracle. Row numbers always use an order whose ties are identical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.plans.blocked import dense_index, enough_partitions


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def numbered_events(spark: SparkSession, d: str) -> DataFrame:
    """events plus `n`, the position inside the user by (ts, event_id)."""
    ev = table(spark, d, "events")
    return dense_index(ev, ["user_id"], ["ts", "event_id"], "ts")


def sig(spark: SparkSession, d: str) -> DataFrame:
    return numbered_events(spark, d).select(
        F.col("user_id").alias("signal_id"),
        F.lit(0).alias("channel"),
        "n",
        (F.col("value") / 250.0 - 1).alias("x"),
    )


def siglong(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    mean = li.agg(F.round(F.avg("l_extendedprice"), 2).alias("_m")).scalar()
    num = dense_index(li, ["l_suppkey"], ["l_shipdate", "l_extendedprice"], "l_shipdate")
    return num.select(
        F.col("l_suppkey").alias("signal_id"),
        F.lit(0).alias("channel"),
        "n",
        F.round(F.col("l_extendedprice") - mean, 2).alias("x"),
    )


def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    order = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    return dense_index(li, ["l_orderkey"], order, "l_partkey", out="row", partitions=enough_partitions(li))


def cell(spark: SparkSession, d: str) -> DataFrame:
    return numbered_lines(spark, d).select(
        F.col("l_orderkey").alias("pattern"),
        "row",
        (F.col("l_suppkey") % 4).alias("channel"),
        F.when(F.col("l_partkey") % 17 == 0, F.lit(255)).otherwise(F.col("l_partkey") % 129).cast("long").alias("note"),
        F.col("l_suppkey").alias("instr"),
        (F.col("l_linenumber") % 16).cast("long").alias("volcmd"),
        F.col("l_quantity").cast("long").alias("vol"),
        (F.col("l_partkey") % 58).alias("command"),
        (F.col("l_orderkey") % 256).alias("param"),
    )


def orders_seq(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("seq"),
        F.col("turn").alias("ord"),
        (F.length("text") % 50).cast("long").alias("pattern"),
        F.when(F.col("role") == "system", F.lit("stop")).otherwise(F.lit("pattern")).alias("kind"),
    )


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    v = e.select(
        F.expr("vec_id div 10").alias("item"),
        (F.col("vec_id") % 10).alias("engine"),
        F.col("embedding"),
        F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bin"),
    )
    return v.select(
        "item",
        "engine",
        F.col("bin").cast("long").alias("bin"),
        F.get("embedding", F.col("bin") * 2).cast("double").alias("re"),
        F.get("embedding", F.col("bin") * 2 + 1).cast("double").alias("im"),
    )


def stereo(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    v = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k"))
    return v.select(
        F.col("vec_id").alias("signal_id"),
        F.col("k").cast("long").alias("n"),
        F.get("embedding", F.col("k") * 2).cast("double").alias("l"),
        F.get("embedding", F.col("k") * 2 + 1).cast("double").alias("r"),
    )


def byte_stream(spark: SparkSession, d: str) -> DataFrame:
    return numbered_events(spark, d).select(
        F.col("user_id").alias("stream"), F.col("n").alias("seq"), (F.col("event_id") % 256).alias("b")
    )


def controls(spark: SparkSession, d: str) -> DataFrame:
    status = 8 + F.col("event_id") % 7
    return numbered_events(spark, d).select(
        F.col("user_id").alias("stream"),
        F.col("n").alias("seq"),
        (
            status * 16
            + F.col("user_id") % 16
            + (F.col("event_id") % 128) * 256
            + (F.floor("value").cast("long") % 128) * 65536
        ).alias("word"),
    )


# The same views for DuckDB.
SQL = {
    "nev": """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events""",
    "sig": """SELECT user_id AS signal_id, 0 AS channel, n, value / 250.0 - 1 AS x FROM nev""",
    "siglong": """SELECT l_suppkey AS signal_id, 0 AS channel,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_extendedprice) - 1 AS n,
        round(l_extendedprice - (SELECT round(avg(l_extendedprice), 2) FROM lineitem), 2) AS x FROM lineitem""",
    "cell": """SELECT l_orderkey AS pattern,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) - 1 AS "row",
        l_suppkey % 4 AS channel,
        CAST(CASE WHEN l_partkey % 17 = 0 THEN 255 ELSE l_partkey % 129 END AS BIGINT) AS note,
        l_suppkey AS instr, CAST(l_linenumber % 16 AS BIGINT) AS volcmd, CAST(l_quantity AS BIGINT) AS vol,
        l_partkey % 58 AS command, l_orderkey % 256 AS param FROM lineitem""",
    "orders_seq": """SELECT conv_id AS seq, turn AS ord, CAST(length(text) % 50 AS BIGINT) AS pattern,
        CASE WHEN role = 'system' THEN 'stop' ELSE 'pattern' END AS kind FROM conversations""",
    "frames": """SELECT vec_id // 10 AS item, vec_id % 10 AS engine, k AS bin,
        CAST(embedding[2 * k + 1] AS DOUBLE) AS re, CAST(embedding[2 * k + 2] AS DOUBLE) AS im
        FROM embeddings, range(32) t(k)""",
    "stereo": """SELECT vec_id AS signal_id, k AS n, CAST(embedding[2 * k + 1] AS DOUBLE) AS l,
        CAST(embedding[2 * k + 2] AS DOUBLE) AS r FROM embeddings, range(32) t(k)""",
    "byte_stream": """SELECT user_id AS stream, n AS seq, event_id % 256 AS b FROM nev""",
    "controls": """SELECT user_id AS stream, n AS seq, (8 + event_id % 7) * 16 + user_id % 16
        + (event_id % 128) * 256 + (CAST(floor(value) AS BIGINT) % 128) * 65536 AS word FROM nev""",
}
NEEDS = {"sig": ["nev"], "byte_stream": ["nev"], "controls": ["nev"]}


def oracle(views: str, *parts: str) -> str:
    """`WITH` the named views, then any further `name AS (...)` parts; the last part is the main query."""
    names: list[str] = []
    for v in views.split():
        for dep in [*NEEDS.get(v, []), v]:
            if dep not in names:
                names.append(dep)
    ctes = [f"{v} AS ({SQL[v]})" for v in names] + list(parts[:-1])
    return (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + parts[-1]
