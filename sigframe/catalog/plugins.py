"""Queries for the plug-in seams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sigframe.catalog.registry import query, r6
from sigframe.operators.enhance import Enhancer, enhance
from sigframe.plans import views as v
from sigframe.plans.views import oracle
from sigframe.sources.records import decode_layout, encode_layout


def _repeat(batch):
    """A stand-in engine: every sample is repeated up to the output rate; a very loud item is refused."""
    out = {}
    for stem, rate, x in batch:
        if np.abs(x).max() > 0.4:
            raise ValueError("too loud")
        out[stem] = np.repeat(x, 48000 // rate)
    return out


@query("enhance", "E1", """WITH e AS (SELECT vec_id, [6000, 12000, 24000, 48000][vec_id % 4 + 1] AS rate, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS xs FROM embeddings)
    SELECT 'v' || vec_id AS stem, CASE WHEN list_max(list_transform(xs, lambda x: abs(x))) <= 0.4 THEN CAST(64 * (48000 // rate) AS INTEGER) END AS samples,
    CASE WHEN list_max(list_transform(xs, lambda x: abs(x))) <= 0.4 THEN round(list_sum(xs) * (48000 // rate), 5) + 0.0 END AS total,
    CASE WHEN list_max(list_transform(xs, lambda x: abs(x))) > 0.4 THEN 'ValueError: too loud' END AS error FROM e WHERE rate < 48000""")
def _(spark, d):
    rates = F.array(*[F.lit(r) for r in (6000, 12000, 24000, 48000)])
    items = v.table(spark, d, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("stem"),
        F.element_at(rates, (F.col("vec_id") % 4).cast("int") + 1).alias("rate"),
        F.transform("embedding", lambda x: x.cast("double")).alias("xs"),
    )
    out = enhance(items, Enhancer("repeat", "repeat-1", _repeat))
    total = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x)
    return out.select("stem", F.when(F.col("xs").isNotNull(), F.size("xs")).alias("samples"), r6(total, 5).alias("total"), "error")


@query("decode_layout", "E5", oracle("cell", 'SELECT pattern, "row", channel, note, instr % 256 AS instr, volcmd, vol, command, param FROM cell'))
def _(spark, d):
    return decode_layout(encode_layout(v.cell(spark, d).withColumn("instr", F.col("instr") % 256)))
