"""Connected components of an edge table by hooking and pointer jumping.

Each round hooks every node to its smallest neighbour, follows the hooks to their ends by doubling, and replaces the edges by
edges between the ends. The number of rounds and of doublings is logarithmic; all steps are equi-joins and combinable aggregates,
and each table is written to the shared folder, so that plans stay short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.session import materialize


def _rename(edges: DataFrame, root: DataFrame) -> DataFrame:
    """Edges between the roots of both ends; loops and repeats go."""
    a = root.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    out = edges.join(a, "a", "left").join(b, "b", "left")
    out = out.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _follow(hooks: DataFrame) -> DataFrame:
    """(node, root) with root replaced by the end of its chain."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = materialize(hooks.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "hooks")
        hooks = step.select("node", "root")
        if step.filter("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b) that is not itself the smallest node of its component.

    Loops and repeated edges are harmless, an empty table gives an empty result; null ends must not occur."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    root = None
    while not edges.isEmpty():
        hooks = _follow(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        edges = materialize(_rename(edges, hooks), "edges")
        if root is None:
            root = hooks
        else:  # a root that got a hook passes it on
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
            moved = root.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            root = materialize(moved.unionByName(hooks), "roots")
    return root if root is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
