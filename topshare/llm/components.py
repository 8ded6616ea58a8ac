"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topshare.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that is not the root of its component (this starts jobs).

    ``edges`` has two columns of one orderable type, of any direction and with
    repeats.  Every node hooks onto its least smaller neighbour, chains are
    shortened by pointer jumping, and the graph is contracted to the roots;
    each round leaves only local minima, so few rounds are needed.  The root
    is the least node of the component.

    No group is gathered: neighbours meet in a minimum with partial sums, and
    the joins have one row per node on one side, so a node with very many
    edges can be split by adaptive execution.  Every table is written to the
    scratch folder and read again, so lost executors cost one step.
    """
    a, b = (F.col(c) for c in edges.columns)
    edges = written(
        edges.where(a != b).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct(), "edges"
    )
    roots = None
    while not edges.isEmpty():
        hooks = written(edges.groupBy("high").agg(F.min("low").alias("root")), "hooks")
        hooks = _flatten(hooks)
        if roots is None:
            roots = hooks.withColumnRenamed("high", "node")
        else:
            newer = hooks.select(F.col("high").alias("root"), F.col("root").alias("newer"))
            moved = roots.join(newer, "root", "left").select("node", F.coalesce("newer", "root").alias("root"))
            roots = written(moved.unionByName(hooks.withColumnRenamed("high", "node")), "roots")
        edges = _contract(edges, hooks)
    return roots if roots is not None else edges.select(F.col("low").alias("node"), F.col("high").alias("root"))


def _flatten(hooks: DataFrame) -> DataFrame:
    """Every hook onto the end of its chain."""
    while True:
        above = hooks.select(F.col("high").alias("root"), F.col("root").alias("above"))
        raised = written(hooks.join(above, "root", "left").select("high", "root", "above"), "raised")
        hooks = raised.select("high", F.coalesce("above", "root").alias("root"))
        if raised.where(F.col("above").isNotNull()).isEmpty():
            return hooks


def _contract(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    """The edges between the roots that are left."""
    low = hooks.select(F.col("high").alias("low"), F.col("root").alias("low_root"))
    high = hooks.select("high", F.col("root").alias("high_root"))
    ends = (
        edges.join(low, "low", "left")
        .join(high, "high", "left")
        .select(F.coalesce("low_root", "low").alias("p"), F.coalesce("high_root", "high").alias("q"))
        .where(F.col("p") != F.col("q"))
    )
    return written(ends.select(F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high")).distinct(), "edges")
