"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import drop_tables, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour of a node is linked to the node's least neighbour (or itself).
    Small star: the same for the smaller neighbours and the node itself."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # a node's least neighbour by a hash aggregate with map-side combining, then a join that splits hot nodes
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (its least node) for every node of an edge; isolated nodes have no row.

    Null ends are ignored; self-loops give their node a row of its own.  Every round is written to the shared folder.
    """
    raw = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null"), "edges")
    now = materialize(raw.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before, rows = None, raw.count()
    while True:
        large = materialize(_star(now, True), "stars", rows)
        now, old = materialize(_star(large, False), "stars", rows), now
        drop_tables(large, old)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
    nodes = raw.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
