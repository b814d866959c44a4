"""Graph operators on edge tables (src, dst): frontier loops of joins, each round written to the shared folder.

No operator gathers nodes or edges on the driver.  Null ends are ignored; parallel edges count only where said.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components  # noqa: F401
from graphloom.plans.shared import drop_tables, materialize, merged


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(reverse(edges)).distinct()


def _clean(edges: DataFrame) -> DataFrame:
    return materialize(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """root, node, hops: everything reachable along edges from every root (roots themselves at 0 hops).

    ``allowed`` (node) restricts which nodes may be entered.
    """
    edges = _clean(edges)
    if allowed is not None:
        edges = edges.join(allowed.select(F.col("node").alias("dst")), "dst", "left_semi")
    frontier = materialize(starts.select(F.col("node").alias("root"), "node").filter("node is not null").distinct().withColumn("hops", F.lit(0)), "frontier")
    seen, hops = [frontier], 0
    while (depth is None or hops < depth) and not frontier.isEmpty():
        hops += 1
        step = frontier.select("root", F.col("node").alias("src")).join(edges, "src").select("root", F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, seen).select("root", "node")
        frontier = materialize(step.join(known, ["root", "node"], "left_anti").withColumn("hops", F.lit(hops)), "frontier")
        seen = merged([*seen, frontier], "seen", keep=frontier)
    return reduce(DataFrame.unionByName, seen)


def reach_any(edges: DataFrame, starts: DataFrame, depth: int | None = None, stops: DataFrame | None = None) -> DataFrame:
    """node: everything reachable from any start, starts included; one row per node, however many starts reach it.

    Nodes of ``stops`` (node) are reached but not left again.
    """
    edges = _clean(edges)
    if stops is not None:
        edges = edges.join(stops.select(F.col("node").alias("src")).distinct(), "src", "left_anti").select("src", "dst")
    frontier = materialize(starts.select("node").filter("node is not null").distinct(), "frontier")
    seen, hops = [frontier], 0
    while (depth is None or hops < depth) and not frontier.isEmpty():
        hops += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(reduce(DataFrame.unionByName, seen), "node", "left_anti"), "frontier")
        seen = merged([*seen, frontier], "seen", keep=frontier)
    return reduce(DataFrame.unionByName, seen)


def spread(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """node, mark: every mark (node, mark) travels against the edges, from callees to all their callers.

    A round holds only what is new, so there are at most as many rows as nodes times marks.
    """
    edges = _clean(edges)
    new = materialize(marks.select("node", "mark").filter("node is not null and mark is not null").distinct(), "marks")
    seen = [new]
    while not new.isEmpty():
        step = edges.join(new.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "mark").distinct()
        new = materialize(step.join(reduce(DataFrame.unionByName, seen), ["node", "mark"], "left_anti"), "marks")
        seen = merged([*seen, new], "seen", keep=new)
    return reduce(DataFrame.unionByName, seen)


def descendants(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """root, node: reachable nodes without the root itself, also on a cycle."""
    return reach(edges, starts).filter("node <> root").select("root", "node")


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return descendants(reverse(edges), starts)


def neighborhood(edges: DataFrame, starts: DataFrame, depth: int, allowed: DataFrame | None = None) -> DataFrame:
    """root, node within ``depth`` hops in either direction, the root included; with ``allowed``, the ego set."""
    return reach(symmetric(edges), starts, depth, allowed).select("root", "node")


def reachable_subgraph(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between nodes reachable from any root, roots included, parallel edges kept."""
    inside = materialize(reach_any(edges, roots), "inside")
    e = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi")
    return e.join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, degree: in and out, parallel edges counted, a self-loop twice, isolated nodes 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("node").distinct().join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def simple_paths(edges: DataFrame, start: int, goal: int, max_depth: int) -> DataFrame:
    """path (array) of 1..max_depth edges from start to goal without repeated nodes; start = goal gives cycles."""
    edges = _clean(edges)
    spark = edges.sparkSession
    grown = spark.range(1).select(F.array(F.lit(start)).cast("array<long>").alias("path"))
    out = []
    for _ in range(max_depth):
        step = grown.withColumn("src", F.element_at("path", -1)).join(edges, "src").withColumn("dst", F.col("dst").cast("long"))
        step = step.filter((F.col("dst") == goal) | ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        step = materialize(step, "paths")
        out.append(step.filter(F.element_at("path", -1) == goal))
        grown = step.filter(F.element_at("path", -1) != goal)
    return reduce(DataFrame.unionByName, out)


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, component (its largest node) of components with more than one node.

    Nodes without an edge in or out are on no cycle and leave first, round by round.  Then colouring: every node takes the
    largest node that reaches it; what reaches its colour's root backwards inside the colour is one component; found nodes
    leave and the rest goes on.
    """
    live = _clean(edges.filter("src <> dst"))
    found = None
    while True:
        both = live.select(F.col("src").alias("node")).distinct().join(live.select(F.col("dst").alias("node")).distinct(), "node")
        kept = live.join(both.select(F.col("node").alias("src")), "src", "left_semi").join(both.select(F.col("node").alias("dst")), "dst", "left_semi")
        kept, before = materialize(kept.select("src", "dst"), "live"), live.count()
        live = kept
        if live.count() == before:
            break
    while not live.isEmpty():
        color = table = materialize(live.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("color", F.col("node")), "color")
        while True:
            pushed = live.join(color.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.max("color").alias("c"))
            new = color.join(pushed.withColumnRenamed("dst", "node"), "node", "left").select("node", "color", F.greatest("color", "c").alias("now"))
            new, old = materialize(new, "color"), table
            changed = not new.filter("now <> color").isEmpty()
            color, table = new.select("node", F.col("now").alias("color")), new
            drop_tables(old)
            if not changed:
                break
        inside = live.join(color.select(F.col("node").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("b")), "dst")
        inside = materialize(inside.filter("a = b").select("src", "dst", "a"), "inside")
        back = reach(reverse(inside), color.filter("node = color").select("node"))
        done = materialize(back.join(color, "node").filter("root = color").select("node", F.col("root").alias("component")), "scc")
        found = done if found is None else found.unionByName(done)
        keep = live.join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst")), "dst", "left_anti")
        live = materialize(keep.select("src", "dst"), "live")
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    big = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return found.join(big, "component").select("node", "component")


def layers(edges: DataFrame) -> DataFrame:
    """node, layer: longest path from a source of an acyclic graph (level peeling); nodes on or behind cycles are left out."""
    live = _clean(edges)
    nodes = materialize(live.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    out, level = [], 0
    while not nodes.isEmpty():
        free = materialize(nodes.join(live.select(F.col("dst").alias("node")), "node", "left_anti"), "level")
        if free.isEmpty():
            break
        out.append(free.withColumn("layer", F.lit(level)))
        nodes = materialize(nodes.join(free, "node", "left_anti"), "nodes")
        live = materialize(live.join(free.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst"), "live")
        level += 1
        if len(out) > 8:
            out = [materialize(reduce(DataFrame.unionByName, out), "layers")]
    return reduce(DataFrame.unionByName, out) if out else nodes.withColumn("layer", F.lit(0)).limit(0)


def topological_order(edges: DataFrame) -> DataFrame:
    """node, position: by (layer, node); no rows if the graph has a cycle."""
    laid = materialize(layers(edges), "laid")
    total = edges.filter("src is not null and dst is not null").select(F.explode(F.array("src", "dst")).alias("node")).distinct().count()
    if laid.count() < total:
        return laid.select("node", F.lit(0).cast("long").alias("position")).limit(0)
    sizes = laid.groupBy("layer").agg(F.count("*").alias("n"))  # one row per layer
    before = sizes.select("layer", (F.sum("n").over(Window.orderBy("layer")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("layer").orderBy("node"))
    return laid.withColumn("r", rank).join(before, "layer").select("node", (F.col("before") + F.col("r") - 1).cast("long").alias("position"))
