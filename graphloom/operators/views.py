"""View queries: filters, overview, inspector tables and layout arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overview(crates: DataFrame, modules: DataFrame, symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """One row of totals; lines has line_count per file."""
    kinds = symbols.agg(
        F.count("*").alias("symbols"),
        F.count_if(F.col("kind").isin("Function", "Method")).alias("functions"),
        F.count_if(F.col("kind") == "Struct").alias("structs"),
        F.count_if(F.col("kind") == "Trait").alias("traits"),
        F.count_if(F.col("is_unsafe") | F.col("has_unsafe_block")).alias("unsafe"),
    )
    c = crates.agg(F.count("*").alias("crates"), F.count_if(F.col("crate_type") == "Library").alias("libraries"))
    f = lines.agg(F.count("*").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"))
    return c.crossJoin(modules.agg(F.count("*").alias("modules"))).crossJoin(kinds).crossJoin(f)  # one row each


def visible_nodes(symbols: DataFrame, hidden_kinds: list[str] = (), hidden_visibility: list[str] = (), hide_tests: bool = True) -> DataFrame:
    """Symbols that pass every filter; values a filter does not name are visible."""
    keep = F.lit(True)
    if hidden_kinds:
        keep &= ~F.coalesce(F.col("kind").isin(*hidden_kinds), F.lit(False))
    if hidden_visibility:
        keep &= ~F.coalesce(F.col("visibility").isin(*hidden_visibility), F.lit(False))
    return symbols.filter(keep & ~(F.coalesce("is_test", F.lit(False)) if hide_tests else F.lit(False)))


def visible_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    ids = visible.select(F.col("id").alias("src"))
    return edges.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi")


def parallel_edges(edges: DataFrame) -> DataFrame:
    """a, b, n: edges between an unordered pair."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))


def parallel_offsets(edges: DataFrame, order: list[str], gap: float = 12.0) -> DataFrame:
    """Every edge with its offset (ordinal - (n-1)/2) * gap among its pair's edges."""
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst"))
    ordinal = F.row_number().over(pair.orderBy(*order)) - 1
    return edges.withColumn("offset", (ordinal - (F.count("*").over(pair) - 1) / 2) * gap)


def coupling_color(score):
    """r, g, b of a score: blue to red over 0..25."""
    t = F.least(F.greatest(score / 25, F.lit(0.0)), F.lit(1.0))
    return F.floor(255 * t).alias("r"), F.floor(100 * (1 - F.abs(2 * t - 1))).alias("g"), F.floor(200 * (1 - t)).alias("b")


def node_radius(kind, modules, symbols, fan_in):
    return (
        F.when(kind == "Crate", F.least(12 + 3 * F.sqrt(modules), F.lit(30.0)))
        .when(kind == "Module", F.least(8 + 2 * F.sqrt(symbols), F.lit(22.0)))
        .when(kind == "Symbol", F.least(5 + 2.5 * F.sqrt(fan_in), F.lit(24.0)))
        .otherwise(7.0)
    )


def hotspots(metrics: DataFrame, by: str, n: int = 20) -> DataFrame:
    return metrics.orderBy(F.desc(by), "symbol_id").limit(n)


def spatial_grid(points: DataFrame, cell: float = 50.0) -> DataFrame:
    return points.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.count("*").alias("n"))


def hit_test(points: DataFrame, x: float, y: float, zoom: float = 1.0, slack: float = 3.0) -> DataFrame:
    """Nodes (x, y, radius) under a point, of which the view takes the last in its scan order."""
    return points.filter(F.hypot(F.col("x") - x, F.col("y") - y) < F.col("radius") * zoom + slack)


def auto_fit(points: DataFrame, width: float, height: float, padding: float = 60.0) -> DataFrame:
    """zoom, pan_x, pan_y that show all points in the middle; no row without points."""
    box = points.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "low"), (F.max, "high")))).filter("low_x is not null and low_y is not null")
    fit = lambda c, room: (room - 2 * padding) / F.greatest(F.col(f"high_{c}") - F.col(f"low_{c}"), F.lit(1.0))
    zoom = F.least(F.greatest(F.least(fit("x", width), fit("y", height)), F.lit(0.15)), F.lit(2.0))
    pan = lambda c, room: (room / 2 - (F.col(f"low_{c}") + F.col(f"high_{c}")) / 2 * F.col("zoom")).alias(f"pan_{c}")
    return box.withColumn("zoom", zoom).select("zoom", pan("x", width), pan("y", height))


def canvas_scale(visible):
    return 2.5 + F.least(visible / 30, F.lit(2.0))


def coupling_heatmap(modules: DataFrame, module_metrics: DataFrame) -> DataFrame:
    """module_id, coupling_score (0 for modules without metrics) and its colour."""
    score = F.coalesce("coupling_score", F.lit(0.0))
    joined = modules.select(F.col("id").alias("module_id")).join(module_metrics.select("module_id", "coupling_score"), "module_id", "left")
    return joined.select("module_id", score.alias("coupling_score"), *coupling_color(score))


# ---------------------------------------------------------------- filters

NODE_KINDS = ("Crate", "Module", "File", "Symbol")
EDGE_KINDS = ("Contains", "Calls", "References", "Imports", "Implements", "DependsOn")
SYMBOL_KINDS = ("Function", "Method", "Struct", "Enum", "Trait", "ImplBlock", "Constant", "Static", "TypeAlias")
#: What a view shows (node kinds, edge kinds, symbol kinds) under each named setting.
PRESETS = {
    "Dependencies": (("Crate",), ("DependsOn",), ()),
    "Modules": (("Crate", "Module"), ("Contains", "Imports", "DependsOn"), ()),
    "Call Flow": (("Symbol",), ("Calls",), ("Function", "Method")),
    "Type Graph": (("Symbol",), ("References", "Implements"), ("Struct", "Enum", "Trait", "ImplBlock", "TypeAlias")),
    "Imports": (("Module", "Symbol"), ("Imports",), SYMBOL_KINDS),
    "Everything": (NODE_KINDS, EDGE_KINDS, SYMBOL_KINDS),
}


def preset(nodes: DataFrame, edges: DataFrame, name: str, symbols: DataFrame | None = None, crates: list[int] | None = None, owner: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges a named setting shows.

    nodes: node_kind, node_id; symbols (id, kind) let it choose among kinds; crates with owner (node_kind, node_id, crate_id)
    among crates; nodes that no table names stay.
    """
    node_kinds, edge_kinds, kinds = PRESETS[name]
    shown = nodes.filter(F.col("node_kind").isin(*node_kinds))
    if symbols is not None:
        hidden = symbols.filter(~F.col("kind").isin(*kinds) if kinds else F.lit(True)).select(F.lit("Symbol").alias("node_kind"), F.col("id").alias("node_id"))
        shown = shown.join(hidden, ["node_kind", "node_id"], "left_anti")
    if crates is not None and owner is not None:
        shown = shown.join(owner.filter(~F.col("crate_id").isin(*crates)), ["node_kind", "node_id"], "left_anti")
    ends = lambda a, b: shown.select(F.col("node_kind").alias(a), F.col("node_id").alias(b))
    kept = edges.filter(F.col("kind").isin(*edge_kinds)).join(ends("src_kind", "src_id"), ["src_kind", "src_id"], "left_semi")
    return shown, kept.join(ends("dst_kind", "dst_id"), ["dst_kind", "dst_id"], "left_semi").select(*edges.columns)


def highlighted(symbols: DataFrame, entrypoints: DataFrame | None = None, unsafe: bool = False, flags: DataFrame | None = None) -> DataFrame:
    """The symbols that fit all chosen modes: entrypoints, unsafe code, flagged; all of them without a mode."""
    out = symbols.filter(F.col("is_unsafe") | F.col("has_unsafe_block")) if unsafe else symbols
    if entrypoints is not None:
        out = out.join(entrypoints.select(F.col("symbol_id").alias("id")).distinct(), "id", "left_semi")
    if flags is not None:
        out = out.join(flags.filter("target_kind = 'Symbol'").select(F.col("target_id").alias("id")).distinct(), "id", "left_semi")
    return out


def min_degree(degrees: DataFrame, least: int) -> DataFrame:
    return degrees.filter(F.col("degree") >= least)


def search_symbols(symbols: DataFrame, query: str, n: int = 1) -> DataFrame:
    """The first symbols by id whose name holds the query, whatever the case."""
    return symbols.filter(F.contains(F.lower("name"), F.lit(query.lower()))).orderBy("id").limit(n)


def search_tree(modules: DataFrame, symbols: DataFrame, query: str) -> DataFrame:
    """Modules whose name, symbols or modules below fit the query."""
    from graphloom.operators.graph import reach_any

    fits = F.contains(F.lower("name"), F.lit(query.lower()))
    hits = modules.filter(fits).select(F.col("id").alias("node")).unionByName(symbols.filter(fits).select(F.col("module_id").alias("node")))
    up = modules.filter("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    return modules.join(reach_any(up, hits.distinct()).withColumnRenamed("node", "id"), "id", "left_semi")


def in_viewport(points: DataFrame, x0: float, y0: float, x1: float, y1: float, cell: float = 50.0) -> DataFrame:
    """Points in the grid cells that a window touches."""
    inside = lambda c, a, b: F.floor(F.col(c) / cell).between(int(a // cell), int(b // cell))
    return points.filter(inside("x", x0, x1) & inside("y", y0, y1))


# ---------------------------------------------------------------- inspector tables


def symbol_cards(symbols: DataFrame, modules: DataFrame, symbol_metrics: DataFrame, flags: DataFrame, calls: DataFrame) -> DataFrame:
    """A row per symbol: its module, metrics, flags, and how many call it and it calls."""
    home = modules.select(F.col("id").alias("module_id"), F.col("path").alias("module"))
    flagged = flags.filter("target_kind = 'Symbol'").groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_set("kind")).alias("flags"))
    count = lambda a, name: calls.groupBy(F.col(a).alias("id")).agg(F.count("*").alias(name))
    out = symbols.join(home, "module_id", "left").join(symbol_metrics.withColumnRenamed("symbol_id", "id"), "id", "left").join(flagged, "id", "left")
    out = out.join(count("dst", "callers"), "id", "left").join(count("src", "callees"), "id", "left")
    return out.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>"))).na.fill(0, ["callers", "callees"])


def module_cards(modules: DataFrame, symbols: DataFrame, module_metrics: DataFrame) -> DataFrame:
    """A row per module: its parent's path, numbers of children and of symbols by kind, metrics."""
    above = modules.select(F.col("id").alias("parent"), F.col("path").alias("parent_path"))
    children = modules.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    kinds = symbols.groupBy(F.col("module_id").alias("id"), "kind").agg(F.count("*").alias("n")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("symbols_by_kind"))
    return modules.join(above, "parent", "left").join(children, "id", "left").join(kinds, "id", "left").join(module_metrics.withColumnRenamed("module_id", "id"), "id", "left").na.fill(0, ["children"])


def crate_cards(crates: DataFrame, crate_modules: DataFrame, dependencies: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row per crate: numbers of modules, symbols and dependencies."""
    owned = crate_modules.groupBy("crate_id").agg(F.count("*").alias("modules"))
    held = crate_modules.join(symbols.select("module_id"), "module_id").groupBy("crate_id").agg(F.count("*").alias("symbols"))
    needs = dependencies.groupBy("crate_id").agg(F.countDistinct("dependency").alias("dependencies"))
    out = crates.withColumnRenamed("id", "crate_id")
    for t in (owned, held, needs):
        out = out.join(t, "crate_id", "left")
    return out.na.fill(0, ["modules", "symbols", "dependencies"])


def module_owner(crate_modules: DataFrame, crates: DataFrame) -> DataFrame:
    """module_id, crate_id: of several crates that hold a module, the last."""
    ordered = crate_modules.join(crates.select(F.col("id").alias("crate_id"), "ord"), "crate_id")
    return ordered.groupBy("module_id").agg(F.max_by("crate_id", F.struct("ord", "crate_id")).alias("crate_id"))


def overlay(nodes: DataFrame, edges: DataFrame, cycles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node) and edges (src, dst) with in_cycle: an edge is where both its ends are in the same cycle (node, component)."""
    own = nodes.join(cycles, "node", "left").withColumn("in_cycle", F.col("component").isNotNull()).drop("component")
    both = edges.join(cycles.toDF("src", "a"), "src", "left").join(cycles.toDF("dst", "b"), "dst", "left")
    return own, both.select(*edges.columns, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("in_cycle"))
