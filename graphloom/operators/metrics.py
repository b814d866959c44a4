"""Symbol and module metrics, ratios and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALLABLE = ("Function", "Method")

#: Strict upper bounds (fixed values) of the quality flags.
THRESHOLDS = {"HighComplexity": 15, "LargeFunction": 100, "LargeModule": 50, "HighFanIn": 20, "HighFanOut": 15}


def line_count():
    return F.when(F.col("end_line") >= F.col("start_line"), F.col("end_line") - F.col("start_line") + 1).otherwise(1).cast("long")


def parameter_count(signature):
    """Commas outside <> and () between the first "(" and its match, plus one; 0 without parameters."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("a"), F.lit(0).alias("n"), F.lit(False).alias("any"), F.lit(False).alias("over"))

    def step(s, c):
        inside = (s["d"] > 0) & ~s["over"]
        depth = s["d"] + F.when(c == "(", 1).when((c == ")") & (s["d"] > 0), -1).otherwise(0)
        angle = s["a"] + F.when(inside & (c == "<"), 1).when(inside & (c == ">") & (s["a"] > 0), -1).otherwise(0)
        top = inside & (s["d"] == 1) & (s["a"] == 0) & (c == ",")
        text = inside & (c != " ") & ~((c == ")") & (s["d"] == 1))
        over = s["over"] | ((c == ")") & (s["d"] == 1))
        return F.struct(depth.alias("d"), angle.alias("a"), (s["n"] + top.cast("int")).alias("n"), (s["any"] | text).alias("any"), over.alias("over"))

    done = lambda s: F.when(s["any"], s["n"] + 1).otherwise(0).cast("long")
    return F.coalesce(F.aggregate(F.split(signature, ""), start, step, done), F.lit(0).cast("long"))


def fans(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """symbol_id, fan_in, fan_out: distinct callers and callees, 0 without any."""
    fan_in = calls.groupBy(F.col("dst").alias("symbol_id")).agg(F.countDistinct("src").alias("fan_in"))
    fan_out = calls.groupBy(F.col("src").alias("symbol_id")).agg(F.countDistinct("dst").alias("fan_out"))
    out = symbols.select(F.col("id").alias("symbol_id")).join(fan_in, "symbol_id", "left").join(fan_out, "symbol_id", "left")
    return out.select("symbol_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fan_in", "fan_out")))


def symbol_metrics(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    return symbols.select(F.col("id").alias("symbol_id"), "kind", line_count().alias("line_count")).join(fans(symbols, calls), "symbol_id")


def module_calls(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """src_module, dst_module of every call."""
    m = symbols.select("id", "module_id")
    a = m.select(F.col("id").alias("src"), F.col("module_id").alias("src_module"))
    return calls.join(a, "src").join(m.select(F.col("id").alias("dst"), F.col("module_id").alias("dst_module")), "dst").select("src_module", "dst_module")


def module_metrics(modules: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per module: sizes, distinct modules calling in and called, coupling, cohesion, API surface.

    instability is 0 without coupling, cohesion 1 without calls, api_surface_ratio 0 without symbols.
    """
    own = symbols.groupBy("module_id").agg(F.count("*").alias("symbol_count"), F.sum(line_count()).alias("line_count"), F.count_if(F.col("visibility") == "Public").alias("public"))
    between = module_calls(symbols, calls).groupBy("src_module", "dst_module").agg(F.count("*").alias("n"))
    outer = between.filter("src_module <> dst_module")
    fan_in = outer.groupBy(F.col("dst_module").alias("module_id")).agg(F.count("*").alias("fan_in"))
    fan_out = outer.groupBy(F.col("src_module").alias("module_id")).agg(F.count("*").alias("fan_out"))
    refs = between.groupBy(F.col("src_module").alias("module_id")).agg(F.sum("n").alias("refs"), F.sum(F.when(F.col("src_module") == F.col("dst_module"), F.col("n")).otherwise(0)).alias("internal"))
    out = modules.select(F.col("id").alias("module_id"))
    for side in (own, fan_in, fan_out, refs):
        out = out.join(side, "module_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ratio = lambda a, b, other: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(other)), 6)
    return out.select(
        "module_id",
        *(z(c).alias(c) for c in ("symbol_count", "line_count", "fan_in", "fan_out")),
        ratio(z("fan_out"), z("fan_in") + z("fan_out"), 0.0).alias("instability"),
        ratio(z("internal"), z("refs"), 1.0).alias("cohesion"),
        (z("fan_in") + z("fan_out")).cast("double").alias("coupling_score"),
        ratio(z("public"), z("symbol_count"), 0.0).alias("api_surface_ratio"),
    )


def complexity_flags(symbol_m: DataFrame, module_m: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """target_kind, target_id, kind, value, threshold for every metric above its bound."""
    t = THRESHOLDS | (thresholds or {})

    def rows(df, target, id_col, pairs):
        stack = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("value"), F.lit(t[k]).cast("long").alias("threshold")) for k, c in pairs)))
        return df.select(F.lit(target).alias("target_kind"), F.col(id_col).cast("long").alias("target_id"), stack).filter("value > threshold")

    symbol_pairs = [("LargeFunction", "line_count")] + ([("HighComplexity", "cyclomatic_complexity")] if "cyclomatic_complexity" in symbol_m.columns else [])
    module_pairs = [("LargeModule", "symbol_count"), ("HighFanIn", "fan_in"), ("HighFanOut", "fan_out")]
    return rows(symbol_m, "Symbol", "symbol_id", symbol_pairs).unionByName(rows(module_m, "Module", "module_id", module_pairs))


def cyclomatic_complexity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """function_id, cyclomatic_complexity = edges - nodes + 2 * weak components, at least 1.

    nodes: function_id, node_ix; edges: function_id, src_ix, dst_ix.  Functions without nodes have no row (0).
    """
    from graphloom.operators.components import connected_components

    key = lambda c: F.struct("function_id", F.col(c).alias("ix"))
    n = nodes.groupBy("function_id").agg(F.count("*").alias("n"))
    e = edges.groupBy("function_id").agg(F.count("*").alias("e"))
    parts = connected_components(edges.select(key("src_ix").alias("src"), key("dst_ix").alias("dst")))
    merged = parts.filter("node <> component").groupBy(F.col("node.function_id").alias("function_id")).agg(F.count("*").alias("merged"))
    out = n.join(e, "function_id", "left").join(merged, "function_id", "left").na.fill(0, ["e", "merged"])
    return out.select("function_id", F.greatest(F.lit(1), F.col("e") - F.col("n") + 2 * (F.col("n") - F.col("merged"))).cast("long").alias("cyclomatic_complexity"))
