"""Detectors: security indicators, entrypoints, structure; findings, scores and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import strongly_connected
from graphloom.operators.metrics import CALLABLE

#: API prefixes by indicator, in order of precedence (fixed values).
API_PREFIXES = {
    "FilesystemAccess": ["std::fs::", "tokio::fs::"],
    "NetworkAccess": ["std::net::", "tokio::net::", "reqwest::", "hyper::"],
    "SubprocessExecution": ["std::process::Command", "tokio::process::Command"],
}
ASYNC_MAINS = ["tokio::main", "async_std::main", "actix_web::main"]
HANDLERS = ["get", "post", "put", "delete", "handler"]
COMMANDS = ["command"]


def has_any(attributes: Column, names: list[str]) -> Column:
    return F.arrays_overlap(attributes, F.array(*map(F.lit, names)))


def has_any_prefix(attributes: Column, names: list[str]) -> Column:
    """Equal to a name, or the name followed by "("."""
    return F.exists(attributes, lambda a: reduce(Column.__or__, [(a == n) | a.startswith(n + "(") for n in names]))


def api_kind(name: Column, prefixes: dict | None = None) -> Column:
    """First indicator one of whose prefixes the qualified name has."""
    out = None
    for kind, ps in (prefixes or API_PREFIXES).items():
        hit = reduce(Column.__or__, [name.startswith(p) for p in ps])
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def security_indicators(symbols: DataFrame, modules: DataFrame, calls: DataFrame, prefixes: dict | None = None) -> DataFrame:
    """kind, symbol_id, name: unsafe functions and blocks, foreign functions, and calls into the named APIs."""
    flags = [("UnsafeFunction", "is_unsafe"), ("UnsafeBlock", "has_unsafe_block"), ("FfiCall", "is_extern")]
    own = symbols.select("id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("on")) for k, c in flags)))).filter("on")
    own = own.select("kind", F.col("id").alias("symbol_id"), F.lit(None).cast("string").alias("name"))
    paths = modules.select(F.col("id").alias("module_id"), "path")
    named = symbols.join(paths, "module_id", "left").select(F.col("id").alias("dst"), F.coalesce(F.concat("path", F.lit("::"), "name"), "name").alias("name"))
    hit = named.withColumn("kind", api_kind(F.col("name"), prefixes)).filter("kind is not null")  # few callees before the join
    return own.unionByName(calls.join(hit, "dst").select("kind", F.col("src").alias("symbol_id"), "name"))


def entrypoints(symbols: DataFrame, modules: DataFrame, calls: DataFrame) -> DataFrame:
    """symbol_id, rules (sorted): main in a root module, async main, handler, test, command, function nobody calls."""
    roots = modules.filter("parent is null").select(F.col("id").alias("module_id"))
    is_callable = F.col("kind").isin(*CALLABLE)
    rules = symbols.filter((F.col("kind") == "Function") & (F.col("name") == "main")).join(roots, "module_id", "left_semi").select("id", F.lit("main").alias("rule"))
    parts = [rules, symbols.filter("is_test").select("id", F.lit("test").alias("rule"))]
    if "attribute_paths" in symbols.columns:
        a = F.col("attribute_paths")
        for rule, test in (("async_main", has_any(a, ASYNC_MAINS)), ("handler", has_any_prefix(a, HANDLERS)), ("command", has_any(a, COMMANDS))):
            parts.append(symbols.filter(is_callable & test).select("id", F.lit(rule).alias("rule")))
    uncalled = symbols.filter("kind = 'Function'").join(calls.select(F.col("dst").alias("id")), "id", "left_anti")
    parts.append(uncalled.select("id", F.lit("no_callers").alias("rule")))
    return reduce(DataFrame.unionByName, parts).groupBy(F.col("id").alias("symbol_id")).agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


def structural_findings(module_m: DataFrame, module_edges: DataFrame, god_symbols: int = 50, god_coupling: float = 20.0, api_ratio: float = 0.8, crate_edges: DataFrame | None = None) -> DataFrame:
    """kind, severity, members (sorted ids), description: cycles of crates and of modules, god modules, wide API surfaces."""
    one = lambda c: F.array(F.col(c).cast("long")).alias("members")

    def cycles(edges, kind, severity, what):
        found = strongly_connected(edges).groupBy("component").agg(F.array_sort(F.collect_list(F.col("node").cast("long"))).alias("members"))
        return found.select(F.lit(kind).alias("kind"), severity.alias("severity"), "members", F.format_string(f"cycle of %d {what}", F.size("members")).alias("description"))

    god = (F.col("symbol_count") > god_symbols) & (F.col("coupling_score") > god_coupling)
    wide = (F.col("symbol_count") >= 3) & (F.col("api_surface_ratio") > api_ratio)
    share = F.round(F.col("api_surface_ratio") * 100).cast("int")
    found = [
        cycles(module_edges, "CyclicModuleDependency", F.when(F.size("members") >= 3, "High").otherwise("Medium"), "modules"),
        module_m.filter(god).select(F.lit("GodModule").alias("kind"), F.lit("Medium").alias("severity"), one("module_id"), F.format_string("%d symbols, coupling %.1f", "symbol_count", "coupling_score").alias("description")),
        module_m.filter(wide).select(F.lit("ExcessiveApiSurface").alias("kind"), F.lit("Low").alias("severity"), one("module_id"), F.format_string("%d%% of %d symbols are public", share, F.col("symbol_count")).alias("description")),
    ]
    if crate_edges is not None:
        found.insert(0, cycles(crate_edges, "CyclicCrateDependency", F.lit("Critical"), "crates"))
    return reduce(DataFrame.unionByName, found)


def structural_counts(found: DataFrame) -> DataFrame:
    """cycle_count and god_module_count of structural findings, in one row."""
    return found.agg(F.count_if(F.col("kind").startswith("Cyclic")).alias("cycle_count"), F.count_if(F.col("kind") == "GodModule").alias("god_module_count"))


#: Weights (fixed values) of the six ranking factors.
FACTORS = {"reachability": 0.25, "exploitability": 0.20, "cost": 0.15, "centrality": 0.15, "confidence": 0.15, "severity": 0.10}


def total_score() -> Column:
    """0..100 from the six factor columns; a missing factor counts 0."""
    return F.round(100 * reduce(Column.__add__, [F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in FACTORS.items()]), 4)


def gate(findings: DataFrame, fail_on: str | None = None, max_findings: int | None = None) -> int:
    """Exit code: 0, or 2 beyond the allowed number or with a finding of at least the given severity."""
    order = ["Info", "Low", "Medium", "High", "Critical"]
    bad = order[order.index(fail_on) :] if fail_on else []
    r = findings.agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin(*bad) if bad else F.lit(False)).alias("bad")).first()
    return 2 if r["bad"] or (max_findings is not None and r["n"] > max_findings) else 0
