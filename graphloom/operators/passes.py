"""Passes over the call graph: taint paths, guards, cost, layers, reachability, and rules given as data.

Names decide what a function is (source, sink, sanitizer, guard, costly operation); every pattern is a parameter.
Null names match nothing; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import reach, reach_any, reverse, strongly_connected
from graphloom.plans.shared import materialize

#: Parts of names (fixed values).
SANITIZERS = "escape|sanitize|encode|validate|verify"
WEAK_SANITIZERS = "validate|check"
GUARDS = "auth|require|check_permission|verify_token|guard|authorize|is_admin|has_role"
SENSITIVE = "insert|update|delete|execute|create_user|delete_user|update_role"
#: Cost of an operation by type, and the parts of qualified names that tell it (fixed values).
COST_WEIGHTS = {"Allocation": 1.0, "Lock": 2.0, "IoRead": 5.0, "IoWrite": 5.0, "NetworkCall": 10.0, "DbQuery": 10.0, "Serialization": 2.0, "Clone": 1.0}
COST_PATTERNS = {
    "DbQuery": "^(sqlx|diesel|rusqlite)::.*(query|execute|fetch|prepare)",
    "NetworkCall": "^reqwest::|^hyper::|TcpStream::connect",
    "Allocation": "Vec::new|Box::new|String::from|HashMap::new|to_vec|to_string$|to_owned",
    "Clone": "Clone::clone|[.]clone",
    "IoRead": "std::fs::read|File::open|BufReader::new",
    "IoWrite": "std::fs::write|File::create|BufWriter::new",
    "Lock": "Mutex::lock|RwLock::read|RwLock::write",
    "Serialization": "serde_json::to_string|serde_json::from_str|bincode::serialize",
}
#: Scores of levels (fixed values).
CONFIDENCE = {"High": 1.0, "Medium": 0.6, "Low": 0.3}
SEVERITY = {"Critical": 1.0, "High": 0.8, "Medium": 0.5, "Low": 0.3, "Info": 0.1}
REACHABILITY = {"Public": 1.0, "Internal": 0.5, "Unknown": 0.3}
EXPLOITABILITY = {"taint/sql-injection": 1.0, "taint/command-injection": 1.0, "auth/missing-guard": 0.9, "taint/ssrf": 0.8, "cost/db-in-loop": 0.5, "structure/cyclic-dependency": 0.3, "complexity/": 0.2}


def _level(column: str, scores: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in scores.items() for x in kv)), F.col(column))


# ---------------------------------------------------------------- taint


def paths_between(edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int = 10) -> DataFrame:
    """path (array): simple paths of 1..max_depth edges from any source to any sink; a path ends at its first sink.

    Only edges between what sources reach and what reaches a sink take part, so branches that lead nowhere never grow.
    """
    ahead = reach_any(edges, sources, max_depth)
    behind = reach_any(reverse(edges), sinks, max_depth)
    useful = materialize(ahead.join(behind, "node", "left_semi"), "useful")
    e = edges.select("src", "dst").distinct().join(useful.withColumnRenamed("node", "src"), "src", "left_semi")
    e = materialize(e.join(useful.withColumnRenamed("node", "dst"), "dst", "left_semi").join(sinks.select(F.col("node").alias("dst"), F.lit(True).alias("ends")).distinct(), "dst", "left"), "edges")
    grown = sources.filter("node is not null").select(F.array(F.col("node").cast("long")).alias("path")).distinct()
    out = []
    for _ in range(max_depth):
        step = grown.withColumn("src", F.element_at("path", -1)).join(e, "src").filter(~F.array_contains("path", F.col("dst").cast("long")))
        step = materialize(step.select(F.concat("path", F.array(F.col("dst").cast("long"))).alias("path"), "ends"), "paths")
        out.append(step.filter("ends").select("path"))
        grown = step.filter("ends is null").select("path")
        if grown.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def taint_findings(paths: DataFrame, names: DataFrame, sanitizers: str = SANITIZERS, weak: str = WEAK_SANITIZERS) -> DataFrame:
    """path, n_edges, severity, confidence of the paths that no function between their ends sanitizes.  ``names``: node, name.

    A weak sanitizer does not clean a path: it lowers the severity to Medium and the confidence by a level, as does a path
    of over five edges for the confidence.
    """
    p = paths.withColumn("id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))
    inner = p.select("id", F.posexplode("path").alias("at", "node"), (F.size("path") - 1).alias("last")).filter("at > 0 and at < last")
    is_weak = F.col("name").rlike(weak)
    seen = inner.join(names.select("node", "name"), "node").groupBy("id").agg(F.max(F.col("name").rlike(sanitizers) & ~is_weak).alias("clean"), F.max(is_weak).alias("weak"))
    scored = p.join(seen, "id", "left").withColumn("n_edges", (F.size("path") - 1).cast("long")).filter("not coalesce(clean, false)")
    softened = F.coalesce("weak", F.lit(False))
    lost = F.when(F.col("n_edges") > 5, 1).otherwise(0) + F.when(softened, 1).otherwise(0)
    level = F.element_at(F.array(*map(F.lit, ("High", "Medium", "Low"))), lost + 1)
    return scored.select("path", "n_edges", F.when(softened, "Medium").otherwise("High").alias("severity"), level.alias("confidence"))


# ---------------------------------------------------------------- guards


def missing_guards(edges: DataFrame, entrypoints: DataFrame, names: DataFrame, guards: str = GUARDS) -> DataFrame:
    """node, severity: entrypoints (node, external) that reach no guard; High from outside, Medium inside."""
    guard = materialize(names.filter(F.col("name").rlike(guards)).select("node").distinct(), "guards")
    callers = edges.join(guard.withColumnRenamed("node", "dst"), "dst").filter("src <> dst").select(F.col("src").alias("node"))
    guarded = reach_any(reverse(edges), callers).join(guard, "node", "left_anti")  # once backwards from all guards
    # a guard is no guard of its own: those among the entrypoints look for another
    others = reach(edges, entrypoints.join(guard, "node", "left_semi")).filter("node <> root").join(guard, "node", "left_semi").select(F.col("root").alias("node"))
    bare = entrypoints.join(guarded.unionByName(others), "node", "left_anti")
    return bare.select("node", F.when(F.col("external"), "High").otherwise("Medium").alias("severity"))


def unguarded_operations(edges: DataFrame, entrypoints: DataFrame, names: DataFrame, guards: str = GUARDS, sensitive: str = SENSITIVE) -> DataFrame:
    """root, node: sensitive operations that an entrypoint reaches on some path without a guard (guards cut out)."""
    guard = materialize(names.filter(F.col("name").rlike(guards)).select("node"), "guards")
    open_edges = edges.join(guard.withColumnRenamed("node", "src"), "src", "left_anti").join(guard.withColumnRenamed("node", "dst"), "dst", "left_anti")
    roots = entrypoints.join(guard, "node", "left_anti")
    return reach(open_edges, roots).filter("node <> root").join(names.filter(F.col("name").rlike(sensitive)), "node", "left_semi").select("root", "node")


# ---------------------------------------------------------------- cost


def direct_costs(calls: DataFrame, names: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """node, cost_type, cost: weights of the operations a function calls, by type.  A callee is of its first type."""
    kind = None
    for k, p in (patterns or COST_PATTERNS).items():
        hit = F.col("name").rlike(p)
        kind = F.when(hit, k) if kind is None else kind.when(hit, k)
    costly = names.select(F.col("node").alias("dst"), kind.alias("cost_type")).filter("cost_type is not null")
    weighed = costly.withColumn("w", _level("cost_type", COST_WEIGHTS))
    return calls.join(weighed, "dst").groupBy(F.col("src").alias("node"), "cost_type").agg(F.sum("w").alias("cost"))


def total_costs(edges: DataFrame, direct: DataFrame) -> DataFrame:
    """node, total: own cost (node, cost) and the totals of all distinct callees; a cycle counts as one function.

    Costs travel from callees to callers one edge a round, so a round holds one row per caller.
    """
    scc = materialize(strongly_connected(edges), "scc")
    own = edges.filter("src is not null and dst is not null and src <> dst")
    ends = materialize(own.select(F.explode(F.array("src", "dst")).alias("node")).union(direct.select("node")).distinct(), "ends")
    groups = materialize(ends.join(scc, "node", "left").select("node", F.coalesce("component", "node").alias("g")), "groups")
    dag = own.join(groups.select(F.col("node").alias("src"), F.col("g").alias("a")), "src").join(groups.select(F.col("node").alias("dst"), F.col("g").alias("b")), "dst")
    dag = materialize(dag.filter("a <> b").select("a", "b").distinct(), "dag")
    sent = materialize(direct.join(groups, "node").groupBy("g").agg(F.sum("cost").alias("cost")), "sent")
    parts = [sent]
    while not sent.isEmpty():
        sent = materialize(dag.join(sent.withColumnRenamed("g", "b"), "b").groupBy(F.col("a").alias("g")).agg(F.sum("cost").alias("cost")), "sent")
        parts.append(sent)
        if len(parts) > 8:
            parts = [materialize(reduce(DataFrame.unionByName, parts).groupBy("g").agg(F.sum("cost").alias("cost")), "totals")]
    total = reduce(DataFrame.unionByName, parts).groupBy("g").agg(F.sum("cost").alias("total"))
    return groups.join(total, "g", "left").select("node", F.coalesce("total", F.lit(0.0)).alias("total"))


# ---------------------------------------------------------------- structure


def layer_violations(edges: DataFrame, modules: DataFrame, layers: list[list[str]]) -> DataFrame:
    """src, dst, src_layer, dst_layer: imports from a module of a lower layer into a higher one.

    ``layers`` holds path prefixes, top layer first; modules in no layer are free.
    """
    index = None
    for i, prefixes in enumerate(layers):
        hit = reduce(Column.__or__, [F.col("path").startswith(p) for p in prefixes])
        index = F.when(hit, i) if index is None else index.when(hit, i)
    at = modules.select("id", index.alias("layer")).filter("layer is not null")
    both = edges.select("src", "dst").join(at.toDF("src", "src_layer"), "src").join(at.toDF("dst", "dst_layer"), "dst")
    return both.filter("dst_layer < src_layer").select("src", "dst", "src_layer", "dst_layer")


def god_modules(module_metrics: DataFrame, symbols: int = 50, coupling: float = 30.0, fan_out: int = 20, cohesion: float = 0.3) -> DataFrame:
    """module_id of modules that are large and coupled, or depend on many, or hold little together."""
    large = (F.col("symbol_count") >= symbols) & (F.col("coupling_score") >= coupling)
    return module_metrics.filter(large | (F.col("fan_out") >= fan_out) | (F.col("cohesion") < cohesion)).select("module_id")


# ---------------------------------------------------------------- ranking and rules


def reachability(nodes: DataFrame, edges: DataFrame, external: DataFrame) -> DataFrame:
    """node, reachability: Public if an external entrypoint reaches it (or is it), else Internal."""
    public = reach_any(edges, external).withColumn("public", F.lit(True))
    return nodes.select("node").distinct().join(public, "node", "left").select("node", F.when(F.col("public"), "Public").otherwise("Internal").alias("reachability"))


def factor_scores(findings: DataFrame, max_cost: float = 50.0, max_fan_in: float = 20.0) -> DataFrame:
    """The six ranking factors of findings (rule_id, severity, confidence, reachability, total_cost, fan_in).

    Unknown levels and rules score 0, missing cost or fan-in too.
    """
    rule = reduce(lambda c, kv: c.when(F.col("rule_id").contains(kv[0]), kv[1]), EXPLOITABILITY.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    scored = {
        "reachability": F.coalesce(_level("reachability", REACHABILITY), F.lit(0.0)),
        "exploitability": rule,
        "cost": F.coalesce(F.least(F.lit(1.0), F.col("total_cost") / max_cost), F.lit(0.0)),
        "centrality": F.coalesce(F.least(F.lit(1.0), F.col("fan_in") / max_fan_in), F.lit(0.0)),
        "confidence": F.coalesce(_level("confidence", CONFIDENCE), F.lit(0.0)),
        "severity": F.coalesce(_level("severity", SEVERITY), F.lit(0.0)),
    }
    keep = [c for c in findings.columns if c not in scored and c not in ("total_cost", "fan_in")]
    return findings.select(*keep, *(v.alias(k) for k, v in scored.items()))


_COMPARE = {"Gt": "__gt__", "Gte": "__ge__", "Lt": "__lt__", "Lte": "__le__", "Eq": "__eq__"}


def ranked(findings: DataFrame, *ties: str) -> DataFrame:
    """Findings by score, the highest first, with their place; equal scores by the tie columns.

    Places come from a range sort: a partition's rows follow the counted rows of those before it.
    """
    order = [F.desc("score"), *ties]
    placed = materialize(findings.sort(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % F.lit(1 << 33)), "ranked")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("place", (F.col("before") + F.col("at") + 1).cast("long")).drop("part", "at", "before")


def rule_test(rule: dict) -> Column:
    """The condition of a rule {field, op, value}: Gt, Gte, Lt, Lte, Eq on numbers; Prefix, Exact, Contains, Regex on text."""
    c, v = F.col(rule["field"]), rule["value"]
    if rule["op"] in _COMPARE:
        return getattr(c, _COMPARE[rule["op"]])(F.lit(v))
    return {"Prefix": c.startswith, "Exact": lambda x: c == x, "Contains": c.contains, "Regex": c.rlike}[rule["op"]](v)


class RuleRegistry:
    """Rules by id: {id, category, severity, field, op, value}; a rule is enabled until it is switched off."""

    def __init__(self, rules: list[dict] = ()):
        self.rules, self.off = {}, set()
        for r in rules:
            self.register(r)

    def register(self, rule: dict) -> None:
        self.rules[rule["id"]] = rule

    def set_enabled(self, rule_id: str, on: bool) -> None:
        (self.off.discard if on else self.off.add)(self.rules[rule_id]["id"])

    def enabled(self, category: str | None = None) -> list[dict]:
        return [r for k, r in sorted(self.rules.items()) if k not in self.off and category in (None, r["category"])]

    def evaluate(self, rows: DataFrame, id_col: str) -> DataFrame:
        """rule_id, severity, target: a row for every enabled rule that a row meets, in one pass over ``rows``."""
        on = self.enabled()
        hits = F.array(*(F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), F.coalesce(rule_test(r), F.lit(False)).alias("hit")) for r in on))
        if not on:
            return rows.select(F.lit("").alias("rule_id"), F.lit("").alias("severity"), F.col(id_col).alias("target")).limit(0)
        return rows.select(F.col(id_col).alias("target"), F.inline(hits)).filter("hit").select("rule_id", "severity", "target")
