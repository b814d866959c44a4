"""The whole analysis of a loaded and parsed project, and its findings.

Every table is a DataFrame; nothing is gathered but counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import build, graph, metrics, passes, rules
from graphloom.plans.shared import materialize
from graphloom.sources.loader import Project
from graphloom.sources.parse import Parsed

#: Built-in rules: id, category, severity, description (fixed values).
CATALOG = [
    ("quality/complexity/high-cyclomatic", "Quality", "Medium", "Cyclomatic complexity exceeds threshold"),
    ("quality/complexity/large-function", "Quality", "Low", "Function exceeds line count threshold"),
    ("quality/complexity/large-module", "Quality", "Low", "Module exceeds symbol count threshold"),
    ("quality/coupling/high-fan-in", "Quality", "Low", "Module has excessive incoming dependencies"),
    ("quality/coupling/high-fan-out", "Quality", "Low", "Module has excessive outgoing dependencies"),
    ("security/code/unsafe-function", "Security", "Medium", "Function declared as unsafe"),
    ("security/code/unsafe-block", "Security", "Medium", "Unsafe block detected"),
    ("security/boundary/ffi-call", "Security", "High", "Foreign function interface call"),
    ("security/api/filesystem-access", "Security", "Medium", "Filesystem API access"),
    ("security/api/network-access", "Security", "Medium", "Network API access"),
    ("security/api/subprocess-exec", "Security", "High", "Subprocess execution"),
    ("security/taint/sql-injection", "Security", "Critical", "Unsanitized input reaches SQL execution"),
    ("security/taint/command-injection", "Security", "Critical", "Unsanitized input reaches shell execution"),
    ("security/taint/ssrf", "Security", "High", "Unsanitized input used in outbound HTTP request"),
    ("security/auth/missing-guard", "Security", "High", "HTTP handler missing authorization check"),
    ("perf/cost/db-in-loop", "Performance", "High", "Database query inside loop body (N+1)"),
    ("perf/cost/network-in-loop", "Performance", "High", "Network call inside loop body"),
    ("perf/cost/allocation-in-loop", "Performance", "Medium", "Heap allocation inside loop body"),
    ("perf/cost/hotspot", "Performance", "Medium", "Function exceeds cost threshold"),
    ("arch/structure/cyclic-dependency", "Architecture", "Medium", "Cyclic dependency between modules or crates"),
    ("arch/structure/layer-violation", "Architecture", "High", "Import violates layer ordering"),
    ("arch/structure/excessive-api-surface", "Architecture", "Low", "Module exposes too many public symbols"),
    ("arch/structure/god-module", "Architecture", "Medium", "Module is too large and highly coupled"),
    ("resource/lock/held-across-await", "Resource", "High", "Mutex guard potentially held across await point"),
    ("resource/transaction/uncommitted", "Resource", "Medium", "Transaction opened without commit/rollback"),
]
#: The rule of an indicator, of a flag and of a structural finding.
RULE_OF = {
    "UnsafeFunction": "security/code/unsafe-function",
    "UnsafeBlock": "security/code/unsafe-block",
    "FfiCall": "security/boundary/ffi-call",
    "FilesystemAccess": "security/api/filesystem-access",
    "NetworkAccess": "security/api/network-access",
    "SubprocessExecution": "security/api/subprocess-exec",
    "HighComplexity": "quality/complexity/high-cyclomatic",
    "LargeFunction": "quality/complexity/large-function",
    "LargeModule": "quality/complexity/large-module",
    "HighFanIn": "quality/coupling/high-fan-in",
    "HighFanOut": "quality/coupling/high-fan-out",
    "CyclicModuleDependency": "arch/structure/cyclic-dependency",
    "CyclicCrateDependency": "arch/structure/cyclic-dependency",
    "GodModule": "arch/structure/god-module",
    "ExcessiveApiSurface": "arch/structure/excessive-api-surface",
}
LOOP_RULES = {"DbQuery": "perf/cost/db-in-loop", "NetworkCall": "perf/cost/network-in-loop", "Allocation": "perf/cost/allocation-in-loop"}
#: Resources by the calls that take and give them back (fixed values), and the words of a result type that pass them on.
RESOURCES = {
    "File": ("File::(open|create)$|OpenOptions::open$", "(^|::)(drop|close)$", "File|Reader|Writer"),
    "DbConnection": ("(^|::)connect$|Pool::get$|Connection::open$", "(^|::)(drop|close)$", "Connection|Pool"),
    "Lock": ("(Mutex::|^)lock$|RwLock::(read|write)$", "(^|::)drop$", "Guard"),
    "Transaction": ("(^|::)(begin|transaction)$", "(^|::)(commit|rollback)$", "Transaction"),
    "TcpStream": ("TcpStream::connect$|TcpListener::bind$", "(^|::)(drop|shutdown)$", "Stream|Listener"),
    "Process": ("Command::spawn$|^spawn$", "(^|::)(wait|kill)$", "Child"),
}
#: What calls do beyond computing, by their names (fixed values).
EFFECTS = {
    "FileRead": passes.COST_PATTERNS["IoRead"],
    "FileWrite": passes.COST_PATTERNS["IoWrite"],
    "NetworkCall": passes.COST_PATTERNS["NetworkCall"],
    "DbQuery": passes.COST_PATTERNS["DbQuery"],
    "SubprocessExec": "process::Command",
    "Logging": "^(log|tracing)::",
    "Allocation": passes.COST_PATTERNS["Allocation"],
    "LockAcquire": RESOURCES["Lock"][0],
    "Panic": "(^|::)(unwrap|expect|panic)$",
}


def catalog(spark) -> DataFrame:
    return spark.createDataFrame([(*r, True) for r in CATALOG], "rule_id string, category string, severity string, description string, enabled boolean")


def called_names(extracted: DataFrame) -> DataFrame:
    """rel_id, source_id, name and place of calls from functions; names begin where the module's imports say."""
    used = extracted.filter("kind = 'Imports' and target_name <> '*'").groupBy("module_id", F.col("target_name").alias("first")).agg(F.min("target_path").alias("prefix"))
    calls = extracted.filter("kind = 'Calls' and source_id is not null").withColumn("path", F.coalesce("target_path", "target_name")).withColumn("first", F.split("path", "::")[0])
    full = F.when(F.col("prefix").isNotNull() & F.col("target_path").isNotNull(), F.concat("prefix", F.expr("substr(path, length(first) + 1)"))).otherwise(F.col("path"))
    return calls.join(used, ["module_id", "first"], "left").select("rel_id", "source_id", full.alias("name"), "file_id", "start_line", "start_col", "end_line", "end_col")


def kinds_of(name: Column, patterns: dict[str, str]) -> Column:
    """All kinds whose pattern a name fits."""
    return F.filter(F.array(*(F.when(name.rlike(p), F.lit(k)) for k, p in patterns.items())), lambda k: k.isNotNull())


def _inside(inner: str, outer: str) -> Column:
    start = lambda d, e: F.struct(f"{d}.{e}_line", f"{d}.{e}_col")
    return (start(outer, "start") <= start(inner, "start")) & (start(inner, "end") <= start(outer, "end"))


def calls_in_loops(called: DataFrame, cfg_nodes: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """rel_id, function_id, kind, rule_id, name, line: costly calls whose span lies in a loop of their function, once each."""
    patterns = patterns or {k: passes.COST_PATTERNS[k] for k in LOOP_RULES}
    costly = called.withColumn("kind", F.explode(kinds_of(F.col("name"), patterns))).alias("c")
    loops = cfg_nodes.filter("kind = 'Loop'").alias("l")
    met = costly.join(loops, (F.col("c.source_id") == F.col("l.function_id")) & _inside("c", "l"), "left_semi")
    rule = F.element_at(F.create_map(*(F.lit(x) for kv in LOOP_RULES.items() for x in kv)), F.col("kind"))
    return met.select("rel_id", F.col("source_id").alias("function_id"), "kind", rule.alias("rule_id"), "name", F.col("start_line").alias("line"))


def _flow_ids(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = lambda c: F.xxhash64("function_id", c)
    return nodes.withColumn("node", key("node_ix")), edges.select(key("src_ix").alias("src"), key("dst_ix").alias("dst"))


def _calls_at(called: DataFrame, nodes: DataFrame) -> DataFrame:
    """rel_id, name, node, node_kind: the innermost node of the flow that holds a call."""
    c, n = called.alias("c"), nodes.filter("start_line is not null").alias("n")
    held = c.join(n, (F.col("c.source_id") == F.col("n.function_id")) & _inside("c", "n"))
    size = F.struct(F.col("n.start_line").alias("a"), F.col("n.start_col").alias("b"), (-F.col("n.end_line")).alias("c"), (-F.col("n.end_col")).alias("d"), F.col("n.node").alias("n"), F.col("n.kind").alias("k"))
    return held.groupBy("c.rel_id", "c.name", "c.source_id").agg(F.max(size).alias("m")).select("rel_id", "name", "source_id", F.col("m.n").alias("node"), F.col("m.k").alias("node_kind"))


def locks_across_await(symbols: DataFrame, called: DataFrame, cfg_nodes: DataFrame, cfg_edges: DataFrame) -> DataFrame:
    """function_id of async functions where an await can follow the taking of a lock without a drop between."""
    nodes, edges = _flow_ids(cfg_nodes, cfg_edges)
    wanted = symbols.filter("is_async").select(F.col("id").alias("source_id"))
    acquire, release, _ = RESOURCES["Lock"]
    at = materialize(_calls_at(called.join(wanted, "source_id", "left_semi").filter(F.col("name").rlike(f"{acquire}|{release}")), nodes), "lock-calls")
    taken, given = at.filter(F.col("name").rlike(acquire)).select("node", "source_id"), at.filter(F.col("name").rlike(release)).select("node").distinct()
    begin = edges.join(taken.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node"))
    open_ = graph.reach_any(edges, begin.join(given, "node", "left_anti"), stops=given).join(given, "node", "left_anti")
    awaits = nodes.filter("kind = 'Await'").join(open_, "node", "left_semi").select("function_id")
    return awaits.join(taken.select(F.col("source_id").alias("function_id")), "function_id", "left_semi").distinct()


def resource_events(called: DataFrame) -> DataFrame:
    """symbol_id, kind, transition (Acquire or Release), rel_id, line."""
    parts = []
    for kind, (acquire, release, _) in RESOURCES.items():
        for transition, pattern in (("Acquire", acquire), ("Release", release)):
            parts.append(called.filter(F.col("name").rlike(pattern)).select(F.col("source_id").alias("symbol_id"), F.lit(kind).alias("kind"), F.lit(transition).alias("transition"), "rel_id", F.col("start_line").alias("line")))
    return reduce(DataFrame.unionByName, parts)


def unreleased(symbols: DataFrame, called: DataFrame) -> DataFrame:
    """symbol_id, kind: resources that a function takes, neither gives back nor passes on by its result."""
    events = resource_events(called)
    taken, given = (events.filter(F.col("transition") == t).select("symbol_id", "kind").distinct() for t in ("Acquire", "Release"))
    result = F.regexp_extract("signature", "-> (.*)$", 1)
    passed = F.lit(False)
    for kind, (_, _, words) in RESOURCES.items():
        passed = passed | ((F.col("kind") == kind) & result.rlike(words))
    kept = taken.join(given, ["symbol_id", "kind"], "left_anti").join(symbols.select(F.col("id").alias("symbol_id"), "signature"), "symbol_id")
    return kept.filter(~F.coalesce(passed, F.lit(False))).select("symbol_id", "kind")


def uncommitted(called: DataFrame, calls: DataFrame) -> DataFrame:
    """symbol_id of functions that begin a transaction that neither they nor what they call commit or roll back."""
    begin, end, _ = RESOURCES["Transaction"]
    ends = called.filter(F.col("name").rlike(end)).select(F.col("source_id").alias("node"))
    settled = graph.reach_any(graph.reverse(calls), ends)
    return called.filter(F.col("name").rlike(begin)).select(F.col("source_id").alias("symbol_id")).distinct().join(settled.withColumnRenamed("node", "symbol_id"), "symbol_id", "left_anti")


def function_summaries(symbols: DataFrame, calls: DataFrame, called: DataFrame, costs: DataFrame | None = None, guards: str = passes.GUARDS, sanitizers: str = passes.SANITIZERS) -> DataFrame:
    """What a function does itself or through what it calls: symbol_id, side_effects, taint_sinks, resources_acquired,
    resources_released, provides_auth, requires_auth, taint_sanitizes, has_await, holds_lock, is_pure, direct_cost, total_cost.

    Marks travel from callees to callers until no function learns anything new; members of a cycle so share theirs.
    """
    own = symbols.filter(F.col("kind").isin(*metrics.CALLABLE))
    tagged = lambda tag, kinds: F.transform(kinds, lambda k: F.concat(F.lit(tag), k))
    sinks = {"Sql": "(sqlx|diesel|rusqlite)::.*(query|execute)", "Shell": "process::Command", "Http": "^(reqwest|hyper)::", "Write": passes.COST_PATTERNS["IoWrite"]}
    takes = {k: v[0] for k, v in RESOURCES.items()}
    gives = {k: v[1] for k, v in RESOURCES.items()}
    direct = called.select(F.col("source_id").alias("node"), F.explode(F.concat(*(tagged(t, kinds_of(F.col("name"), p)) for t, p in (("effect:", EFFECTS), ("sink:", sinks), ("take:", takes), ("give:", gives))))).alias("mark"))
    guarding = own.filter(F.col("name").rlike(guards)).select(F.col("id").alias("node"))
    # what a guard is to its callers, not to itself
    guarded = calls.join(guarding.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"), F.lit("auth:").alias("mark"))
    marks = graph.spread(calls, direct.unionByName(guarded).distinct()).groupBy(F.col("node").alias("id")).agg(F.collect_set("mark").alias("marks"))
    costs = passes.direct_costs(called.select(F.col("source_id").alias("src"), F.xxhash64("name").alias("dst")), called.select(F.xxhash64("name").alias("node"), "name").distinct()) if costs is None else costs
    direct_cost = costs.groupBy("node").agg(F.sum("cost").alias("cost"))
    total = passes.total_costs(calls, direct_cost).withColumnRenamed("node", "id")
    of = lambda tag: F.array_sort(F.transform(F.filter(F.col("marks"), lambda m: m.startswith(tag)), lambda m: F.substring(m, len(tag) + 1, 100)))
    all_ = own.join(marks, "id", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<string>"))).join(total, "id", "left").join(direct_cost.withColumnRenamed("node", "id"), "id", "left")
    return all_.select(
        F.col("id").alias("symbol_id"),
        of("effect:").alias("side_effects"),
        of("sink:").alias("taint_sinks"),
        of("take:").alias("resources_acquired"),
        of("give:").alias("resources_released"),
        F.col("name").rlike(guards).alias("provides_auth"),
        F.array_contains("marks", "auth:").alias("requires_auth"),
        F.col("name").rlike(sanitizers).alias("taint_sanitizes"),
        F.array_contains("marks", "take:Lock").alias("holds_lock"),
        (F.size(of("effect:")) == 0).alias("is_pure"),
        F.coalesce("cost", F.lit(0.0)).alias("direct_cost"),
        F.coalesce("total", F.lit(0.0)).alias("total_cost"),
    )


def affected(changed: DataFrame, calls: DataFrame) -> DataFrame:
    """symbol_id: the changed functions (symbol_id) and everything that calls them; only their summaries can differ."""
    return graph.reach_any(graph.reverse(calls), changed.select(F.col("symbol_id").alias("node"))).withColumnRenamed("node", "symbol_id")


@dataclass
class Analysis:
    nodes: DataFrame
    edges: DataFrame
    calls: DataFrame
    called: DataFrame
    symbol_metrics: DataFrame
    module_metrics: DataFrame
    flags: DataFrame
    entrypoints: DataFrame
    indicators: DataFrame
    structural: DataFrame
    findings: DataFrame


def module_links(project: Project, parsed: Parsed, edges: DataFrame) -> DataFrame:
    """src, dst: modules that refer to another through their symbols or import it by its path."""
    home = parsed.symbols.select("id", "module_id")
    between = edges.filter("src_kind = 'Symbol' and kind in ('References', 'Imports', 'Implements')").join(home.toDF("src_id", "src"), "src_id").join(home.toDF("dst_id", "dst"), "dst_id").select("src", "dst")
    roots = project.modules.select(F.col("id").alias("dst"), "path", "crate_id")
    names = project.modules.select(F.col("id").alias("module_id"), F.col("path").alias("own"))
    used = parsed.extracted.filter("kind = 'Imports'").select("module_id", "target_path").distinct().join(names, "module_id")
    crate = F.split("own", "::")[0]
    whole = F.regexp_replace(F.regexp_replace("target_path", "^crate", crate), "^self", F.col("own"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("whole", "::"))), lambda n: F.array_join(F.slice(F.split("whole", "::"), 1, n), "::"))
    hits = used.withColumn("whole", whole).select("module_id", "target_path", F.explode(prefixes).alias("path")).join(roots, "path")
    longest = hits.groupBy("module_id", "target_path").agg(F.max_by("dst", F.length("path")).alias("dst")).select(F.col("module_id").alias("src"), "dst")
    return between.unionByName(longest).filter("src <> dst and src >= 0 and dst >= 0").distinct()


def analyze(project: Project, parsed: Parsed) -> Analysis:
    """Metrics, flags, entrypoints, indicators and structure of a project, and all of them as findings."""
    symbols, modules = parsed.symbols, project.modules
    nodes = build.nodes(project.crates, modules, project.files, symbols)
    relations = materialize(parsed.relationships, "relationships")
    edges = build.contains_edges(project.crates, modules, symbols).unionByName(build.relationship_edges(relations, symbols)).unionByName(build.depends_on_edges(project.crates, project.dependencies))
    edges = materialize(build.with_weights(edges), "model-edges")
    calls = materialize(build.call_edges(relations, symbols), "calls")
    called = materialize(called_names(parsed.extracted), "called")
    complexity = metrics.cyclomatic_complexity(parsed.cfg_nodes, parsed.cfg_edges).withColumnRenamed("function_id", "symbol_id")
    of_symbols = metrics.symbol_metrics(symbols, calls).join(complexity, "symbol_id", "left").na.fill(0, ["cyclomatic_complexity"])
    of_modules = metrics.module_metrics(modules, symbols, calls)
    flags = metrics.complexity_flags(of_symbols, of_modules)
    outside = called.withColumn("kind", rules.api_kind(F.col("name"))).filter("kind is not null").select("kind", F.col("source_id").alias("symbol_id"), "name")
    indicators = rules.security_indicators(symbols, modules, calls).unionByName(outside).distinct()
    crates = edges.filter("kind = 'DependsOn'").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    structural = rules.structural_findings(of_modules, module_links(project, parsed, edges), crate_edges=crates)
    out = Analysis(nodes, edges, calls, called, of_symbols, of_modules, flags, rules.entrypoints(symbols, modules, calls), indicators, structural, None)
    out.findings = findings(project, parsed, out)
    return out


def findings(project: Project, parsed: Parsed, a: Analysis) -> DataFrame:
    """rule_id, category, severity, file, line, symbol_id, module_id, message.  Rules that are not in the catalog are Info."""
    spark = parsed.symbols.sparkSession
    rule = F.element_at(F.create_map(*(F.lit(x) for kv in RULE_OF.items() for x in kv)), F.col("kind")).alias("rule_id")
    none = F.lit(None).cast("long")
    text = lambda *parts: F.concat_ws(" ", *parts).alias("message")
    sym = lambda df, col, message, r=rule, severity=None: df.select(r, F.col(col).cast("long").alias("symbol_id"), none.alias("module_id"), (severity if severity is not None else F.lit(None).cast("string")).alias("own_severity"), message)
    mod = lambda df, col, message, severity=None: df.select(rule, none.alias("symbol_id"), F.col(col).cast("long").alias("module_id"), (severity if severity is not None else F.lit(None).cast("string")).alias("own_severity"), message)
    value = text(F.col("kind"), F.col("value").cast("string"), F.lit("over"), F.col("threshold").cast("string"))
    parts = [
        sym(a.indicators, "symbol_id", text(F.col("kind"), F.col("name"))),
        sym(a.flags.filter("target_kind = 'Symbol'"), "target_id", value),
        mod(a.flags.filter("target_kind = 'Module'"), "target_id", value),
        mod(a.structural.filter("kind <> 'CyclicCrateDependency'").withColumn("m", F.col("members")[0]), "m", text(F.col("description")), F.col("severity")),
        mod(a.structural.filter("kind = 'CyclicCrateDependency'").withColumn("m", none), "m", text(F.col("description")), F.col("severity")),
        sym(calls_in_loops(a.called, parsed.cfg_nodes), "function_id", text(F.col("name"), F.lit("in a loop")), F.col("rule_id")),
        sym(locks_across_await(parsed.symbols, a.called, parsed.cfg_nodes, parsed.cfg_edges), "function_id", text(F.lit("a lock may be held across an await")), F.lit("resource/lock/held-across-await").alias("rule_id")),
        sym(uncommitted(a.called, a.calls), "symbol_id", text(F.lit("a transaction is neither committed nor rolled back")), F.lit("resource/transaction/uncommitted").alias("rule_id")),
    ]
    found = reduce(DataFrame.unionByName, parts).join(F.broadcast(catalog(spark).select("rule_id", "category", F.col("severity").alias("usual"))), "rule_id", "left")
    files = project.files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    places = parsed.symbols.select(F.col("id").alias("symbol_id"), "file_id", F.col("start_line").cast("long").alias("line")).join(files, "file_id").drop("file_id")
    homes = project.modules.select(F.col("id").alias("module_id"), F.col("file_path").alias("module_file"))
    found = found.join(places, "symbol_id", "left").join(homes, "module_id", "left")
    out = found.select("rule_id", F.coalesce("category", F.lit("Quality")).alias("category"), F.coalesce("own_severity", "usual", F.lit("Info")).alias("severity"), F.coalesce("file", "module_file").alias("file"), F.coalesce("line", F.lit(1)).cast("long").alias("line"), "symbol_id", "module_id", "message")
    errors = parsed.errors.select(F.lit("quality/parse/error").alias("rule_id"), F.lit("Quality").alias("category"), F.lit("Info").alias("severity"), F.col("file_path").alias("file"), F.col("line").cast("long").alias("line"), none.alias("symbol_id"), none.alias("module_id"), "message")
    return out.unionByName(errors)
