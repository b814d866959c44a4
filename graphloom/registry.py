"""All queries of the library itself, each over the model tables of ``plans.binding``, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import expressions as fx
from graphloom.operators import analysis, build, diff, graph, metrics, passes, reports, rules, sinks, views
from graphloom.plans import generated
from graphloom.plans.binding import bind, with_model
from graphloom.plans.shared import materialize
from graphloom.sources import parse, project

_QUERIES: dict = {}
_SQL: dict = {}

#: Node pairs along directed paths, for the SQL counterparts.
_CLOSURE = "with recursive reach(root, node) as (select src, dst from {e} union select root, dst from reach join {e} on node = src) "


def query(*tables: str, sql: str | None = None):
    """Register ``f(*model tables)``; its SQL sees the same tables."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(*bind(spark, sf_dir, *tables))
        if sql:
            _SQL[f.__name__] = with_model(sql)
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


_LINES = "case when end_line >= start_line then end_line - start_line + 1 else 1 end"


@query("files", sql="select id, path, sha256(coalesce(text, '')) as hash, cast(case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + case when text like '%' || chr(10) then 0 else 1 end end as bigint) as line_count from files")
def s10_fingerprints(files):
    return project.fingerprints(files)


@query("files", sql="select path, count(*) as lines from (select path, unnest(string_split(text, chr(10))) as line from files) where length(line) > 0 group by path")
def s14_source_lines(files):
    return files.select("path", F.explode(F.split("text", "\n")).alias("line")).filter("length(line) > 0").groupBy("path").agg(F.count("*").alias("lines"))


@query("symbols", sql=f"select id as symbol_id, cast({_LINES} as bigint) as line_count from symbols")
def e01_line_count(symbols):
    return symbols.select(F.col("id").alias("symbol_id"), metrics.line_count().alias("line_count"))


@query("symbols", sql="select id as symbol_id, cast(case when id % 3 = 0 then 0 when id % 3 = 1 then 2 else 1 end as bigint) as parameters from symbols")
def e02_parameter_count(symbols):
    sig = F.when(F.col("id") % 3 == 0, F.lit("fn f()")).when(F.col("id") % 3 == 1, F.concat(F.lit("fn f(a: Map<"), "kind", F.lit(", u8>, b: (u8, u8)) -> T"))).otherwise(F.concat(F.lit("fn f(x: "), "name", F.lit(")")))
    return symbols.select(F.col("id").alias("symbol_id"), metrics.parameter_count(sig).alias("parameters"))


@query("symbols", "modules", sql="select s.id as symbol_id, coalesce(m.path || '::' || s.name, s.name) as qualified from symbols s left join (select * from modules where id % 5 <> 0) m on m.id = s.module_id")
def e03_qualified_name(symbols, modules):
    m = modules.filter("id % 5 <> 0").select(F.col("id").alias("module_id"), "path")
    return symbols.join(m, "module_id", "left").select(F.col("id").alias("symbol_id"), F.coalesce(F.concat("path", F.lit("::"), "name"), "name").alias("qualified"))


@query("symbols", "call_edges", sql="select s.id as symbol_id, coalesce(i.n, 0) as fan_in, coalesce(o.n, 0) as fan_out from symbols s left join (select dst, count(distinct src) as n from call_edges group by dst) i on i.dst = s.id left join (select src, count(distinct dst) as n from call_edges group by src) o on o.src = s.id")
def a01_symbol_fans(symbols, calls):
    return metrics.fans(symbols, calls)


_MODULE_METRICS = f"""with b as (select a.module_id as sm, d.module_id as dm, count(*) as n from call_edges c join symbols a on a.id = c.src join symbols d on d.id = c.dst group by 1, 2),
w as (select module_id, count(*) as symbol_count, sum({_LINES}) as line_count, sum(case when visibility = 'Public' then 1 else 0 end) as pub from symbols group by 1),
i as (select dm, count(*) as n from b where sm <> dm group by 1), o as (select sm, count(*) as n from b where sm <> dm group by 1),
r as (select sm, sum(n) as refs, sum(case when sm = dm then n else 0 end) as internal from b group by 1)
select m.id as module_id, cast(coalesce(symbol_count, 0) as bigint) as symbol_count, cast(coalesce(line_count, 0) as bigint) as line_count, cast(coalesce(i.n, 0) as bigint) as fan_in, cast(coalesce(o.n, 0) as bigint) as fan_out,
round(coalesce(coalesce(o.n, 0) / cast(nullif(coalesce(i.n, 0) + coalesce(o.n, 0), 0) as double), 0.0), 6) as instability,
round(coalesce(cast(internal as double) / cast(nullif(refs, 0) as double), 1.0), 6) as cohesion, cast(coalesce(i.n, 0) + coalesce(o.n, 0) as double) as coupling_score,
round(coalesce(cast(pub as double) / cast(symbol_count as double), 0.0), 6) as api_surface_ratio
from modules m left join w on w.module_id = m.id left join i on i.dm = m.id left join o on o.sm = m.id left join r on r.sm = m.id"""


@query("modules", "symbols", "call_edges", sql=_MODULE_METRICS)
def module_metrics(modules, symbols, calls):
    return metrics.module_metrics(modules, symbols, calls)


@query("symbols", "call_edges", sql="select s.id as symbol_id, cast(coalesce(len(c.ids), 0) as bigint) as n, cast(coalesce(list_sum(c.ids), 0) as bigint) as total from symbols s left join (select dst, list(distinct src) as ids from call_edges group by dst) c on c.dst = s.id where kind in ('Function', 'Method')")
def a10_callers(symbols, calls):
    ids = build.adjacency(symbols, calls)
    return ids.select("symbol_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("crates", "modules", "symbols", "files", sql="""select cast(c.n as bigint) as crates, cast(c.l as bigint) as libraries, cast(m.n as bigint) as modules, cast(s.n as bigint) as symbols, cast(s.f as bigint) as functions, cast(s.st as bigint) as structs, cast(s.tr as bigint) as traits, cast(s.u as bigint) as unsafe, cast(f.n as bigint) as files, cast(f.t as bigint) as total_lines
from (select count(*) as n, sum(case when crate_type = 'Library' then 1 else 0 end) as l from crates) c, (select count(*) as n from modules) m,
(select count(*) as n, sum(case when kind in ('Function', 'Method') then 1 else 0 end) as f, sum(case when kind = 'Struct' then 1 else 0 end) as st, sum(case when kind = 'Trait' then 1 else 0 end) as tr, sum(case when is_unsafe or has_unsafe_block then 1 else 0 end) as u from symbols) s,
(select count(*) as n, sum(case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + case when text like '%' || chr(10) then 0 else 1 end end) as t from files) f""")
def a14_overview(crates, modules, symbols, files):
    return views.overview(crates, modules, symbols, project.fingerprints(files))


@query("module_edges", sql="select least(src, dst) as a, greatest(src, dst) as b, count(*) as n from module_edges group by 1, 2")
def a17_parallel_edges(edges):
    return views.parallel_edges(edges)


@query("crates", "modules", "symbols", sql="""select 'Crate' as src_kind, cast(crate_id as bigint) as src_id, 'Module' as dst_kind, cast(id as bigint) as dst_id, 'Contains' as kind, cast(2 as double) as weight from modules where parent is null
union all select 'Module', parent, 'Module', id, 'Contains', 2 from modules where parent is not null
union all select 'Module', case when module_id % 5 = 0 then -1 else module_id end, 'Symbol', id, 'Contains', 2 from symbols""")
def j01_contains_edges(crates, modules, symbols):
    lost = symbols.withColumn("module_id", F.when(F.col("module_id") % 5 == 0, 1000).otherwise(F.col("module_id")))
    return build.with_weights(build.contains_edges(crates, modules, lost))


# modules as a binary tree by their ids, names that some symbols share, and every eleventh symbol imported elsewhere
@query("symbols", sql="""with recursive up(module_id, ancestor) as (select distinct module_id, cast(floor((module_id - 1) / 2) as bigint) from symbols where module_id > 0
  union select module_id, cast(floor((ancestor - 1) / 2) as bigint) from up where ancestor > 0),
n as (select cast(floor(count(*) / 40) as bigint) + 1 as names from symbols),
s as (select id, concat(kind, '_', cast((id * 7) % names as varchar)) as name, module_id, visibility from symbols, n),
r as (select id as ref_id, (module_id + id) % 25 as module_id, concat(kind, '_', cast((id * 3) % (names + 9) as varchar)) as name from symbols, n),
i as (select (module_id + 7) % 25 as module_id, name, id from s where id % 11 = 3),
h as (select ref_id, s.id as target, 1 as tier from r join s on s.module_id = r.module_id and s.name = r.name
union select ref_id, i.id, 2 from r join i on i.module_id = r.module_id and i.name = r.name
union select ref_id, s.id, 3 from r join up on up.module_id = r.module_id join s on s.module_id = up.ancestor and s.name = r.name where s.visibility <> 'Private'
union select ref_id, s.id, 4 from r join s on s.name = r.name),
b as (select ref_id, min(tier) as tier from h group by 1)
select r.ref_id, cast(coalesce(h.target, -1) as bigint) as target, cast(coalesce(h.tier, 0) as bigint) as tier from r left join b on b.ref_id = r.ref_id left join h on h.ref_id = b.ref_id and h.tier = b.tier""")
def j11_name_resolution(symbols):
    names = symbols.agg((F.floor(F.count("*") / 40) + 1).alias("names"))  # one row
    s = symbols.join(F.broadcast(names))
    named = lambda n: F.concat("kind", F.lit("_"), n.cast("string")).alias("name")
    defs = s.select("id", named(F.col("id") * 7 % F.col("names")), "module_id", "visibility")
    refs = s.select(F.col("id").alias("ref_id"), ((F.col("module_id") + F.col("id")) % 25).alias("module_id"), named(F.col("id") * 3 % (F.col("names") + 9)))
    used = defs.filter("id % 11 = 3").select(((F.col("module_id") + 7) % 25).alias("module_id"), "name", F.col("id").alias("symbol_id"))
    tree = symbols.select(F.col("module_id").alias("id")).distinct().withColumn("parent", F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 2)))
    return build.resolve(refs, defs, used, parse.ancestors(tree))


@query("crates", sql="""select 'Crate' as src_kind, cast(a.id as bigint) as src_id, 'Crate' as dst_kind, cast(b.id as bigint) as dst_id, 'DependsOn' as kind
from crates a join crates b on b.id in ((a.id + 1) % 5, (a.id + 3) % 5) where a.id <> b.id and b.name not like '% %'""")
def j05_depends_on(crates):
    c = crates.withColumn("name", F.translate("name", "-", "_"))
    names = c.select(F.col("id").alias("k"), F.translate("name", "_", "-").alias("dependency")).filter("dependency not like '% %'")
    deps = c.select(F.col("id").alias("crate_id"), F.explode(F.array((F.col("id") + 1) % 5, (F.col("id") + 3) % 5)).alias("k"))
    return build.depends_on_edges(c, deps.join(names, "k").select("crate_id", "dependency"))


@query("model_edges", sql=_CLOSURE.format(e="model_edges") + "select root, node from reach where root between -99 and -1")
def g03_descendants(edges):
    return graph.descendants(edges, edges.filter("src between -99 and -1").select(F.col("src").alias("node")))


@query("model_edges", sql=_CLOSURE.format(e="model_edges") + "select node as root, root as node from reach where node > 0 and node % 2 = 1")
def g04_ancestors(edges):
    return graph.ancestors(edges, edges.filter("dst > 0 and dst % 2 = 1").select(F.col("dst").alias("node")))


@query("model_edges", sql=_CLOSURE.format(e="model_edges") + ", k as (select node from reach where root in (-2, -4) union select -2 union select -4) select src, dst from model_edges where src in (select node from k) and dst in (select node from k)")
def g05_reachable_subgraph(edges):
    return graph.reachable_subgraph(edges, edges.filter("src in (-2, -4)").select(F.col("src").alias("node")))


@query("model_edges", "modules", sql="""with g as (select src as crate, dst as module from model_edges where src between -99 and -1), m as (select crate, min(module) as component from g group by crate)
select crate as node, component from m union all select module, component from g join m using (crate) union all select dst, component from model_edges join g on src = module join m using (crate)""")
def g06_components(edges, modules):
    return graph.connected_components(edges.filter("src < 0"))


@query("module_edges", sql=_CLOSURE.format(e="module_edges") + ", m as (select x.root, x.node from reach x join reach y on x.root = y.node and x.node = y.root where x.root <> x.node) select root as node, greatest(root, max(node)) as component from m group by root")
def g07_cycles(edges):
    return graph.strongly_connected(edges)


@query("model_edges", sql="with l as (select src as node, 0 as layer from model_edges where src between -99 and -1 union select dst, case when dst < 0 then 1 when dst % 2 = 0 then 2 else 3 end from model_edges) select node, cast(row_number() over (order by layer, node) - 1 as bigint) as position from l")
def g08_topological_order(edges):
    return graph.topological_order(edges)


@query("symbols", "call_edges", sql="select s.id as node, cast(coalesce(n, 0) as bigint) as degree from symbols s left join (select node, count(*) as n from (select src as node from call_edges union all select dst from call_edges) group by node) d on d.node = s.id")
def g09_degree_centrality(symbols, calls):
    return graph.degree_centrality(symbols.select(F.col("id").alias("node")), calls)


@query("module_edges", sql="with u as (select src as a, dst as b from module_edges union select dst, src from module_edges), h1 as (select 7 as n union select b from u where a = 7), h2 as (select n from h1 union select b from u join h1 on a = n) select 7 as root, n as node from h2")
def g10_neighborhood(edges):
    return graph.neighborhood(edges, edges.select(F.lit(7).alias("node")).limit(1), 2)


@query("module_edges", sql="with recursive p(path, last) as (select [cast(0 as bigint)], 0 union all select list_append(path, cast(dst as bigint)), dst from p join module_edges on src = last where (last <> 9 or len(path) = 1) and len(path) <= 5 and (dst = 9 or not list_contains(path, dst))) select array_to_string(path, '>') as path from p where last = 9 and len(path) > 1")
def g02_simple_paths(edges):
    return graph.simple_paths(edges, 0, 9, 5).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("symbols", "modules", "call_edges", sql="""with n as (select s.id, s.name, coalesce(concat(m.path, '::', s.name), s.name) as q, s.is_unsafe, s.has_unsafe_block, s.is_extern from symbols s left join modules m on m.id = s.module_id)
select 'UnsafeFunction' as kind, id as symbol_id, cast(null as varchar) as name from n where is_unsafe union all select 'UnsafeBlock', id, null from n where has_unsafe_block union all select 'FfiCall', id, null from n where is_extern
union all select case when q like 'ASIA::%' then 'FilesystemAccess' else 'NetworkAccess' end, c.src, q from call_edges c join n on n.id = c.dst where q like 'ASIA::%' or q like 'EUROPE::NATION_1%'""")
def d07_security_indicators(symbols, modules, calls):
    return rules.security_indicators(symbols, modules, calls, {"FilesystemAccess": ["ASIA::"], "NetworkAccess": ["EUROPE::NATION_1"]})


@query("symbols", "modules", "call_edges", sql="""with c as (select * from call_edges where dst % 5 <> 0),
r as (select id, 'test' as rule from symbols where is_test union select id, 'no_callers' from symbols where kind = 'Function' and id not in (select dst from c))
select id as symbol_id, string_agg(rule, ',' order by rule) as rules from r group by id""")
def d14_entrypoints(symbols, modules, calls):
    return rules.entrypoints(symbols, modules, calls.filter("dst % 5 <> 0"))


@query("modules", "symbols", "call_edges", sql=_MODULE_METRICS.replace("with b as", "with b as", 1).replace("select m.id as module_id", ", mm as (select m.id as module_id", 1) + f""")
select 'Symbol' as target_kind, cast(id as bigint) as target_id, 'LargeFunction' as kind, cast({_LINES} as bigint) as value, cast(100 as bigint) as threshold from symbols where {_LINES} > 100
union all select 'Module', module_id, 'LargeModule', symbol_count, 55 from mm where symbol_count > 55
union all select 'Module', module_id, 'HighFanIn', fan_in, 20 from mm where fan_in > 20 union all select 'Module', module_id, 'HighFanOut', fan_out, 15 from mm where fan_out > 15""")
def d20_complexity_flags(modules, symbols, calls):
    return metrics.complexity_flags(metrics.symbol_metrics(symbols, calls), metrics.module_metrics(modules, symbols, calls), {"LargeModule": 55})


@query("modules", "symbols", "call_edges", "module_edges", sql=_MODULE_METRICS.replace("with b as", "with recursive b as", 1).replace("select m.id as module_id", ", mm as (select m.id as module_id", 1) + """),
ce as (select distinct a.crate_id as src, b.crate_id as dst from module_edges join modules a on a.id = src join modules b on b.id = dst where a.crate_id <> b.crate_id),
r1(root, node) as (select src, dst from module_edges union select root, dst from r1 join module_edges on node = src), r2(root, node) as (select src, dst from ce union select root, dst from r2 join ce on node = src),
c1 as (select x.root, greatest(x.root, max(x.node)) as component from r1 x join r1 y on x.root = y.node and x.node = y.root where x.root <> x.node group by x.root),
c2 as (select x.root, greatest(x.root, max(x.node)) as component from r2 x join r2 y on x.root = y.node and x.node = y.root where x.root <> x.node group by x.root)
select 'CyclicModuleDependency' as kind, case when count(*) >= 3 then 'High' else 'Medium' end as severity, string_agg(cast(root as varchar), ',' order by root) as members, 'cycle of ' || count(*) || ' modules' as description from c1 group by component
union all select 'CyclicCrateDependency', 'Critical', string_agg(cast(root as varchar), ',' order by root), 'cycle of ' || count(*) || ' crates' from c2 group by component
union all select 'GodModule', 'Medium', cast(module_id as varchar), printf('%d symbols, coupling %.1f', symbol_count, coupling_score) from mm where symbol_count > 5 and coupling_score > 20
union all select 'ExcessiveApiSurface', 'Low', cast(module_id as varchar), printf('%d%% of %d symbols are public', cast(round(api_surface_ratio * 100) as bigint), symbol_count) from mm where symbol_count >= 3 and api_surface_ratio > 0.5""")
def d24_structural_findings(modules, symbols, calls, edges):
    crate = lambda c: modules.select(F.col("id").alias(c), F.col("crate_id").alias(c + "_crate"))
    lifted = edges.join(crate("src"), "src").join(crate("dst"), "dst").select(F.col("src_crate").alias("src"), F.col("dst_crate").alias("dst")).distinct()
    found = rules.structural_findings(metrics.module_metrics(modules, symbols, calls), edges, 5, 20.0, 0.5, lifted)
    return found.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))



@query("symbols", "call_edges", sql="select c.src, c.dst from call_edges c join symbols a on a.id = c.src join symbols b on b.id = c.dst where a.kind <> 'Trait' and b.kind <> 'Trait' and not a.is_test and not b.is_test and a.visibility <> 'Private' and b.visibility <> 'Private'")
def f09_visible_edges(symbols, calls):
    return views.visible_edges(calls, views.visible_nodes(symbols, ["Trait"], ["Private"])).select("src", "dst")


@query("files", sql="""with b as (select path, case when id % 7 = 0 then 'x' else sha256(coalesce(text, '')) end as old from files where id % 10 <> 0), c as (select path, sha256(coalesce(text, '')) as new from files where id % 11 <> 0)
select coalesce(b.path, c.path) as path, case when old is null then 'added' when new is null then 'removed' when old <> new then 'modified' else 'unchanged' end as status from b full join c on b.path = c.path""")
def x50_change_set(files):
    f = project.fingerprints(files)
    old = f.filter("id % 10 <> 0").select("path", F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return diff.change_set(old, f.filter("id % 11 <> 0").select("path", "hash"))


@query("files", sql="""with b as (select id % 50 as rule, id % 9 as loc, id % 3 as line from files where id % 4 <> 0), c as (select id % 50 as rule, id % 9 as loc, id % 3 + 1 as line from files where id % 6 <> 0),
lc as (select * from c where not exists (select 1 from b where b.rule = c.rule and b.loc = c.loc and b.line = c.line)), lb as (select * from b where not exists (select 1 from c where b.rule = c.rule and b.loc = c.loc and b.line = c.line)),
u as (select c.*, 'unchanged' as state from c where exists (select 1 from b where b.rule = c.rule and b.loc = c.loc and b.line = c.line)
union all select lc.*, case when exists (select 1 from lb where lb.rule = lc.rule and lb.loc = lc.loc) then 'unchanged' else 'new' end from lc
union all select lb.*, 'fixed' from lb where not exists (select 1 from lc where lb.rule = lc.rule and lb.loc = lc.loc))
select state, count(*) as n from u group by state""")
def x52_regression(files):
    old = files.filter("id % 4 <> 0").select((F.col("id") % 50).alias("rule"), (F.col("id") % 9).alias("loc"), (F.col("id") % 3).alias("line"))
    new = files.filter("id % 6 <> 0").select((F.col("id") % 50).alias("rule"), (F.col("id") % 9).alias("loc"), (F.col("id") % 3 + 1).alias("line"))
    return diff.regression(old, new, ["rule", "loc", "line"], ["rule", "loc"]).groupBy("state").agg(F.count("*").alias("n"))


@query("symbols", "call_edges", sql="""with t as (select s.id as symbol_id, cast(s.id % 5 + coalesce(c, 0) as double) as total from symbols s left join (select src, sum(dst % 5) as c from call_edges group by src) e on e.src = s.id)
select symbol_id, total, case when total > 100 then 'Critical' when total > 50 then 'High' when total > 20 then 'Medium' else 'Low' end as severity from (select *, row_number() over (order by total desc, symbol_id) as r from t) x where r <= 20""")
def x19_hotspots(symbols, calls):
    costs = passes.total_costs(calls, symbols.select(F.col("id").alias("node"), (F.col("id") % 5).cast("double").alias("cost")))
    return views.hotspots(costs.withColumnRenamed("node", "symbol_id"), "total").withColumn("severity", reports.hotspot_severity(F.col("total")))



@query("model_edges", "model_nodes", sql="""with recursive p(path, last) as (select [cast(node as bigint)], node from model_nodes where node between -99 and -1
union all select list_append(path, cast(dst as bigint)), dst from p join model_edges on src = last where len(path) <= 6 and (len(path) = 1 or last % 7 not in (3, 6))),
f as (select path, len(path) - 1 as n from p where len(path) > 1 and last % 7 in (3, 6)),
i as (select x.path, max(case when regexp_matches(name, '[258]$') and not regexp_matches(name, '[28]$') then 1 else 0 end) as clean, max(case when regexp_matches(name, '[28]$') then 1 else 0 end) as weak from (select path, unnest(path[2:len(path) - 1]) as node from f) x join model_nodes m on m.node = x.node group by x.path)
select array_to_string(f.path, '>') as path, cast(n as bigint) as n_edges, case when coalesce(weak, 0) = 1 then 'Medium' else 'High' end as severity,
case (case when n > 5 then 1 else 0 end) + coalesce(weak, 0) when 0 then 'High' when 1 then 'Medium' else 'Low' end as confidence from f left join i on i.path = f.path where coalesce(clean, 0) = 0""")
def x08_taint_paths(edges, names):
    found = passes.paths_between(edges, names.filter("node between -99 and -1"), names.filter("node % 7 in (3, 6)"), 6)
    out = passes.taint_findings(found, names, "[258]$", "[28]$")
    return out.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query("model_edges", "model_nodes", sql=_CLOSURE.format(e="model_edges") + """select m.node, case when node < 0 then 'High' else 'Medium' end as severity from model_nodes m
where node not in (select root from reach join model_nodes g on g.node = reach.node where root <> reach.node and regexp_matches(g.name, '(11|17)$'))""")
def x12_missing_guards(edges, names):
    return passes.missing_guards(edges, names.select("node", (F.col("node") < 0).alias("external")), names, "(11|17)$")


@query("model_edges", "model_nodes", sql="""with recursive g as (select node from model_nodes where regexp_matches(name, '[13]$')), e as (select src, dst from model_edges where src not in (select node from g) and dst not in (select node from g)),
reach(root, node) as (select src, dst from e union select root, dst from reach join e on node = src)
select root, m.node from reach join model_nodes m on m.node = reach.node where root < 0 and regexp_matches(name, '[0269]$')""")
def x13_unguarded_operations(edges, names):
    return passes.unguarded_operations(edges, names.filter("node < 0").select("node"), names, "[13]$", "[0269]$")


@query("symbols", "modules", "call_edges", sql="""with n as (select s.id, coalesce(concat(m.path, '::', s.name), s.name) as q from symbols s left join modules m on m.id = s.module_id),
k as (select id, case when q like 'ASIA::%' then 'DbQuery' when q like '%1' then 'Lock' end as t from n)
select src as node, t as cost_type, cast(sum(case t when 'DbQuery' then 10 else 2 end) as double) as cost from call_edges join k on k.id = dst where t is not null group by 1, 2""")
def x15_direct_costs(symbols, modules, calls):
    paths = modules.select(F.col("id").alias("module_id"), "path")
    names = symbols.join(paths, "module_id", "left").select(F.col("id").alias("node"), F.coalesce(F.concat("path", F.lit("::"), "name"), "name").alias("name"))
    return passes.direct_costs(calls, names, {"DbQuery": "^ASIA::", "Lock": "1$"})


@query("model_edges", sql="""with recursive n as (select src as node from model_edges union select dst from model_edges),
p(root, node) as (select node, node from n union all select root, dst from p join model_edges on src = node)
select root as node, cast(sum(abs(node) % 7) as double) as total from p group by root""")
def x17_total_costs(edges):
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return passes.total_costs(edges, nodes.select("node", (F.abs("node") % 7).cast("double").alias("cost")))


@query("module_edges", "modules", sql="""with l as (select id, case when path like 'AFRICA%' or path like 'AMERICA%' then 0 when path like 'ASIA%' then 1 when path like 'EUROPE%' then 2 end as layer from modules)
select src, dst, a.layer as src_layer, b.layer as dst_layer from module_edges join l a on a.id = src join l b on b.id = dst where b.layer < a.layer""")
def x20_layer_violations(edges, modules):
    return passes.layer_violations(edges, modules, [["AFRICA", "AMERICA"], ["ASIA"], ["EUROPE"]])


@query("modules", "symbols", "call_edges", sql=_MODULE_METRICS.replace("select m.id as module_id", ", mm as (select m.id as module_id", 1) + ") select module_id from mm where symbol_count >= 60 and coupling_score >= 30 or fan_out >= 25 or cohesion < 0.04")
def x21_god_modules(modules, symbols, calls):
    return passes.god_modules(metrics.module_metrics(modules, symbols, calls), 60, 30.0, 25, 0.04)


@query("model_edges", "model_nodes", sql=_CLOSURE.format(e="model_edges") + "select node, case when node in (-2, -4) or node in (select node from reach where root in (-2, -4)) then 'Public' else 'Internal' end as reachability from model_nodes")
def x30_reachability(edges, names):
    return passes.reachability(names, edges, names.filter("node in (-2, -4)"))


@query("symbols", "call_edges", sql="""with f as (select s.id, case when id % 3 = 0 then 'security/taint/ssrf' when id % 3 = 1 then 'quality/complexity/large' else 'other' end as rule_id, case when is_unsafe then 'Critical' else 'Low' end as severity, case when is_test then 'Low' else 'High' end as confidence,
case when visibility = 'Public' then 'Public' else 'Internal' end as r, coalesce(n, 0) as fan_in from symbols s left join (select dst, count(distinct src) as n from call_edges group by dst) i on i.dst = s.id)
select id, round(100 * (case r when 'Public' then 0.25 else 0.125 end + 0.2 * case id % 3 when 0 then 0.8 when 1 then 0.2 else 0 end + 0.15 * least(1, (id % 90) / 50.0) + 0.15 * least(1, fan_in / 20.0) + 0.15 * case confidence when 'Low' then 0.3 else 1 end + 0.1 * case severity when 'Critical' then 1 else 0.3 end), 2) as score from f""")
def x31_scores(symbols, calls):
    fans = metrics.fans(symbols, calls).select(F.col("symbol_id").alias("id"), "fan_in")
    rule = F.when(F.col("id") % 3 == 0, "security/taint/ssrf").when(F.col("id") % 3 == 1, "quality/complexity/large").otherwise("other")
    found = symbols.select("id", rule.alias("rule_id"), F.when(F.col("is_unsafe"), "Critical").otherwise("Low").alias("severity"), F.when(F.col("is_test"), "Low").otherwise("High").alias("confidence"), F.when(F.col("visibility") == "Public", "Public").otherwise("Internal").alias("reachability"), (F.col("id") % 90).alias("total_cost"))
    return passes.factor_scores(found.join(fans, "id")).select("id", F.round(rules.total_score(), 2).alias("score"))


@query("symbols", sql=f"""select 'quality/size/long' as rule_id, 'Medium' as severity, id as target from symbols where {_LINES} > 100
union all select 'security/name/supplier', 'Low', id from symbols where name like 'Supplier%' union all select 'style/name/nine', 'Info', id from symbols where regexp_matches(name, '9$')""")
def x35_rules(symbols):
    found = passes.RuleRegistry(
        [
            {"id": "quality/size/long", "category": "Quality", "severity": "Medium", "field": "line_count", "op": "Gt", "value": 100},
            {"id": "security/name/supplier", "category": "Security", "severity": "Low", "field": "name", "op": "Prefix", "value": "Supplier"},
            {"id": "style/name/nine", "category": "Style", "severity": "Info", "field": "name", "op": "Regex", "value": "9$"},
            {"id": "style/name/all", "category": "Style", "severity": "Info", "field": "name", "op": "Contains", "value": ""},
        ]
    )
    found.set_enabled("style/name/all", False)
    lines = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))
    return found.evaluate(symbols.withColumn("line_count", lines), "id")


_FINDINGS = f"""f as (select id, case when id % 3 = 0 then 'security/taint/a&b' when id % 3 = 1 then 'quality/size/long' else 'style/name' end as rule_id,
case when is_unsafe then 'High' when id % 2 = 0 then 'Medium' else 'Low' end as severity, concat('src/', name, '.rs') as file, cast(start_line as bigint) as line, concat(kind, ' <', name, '>') as message from symbols)"""


def _findings(symbols):
    rule = F.when(F.col("id") % 3 == 0, "security/taint/a&b").when(F.col("id") % 3 == 1, "quality/size/long").otherwise("style/name")
    severity = F.when(F.col("is_unsafe"), "High").when(F.col("id") % 2 == 0, "Medium").otherwise("Low")
    return symbols.select(rule.alias("rule_id"), severity.alias("severity"), F.concat(F.lit("src/"), "name", F.lit(".rs")).alias("file"), F.col("start_line").alias("line"), F.concat("kind", F.lit(" <"), "name", F.lit(">")).alias("message"))


@query("symbols", sql=f"""with {_FINDINGS} select concat('{{"ruleId":"', rule_id, '","level":"', case severity when 'High' then 'error' when 'Medium' then 'warning' else 'note' end, '","message":{{"text":"', message, '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"', file, '"}},"region":{{"startLine":', line, '}}}}}}]}}') as result from f""")
def k07_sarif_results(symbols):
    return reports.sarif_results(_findings(symbols))


@query("symbols", sql=f"""with {_FINDINGS} select string_split(rule_id, '/')[1] as suite, count(*) as tests, cast(sum(case when severity <> 'Low' then 1 else 0 end) as bigint) as failures from f group by 1""")
def k08_junit_suites(symbols):
    return reports.junit_suites(reports.junit_cases(_findings(symbols)))


@query("symbols", sql=f"""with {_FINDINGS} select string_split(rule_id, '/')[1] as suite, severity <> 'Low' as failed, concat('<testcase classname="', replace(rule_id, '&', '&amp;'), '" name="', file, ':', line, '"',
case when severity <> 'Low' then concat('><failure message="', replace(replace(message, '<', '&lt;'), '>', '&gt;'), '"/></testcase>') else '/>' end) as xml from f""")
def k08_junit_cases(symbols):
    return reports.junit_cases(_findings(symbols))


@query("symbols", sql=f"with {_FINDINGS} select concat('::warning file=', file, ',line=', line, '::', message) as annotation from f")
def k09_annotations(symbols):
    return reports.annotations(_findings(symbols))


@query("symbols", sql="""with p as (select cast(id % 97 as double) as x, cast(id % 53 as double) * 8 as y from symbols), b as (select min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from p),
z as (select *, least(greatest(least(680.0 / greatest(hx - lx, 1), 480.0 / greatest(hy - ly, 1)), 0.15), 2.0) as zoom from b)
select round(cast(zoom as double), 6) as zoom, round(cast(400 - (lx + hx) / 2 * zoom as double), 6) as pan_x, round(cast(300 - (ly + hy) / 2 * zoom as double), 6) as pan_y from z""")
def u12_auto_fit(symbols):
    points = symbols.select((F.col("id") % 97).cast("double").alias("x"), ((F.col("id") % 53).cast("double") * 8).alias("y"))
    return views.auto_fit(points, 800.0, 600.0).select(*(F.round(c, 6).alias(c) for c in ("zoom", "pan_x", "pan_y")))


@query("symbols", sql="select id from symbols where sqrt(power(id % 97 - 40.0, 2) + power(id % 53 - 20.0, 2)) < 5 * 2.0 + 3")
def u11_hit_test(symbols):
    points = symbols.select("id", (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 53).cast("double").alias("y"), F.lit(5.0).alias("radius"))
    return views.hit_test(points, 40.0, 20.0, 2.0).select("id")


@query("modules", "symbols", "call_edges", sql=_MODULE_METRICS.replace("select m.id as module_id", ", mm as (select m.id as module_id", 1) + """), t as (select module_id, coupling_score, least(coupling_score / 25, 1.0) as t from mm)
select module_id, coupling_score, cast(floor(255 * t) as bigint) as r, cast(floor(100 * (1 - abs(2 * t - 1))) as bigint) as g, cast(floor(200 * (1 - t)) as bigint) as b from t""")
def u15_coupling_heatmap(modules, symbols, calls):
    return views.coupling_heatmap(modules, metrics.module_metrics(modules, symbols, calls))


# ---------------------------------------------------------------- sources, over text generated from the model

_HAS_BODY = "kind in ('Function', 'Method')"
_READ = f"(select * from symbols where not ({generated.BROKEN}))"


def _parsed(symbols, calls):
    files = materialize(generated.source_files(symbols, calls), "generated")
    return files, parse.parse(files, generated.owners(files))


@query("symbols", "call_edges", sql=f"""with r as (select *, row_number() over (partition by module_id order by id) as line from symbols), g as (select * from r where not ({generated.BROKEN}))
select cast(module_id as bigint) as file_id, {generated.NAME} as name, kind, case when visibility = 'Public' then 'Public' else 'Private' end as visibility, {generated.SIGNATURE} as signature, cast(line as bigint) as start_line,
  kind = 'Function' and is_unsafe or kind = 'Trait' as is_unsafe, kind = 'Function' and is_extern as is_extern, kind = 'Function' and is_test as is_test, kind in ('Function', 'Method') and has_unsafe_block as has_unsafe_block from g
union all select module_id, concat('impl Show for S', cast(id as varchar)), 'ImplBlock', 'Private', concat('impl Show for S', cast(id as varchar)), line, false, false, false, false from g where kind = 'Method'""")
def v01_symbols(symbols, calls):
    """Every declaration of the generated files; files that can't be read give none."""
    s = _parsed(symbols, calls)[1].symbols
    return s.select("file_id", "name", "kind", "visibility", "signature", F.col("start_line").cast("long").alias("start_line"), "is_unsafe", "is_extern", "is_test", "has_unsafe_block")


@query("symbols", "call_edges", sql=f"""with g as (select *, {generated.NAME} as n, case when kind = 'Method' then concat('S', cast(id as varchar), '::') else '' end as owner from {_READ} x),
c as (select g.owner || g.n as source_name, t.n as target_name from call_edges e join g on g.id = e.src join (select id, {generated.NAME} as n from symbols) t on t.id = e.dst where {_HAS_BODY}
union all select owner || n, 'f' from g where {_HAS_BODY} and has_unsafe_block
union all select owner || n, unnest(case id % 3 when 0 then ['g', 'h'] when 1 then ['len'] else ['k', 'k'] end) from g where {_HAS_BODY})
select source_name, 'Calls' as kind, target_name, cast(count(*) as bigint) as n from c group by 1, 3
union all select concat('S', cast(id as varchar)), 'Implements', 'Show', 1 from g where kind = 'Method'""")
def v11_relationships(symbols, calls):
    """Calls and implementations by name, counted."""
    found = _parsed(symbols, calls)[1].extracted
    return found.groupBy("source_name", "kind", "target_name").agg(F.count("*").alias("n"))


@query("symbols", "call_edges", sql=f"""with g as (select *, {generated.NAME} as n from {_READ} x)
select a.n as source, b.n as target, cast(case when a.module_id = b.module_id then 1 else 4 end as bigint) as tier from call_edges e join g a on a.id = e.src join g b on b.id = e.dst where a.{_HAS_BODY}""")
def j14_resolved_calls(symbols, calls):
    """Calls of the generated files with both ends resolved to symbols, and the tier that did so."""
    p = _parsed(symbols, calls)[1]
    ends = p.symbols.select("id", "name")
    found = p.relationships.filter("kind = 'Calls' and tier > 0").join(ends.select(F.col("id").alias("source"), F.col("name").alias("a")), "source")
    return found.join(ends.select(F.col("id").alias("target"), F.col("name").alias("b")), "target").select(F.col("a").alias("source"), F.col("b").alias("target"), "tier")


@query("symbols", "call_edges", sql=f"""with g as (select *, {generated.NAME} as n, coalesce(m, 0) as calls from {_READ} x left join (select src, count(*) as m from call_edges group by 1) c on c.src = x.id where {_HAS_BODY})
select n as name, cast(case id % 3 when 0 then 3 else 2 + case when id % 3 = 1 then 1 else 0 end end as bigint) as cyclomatic_complexity,
cast(3 + calls + case when has_unsafe_block then 1 else 0 end + case id % 3 when 0 then 7 when 1 then 4 else 5 end as bigint) as nodes from g""")
def c15_complexity(symbols, calls):
    """Complexity and size of the control flow of every function of the generated files."""
    p = _parsed(symbols, calls)[1]
    size = p.cfg_nodes.groupBy("function_id").agg(F.count("*").alias("nodes"))
    named = p.symbols.select(F.col("id").alias("function_id"), "name")
    return metrics.cyclomatic_complexity(p.cfg_nodes, p.cfg_edges).join(size, "function_id").join(named, "function_id").select("name", "cyclomatic_complexity", "nodes")


@query("symbols", "call_edges", sql=f"select concat('src/m', cast(module_id as varchar), '.rs') as file_path, 'unclosed delimiter' as message, cast(count(*) + 1 as bigint) as line from symbols where {generated.BROKEN} group by module_id")
def s20_parse_errors(symbols, calls):
    return _parsed(symbols, calls)[1].errors.select("file_path", "message", F.col("line").cast("long").alias("line"))


# ---------------------------------------------------------------- labels, styles, filters, inspector tables


@query("symbols", "modules", sql="""select s.id, case when s.kind = 'Function' then 'fn ' || s.name else s.name end as label, split_part(m.path, '::', 2) as last, cast(len(string_split(m.path, '::')) as bigint) as segments,
format('{:,}', s.id * 1001) as shown, coalesce(case when s.kind = 'Trait' then regexp_extract(s.name || '/' || s.kind, '([^/]*)$', 1) when s.kind = 'Struct' then null else s.name end, '?') as node_label from symbols s join modules m on m.id = s.module_id""")
def e04_labels(symbols, modules):
    s = symbols.join(modules.select(F.col("id").alias("module_id"), "path"), "module_id")
    signature = F.when(F.col("kind") == "Function", F.concat(F.lit("fn "), "name"))
    shown = fx.node_label(F.when(F.col("kind") == "Trait", "File").otherwise("Symbol"), F.when(F.col("kind") != "Struct", F.col("name")), F.concat("name", F.lit("/"), "kind"))
    return s.select("id", fx.qualified_label(signature, F.col("name")).alias("label"), fx.last_segment(F.col("path")).alias("last"), F.size(fx.path_segments(F.col("path"))).cast("long").alias("segments"), fx.format_count(F.col("id") * 1001).alias("shown"), shown.alias("node_label"))


@query("symbols", sql="""select id, cast(least(case when is_test then 1.0 else 0.15 end, case when visibility = 'Public' then 1.0 else 0.12 end, 1.0, case when id % 4 = 0 then 1.0 else 0.2 end) as double) as alpha,
round(least(6.0, 1 + ln(greatest(cast(id % 900 as double), 1.0)) + case when is_unsafe then 1.0 else 0.0 end), 6) as width, round((60 + least(cast(id % 9 as double), 5.0) / 5 * 160) / 255, 6) as edge_alpha,
case visibility when 'Public' then 'pub ' else '' end as prefix from symbols""")
def e29_styles(symbols):
    alpha = fx.node_alpha(F.col("is_test"), F.col("visibility") == "Public", F.lit(True), F.col("id") % 4 == 0)
    width = fx.edge_width((F.col("id") % 900).cast("double"), F.col("is_unsafe"))
    return symbols.select("id", alpha.alias("alpha"), F.round(width, 6).alias("width"), F.round(fx.edge_alpha((F.col("id") % 9).cast("double")), 6).alias("edge_alpha"), fx.visibility_prefix(F.col("visibility")).alias("prefix"))


@query("symbols", "modules", "call_edges", sql=f"select id from symbols where (is_unsafe or has_unsafe_block) and {_LINES} > 100 and kind = 'Function' and id not in (select dst from call_edges)")
def f10_highlighted(symbols, modules, calls):
    flags = metrics.complexity_flags(metrics.symbol_metrics(symbols, calls), metrics.module_metrics(modules, symbols, calls))
    uncalled = rules.entrypoints(symbols, modules, calls).filter("rules like '%no_callers%'")
    return views.highlighted(symbols, uncalled, True, flags).select("id")


@query("modules", "symbols", sql="""with recursive h as (select id from modules where lower(name) like '%an%' union select module_id from symbols where lower(name) like '%0077%'),
up(id) as (select id from h union select parent from up join modules using (id) where parent is not null) select m.id, m.path from modules m join up using (id)""")
def f15_search_tree(modules, symbols):
    return views.search_tree(modules, symbols, "AN").select("id", "path").union(views.search_tree(modules, symbols, "0077").select("id", "path")).distinct()


@query("symbols", sql="select id, name from symbols where name like '%99%' order by id limit 1")
def f16_search_symbols(symbols):
    return views.search_symbols(symbols, "99").select("id", "name")


@query("symbols", "call_edges", sql="select node, cast(count(*) as bigint) as degree from (select src as node from call_edges union all select dst from call_edges) e group by node having count(*) >= 30")
def f18_min_degree(symbols, calls):
    return views.min_degree(graph.degree_centrality(symbols.select(F.col("id").alias("node")), calls), 30)


_MODEL_TABLES = """with n as (select 'Symbol' as node_kind, id as node_id from symbols union all select 'Module', id from modules),
e as (select 'Symbol' as src_kind, src as src_id, 'Symbol' as dst_kind, dst as dst_id, case when dst % 3 = 0 then 'References' else 'Calls' end as kind from call_edges
union all select 'Module', module_id, 'Symbol', id, 'Contains' from symbols) """


def _model_tables(symbols, modules, calls):
    nodes = symbols.select(F.lit("Symbol").alias("node_kind"), F.col("id").alias("node_id")).union(modules.select(F.lit("Module"), F.col("id").cast("long")))
    found = calls.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.when(F.col("dst") % 3 == 0, "References").otherwise("Calls").alias("kind"))
    lost = found.withColumn("target", F.lit(-1))
    edges = build.relationship_edges(found.union(found).union(lost), symbols)
    homes = symbols.select(F.lit("Module").alias("src_kind"), F.col("module_id").cast("long").alias("src_id"), F.lit("Symbol").alias("dst_kind"), F.col("id").alias("dst_id"), F.lit("Contains").alias("kind"))
    return nodes, edges.unionByName(homes), found


@query("symbols", "modules", "call_edges", sql=_MODEL_TABLES + "select src_kind, src_id, dst_kind, dst_id, kind from e")
def j04_relationship_edges(symbols, modules, calls):
    return _model_tables(symbols, modules, calls)[1]


@query("symbols", "modules", "call_edges", sql="select src, dst from call_edges where dst % 3 <> 0 and src in (select id from symbols where kind in ('Function', 'Method')) and dst in (select id from symbols where kind in ('Function', 'Method'))")
def j06_call_edges(symbols, modules, calls):
    return build.call_edges(_model_tables(symbols, modules, calls)[2], symbols)


@query("symbols", "modules", "call_edges", sql=_MODEL_TABLES + "select src_id, dst_id from e where kind = 'Calls' and src_id in (select id from symbols where kind in ('Function', 'Method')) and dst_id in (select id from symbols where kind in ('Function', 'Method'))")
def f11_call_flow_preset(symbols, modules, calls):
    nodes, edges, _ = _model_tables(symbols, modules, calls)
    return views.preset(nodes, edges, "Call Flow", symbols)[1].select("src_id", "dst_id")


@query("symbols", "modules", "call_edges", sql=_MODEL_TABLES + "select src_id, dst_id from e where kind in ('Contains', 'References') and src_kind = 'Symbol'")
def g13_projection(symbols, modules, calls):
    return build.project(_model_tables(symbols, modules, calls)[1], ["Contains", "References"], ["Symbol"]).select("src_id", "dst_id")


@query("module_edges", "modules", sql="with v as (select id from modules where id % 4 <> 0 or id = 7), u as (select src as a, dst as b from module_edges union select dst, src from module_edges), h1 as (select 7 as n union select b from u where a = 7 and b in (select id from v)), h2 as (select n from h1 union select b from u join h1 on a = n where b in (select id from v)) select cast(7 as bigint) as root, cast(n as bigint) as node from h2")
def g11_ego_set(edges, modules):
    start = modules.filter("id = 7").select(F.col("id").alias("node"))
    found = graph.neighborhood(edges, start, 2, modules.filter("id % 4 <> 0 or id = 7").select(F.col("id").alias("node")))
    return found.select(F.col("root").cast("long").alias("root"), F.col("node").cast("long").alias("node"))


@query("module_edges", sql="select src, dst, cast((row_number() over (partition by least(src, dst), greatest(src, dst) order by src, dst) - 1 - (count(*) over (partition by least(src, dst), greatest(src, dst)) - 1) / 2.0) * 12 as double) as \"offset\" from module_edges")
def w04_parallel_offsets(edges):
    return views.parallel_offsets(edges, ["src", "dst"]).withColumn("offset", F.col("offset").cast("double"))


@query("symbols", sql="select cast(floor((id % 997) / 50) as bigint) as cx, cast(floor((id % 613) / 50) as bigint) as cy, cast(count(*) as bigint) as n from symbols where floor((id % 997) / 50) between 2 and 9 and floor((id % 613) / 50) between 0 and 5 group by 1, 2")
def u10_spatial_grid(symbols):
    points = symbols.select(F.col("id").alias("node"), (F.col("id") % 997).cast("double").alias("x"), (F.col("id") % 613).cast("double").alias("y"))
    return views.spatial_grid(views.in_viewport(points, 120, 20, 480, 260))


@query("symbols", "modules", "call_edges", sql=f"""with c as (select dst as id, count(*) as n from call_edges group by dst), d as (select src as id, count(*) as n from call_edges group by src)
select s.id, m.path as module, cast({_LINES} as bigint) as line_count, case when {_LINES} > 100 then 'LargeFunction' else '' end as flags, cast(coalesce(c.n, 0) as bigint) as callers, cast(coalesce(d.n, 0) as bigint) as callees
from symbols s join modules m on m.id = s.module_id left join c on c.id = s.id left join d on d.id = s.id""")
def j22_symbol_cards(symbols, modules, calls):
    m = metrics.symbol_metrics(symbols, calls)
    cards = views.symbol_cards(symbols, modules, m, metrics.complexity_flags(m, metrics.module_metrics(modules, symbols, calls)), calls)
    return cards.select("id", "module", F.col("line_count").cast("long").alias("line_count"), F.array_join("flags", ",").alias("flags"), "callers", "callees")


@query("symbols", "modules", "call_edges", sql="""with k as (select module_id, count(*) as n, sum(case when kind = 'Trait' then 1 else 0 end) as t from symbols group by 1), c as (select parent, count(*) as n from modules where parent is not null group by 1)
select m.id, p.path as parent_path, cast(coalesce(c.n, 0) as bigint) as children, cast(coalesce(k.t, 0) as bigint) as traits, cast(coalesce(k.n, 0) as bigint) as symbol_count from modules m left join modules p on p.id = m.parent left join c on c.parent = m.id left join k on k.module_id = m.id""")
def j23_module_cards(symbols, modules, calls):
    cards = views.module_cards(modules, symbols, metrics.module_metrics(modules, symbols, calls))
    return cards.select("id", "parent_path", F.col("children").cast("long").alias("children"), F.coalesce(F.element_at("symbols_by_kind", "Trait"), F.lit(0)).cast("long").alias("traits"), "symbol_count")


@query("modules", sql="""with o as (select *, row_number() over (partition by parent order by id, path) as k, count(*) over (partition by parent) as n from modules)
select crate_id, name as line from modules where parent is null union all select crate_id, case when k = n then '└── ' else '├── ' end || name from o where parent is not null""")
def k03_tree(modules):
    return sinks.tree_lines(modules.withColumn("ord", F.col("id"))).select("crate_id", "line")


@query("symbols", sql="""with f as (select case when is_unsafe then 'High' else 'Low' end as severity, kind as category from symbols)
select 'total' as "by", '' as value, cast(count(*) as bigint) as n from f union all select 'severity', severity, count(*) from f group by severity union all select 'category', category, count(*) from f group by category""")
def a20_finding_summary(symbols):
    return sinks.summary(symbols.select(F.when(F.col("is_unsafe"), "High").otherwise("Low").alias("severity"), F.col("kind").alias("category")))


@query("symbols", "call_edges", "files", sql="""with c as (select 2 * id as s from files where id % 5 = 2 and id % 3 <> 0)
select s as node from c join symbols on id = s union select src from call_edges where dst in (select s from c) union select src from call_edges where src in (select s from c)""")
def x51_changed_closure(symbols, calls, files):
    changes = files.select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 5 == 2, F.when(F.col("id") % 3 == 0, "removed").otherwise("modified")).otherwise("unchanged").alias("status"))
    return diff.changed_closure(changes, symbols.withColumn("file", (F.col("id") / 2).cast("string")).withColumn("file", F.regexp_replace("file", r"\.0$", "")), calls)


#: What the model's calls are called, so that costs, effects and resources show.
_CALLED = "case dst % 10 when 1 then 'std::fs::read' when 3 then 'reqwest::get' when 5 then 'Mutex::lock' when 7 then 'db::begin' when 9 then 'drop' end"


def _called(calls):
    return calls.select(F.col("src").alias("source_id"), F.expr(_CALLED).alias("name"), F.xxhash64("src", "dst").alias("rel_id"), F.lit(0).alias("start_line"))


@query("symbols", "call_edges", sql=f"""with c as (select src, {_CALLED} as n from call_edges), e as (select distinct src, case n when 'std::fs::read' then 'FileRead' when 'reqwest::get' then 'NetworkCall' when 'Mutex::lock' then 'LockAcquire' end as e from c),
l as (select src, string_agg(e, ',' order by e) as side_effects from e where e is not null group by src), t as (select src, sum(case n when 'std::fs::read' then 5 when 'reqwest::get' then 10 when 'Mutex::lock' then 2 else 0 end) as w, max(case when n = 'Mutex::lock' then 1 else 0 end) as k from c group by src)
select s.id as symbol_id, coalesce(side_effects, '') as side_effects, side_effects is null as is_pure, coalesce(k, 0) = 1 as holds_lock, cast(coalesce(w, 0) as double) as total_cost from symbols s left join l on l.src = s.id left join t on t.src = s.id where kind in ('Function', 'Method')""")
def x40_function_summaries(symbols, calls):
    own = symbols.filter("kind in ('Function', 'Method')")
    mine = calls.join(own.select(F.col("id").alias("src")), "src", "left_semi")
    got = analysis.function_summaries(symbols, mine, _called(mine))
    return got.select("symbol_id", F.array_join("side_effects", ",").alias("side_effects"), "is_pure", "holds_lock", F.col("total_cost").cast("double").alias("total_cost"))


@query("call_edges", sql=f"""with c as (select src as symbol_id, {_CALLED} as n from call_edges) select symbol_id, 'Lock' as kind from c where n = 'Mutex::lock' and symbol_id not in (select symbol_id from c where n = 'drop')
union select symbol_id, 'Transaction' from c where n = 'db::begin'""")
def x23_unreleased(calls):
    symbols = calls.select(F.col("src").alias("id"), F.lit("fn f()").alias("signature")).distinct()
    return analysis.unreleased(symbols, _called(calls))


@query("call_edges", sql=f"with c as (select src as symbol_id, {_CALLED} as n from call_edges) select distinct symbol_id from c where n = 'db::begin'")
def x25_uncommitted(calls):
    return analysis.uncommitted(_called(calls), calls)


@query("symbols", "call_edges", sql=f"select {generated.NAME} as name, 'Allocation' as kind, 'perf/cost/allocation-in-loop' as rule_id, cast(count(*) as bigint) as n from {_READ} x where {_HAS_BODY} and id % 3 = 1 group by 1")
def x18_calls_in_loops(symbols, calls):
    """Costly calls whose place lies in a loop of the generated files."""
    p = _parsed(symbols, calls)[1]
    named = p.symbols.select(F.col("id").alias("function_id"), F.col("name").alias("function"))
    found = analysis.calls_in_loops(analysis.called_names(p.extracted), p.cfg_nodes, {"Allocation": "^len$"})
    return found.join(named, "function_id").groupBy(F.col("function").alias("name"), "kind", "rule_id").agg(F.count("*").alias("n"))


@query("symbols", "modules", "call_edges", sql="""with r as (select id, 'async_main' as rule from symbols where kind in ('Function', 'Method') and id % 31 = 0 union all select id, 'handler' from symbols where kind in ('Function', 'Method') and id % 37 in (0, 1)
union all select id, 'command' from symbols where kind in ('Function', 'Method') and id % 41 = 0 union all select id, 'test' from symbols where is_test union all select id, 'no_callers' from symbols where kind = 'Function' and id not in (select dst from call_edges))
select id as symbol_id, string_agg(rule, ',' order by rule) as rules from r group by id""")
def d09_attribute_entrypoints(symbols, modules, calls):
    paths = F.filter(F.array(*(F.when(F.col("id") % m == k, a) for m, k, a in ((31, 0, "tokio::main"), (37, 0, "get(/x)"), (37, 1, "handler"), (37, 2, "getter"), (41, 0, "command"), (41, 1, "command(x)")))), lambda a: a.isNotNull())
    return rules.entrypoints(symbols.withColumn("attribute_paths", paths), modules, calls)


@query("symbols", "call_edges", sql=f"select cast(id as bigint) as id, {generated.NAME} as name, 'ok' as state from {_READ} x where kind = 'Struct' union all select module_id, 'parse error', 'Info' from symbols where {generated.BROKEN} group by module_id")
def x03_parse_findings(symbols, calls):
    """Structs as they were read, by the ids the text was made from, and a finding for every file that can't be read."""
    p = _parsed(symbols, calls)[1]
    read = p.symbols.filter("kind = 'Struct'").join(symbols.select("id", F.expr(generated.NAME).alias("name")).withColumnRenamed("id", "own"), "name").select(F.col("own").alias("id"), "name", F.lit("ok").alias("state"))
    return read.union(p.errors.select("file_id", F.lit("parse error"), F.lit("Info")))


@query("symbols", "call_edges", sql=f"select {generated.NAME} as name, cast(1 as bigint) as held from {_READ} x where {_HAS_BODY} and id % 7 = 0")
def x24_locks_across_await(symbols, calls):
    """Functions of a made-up control flow that take a lock and wait; every seventh keeps it meanwhile, the others drop it."""
    own = symbols.filter(f"{_HAS_BODY} and not ({generated.BROKEN})").select("id", F.expr(generated.NAME).alias("name"))
    spot = lambda k: [F.lit(k).alias("start_line"), F.lit(0).alias("start_col"), F.lit(k).alias("end_line"), F.lit(9).alias("end_col")]
    kinds = ("Entry", "Exit", "Statement", "Statement", "Await")
    nodes = reduce(DataFrame.unionByName, [own.select(F.col("id").alias("function_id"), F.lit(i).alias("node_ix"), F.lit(k).alias("kind"), *spot(i)) for i, k in enumerate(kinds)])
    edges = reduce(DataFrame.unionByName, [own.select(F.col("id").alias("function_id"), F.lit(a).alias("src_ix"), F.lit(b).alias("dst_ix")) for a, b in ((0, 2), (2, 3), (3, 4), (4, 1))])
    call = lambda k, name: own.select((F.col("id") * 10 + k).alias("rel_id"), F.col("id").alias("source_id"), name.alias("name"), *spot(k))
    called = call(2, F.lit("lock")).unionByName(call(3, F.when(F.col("id") % 7 == 0, "log").otherwise("drop")))
    found = analysis.locks_across_await(own.withColumn("is_async", F.lit(True)), called, nodes, edges)
    return found.join(own.withColumnRenamed("id", "function_id"), "function_id").select("name", F.lit(1).cast("long").alias("held"))


@query("crates", "modules", sql="select cast(m.id as bigint) as module_id, cast(max(c.id) as bigint) as crate_id from modules m join crates c on c.id in (m.crate_id, (m.crate_id + m.id) % 5) group by m.id")
def w02_module_owner(crates, modules):
    held = modules.select(F.col("id").cast("long").alias("module_id"), F.explode(F.array(F.col("crate_id").cast("long"), ((F.col("crate_id") + F.col("id")) % 5).cast("long"))).alias("crate_id"))
    return views.module_owner(held, crates.select(F.col("id").cast("long").alias("id"), F.col("id").alias("ord")))


@query("modules", "symbols", "call_edges", "module_edges")
def a15_structural_counts(modules, symbols, calls, edges):
    return rules.structural_counts(d24_structural_findings(modules, symbols, calls, edges))


_SQL["a15_structural_counts"] = f"select cast(sum(case when kind like 'Cyclic%' then 1 else 0 end) as bigint) as cycle_count, cast(sum(case when kind = 'GodModule' then 1 else 0 end) as bigint) as god_module_count from ({_SQL['d24_structural_findings']}) d"


@query("symbols", sql="select id, cast((id * 37) % 101 as double) as score, cast(row_number() over (order by (id * 37) % 101 desc, id) as bigint) as place from symbols")
def o07_ranked_findings(symbols):
    return passes.ranked(symbols.select("id", ((F.col("id") * 37) % 101).cast("double").alias("score")), "id").select("id", "score", "place")
