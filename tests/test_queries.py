"""Every query with SQL gives the SQL's rows; operators on small graphs and sources."""

import json
from xml.etree import ElementTree

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import registry
from graphloom.operators import graph, metrics, passes, reports, rules, views
from graphloom.sources import project

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df, cols):
    return sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert rows(got, cols) == rows(want, cols)


def edges(spark, *pairs):
    return spark.createDataFrame([*pairs], "src long, dst long")


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_cycles(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (None, 1))
    assert pairs(graph.strongly_connected(e)) == [(1, 3), (2, 3), (3, 3), (4, 5), (5, 5)]
    assert pairs(graph.topological_order(e.filter("src is not null"))) == []
    assert pairs(graph.strongly_connected(edges(spark, (1, 2)).limit(0))) == []


def test_reach_on_a_cycle_leaves_out_the_root(spark):
    e, start = edges(spark, (1, 2), (2, 3), (3, 1)), spark.createDataFrame([(1,)], "node long")
    assert pairs(graph.descendants(e, start)) == [(1, 2), (1, 3)]
    assert pairs(graph.neighborhood(e, start, 0)) == [(1, 1)]


def test_paths(spark):
    e = edges(spark, (1, 2), (2, 4), (1, 3), (3, 4), (4, 1))
    assert sorted(r["path"] for r in graph.simple_paths(e, 1, 4, 3).collect()) == [[1, 2, 4], [1, 3, 4]]
    assert len(graph.simple_paths(e, 1, 1, 3).collect()) == 2


def test_components(spark):
    e = edges(spark, (5, 4), (4, 3), (1, 2), (9, 9), (7, None))
    assert pairs(graph.connected_components(e)) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (9, 9)]


def test_cyclomatic_complexity(spark):
    n = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3)], "function_id long, node_ix long")
    e = spark.createDataFrame([(1, 0, 1), (2, 0, 2), (2, 2, 3), (2, 2, 1), (2, 3, 2), (2, 3, 1)], "function_id long, src_ix long, dst_ix long")
    assert pairs(metrics.cyclomatic_complexity(n, e)) == [(1, 1), (2, 3)]


@pytest.mark.parametrize(
    ("signature", "n"),
    [("fn f()", 0), (None, 0), ("fn f", 0), ("fn f(a: u8)", 1), ("fn f(a: u8, b: u8)", 2), ("fn f(a: M<K, V>, b: (u8, u8)) -> (A, B)", 2), ("fn f(&self, x: fn(u8, u8))", 2)],
)
def test_parameter_count(spark, signature, n):
    df = spark.createDataFrame([(signature,)], "s string")
    assert df.select(metrics.parameter_count("s").alias("n")).first()["n"] == n


def test_gate(spark):
    f = spark.createDataFrame([("High",), ("Low",)], "severity string")
    assert [rules.gate(f), rules.gate(f, "Critical"), rules.gate(f, "High"), rules.gate(f, None, 1), rules.gate(f, None, 2)] == [0, 0, 2, 2, 0]


def test_sources():
    text = '#[path = "x/y.rs"]\npub(crate) mod a;\nmod b { }\n// mod c;\n/* mod d;\n mod e;\n*/\nmod f ;\n#[cfg(test)]\nmod tests {\nlet mod_x = 1;'
    assert project.module_declarations(text) == [("a", False, "x/y.rs"), ("b", True, None), ("f", False, None), ("tests", True, None)]
    m = project.parse_manifest('[package]\nname="p"\n[dependencies]\nb="1"\na="1"\n[dev-dependencies]\na="1"\n[[bin]]\nname="t"\npath="src/t.rs"')
    assert (m["kind"], m["name"], m["dependencies"], m["bins"]) == ("crate", "p", ["a", "b"], [{"name": "t", "path": "src/t.rs"}])
    assert project.parse_manifest('[workspace]\nmembers=["a"]', "/x/ws")["name"] == "ws"
    with pytest.raises(ValueError):
        project.parse_manifest("[dependencies]")
    assert project.crate_targets("p", {"src/lib.rs", "src/main.rs"}, m["bins"]) == [("p", "Library"), ("p", "Binary"), ("t", "Binary")]


def test_passes(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 2), (3, 4), (5, 4), (6, 6), (None, 1))
    cost = spark.createDataFrame([(2, 1.0), (3, 2.0), (4, 5.0), (7, 9.0)], "node long, cost double")
    assert pairs(passes.total_costs(e, cost)) == [(1, 8.0), (2, 8.0), (3, 8.0), (4, 5.0), (5, 5.0), (7, 9.0)]
    names = spark.createDataFrame([(1, "get"), (2, "validate_it"), (3, "encode"), (4, "delete_row"), (5, None)], "node long, name string")
    start, end = names.filter("node in (1, 5)").select("node"), names.filter("node = 4").select("node")
    found = passes.taint_findings(passes.paths_between(e, start, end), names)
    assert sorted(map(tuple, found.collect())) == [([5, 4], 1, "High", "High")]  # 3 sanitizes the other path
    found = passes.taint_findings(passes.paths_between(e, start, end), names, sanitizers="escape")
    assert sorted(map(tuple, found.collect())) == [([1, 2, 3, 4], 3, "Medium", "Medium"), ([5, 4], 1, "High", "High")]  # 2 is a weak sanitizer
    assert passes.paths_between(e, start.limit(0), end).count() == 0
    entry = start.withColumn("external", F.lit(True))
    assert pairs(passes.missing_guards(e, entry, names, "encode")) == [(5, "High")]
    assert pairs(passes.unguarded_operations(e, entry, names, "encode")) == [(5, 4)]


def test_rule_registry(spark):
    reg = passes.RuleRegistry([{"id": f"r/{op}", "category": "c", "severity": "Low", "field": f, "op": op, "value": v} for op, f, v in (("Gte", "n", 2), ("Lt", "n", 2), ("Eq", "n", 3), ("Lte", "n", 1), ("Exact", "s", "ab"), ("Contains", "s", "b"), ("Prefix", "s", "b"))])
    df = spark.createDataFrame([(1, 1, "ab"), (2, 3, "b"), (3, None, None)], "id long, n long, s string")
    got = sorted((r["rule_id"], r["target"]) for r in reg.evaluate(df, "id").collect())
    assert got == [("r/Contains", 1), ("r/Contains", 2), ("r/Eq", 2), ("r/Exact", 1), ("r/Gte", 2), ("r/Lt", 1), ("r/Lte", 1), ("r/Prefix", 2)]
    reg.set_enabled("r/Eq", False)
    assert len(reg.enabled()) == 6 and reg.enabled("other") == []
    assert passes.RuleRegistry().evaluate(df, "id").count() == 0


def test_reports(spark):
    f = spark.createDataFrame([("a/b", "High", 'x"y.rs', 3, "m<&>"), (None, None, None, None, None)], "rule_id string, severity string, file string, line long, message string")
    got = [json.loads(r["result"]) for r in reports.sarif_results(f).collect()]
    assert [(g["ruleId"], g["level"], g["locations"][0]["physicalLocation"]["region"]["startLine"]) for g in got] == [("a/b", "error", 3), ("", "note", 1)]
    before, after = reports.sarif_envelope("t")
    assert json.loads(before + ",".join(map(json.dumps, got)) + after)["runs"][0]["results"] == got
    cases = reports.junit_cases(f).collect()
    assert [(c["suite"], c["failed"]) for c in cases] == [("a", True), ("", False)]
    assert [ElementTree.fromstring(c["xml"]).get("name") for c in cases] == ['x"y.rs:3', ":0"]
    assert [r[0] for r in reports.annotations(f).collect()] == ['::warning file=x"y.rs,line=3::m<&>', "::warning file=,line=0::"]
    assert views.auto_fit(spark.createDataFrame([], "x double, y double"), 800.0, 600.0).count() == 0
