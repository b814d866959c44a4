"""The code-graph model over relational tables: views by name, built once per session and folder.

``bind`` registers nothing global: it returns a dict of DataFrames.  The same definitions, as SQL, are the common
table expressions of the SQL counterparts (``MODEL_SQL``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents".split()

#: Entity and edge tables in SQL that Spark and DuckDB both run.
MODEL_SQL = {
    "crates": "select r_regionkey as id, r_name as name, case when r_regionkey % 2 = 0 then 'Library' else 'Binary' end as crate_type from region",
    "modules": "select n_nationkey as id, n_regionkey as crate_id, n_name as name, concat(r_name, '::', n_name) as path, "
    "nullif(min(n_nationkey) over (partition by n_regionkey), n_nationkey) as parent from nation join region on n_regionkey = r_regionkey",
    "symbols": "select 2 * c_custkey as id, c_name as name, case c_mktsegment when 'BUILDING' then 'Function' when 'AUTOMOBILE' then 'Method' "
    "when 'MACHINERY' then 'Struct' when 'HOUSEHOLD' then 'Trait' else 'Constant' end as kind, c_nationkey as module_id, "
    "case when c_acctbal > 0 then 'Public' else 'Private' end as visibility, cast(c_custkey % 50 + 1 as int) as start_line, "
    "cast(c_custkey % 50 + 1 + (c_custkey * 7) % 131 - 3 as int) as end_line, c_custkey % 17 = 0 as is_unsafe, c_custkey % 13 = 0 as has_unsafe_block, "
    "c_custkey % 19 = 0 as is_extern, c_custkey % 23 = 0 as is_test from customer "
    "union all select 2 * s_suppkey + 1, s_name, 'Function', s_nationkey, case when s_acctbal > 0 then 'Public' else 'Private' end, "
    "cast(s_suppkey % 50 + 1 as int), cast(s_suppkey % 50 + 9 as int), s_suppkey % 17 = 0, s_suppkey % 13 = 0, s_suppkey % 19 = 0, s_suppkey % 23 = 0 from supplier",
    "call_edges": "select distinct 2 * o_custkey as src, 2 * l_suppkey + 1 as dst from orders join lineitem on l_orderkey = o_orderkey",
    "module_edges": "select src, dst from (select src, dst, row_number() over (partition by src order by n desc, dst) as rn from "
    "(select c_nationkey as src, s_nationkey as dst, count(*) as n from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey "
    "join supplier on l_suppkey = s_suppkey group by c_nationkey, s_nationkey) w) k where rn <= 2",
    # crates (below 0), their modules (from -100 down), the modules' customers, and what these call: an acyclic graph
    "model_nodes": "select cast(-1 - r_regionkey as bigint) as node, r_name as name from region union all select cast(-100 - n_nationkey as bigint), n_name from nation "
    "union all select cast(2 * c_custkey as bigint), c_name from customer union all select cast(2 * s_suppkey + 1 as bigint), s_name from supplier",
    "model_edges": "select cast(-1 - n_regionkey as bigint) as src, cast(-100 - n_nationkey as bigint) as dst from nation union all select cast(-100 - c_nationkey as bigint), cast(2 * c_custkey as bigint) from customer "
    "union all select distinct cast(2 * o_custkey as bigint), cast(2 * l_suppkey + 1 as bigint) from orders join lineitem on l_orderkey = o_orderkey",
    "files": "select doc_id as id, concat(source, '/', cast(doc_id as string)) as path, text from documents",
}


def needed(*names: str) -> list[str]:
    return [n for n in MODEL_SQL if n in names]


def with_model(sql: str) -> str:
    """``sql`` behind the common table expressions of the model tables it names."""
    used = [n for n in MODEL_SQL if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} as ({MODEL_SQL[n]})" for n in used)
    if not ctes:
        return sql
    return f"with recursive {ctes}, {sql[len('with recursive ') :]}" if sql.startswith("with recursive ") else f"with {ctes}, {sql[5:]}" if sql.startswith("with ") else f"with {ctes} {sql}"


def bind(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named model tables."""
    frames = {}
    out = []
    for name in names:
        sql = MODEL_SQL[name]
        for t in TABLES:
            if re.search(rf"\b{t}\b", sql) and t not in frames:
                frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        for t in sorted({t for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", sql)}):
            sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
        out.append(spark.sql(sql, **{t: f for t, f in frames.items() if f"{{{t}}}" in sql}))
    return out
