"""Where results go: JSON of a project and of findings, report files, baselines, and the module tree as text."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import reports
from graphloom.plans.shared import materialize
from graphloom.sources.loader import Project

EXIT_OK, EXIT_ERROR, EXIT_THRESHOLD, EXIT_REGRESSION = range(4)


def _write_text(path: str, parts: Iterable[str]) -> None:
    """One file, part by part, on any file system that a URI names."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else "file://" + path)
    with where.open_output_stream(name) as f:
        for p in parts:
            f.write(p.encode("utf-8", "surrogatepass"))


def _lines(df: DataFrame, between: str) -> Iterator[str]:
    """The only column of all rows, fetched partition by partition."""
    first = True
    for row in df.toLocalIterator():
        yield ("" if first else between) + row[0]
        first = False


def project_json(project: Project) -> DataFrame:
    """One row a crate: what was loaded, without texts."""
    modules = project.crate_modules.join(project.modules.select(F.col("id").alias("module_id"), F.struct("id", "name", "path", "file_path", "parent").alias("m")), "module_id")
    listed = modules.groupBy("crate_id").agg(F.array_sort(F.collect_list("m")).alias("modules"))
    deps = project.dependencies.groupBy("crate_id").agg(F.array_sort(F.collect_list("dependency")).alias("dependencies"))
    files = project.files.select(F.regexp_extract("path", r"^(.*?)/?src/", 1).alias("path"), F.struct("id", "path", "hash", "line_count").alias("f")).groupBy("path").agg(F.array_sort(F.collect_list("f")).alias("files"))
    full = project.crates.withColumnRenamed("id", "crate_id").join(listed, "crate_id", "left").join(deps, "crate_id", "left").join(files, "path", "left")
    return full.select(F.to_json(F.struct("crate_id", "name", "path", "crate_type", "dependencies", "modules", "files")).alias("crate"))


def write_project(project: Project, path: str) -> None:
    head = json.dumps({"name": project.name, "is_workspace": project.is_workspace})[:-1]
    _write_text(path, [head, ', "crates": [', *_lines(project_json(project), ", "), "]}\n"])


def summary_text(project: Project) -> str:
    """What was loaded, in a few lines: kind, name, and numbers of crates, modules, files and lines."""
    lines = project.files.agg(F.coalesce(F.sum("line_count"), F.lit(0))).first()[0]
    kinds = project.crates.groupBy("crate_type").count().orderBy("crate_type").collect()
    said = [f"{'Workspace' if project.is_workspace else 'Crate'}: {project.name}", "Crates: " + ", ".join(f"{r['count']} {r['crate_type']}" for r in kinds)]
    said += [f"Modules: {project.modules.count()}", f"Files: {project.files.count()}", f"Lines: {lines}"]
    return "\n".join([*said, *(f"Skipped: {p} ({why})" for p, why in project.skipped)])


def write_findings(findings: DataFrame, path: str) -> None:
    """JSON lines, a file per partition."""
    findings.write.mode("overwrite").json(path)


def write_sarif(findings: DataFrame, path: str, tool: str = "graphloom") -> None:
    before, after = reports.sarif_envelope(tool)
    results = reports.sarif_results(findings.withColumn("message", F.coalesce("message", F.lit(""))))

    def parts():
        yield before
        yield from _lines(results, ",")
        yield after

    _write_text(path, parts())


def write_junit(findings: DataFrame, path: str, fail_on: str = "Medium") -> None:
    cases = materialize(reports.junit_cases(findings, fail_on), "cases")
    suites = reports.junit_suites(cases).orderBy("suite").collect()  # one per category

    def parts():
        yield "<testsuites>"
        for s in suites:
            yield f'<testsuite name="{s["suite"]}" tests="{s["tests"]}" failures="{s["failures"]}">'
            yield from _lines(cases.filter(F.col("suite") == s["suite"]).select("xml"), "")
            yield "</testsuite>"
        yield "</testsuites>\n"

    _write_text(path, parts())


def summary(findings: DataFrame) -> DataFrame:
    """by (total, severity or category), value, n."""
    kinds = F.array(F.struct(F.lit("total").alias("by"), F.lit("").alias("value")), F.struct(F.lit("severity").alias("by"), F.col("severity").alias("value")), F.struct(F.lit("category").alias("by"), F.col("category").alias("value")))
    return findings.select(F.inline(kinds)).groupBy("by", "value").agg(F.count("*").alias("n"))


def save_baseline(spark: SparkSession, name: str, files: DataFrame, findings: DataFrame, folder: str) -> None:
    """Tables of file hashes, findings and counts below a folder; a name and time beside them."""
    files.select("path", "hash").write.mode("overwrite").parquet(f"{folder}/files")
    findings.write.mode("overwrite").parquet(f"{folder}/findings")
    summary(findings).write.mode("overwrite").parquet(f"{folder}/summary")
    spark.createDataFrame([(name, int(time.time()))], "project_name string, timestamp long").write.mode("overwrite").json(f"{folder}/project")


def load_baseline(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    tables = {k: spark.read.parquet(f"{folder}/{k}") for k in ("files", "findings", "summary")}
    return tables | {"project": spark.read.schema("project_name string, timestamp long").json(f"{folder}/project")}


def tree_lines(modules: DataFrame) -> DataFrame:
    """crate_id, ord (its place), line: every crate's modules as a tree, children in the order of their declaration."""
    place = Window.partitionBy("parent").orderBy("ord", "path")
    count = Window.partitionBy("parent")
    ranked = materialize(modules.select("id", "crate_id", "name", "parent", "ord", "path").withColumn("k", F.row_number().over(place)).withColumn("n", F.count("*").over(count)), "tree")
    level = ranked.filter("parent is null").select("id", "crate_id", F.array(F.lit(0)).alias("ord"), F.col("name").alias("line"), F.lit("").alias("indent"))
    out = None
    while True:
        level = materialize(level, "tree-level")
        out = level if out is None else out.unionByName(level)
        if level.isEmpty():
            return out.select("crate_id", "ord", "line")
        above = level.select(F.col("id").alias("parent"), F.col("ord").alias("above"), "indent")
        last = F.col("k") == F.col("n")
        level = ranked.join(above, "parent").select(
            "id",
            "crate_id",
            F.concat("above", F.array("k")).alias("ord"),
            F.concat("indent", F.when(last, "└── ").otherwise("├── "), "name").alias("line"),
            F.concat("indent", F.when(last, "    ").otherwise("│   ")).alias("indent"),
        )


def exit_code(findings: DataFrame, fail_on: str | None = None, max_findings: int | None = None, regression: DataFrame | None = None) -> int:
    """0, 2 beyond a gate, 3 with new findings (state "new") against a baseline."""
    from graphloom.operators.rules import gate

    if gate(findings, fail_on, max_findings):
        return EXIT_THRESHOLD
    return EXIT_REGRESSION if regression is not None and not regression.filter("state = 'new'").isEmpty() else EXIT_OK
