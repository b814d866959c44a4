"""Projects as tables: crates, modules and files below a folder with a manifest.

Manifests are few and are read on the driver; sources are listed and read by Spark, and modules are found level by level
with joins, so that a level costs one pass whatever its size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.shared import materialize
from graphloom.sources.project import EXCLUDED, LARGE_FILE, crate_targets, declared_modules, fingerprints, parse_manifest

DEPTH = 64  # levels of modules; a chain of path attributes could else go round


class NoManifest(ValueError):
    """The folder has no manifest."""


@dataclass
class Project:
    """crates: id, ord, name, path, crate_type, root_file.  dependencies: crate_id, dependency.  modules: id, crate_id, name,
    path, file_path, parent, is_inline.  crate_modules: crate_id, module_id (targets of one crate share modules).  files: id,
    path, text, hash, line_count, is_large.  skipped: path, reason."""

    name: str
    is_workspace: bool
    crates: DataFrame
    dependencies: DataFrame
    modules: DataFrame
    crate_modules: DataFrame
    files: DataFrame
    skipped: list[tuple[str, str]]


def _manifests(spark: SparkSession, root: str) -> dict[str, str]:
    """Folder below the root ("" for the root) to manifest text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "Cargo.toml").load(root)
    rows = raw.select("path", F.col("content").cast("string").alias("text")).collect()  # one per crate
    return {r["path"].partition(root.rstrip("/"))[2].strip("/").removesuffix("Cargo.toml").strip("/"): r["text"] for r in rows}


def matching_folders(patterns: list[str], folders: list[str]) -> list[str]:
    """Folders that a member pattern names, each once, in the order of the patterns."""
    out: dict[str, None] = {}
    for p in patterns:
        glob = re.escape(p.strip("/")).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out |= dict.fromkeys(f for f in sorted(folders) if re.fullmatch(glob, f))
    return list(out)


def _sources(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    """path, crate (folder), text of the sources of crates, without excluded folders and files that aren't UTF-8."""
    base = root.rstrip("/")
    found = None
    for folder in dict.fromkeys(folders):
        src = "/".join(x for x in (base, folder, "src") if x)
        if not _exists(spark, src):
            continue
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").load(src)
        inside = F.regexp_extract("path", re.escape(src) + "/(.*)", 1)
        raw = raw.filter(~inside.rlike(f"(^|/)({'|'.join(EXCLUDED)})/") & ~inside.rlike(r"(^|/)build\.rs$"))
        text = F.try_validate_utf8(F.col("content").cast("string"))
        part = raw.select(F.concat(F.lit("/".join(x for x in (folder, "src") if x) + "/"), inside).alias("path"), F.lit(folder).alias("crate"), text.alias("text"))
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "path string, crate string, text string")
    return found.filter("text is not null")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def child_folder(path):
    """Where the child modules of a file lie: beside mod.rs, lib.rs and main.rs, else in a folder of the file's name."""
    return F.when(F.regexp_extract(path, r"([^/]*)$", 1).isin("mod.rs", "lib.rs", "main.rs"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.regexp_replace(path, r"\.rs$", ""))


def _plain(path):
    """A path without "./" and "x/../"."""
    out = F.regexp_replace(path, r"(^|/)(\./)+", "$1")
    for _ in range(4):
        out = F.regexp_replace(out, r"(^|/)(?!\.\.)[^/]+/\.\./", "$1")
    return out


def module_tree(crates: DataFrame, files: DataFrame) -> DataFrame:
    """crate_id, ord, name, path, file_path, parent_path, is_inline, level of all modules, before targets are merged.

    crates: id, ord, name, root_file; files: path, text.  A declaration without a file has a null file_path.
    """
    declared = materialize(declared_modules(files).withColumnRenamed("path", "file_path"), "declared")
    known = files.select(F.col("path").alias("file"))
    root = F.translate("name", "-", "_")
    level = crates.join(known, F.col("root_file") == F.col("file")).select(
        F.col("id").alias("crate_id"), F.col("ord").alias("crate_ord"), F.lit(0).cast("long").alias("ord"), root.alias("name"), root.alias("path"), F.col("root_file").alias("file_path"), F.lit(None).cast("string").alias("parent_path"), F.lit(False).alias("is_inline"), F.lit(0).alias("level")
    )
    out, n = None, 0
    while n < DEPTH:
        level = materialize(level, "module-level")
        out = level if out is None else out.unionByName(level)
        parents = level.filter("not is_inline and file_path is not null").select("crate_id", "crate_ord", "file_path", F.col("path").alias("parent_path"))
        n += 1
        if parents.isEmpty():
            break
        d = parents.join(declared, "file_path").withColumn("folder", child_folder(F.col("file_path")))
        choices = F.when(F.col("inline"), F.array("file_path")).when(F.col("custom_path").isNotNull(), F.array(_plain(F.concat_ws("/", "folder", "custom_path")))).otherwise(F.array(F.concat("folder", F.lit("/"), "name", F.lit(".rs")), F.concat("folder", F.lit("/"), "name", F.lit("/mod.rs"))))
        tried = d.select("*", F.posexplode(choices).alias("choice", "try")).join(known, F.col("try") == F.col("file"), "left")
        keys = ["crate_id", "crate_ord", "parent_path", "ord", "name", "inline"]
        level = tried.groupBy(*keys).agg(F.min_by("file", F.when(F.col("file").isNotNull(), F.col("choice"))).alias("file_path")).select(
            "crate_id", "crate_ord", "ord", "name", F.concat("parent_path", F.lit("::"), "name").alias("path"), "file_path", "parent_path", F.col("inline").alias("is_inline"), F.lit(n).alias("level")
        )
    return out


def merge_targets(tree: DataFrame, crates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """modules and crate_modules: a module that two targets of one folder declare with the same file is the first target's;
    root modules stay apart."""
    folders = crates.select(F.col("id").alias("crate_id"), F.col("path").alias("folder"))
    keyed = tree.join(folders, "crate_id").withColumn("key", F.when(F.col("parent_path").isNull() | F.col("file_path").isNull(), F.xxhash64("crate_id", "path")).otherwise(F.xxhash64("folder", "file_path", "path")))
    keyed = keyed.withColumn("id", F.abs(F.col("key") % F.lit(1 << 62)))
    parents = keyed.select("crate_id", F.col("path").alias("parent_path"), F.col("id").alias("parent"))
    linked = materialize(keyed.join(parents, ["crate_id", "parent_path"], "left"), "modules")
    first = F.struct("crate_ord", "ord")
    modules = linked.groupBy("id").agg(*(F.min_by(c, first).alias(c) for c in ("crate_id", "name", "path", "file_path", "parent", "is_inline", "level", "ord")))
    return modules, linked.select("crate_id", F.col("id").alias("module_id")).distinct()


def load_project(spark: SparkSession, root: str) -> Project:
    """The project below a folder.  Raises NoManifest without one; members without a manifest or with a bad one are skipped."""
    found = _manifests(spark, root)
    if "" not in found:
        raise NoManifest(root)
    top = parse_manifest(found[""], root)
    members, skipped = {}, []
    if top["kind"] == "workspace":
        for folder in matching_folders(top["members"], [f for f in found if f]):
            try:
                m = parse_manifest(found[folder], folder)
            except ValueError as e:
                skipped.append((folder, str(e)))
                continue
            if m["kind"] == "crate":
                members[folder] = m
        skipped += [(p, "no manifest") for p in top["members"] if not matching_folders([p], list(found))]
    else:
        members[""] = top
    files = materialize(_sources(spark, root, list(members)), "sources")
    ids = files.select("path").distinct().sort("path").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("path string, id long")
    files = materialize(files.join(ids, "path"), "files")
    printed = fingerprints(files).drop("path")
    files = files.join(printed, "id").select("id", "path", "text", "hash", "line_count", (F.col("line_count") > LARGE_FILE).alias("is_large"))
    tops = {}
    for r in files.filter(F.col("path").rlike(r"(^|/)src/(lib|main)\.rs$")).select("path").collect():  # two per crate
        tops.setdefault(r["path"].rpartition("src/")[0].strip("/"), set()).add("src/" + r["path"].rpartition("/")[2])
    crates, deps = [], []
    for folder, m in members.items():
        for name, kind in crate_targets(m["name"], tops.get(folder, set()), m["bins"]):
            own = next((b["path"] for b in m["bins"] if b["name"] == name and kind == "Binary"), "src/main.rs") if kind == "Binary" else "src/lib.rs"
            crates.append((len(crates), len(crates), name, folder, kind, "/".join(x for x in (folder, own.replace("\\", "/")) if x)))
            deps += [(crates[-1][0], d) for d in m["dependencies"]]
    crates = spark.createDataFrame(crates, "id long, ord long, name string, path string, crate_type string, root_file string")
    modules, crate_modules = merge_targets(module_tree(crates, files), crates)
    return Project(top["name"], top["kind"] == "workspace", crates, spark.createDataFrame(deps, "crate_id long, dependency string"), modules, crate_modules, files, skipped)
