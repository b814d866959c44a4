"""Baselines, change sets and regression reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import reach_any, reverse


def change_set(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """path, status (added, removed, modified, unchanged) from path and hash of two snapshots."""
    b, c = baseline.select("path", F.col("hash").alias("old")), current.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return b.join(c, "path", "full_outer").select("path", status.alias("status"))


def regression(baseline: DataFrame, current: DataFrame, exact: list[str], fuzzy: list[str]) -> DataFrame:
    """finding keys with state new, fixed or unchanged: the exact key first, what is left by the fuzzy one."""
    cols = list(dict.fromkeys(exact + fuzzy))
    same = current.join(baseline.select(*exact).distinct(), exact, "left_semi")
    left_c, left_b = current.join(baseline.select(*exact), exact, "left_anti"), baseline.join(current.select(*exact), exact, "left_anti")
    near = left_c.join(left_b.select(*fuzzy).distinct(), fuzzy, "left_semi")
    new, fixed = left_c.join(left_b.select(*fuzzy), fuzzy, "left_anti"), left_b.join(left_c.select(*fuzzy), fuzzy, "left_anti")
    tag = lambda df, s: df.select(*cols, F.lit(s).alias("state"))
    return tag(same, "unchanged").unionByName(tag(near, "unchanged")).unionByName(tag(new, "new")).unionByName(tag(fixed, "fixed"))


def changed_closure(changes: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """node: symbols in changed files and everything that calls them, directly or not."""
    changed = changes.filter("status in ('added', 'modified')").select(F.col("path").alias("file"))
    return reach_any(reverse(calls), symbols.join(changed, "file", "left_semi").select(F.col("id").alias("node")))
