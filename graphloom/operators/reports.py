"""Report rows of findings (SARIF results, JUnit cases, annotations), each made in its own row, so reports of any size are written by all tasks.

Findings have rule_id, severity, file, line and message.  Nulls count as empty text, line 0 and severity Info.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ["Info", "Low", "Medium", "High", "Critical"]


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("Critical", "High"), "error").when(severity == "Medium", "warning").otherwise("note")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def sarif_results(findings: DataFrame) -> DataFrame:
    """result: one SARIF 2.1.0 result object in JSON for each finding."""
    place = F.struct(F.struct(_text("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce(F.col("line").cast("long"), F.lit(1)), F.lit(1)).alias("startLine")).alias("region"))
    return findings.select(
        F.to_json(
            F.struct(
                _text("rule_id").alias("ruleId"),
                sarif_level(F.col("severity")).alias("level"),
                F.struct(_text("message").alias("text")).alias("message"),
                F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
            )
        ).alias("result")
    )


def sarif_envelope(tool: str, version: str = "0") -> tuple[str, str]:
    """What stands before and after the comma-joined results of a log file."""
    head = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "version": version}}, "results": []}]}
    before, after = json.dumps(head).split("[]")
    return before + "[", "]" + after


def _escaped(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def junit_cases(findings: DataFrame, fail_on: str = "Medium") -> DataFrame:
    """suite (first part of the rule id), failed, xml: a test case for each finding; it fails from ``fail_on`` upwards."""
    bad = F.coalesce(F.col("severity").isin(*SEVERITIES[SEVERITIES.index(fail_on) :]), F.lit(False))
    head = F.concat(F.lit('<testcase classname="'), _escaped(_text("rule_id")), F.lit('" name="'), _escaped(F.concat(_text("file"), F.lit(":"), F.coalesce(F.col("line"), F.lit(0)).cast("string"))), F.lit('"'))
    failure = F.concat(F.lit('><failure message="'), _escaped(_text("message")), F.lit('"/></testcase>'))
    return findings.select(F.split(_text("rule_id"), "/")[0].alias("suite"), bad.alias("failed"), F.concat(head, F.when(bad, failure).otherwise("/>")).alias("xml"))


def junit_suites(cases: DataFrame) -> DataFrame:
    """suite, tests, failures: the heads of the suites."""
    return cases.groupBy("suite").agg(F.count("*").alias("tests"), F.count_if("failed").alias("failures"))


def annotations(findings: DataFrame) -> DataFrame:
    """annotation: the line a build log shows beside the source."""
    return findings.select(F.format_string("::warning file=%s,line=%d::%s", _text("file"), F.coalesce(F.col("line").cast("long"), F.lit(0)), _text("message")).alias("annotation"))


def hotspot_severity(cost: Column) -> Column:
    return F.when(cost > 100, "Critical").when(cost > 50, "High").when(cost > 20, "Medium").otherwise("Low")
