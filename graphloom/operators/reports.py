"""Scan reports: counts, SARIF documents, the exit code."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the SARIF format.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"


def level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "LOW", "note").otherwise("warning")


def rule(cwe: Column) -> Column:
    return F.when(F.coalesce(cwe, F.lit(0)) != 0, F.concat(F.lit("CWE-"), cwe.cast("string"))).otherwise("SCANNER/UNKNOWN")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result, as JSON, of each vulnerable finding ``file_path, line_start, line_end, severity, description, cwe_id``."""
    cwe = F.when(F.coalesce("cwe_id", F.lit(0)) != 0, F.array(F.struct(rule(F.col("cwe_id")).alias("id"), F.struct(F.lit("CWE").alias("name")).alias("toolComponent"))))
    place = F.struct(
        F.struct(F.col("file_path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
        F.struct(F.col("line_start").alias("startLine"), F.col("line_end").alias("endLine")).alias("region"),
    )
    message = F.struct(F.coalesce("description", F.lit("Possible security weakness.")).alias("text"))
    result = F.struct(rule(F.col("cwe_id")).alias("ruleId"), level(F.col("severity")).alias("level"), message.alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"), cwe.alias("taxa"))
    return findings.filter("vulnerable").select("file_path", "line_start", rule(F.col("cwe_id")).alias("rule_id"), level(F.col("severity")).alias("level"), F.to_json(result).alias("result"))


def write_sarif(findings: DataFrame, path: str, properties: dict[str, str], tool: str = "graphloom") -> None:
    """Writes one document; the results are streamed into the file a partition at a time."""
    rows = sarif_results(findings).orderBy("file_path", "line_start", "rule_id").select("result").toLocalIterator(prefetchPartitions=True)
    head = {"$schema": SARIF_SCHEMA, "version": SARIF_VERSION}
    driver = {"tool": {"driver": {"name": tool, "informationUri": "", "rules": []}}, "properties": properties}
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(head)[:-1] + ', "runs": [' + json.dumps(driver)[:-1] + ', "results": [')
        f.writelines(("," if i else "") + r["result"] for i, r in enumerate(rows))
        f.write("]}]}")


def summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("vulnerable")).alias("vulnerabilities_found"), F.count(F.lit(1)).alias("contexts_scanned"))


def exit_code(findings: DataFrame, no_fail: bool = False) -> int:
    return int(not no_fail and not findings.filter("vulnerable").isEmpty())
