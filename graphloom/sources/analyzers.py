"""Analyzer output as findings: JSON reports of one tool, text lines of the other. Reports are read, tools are not run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators.findings import ISSUE_TOOL, SEVERITY_TOOL

_REPORT = (
    "results array<struct<filename string, line_number int, issue_severity string, issue_text string, issue_cwe struct<id int>, col_offset int, line_range array<int>>>"
)
_LINE = r"^(.+?):([0-9]+):([0-9]+): ([A-Z]+[0-9]+) (.*)$"


def _id(tool: str) -> Column:
    return F.sha1(F.concat_ws(":", F.lit(tool), "file", F.col("line_number").cast("string"), "message").cast("binary"))


def json_report(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """``id, tool, file, line_number, cwe_id, severity, issue_id, message, column, lines``."""
    rows = spark.read.schema(_REPORT).option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    found = rows.select(
        text.relative_path(F.col("r.filename"), root).alias("file"), F.col("r.line_number").alias("line_number"), F.col("r.issue_cwe.id").alias("cwe_id"), F.upper("r.issue_severity").alias("severity"),
        F.col("r.issue_text").alias("message"), F.coalesce("r.col_offset", F.lit(0)).alias("column"), F.coalesce("r.line_range", F.array().cast("array<int>")).alias("lines"),
    )
    return found.select(_id(SEVERITY_TOOL).alias("id"), F.lit(SEVERITY_TOOL).alias("tool"), "file", "line_number", "cwe_id", "severity", F.lit(None).cast("int").alias("issue_id"), "message", "column", "lines")


def text_report(spark: SparkSession, path: str, root: str = "", prefix: str = "DU") -> DataFrame:
    """Findings of lines ``path:line:col: CODE message``; other lines, and codes of other tools, are passed over."""
    lines = spark.read.text(path).filter(F.rlike("value", F.lit(_LINE)))
    part = lambda k: F.regexp_extract("value", _LINE, k)
    rows = lines.select(text.relative_path(part(1), root).alias("file"), part(2).cast("int").alias("line_number"), part(3).cast("int").alias("column"), part(4).alias("code"), F.trim(part(5)).alias("message"))
    rows = rows.filter(F.startswith("code", F.lit(prefix)))
    return rows.select(
        _id(ISSUE_TOOL).alias("id"), F.lit(ISSUE_TOOL).alias("tool"), "file", "line_number", F.lit(None).cast("int").alias("cwe_id"), F.lit(None).cast("string").alias("severity"),
        F.regexp_extract("code", "([0-9]+)", 1).cast("int").alias("issue_id"), "message", "column", F.array().cast("array<int>").alias("lines"),
    )
