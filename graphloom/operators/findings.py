"""Static-analyzer findings: attaching them to nodes, scoring what they say, filtering by severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import model
from graphloom.config import Coefficients
from graphloom.functions import scores, text
from graphloom.operators import graph
from graphloom.operators.ranking import Hints

#: The tool whose findings carry a severity and a CWE; the other tool's carry an issue number.
SEVERITY_TOOL, ISSUE_TOOL = "bandit", "dlint"


def _held(findings: DataFrame, nodes: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` of each finding beside ``dst``, each node whose lines hold it."""
    of = [c for c in ("graph_id",) if c in findings.columns and c in nodes.columns]
    f = findings.select(*columns, *of, "file", "line_number")
    return graph.nodes_at_points(nodes.select(F.col("identifier").alias("dst"), *of, "file_path", "line_start", "line_end"), f).drop(*of, "file", "line_number", "file_path", "line_start", "line_end")


def attach(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """REPORTS edges ``src`` (finding) to ``dst`` (node) of each node whose lines hold the finding; rows of either may repeat.

    The edges are dealt by finding, where joins with the findings want them.
    """
    return _held(findings, nodes, F.col("id").alias("src")).select("src", "dst").repartition("src").distinct()


def merge(findings: DataFrame) -> DataFrame:
    """One finding a tool and id: the last row in ``ord``, or in its own values where there is none, replaces the others whole."""
    scalars = [c for c, t in findings.dtypes if c not in ("id", "tool", "ord") and not t.startswith("map")]
    order = ["ord"] if "ord" in findings.columns else scalars
    rows = graph.last_write(findings, ["id", "tool"], order, per_property=False)
    return rows.withColumns({c: F.when(F.col("tool") == t, F.col(c)) for t, own in ((SEVERITY_TOOL, ("cwe_id", "severity")), (ISSUE_TOOL, ("issue_id",))) for c in own if c in rows.columns})


def merge_reports(reports: DataFrame, findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """One REPORTS edge for each finding and node, both known. Repeats go first, before edges are dealt by either end."""
    edges = reports.select("src", "dst").distinct()
    return edges.join(findings.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("identifier").alias("dst")), "dst", "left_semi").select("src", "dst")


def tier(tool: Column, severity: Column, issue: Column) -> Column:
    return F.when(tool == SEVERITY_TOOL, F.upper(severity)).otherwise(scores.tier_of_issue(issue))


def above(findings: DataFrame, least: str = "HIGH") -> DataFrame:
    """Findings of the issue tool, and those of the other from severity ``least`` on."""
    rank = scores.lookup(F.upper("severity"), model.SEVERITY_RANK, -1)
    return findings.filter((F.col("tool") == ISSUE_TOOL) | (rank >= model.SEVERITY_RANK[least.upper()]))


def _said() -> list[str | Column]:
    """What :func:`_evidence` needs of a finding."""
    return ["tool", "cwe_id", tier(F.col("tool"), F.col("severity"), F.col("issue_id")).alias("tier")]


def _evidence(rows: DataFrame, c: Coefficients) -> DataFrame:
    severity = scores.of_tier(F.col("tier"), c.severity_scores, model.UNKNOWN_SEVERITY)
    confidence = scores.of_tier(F.col("tier"), c.confidence_by_severity, model.UNKNOWN_CONFIDENCE)
    grouped = rows.groupBy(F.col("dst").alias("identifier")).agg(
        F.count(F.lit(1)).alias("n_findings"), F.max(severity).alias("_s"), F.max(confidence).alias("_c"),
        (F.bool_or(F.col("tool") == SEVERITY_TOOL) & F.bool_or(F.col("tool") == ISSUE_TOOL)).alias("_both"),
        F.coalesce(F.bool_or((F.col("tool") == SEVERITY_TOOL) & F.col("cwe_id").isin(*model.HIGH_RISK_CWES)), F.lit(False)).alias("high_risk"),
    )
    score = scores.evidence(F.col("_s"), F.col("_c"), F.col("_both"), F.col("n_findings"), c)
    return grouped.select("identifier", "n_findings", score.alias("finding_evidence_score"), "high_risk")


def node_evidence(reports: DataFrame, findings: DataFrame, c: Coefficients) -> DataFrame:
    """``identifier, n_findings, finding_evidence_score, high_risk`` of each node with a known finding."""
    return _evidence(reports.join(findings.select(F.col("id").alias("src"), *_said()), "src"), c)


def evidence_at_lines(findings: DataFrame, nodes: DataFrame, c: Coefficients) -> DataFrame:
    """:func:`node_evidence` of findings that no edges attach yet: each row counts for each node whose lines hold it.

    What a finding says goes along with its place instead of being looked up by its id behind the join. The rows of an id lie at one
    place, and no node comes twice.
    """
    return _evidence(_held(findings.filter("id is not null"), nodes, *_said()), c)


def score_nodes(nodes: DataFrame, reports: DataFrame, findings: DataFrame, c: Coefficients, hints: Hints = Hints()) -> DataFrame:
    """``nodes`` (with ``snippet``) with both security scores set."""
    found = node_evidence(reports, findings, c).drop("n_findings").withColumnRenamed("finding_evidence_score", "_fe")
    s = F.col("snippet")
    path = scores.security_path(text.contains_any(s, hints.sink), text.contains_any(s, hints.source), text.contains_any(s, hints.guard), F.coalesce("high_risk", F.lit(False)), c)
    rows = nodes.drop("finding_evidence_score", "security_path_score").join(found, "identifier", "left")
    return rows.withColumns({"finding_evidence_score": F.coalesce("_fe", F.lit(0.0)), "security_path_score": path}).drop("_fe", "high_risk")


def messages(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """``identifier, messages``: what the tools say about each root, in the order of the findings."""
    f = findings.select(F.col("id").alias("src"), F.format_string("[%s] %s", F.col("tool"), F.coalesce("message", F.lit(""))).alias("m"))
    rows = F.array_sort(F.collect_list(F.struct("src", "m")))
    return reports.join(f, "src").groupBy(F.col("dst").alias("identifier")).agg(F.transform(rows, lambda x: x["m"]).alias("messages"))
