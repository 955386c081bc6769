"""From a source tree and analyzer reports to reviewed findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import Coefficients
from graphloom.operators import findings, graph, selection
from graphloom.operators.graph import Graph
from graphloom.operators.ranking import Hints
from graphloom.plans import assemble, review
from graphloom.sources import diffs, python_cpg, tables
from graphloom.staging import materialize


@dataclass(frozen=True)
class Project:
    graph: Graph
    lines: DataFrame
    findings: DataFrame
    reports: DataFrame  # finding to node
    errors: DataFrame  # files that do not parse


def load(spark: SparkSession, root: str, found: DataFrame | None = None, coefficients: Coefficients | None = None, hints: Hints = Hints(), only: str | None = None) -> Project:
    """The graph of a source tree, or of the ``only`` file directly in it, its nodes with both security scores."""
    return build(materialize(python_cpg.scan(spark, root, only=only), "files"), found, coefficients, hints)


def _none(spark: SparkSession, columns: str) -> DataFrame:
    """A table without rows, for which no task runs."""
    return spark.range(1).filter("false").selectExpr(*[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in columns.split(", ")])


def build(files: DataFrame, found: DataFrame | None = None, coefficients: Coefficients | None = None, hints: Hints = Hints()) -> Project:
    """The graph of ``files (file_path, content)``, a written table; with ``graph_id`` in it, and in ``found``, of many checkouts at once."""
    spark = files.sparkSession
    built = python_cpg.build(files)
    merged = graph.checked_nodes(built["nodes"])
    lines = materialize(tables.source_lines(files), "lines")
    g = graph.load_graph(merged, built["edges"], merged=True)
    if found is None:  # nothing to attach, so no node is read for it
        found = _none(spark, "id string, tool string, file string, line_number int, cwe_id int, severity string, issue_id int, message string" + ", graph_id string" * ("graph_id" in files.columns))
        links = _none(spark, "src string, dst string")
    else:
        found = materialize(findings.merge(found), "findings")
        links = materialize(findings.merge_reports(findings.attach(found, g.nodes), found, g.nodes), "reports")
    nodes = findings.score_nodes(selection.snippets(g.nodes, lines), links, found, coefficients or Coefficients(), hints)
    return Project(Graph(materialize(nodes, "nodes"), g.edges, g.types), lines, found, links, built["errors"])


def finding_roots(p: Project, least: str = "HIGH") -> DataFrame:
    """Each node with a finding of the severity or above is the root of a context of its own."""
    kept = findings.above(p.findings, least).select(F.col("id").alias("src"))
    return p.reports.join(kept, "src", "left_semi").select(F.col("dst").alias("context_id"), F.col("dst").alias("start_id")).distinct()


def diff_roots(p: Project, diff: str) -> DataFrame:
    """Each node that shares a line with the added lines of a unified diff."""
    spark = p.lines.sparkSession
    changed = diffs.changed_spans(spark.createDataFrame([("diff", diff)], "diff_id string, diff string"))
    hit = graph.nodes_at_spans(p.graph.nodes, changed)
    return hit.select(F.col("identifier").alias("context_id"), F.col("identifier").alias("start_id")).distinct()


def contexts(p: Project, roots: DataFrame, strategy: str = "cpg_structural", depth: int = 3, budget: int = 2048, coefficients: Coefficients | None = None, **options) -> DataFrame:
    """``sample_id, file_path, line_start, line_end, messages, context_text, tokens``, a row a root."""
    chosen = assemble.selected_from(p.graph, roots, p.lines, strategy, depth, budget, coefficients, **options)
    text = selection.render(chosen, p.graph.nodes, p.lines).select(F.col("context_id").alias("identifier"), F.col("text").alias("context_text"), "tokens")
    said = findings.messages(p.reports, p.findings)
    rows = p.graph.nodes.select("identifier", "file_path", "line_start", "line_end").join(text, "identifier").join(said, "identifier", "left")
    return rows.withColumnRenamed("identifier", "sample_id")


def reviewed(rows: DataFrame, send: review.Send | None = None, responses: DataFrame | None = None, concurrency: int = 8) -> DataFrame:
    """``rows`` with a verdict each, out of a transport or a table of responses; without either nothing is vulnerable."""
    if send is not None:
        asked = rows.withColumn("prompt", review.prompt(F.col("context_text"), F.col("messages")))
        got = materialize(review.ask(asked, send, concurrency), "responses").select("sample_id", "response")
    elif responses is not None:
        got = responses
    else:
        got = rows.select("sample_id", F.lit(None).cast("string").alias("response"))
    return review.review(review.answered(rows, got))
