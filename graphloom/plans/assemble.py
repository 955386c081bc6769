"""Whole queries: from spans to rendered contexts, for all contexts in one plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import model
from graphloom.config import Coefficients
from graphloom.operators import graph, ranking, selection, spans
from graphloom.operators.graph import Graph
from graphloom.staging import materialize


def roots(g: Graph, context_spans: DataFrame, strict: bool = True) -> DataFrame:
    """``context_id, start_id``: nodes that share a line with a context's spans."""
    merged = spans.merge(context_spans, ["context_id", *graph.file_keys(g.nodes, context_spans)], strict)
    return graph.nodes_at_spans(g.nodes, merged).withColumnRenamed("identifier", "start_id")


def neighborhood(g: Graph, starts: DataFrame, depth: int, edge_paths: bool, taint: bool, max_hops: int = 6) -> DataFrame:
    """Context nodes: the nodes around ``starts`` with depth, repeats, edge depths and taint."""
    if edge_paths:
        found = graph.edge_depths(graph.bfs_typed(g, starts, depth))
    else:
        found = graph.collapse(graph.bfs(g, starts, depth)).withColumn("edge_depths", F.lit(None).cast("map<string,int>"))
    attributes = [c for c in ("graph_id", "kind", "name", "file_path", "line_start", "line_end", "finding_evidence_score", "security_path_score", "snippet", "ord") if c in g.nodes.columns]
    found = found.withColumnRenamed("id", "identifier")
    if taint:  # while rows hold no text
        found = graph.attach_taint(found, graph.taint(g, starts.withColumnRenamed("start_id", "id"), max_hops))
    nodes = found.join(g.nodes.select("identifier", *attributes), "identifier")
    defaults = {"finding_evidence_score": F.lit(0.0), "security_path_score": F.lit(0.0), "ord": F.xxhash64("identifier"), "taint_score": F.lit(0.0), "name": F.lit(None).cast("string")}
    return nodes.withColumns({k: v for k, v in defaults.items() if k not in nodes.columns})


def ranked(g: Graph, starts: DataFrame, lines: DataFrame, strategy: str, depth: int, budget: int, coefficients: Coefficients | None, **options) -> DataFrame:
    """The ranked neighbourhoods of ``starts (context_id, start_id)``."""
    s = ranking.pick([strategy])[strategy]
    nodes = neighborhood(g, materialize(starts, "roots"), depth, s.edge_paths, s.taint)
    if "snippet" not in nodes.columns:
        nodes = selection.snippets(nodes, lines)
    return materialize(ranking.rank(nodes, strategy, coefficients, budget=budget, **options), "ranked")


def selected(g: Graph, context_spans: DataFrame, lines: DataFrame, strategy: str = "cpg_structural", depth: int = 3, budget: int = 2048, coefficients: Coefficients | None = None, **options) -> DataFrame:
    return selected_from(g, roots(g, context_spans), lines, strategy, depth, budget, coefficients, **options)


def selected_from(g: Graph, starts: DataFrame, lines: DataFrame, strategy: str, depth: int, budget: int, coefficients: Coefficients | None = None, **options) -> DataFrame:
    """``context_id, identifier, rank`` of the nodes to show. A written table: rendering reads it more than once."""
    order = ranked(g, starts, lines, strategy, depth, budget, coefficients, **options)
    near = graph.induced_edges(g, order, model.PATH_FILL_TYPES)
    return selection.path_fill(order, near, lines, budget)


def assemble(g: Graph, context_spans: DataFrame, lines: DataFrame, strategy: str = "cpg_structural", depth: int = 3, budget: int = 2048, coefficients: Coefficients | None = None, **options) -> DataFrame:
    """``context_id, text, tokens`` of each context that has a root."""
    return selection.render(selected(g, context_spans, lines, strategy, depth, budget, coefficients, **options), g.nodes, lines)


def rank_all(nodes: DataFrame, strategies: list[str], coefficients: Coefficients | None = None, **options) -> DataFrame:
    """``strategy, context_id, identifier, rank`` of several strategies over the same context nodes."""
    ranked_by = [ranking.rank(nodes, s, coefficients, **options).select(F.lit(s).alias("strategy"), "context_id", "identifier", "rank") for s in ranking.pick(strategies)]
    return reduce(DataFrame.unionByName, ranked_by)


@dataclass(frozen=True)
class Around:
    """What no weight changes, and all strategies share: neighbourhoods along any edges and along one type, and induced edges."""

    plain: DataFrame
    typed: DataFrame | None  # none where no strategy asks for it
    edges: DataFrame

    def of(self, strategy: str) -> DataFrame:
        return self.typed if ranking.pick([strategy])[strategy].edge_paths else self.plain


def around(g: Graph, starts: DataFrame, depth: int, strategies: list[str] | None = None) -> Around:
    """Both neighbourhoods of ``starts (context_id, start_id)``, with taint. Written tables.

    For ``strategies`` that rank none along one type, that one is not made: all its nodes are in the other, whose edges these are.
    """
    starts = materialize(starts, "roots")
    plain = materialize(neighborhood(g, starts, depth, False, True), "plain")
    typed = None
    if any(s.edge_paths for s in ranking.pick(strategies).values()):
        typed = materialize(neighborhood(g, starts, depth, True, True), "typed")
    return Around(plain, typed, materialize(graph.induced_edges(g, plain), "edges"))


def contexts(a: Around, nodes: DataFrame, lines: DataFrame, strategies: list[str], budget: int, coefficients: Coefficients | None = None, **options) -> DataFrame:
    """``strategy, context_id, text, tokens`` of every strategy over the same neighbourhoods, without a traversal."""
    out, trees = [], {}
    for name, s in ranking.pick(strategies).items():
        rows = a.of(name)
        if s.edge_paths not in trees:
            trees[s.edge_paths] = selection.ways(rows.filter("depth = 0").select("context_id", F.col("identifier").alias("id")), a.edges)
        rows = rows if "snippet" in rows.columns else selection.snippets(rows, lines)
        order = ranking.rank(rows, name, coefficients, budget=budget, **options)
        text = selection.render(selection.path_fill(order, a.edges, lines, budget, trees[s.edge_paths]), nodes, lines)
        out.append(text.select(F.lit(name).alias("strategy"), "context_id", "text", "tokens"))
    return reduce(DataFrame.unionByName, out)


def prepare(g: Graph, context_spans: DataFrame, depth: int, path: str) -> None:
    """Writes what no weight changes, for later :func:`render_prepared`."""
    a = around(g, roots(g, context_spans), depth)
    for name in ("plain", "typed", "edges"):
        getattr(a, name).write.mode("overwrite").parquet(f"{path}/{name}")


def render_prepared(spark, path: str, nodes: DataFrame, lines: DataFrame, strategies: list[str], budget: int, coefficients: Coefficients | None = None, **options) -> DataFrame:
    """``strategy, context_id, text, tokens`` out of a prepared folder."""
    a = Around(*[spark.read.parquet(f"{path}/{name}") for name in ("plain", "typed", "edges")])
    return contexts(a, nodes, lines, strategies, budget, coefficients, **options)
