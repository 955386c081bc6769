"""The property graph: upserts, lookups by lines, bounded traversals, induced subgraphs.

A traversal holds ``(context, start[, type], node)`` once per node with its least hop. Each level is one join of the frontier
with the neighbours and one anti-join with what was seen; no level is collected, and each is written to the shared
checkpoint folder so that the plan does not grow with the depth. The neighbours of a large graph are bucketed lists, which
each level reads where they lie; those of a hub are spread over the buckets, and its rows of the frontier go to each of them. A
small adjacency is joined edge by edge.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import model
from graphloom.functions import scores
from graphloom.operators import intervals
from graphloom.staging import bucketed, estimated_bytes, materialize


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    types: tuple[str, ...]  # the edge types there are


# ---------------------------------------------------------------- building

def last_write(rows: DataFrame, keys: list[str], order: list[str], per_property: bool = True, count: str | None = None) -> DataFrame:
    """An upsert by ``keys``: of each other column the last non-null value in ``order``, or the whole last row.

    Per property, ``count`` names a column for the number of rows that became one.
    """
    others = [c for c in rows.columns if c not in keys]
    if per_property:
        at = F.struct(*order)
        told = [F.count(F.lit(1)).alias(count)] if count else []
        return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in others], *told)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def merge_nodes(nodes: DataFrame) -> DataFrame:
    return last_write(nodes, ["identifier"], ["ord"])


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge for each source, target and type, both ends known; self loops stay, dangling edges go."""
    ids = nodes.select("identifier").distinct()
    known = edges.join(ids, edges["src"] == ids["identifier"], "left_semi").join(ids, edges["dst"] == ids["identifier"], "left_semi")
    return last_write(known, ["src", "dst", "type"], ["ord"])


def load_graph(nodes: DataFrame, edges: DataFrame, merged: bool = False) -> Graph:
    n = nodes if merged else merge_nodes(nodes)
    e = materialize(merge_edges(edges, n), "edges")
    return Graph(n, e, edge_types(e))


def edge_types(edges: DataFrame) -> tuple[str, ...]:
    """The types in use: at most as many as the vocabulary has."""
    return tuple(sorted(r["type"] for r in edges.select("type").distinct().collect()))


def _payload(nodes: DataFrame) -> Column:
    return F.xxhash64(*[c for c in nodes.columns if c not in ("identifier", "ord")])


def conflicting_nodes(nodes: DataFrame) -> DataFrame:
    """Ids that come with different payloads: merging such files is an error."""
    return nodes.groupBy("identifier").agg(F.countDistinct(_payload(nodes)).alias("payloads")).filter("payloads > 1")


def checked_nodes(nodes: DataFrame) -> DataFrame:
    """:func:`merge_nodes` as a written table, or an error if any are :func:`conflicting_nodes`; one grouping tells both."""
    others, at = [c for c in nodes.columns if c != "identifier"], F.struct("ord")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in others]
    merged = nodes.withColumn("_payload", _payload(nodes)).groupBy("identifier").agg(*last, (F.min("_payload") != F.max("_payload")).alias("_clash"))
    merged = materialize(merged, "merged")
    if clash := merged.filter("_clash").head(1):
        raise ValueError(f"two nodes share the id {clash[0]['identifier']}")
    return merged.drop("_clash")


def write_graph(graph: Graph, path: str) -> None:
    graph.nodes.sortWithinPartitions("file_path", "line_start").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


# ---------------------------------------------------------------- lookups

def file_keys(*tables: DataFrame) -> list[str]:
    """What names a file in all of these tables: its path, and its checkout where each of them holds several."""
    return ["graph_id", "file_path"] if all("graph_id" in t.columns for t in tables) else ["file_path"]


def nodes_at_points(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of ``points`` (``file, line_number``) with each node whose lines hold them."""
    keys = file_keys(nodes, points)
    p = points.withColumns({"file_path": F.col("file"), "_line": F.col("line_number")})
    return intervals.points_in(p, nodes, keys, "_line", "line_start", "line_end").drop("_line")


def nodes_at_spans(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """``context_id, identifier`` of each node that shares a line with a span of the context.

    Either the node begins inside the span, or the span begins inside the node and behind its first line.
    """
    keys = file_keys(nodes, spans)
    n = nodes.select("identifier", *keys, "line_start", F.greatest("line_start", "line_end").alias("line_end"))
    s = spans.select("context_id", *keys, "start_line", "end_line").filter("start_line <= end_line").distinct()
    begins = intervals.points_in(n, s, keys, "line_start", "start_line", "end_line").select("context_id", "identifier")
    rest = n.withColumn("_first", F.col("line_start") + 1)
    inside = intervals.points_in(s, rest, keys, "start_line", "_first", "line_end").select("context_id", "identifier")
    return begins.union(inside).distinct()


# ---------------------------------------------------------------- traversals

def adjacency(edges: DataFrame, types: tuple[str, ...] | None = None, directed: str = "both", typed: bool = False) -> DataFrame:
    """``at, to[, etype]`` without self loops; ``directed`` is ``both``, ``out`` or ``in``.

    Edges are merged, so a row repeats only for other types or the opposite edge; a traversal's own steps drop that.
    """
    e = edges.filter(F.col("type").isin(*types)) if types else edges
    e = e.filter("src <> dst") if directed == "both" else e
    out = e.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("type").alias("etype"))
    back = e.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.col("type").alias("etype"))
    rows = {"both": out.union(back), "out": out, "in": back}[directed]
    return rows if typed else rows.select("at", "to")


@dataclass(frozen=True)
class Neighbours:
    """The adjacency as lists, bucketed by node (and type) and part: a level joins it without an exchange.

    A node with more than ``LIST`` neighbours is a hub: its neighbours lie in several parts, in different buckets, and ``hubs`` says
    in how many, so that no task reads them all.
    """

    lists: DataFrame  # at[, etype], part, to: array
    hubs: DataFrame  # at[, etype], parts
    keys: list[str]

    def of(self, front: DataFrame, keys: list[str]) -> DataFrame:
        """``keys, id``: where one hop leads from the rows ``keys, id`` of ``front``."""
        at = front.withColumnRenamed("id", "at").join(self.hubs, self.keys, "left")
        at = at.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return at.join(self.lists, [*self.keys, "part"]).select(*keys, F.explode("to").alias("id"))


#: Neighbours in a list.
LIST = 4096
#: Estimated bytes from which an adjacency is worth writing as lists.
LISTED_BYTES = 256 << 20
#: Exchanges of all its rows that writing lists and their reading cost as much as.
LISTED_READS = 2


def broadcast(df: DataFrame) -> bool:
    """Whether a join sends this written table to all tasks, by the session's limit."""
    size = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return estimated_bytes(df) <= size


def neighbours(adj: DataFrame) -> Neighbours:
    """Writes ``adj (at, to[, etype])`` as bucketed lists."""
    keys = [c for c in ("at", "etype") if c in adj.columns]
    degrees = adj.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LIST)
    hubs = materialize(degrees.select(*keys, F.ceil(F.col("n") / LIST).cast("int").alias("parts")), "hubs")
    part = F.coalesce(F.pmod(F.xxhash64("to"), F.col("parts")).cast("int"), F.lit(0))
    dealt = adj.join(hubs, keys, "left").select(*keys, part.alias("part"), "to")
    n = int(adj.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = dealt.repartition(n, *keys, "part").groupBy(*keys, "part").agg(F.collect_set("to").alias("to"))  # where they are already
    return Neighbours(bucketed(lists, "lists", [*keys, "part"]), hubs, keys)


#: Kinds of ids up to which a level is told which of them it meets.
KINDS = 64


def _kind(column: str, shared: list[str]) -> Column:
    """What an id says before its first colon, with its edge type where paths keep to one; null without a colon."""
    kind = F.when(F.contains(column, F.lit(":")), F.split_part(column, F.lit(":"), F.lit(1)))
    return F.when(kind.isNotNull(), F.concat_ws("\n", *shared, kind))


def _kinds(front: DataFrame, shared: list[str]) -> list[str] | None:
    """The kinds of the ids of ``front``; None if there are more than ``KINDS``, or ids without one."""
    kinds = front.select(_kind("id", shared).alias("k"))
    # Where ids name many, as those of many checkouts do, the first rows tell it.
    if kinds.limit(64 * KINDS).distinct().limit(KINDS + 1).count() > KINDS:
        return None
    found = [r[0] for r in kinds.distinct().limit(KINDS + 1).collect()]
    return None if len(found) > KINDS or None in found else found


def _read_by_kinds(adj: DataFrame, kinds: list[str], hops: int, shared: list[str]) -> float:
    """At most how often as many rows as ``adj`` has are met in ``hops`` hops from ids of ``kinds``, if each reads those of its kinds only."""
    steps = adj.groupBy(_kind("at", shared).alias("a"), _kind("to", shared).alias("b")).count().limit(KINDS * KINDS + 1).collect()
    if len(steps) > KINDS * KINDS or any(None in (r["a"], r["b"]) for r in steps):
        return float(hops)
    met, now = 0, set(kinds)
    for _ in range(hops):
        from_now = [r for r in steps if r["a"] in now]
        met, now = met + sum(r["count"] for r in from_now), {r["b"] for r in from_now}
    return met / max(1, sum(r["count"] for r in steps))


def traverse(start: DataFrame, adj: DataFrame, keys: list[str], max_depth: int, mark_start: bool = True, symmetric: bool = False) -> DataFrame:
    """``keys, id, depth``: the least number of hops, at most ``max_depth``, from a row ``keys, id`` of ``start``.

    ``adj`` may carry a key (an edge type), which then holds along the whole path. With ``mark_start`` the start is found at
    depth 0; else it is only found if a path leads back to it. If ``adj`` is ``symmetric``, a hop from depth d leads to depths
    d - 1, d and d + 1 only, so no earlier level is read again. An adjacency of ``LISTED_BYTES`` or more is written as bucketed
    lists once a front is too large to be sent to all tasks and more than one hop is left; a smaller one, or one that small
    fronts meet where it lies, is not. Nor is one whose ids name few kinds, if each level reads the rows of its front's kinds only
    and all of them together fewer than ``LISTED_READS`` of the whole: then no other row is exchanged. From an eighth of these bytes
    on, a level joined edge by edge reads the rows of its front's kinds, too. The last level is not written.
    """
    if max_depth < 0:
        raise ValueError("the depth of a traversal is at least 0")
    shared = [k for k in keys if k in adj.columns]
    front = materialize(start.select(*keys, "id").distinct(), "front")
    levels = [front.withColumn("depth", F.lit(0))] if mark_start else []
    size, near, weighed = estimated_bytes(adj), None, False
    for depth in range(1, max_depth + 1):
        rows = adj
        if size >= LISTED_BYTES // 8 and near is None and not broadcast(front):
            kinds = _kinds(front, shared)
            if size >= LISTED_BYTES and depth < max_depth and not weighed:
                weighed = kinds is not None and _read_by_kinds(adj, kinds, max_depth - depth + 1, shared) < LISTED_READS
                near = None if weighed else neighbours(adj)
            rows = adj if kinds is None else adj.filter(_kind("at", shared).isin(*kinds))
        step = near.of(front, keys) if near else front.withColumnRenamed("id", "at").join(rows, ["at", *shared]).select(*keys, F.col("to").alias("id"))
        step = step.distinct()
        if levels:
            seen = reduce(DataFrame.union, [x.select(*keys, "id") for x in (levels[-2:] if symmetric else levels)])
            step = step.join(seen, [*keys, "id"], "left_anti")
        front = step if depth == max_depth else materialize(step, "front")
        if depth < max_depth and front.isEmpty():
            break
        levels.append(front.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.union, levels) if levels else front.withColumn("depth", F.lit(1)).limit(0)


def bfs(graph: Graph, seeds: DataFrame, max_depth: int, types: tuple[str, ...] | None = None) -> DataFrame:
    """``context_id, start_id, id, depth`` over undirected edges from ``seeds (context_id, start_id)``; no types: all."""
    start = seeds.withColumn("id", F.col("start_id"))
    return traverse(start, adjacency(graph.edges, types or None), ["context_id", "start_id"], max_depth, symmetric=True)


def collapse(found: DataFrame) -> DataFrame:
    """``context_id, id, depth, repeats``: the least depth over all starts, and by how many starts more than one it is found."""
    return found.groupBy("context_id", "id").agg(F.min("depth").alias("depth"), (F.count(F.lit(1)) - 1).cast("int").alias("repeats"))


def bfs_typed(graph: Graph, seeds: DataFrame, max_depth: int, types: tuple[str, ...] | None = None) -> DataFrame:
    """``context_id, id, etype, depth``: hops along one edge type at a time, for the types that the graph has.

    Each start is at depth 0 for every one of those types; a node that only mixed paths reach is missing.
    """
    use = [t for t in (types or model.EDGE_TYPES) if t in graph.types]
    spark = seeds.sparkSession
    kinds = spark.createDataFrame([(t,) for t in use], "etype string")
    start = seeds.withColumn("id", F.col("start_id")).join(F.broadcast(kinds), F.lit(True))  # at most as many rows as types
    found = traverse(start, adjacency(graph.edges, tuple(use) or ("",), typed=True), ["context_id", "start_id", "etype"], max_depth, symmetric=True)
    return found.groupBy("context_id", "id", "etype").agg(F.min("depth").alias("depth"))


def edge_depths(typed: DataFrame) -> DataFrame:
    """``context_id, id, depth, repeats, edge_depths``: the typed depths as a map."""
    pairs = F.sort_array(F.collect_list(F.struct("etype", "depth")))
    rows = typed.groupBy("context_id", "id").agg(F.min("depth").alias("depth"), F.map_from_entries(pairs).alias("edge_depths"))
    return rows.withColumn("repeats", F.lit(0))


def taint(graph: Graph, roots: DataFrame, max_hops: int = 6) -> DataFrame:
    """``context_id, id, hop, taint_score`` backward along data flow from all ``roots (context_id, id)`` of a context.

    A root itself is only found on a cycle or before another root.
    """
    found = traverse(roots, adjacency(graph.edges, model.TAINT_TYPES, "in"), ["context_id"], max_hops, mark_start=False)
    return found.select("context_id", "id", F.col("depth").alias("hop"), scores.taint_of_hop(F.col("depth")).alias("taint_score"))


def attach_taint(context_nodes: DataFrame, tainted: DataFrame) -> DataFrame:
    """``taint_score`` of the nodes that ``tainted`` has; the others keep theirs."""
    t = tainted.select("context_id", F.col("id").alias("identifier"), F.col("taint_score").alias("_taint"))
    now = F.col("taint_score") if "taint_score" in context_nodes.columns else F.lit(0.0)
    return context_nodes.join(t, ["context_id", "identifier"], "left").withColumn("taint_score", F.coalesce("_taint", now, F.lit(0.0))).drop("_taint")


#: Contexts in a node's list, at most about so many; of more contexts, each node has several lists.
SHARED = 1024


def induced_edges(graph: Graph, members: DataFrame, types: tuple[str, ...] = model.PATH_FILL_TYPES) -> DataFrame:
    """``context_id, src, dst, type``: directed edges of ``types`` between members of one context, each once as edges are merged."""
    m = materialize(members.select("context_id", F.col("identifier").alias("_id")).distinct(), "members")
    parts = -(-m.select("context_id").distinct().count() // SHARED)
    # A node's contexts are a list: an edge is dealt by either end once, not once for each context of its first end.
    part = [F.pmod(F.xxhash64("context_id"), F.lit(parts)).alias("_part")] if parts > 1 else []
    held = m.groupBy("_id", *part).agg(F.collect_list("context_id").alias("_in"))
    on = [c for c in held.columns if c == "_part"]
    e = graph.edges.filter(F.col("type").isin(*[t for t in types if t in graph.types] or [""])).select("src", "dst", "type")
    e = e.join(held.withColumnsRenamed({"_id": "src", "_in": "_of_src"}), "src").join(held.withColumnRenamed("_id", "dst"), ["dst", *on])
    return e.select(F.explode(F.array_intersect("_of_src", "_in")).alias("context_id"), "src", "dst", "type")


def shortest_tree(roots: DataFrame, adj: DataFrame) -> DataFrame:
    """``context_id, id, parent`` of every node that a root of its context reaches; a root's parent is null.

    ``roots`` has ``context_id, id``; ``adj`` has ``context_id, at, to`` in both directions. Level by level, a node's parent is the least id of
    the level before that is next to it. Only the last two levels can meet the next one.
    """
    front = materialize(roots.select("context_id", "id").distinct().withColumn("parent", F.lit(None).cast("string")), "tree")
    levels = [front]
    while not front.isEmpty():
        step = front.select("context_id", F.col("id").alias("at")).join(adj, ["context_id", "at"]).groupBy("context_id", F.col("to").alias("id")).agg(F.min("at").alias("parent"))
        seen = reduce(DataFrame.union, [x.select("context_id", "id") for x in levels[-2:]])
        front = materialize(step.join(seen, ["context_id", "id"], "left_anti"), "tree")
        levels.append(front)
    return reduce(DataFrame.union, levels)


def undirected(induced: DataFrame) -> DataFrame:
    """``context_id, at, to`` in both directions, without self loops."""
    e = induced.filter("src <> dst")
    way = lambda a, b: F.struct(F.col(a).alias("at"), F.col(b).alias("to"))
    # Both ways of a row at once: a union would make the edges twice.
    return e.select("context_id", F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("_way")).select("context_id", "_way.*").distinct()
