"""Selection under a token budget, and rendering.

What is sequential within a context, the choice by gain and the budget's scan, is plain Python over one context after another;
trees, chains, lines and texts are joins and columns.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.config import BudgetConfig
from graphloom.functions import text
from graphloom.operators import graph
from graphloom.staging import materialize, spread


def greedy(scored: DataFrame, budget: int, b: BudgetConfig) -> DataFrame:
    """``scored`` with ``rank`` and ``selected``: again and again the candidate with most gain that still fits.

    Order: selected roots, other selected in the order of selection, then the rest in input order.
    """
    effective = max(1, int(budget * b.budget_safety_ratio))
    # Only rows that fit at all, and of those what the choice looks at, go to Python; the chosen come back by id.
    need = ["context_id", "identifier", "ord", "tokens", "score", "file_path", "line_start", "clipped_start", "clipped_end", "roles"]
    scored = materialize(scored, "scored")

    def choose(own: dict[str, list]) -> dict[str, list]:
        order = by_gain(own, effective, b)
        return {"context_id": [own["context_id"][i] for i in order], "identifier": [own["identifier"][i] for i in order], "_place": list(range(len(order)))}

    chosen = by_context(scored.filter(F.col("tokens") <= effective).select(*need), ["ord", "identifier"], choose, "context_id string, identifier string, _place int")
    chosen = materialize(chosen, "chosen")
    placed = scored.join(F.broadcast(chosen) if graph.broadcast(chosen) else chosen, ["context_id", "identifier"], "left")
    root = F.col("_place").isNotNull() & (F.col("depth") == 0)
    w = Window.partitionBy("context_id").orderBy(~F.coalesce(root, F.lit(False)), F.col("_place").asc_nulls_last(), "ord", "identifier")
    return placed.withColumns({"rank": F.row_number().over(w), "selected": F.col("_place").isNotNull()}).select(*scored.columns, "rank", "selected")


def by_gain(part: dict[str, list], budget: int, b: BudgetConfig) -> list[int]:
    """The rows of one context in the order in which they are chosen, from a heap of gains.

    A choice changes the gains of its own file, whose lines are now shown, and of the holders of roles that it is the first to
    cover. Only those are put on the heap anew; what does not fit now never will.
    """
    columns = ["tokens", "score", "file_path", "line_start", "clipped_start", "clipped_end"]
    tokens, score, path, line, first, last = (part[c] for c in columns)
    roles = [frozenset(r) for r in part["roles"]]
    cost = [max(1.0, t**b.token_cost_power) for t in tokens]
    in_file, with_role, shown = defaultdict(list), defaultdict(list), defaultdict(set)
    for i, f in enumerate(path):
        in_file[f].append(i)
        for r in roles[i]:
            with_role[r].append(i)
    covered: set[str] = set()
    turn = [0] * len(tokens)  # of each row's valid entry; -1 once it is chosen

    def entry(i: int) -> tuple:
        own, seen = range(first[i], last[i] + 1), shown[path[i]]
        both = sum(x in seen for x in own) if seen else 0
        redundancy = both / (len(own) + len(seen) - both) if both else 0.0
        gain = score[i] * (1 + b.role_coverage_bonus * len(roles[i] - covered)) * max(0.0, 1 - b.novelty_penalty * redundancy) / cost[i]
        turn[i] += 1
        return -gain, -score[i], path[i], line[i], i, turn[i]

    heap = [entry(i) for i in range(len(tokens)) if tokens[i] <= budget]
    heapq.heapify(heap)
    order = []
    while heap:
        *_, i, at = heapq.heappop(heap)
        if at != turn[i] or tokens[i] > budget:
            continue
        order.append(i)
        turn[i], budget = -1, budget - tokens[i]
        shown[path[i]].update(range(first[i], last[i] + 1))
        new = roles[i] - covered
        covered |= new
        for j in set(in_file[path[i]]).union(*(with_role[r] for r in new)):
            if turn[j] >= 0 and tokens[j] <= budget:
                heapq.heappush(heap, entry(j))
    return order


def by_context(rows: DataFrame, order: list[str], work: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``work`` of each context's columns, its rows in ``order``.

    Contexts come one after another out of sorted partitions, many in an Arrow batch, and one at a time is held: a group that
    is handed to Python by itself costs milliseconds, however small it is.
    """
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for batch in batches:
            own = {c: batch[c].tolist() for c in names}
            key = own["context_id"]
            done = []
            cuts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)] if key else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held["context_id"][0] == key[a]:
                    for c in names:
                        held[c] += own[c][a:b]
                    continue
                if held:
                    done.append(work(held))
                held = {c: own[c][a:b] for c in names}
            if done:
                yield pd.DataFrame({c: [x for d in done for x in d[c]] for c in done[0]})
        if held:
            yield pd.DataFrame(work(held))

    return spread(rows, "context_id").sortWithinPartitions("context_id", *order).mapInPandas(run, schema)


def _fill(rows: dict[str, list], budget: int) -> dict[str, list]:
    """The scan of one context: its nodes by rank, with parent and lines, and then the lengths of the lines of their files."""
    n = rows["_line"].index(True) if True in rows["_line"] else len(rows["_line"])
    size, seen, first = {}, {}, {}
    for name, part in groupby(range(n, len(rows["_line"])), rows["_file"].__getitem__):
        places = list(part)
        at = np.array([rows["_from"][k] for k in places], np.int64)
        first[name] = int(at[0])
        size[name] = np.full(int(at[-1]) - first[name] + 1, -1, np.int64)  # -1: no such line
        size[name][at - first[name]] = [rows["_to"][k] for k in places]
        seen[name] = size[name] < 0
    ids = rows["identifier"][:n]
    place = {i: k for k, i in enumerate(ids)}
    parent = [place.get(p, -1) for p in rows["parent"][:n]]
    where = []
    for f, a, b in zip(rows["_file"][:n], rows["_from"], rows["_to"], strict=False):
        where.append((f, slice(max(0, a - first[f]), max(0, b + 1 - first[f]))) if f in first else None)

    def unseen(i: int) -> tuple[int, int]:
        """Characters and lines that a node would add; they count as shown from now on."""
        if where[i] is None:
            return 0, 0
        f, span = where[i]
        new = ~seen[f][span]
        seen[f][span] = True
        return int(size[f][span][new].sum()), int(new.sum())

    def forget(undo: list[tuple]) -> None:
        for f, span, old in undo:
            seen[f][span] = old

    chosen = [False] * n
    chars = shown = 0
    for i in range(n):
        if rows["depth"][i] == 0:
            chosen[i] = True
            c, m = unseen(i)
            chars, shown = chars + c, shown + m
    for i in range(n):
        if chosen[i]:
            continue
        chain, at = [i], parent[i]
        while at >= 0 and not chosen[at]:
            chain.append(at)
            at = parent[at]
        more, count, undo = 0, 0, []
        for k in chain:
            if where[k] is not None:
                undo.append((*where[k], seen[where[k][0]][where[k][1]].copy()))
            c, m = unseen(k)
            more, count = more + c, count + m
            if (chars + more + max(0, shown + count - 1)) // 3 > budget:
                break  # more lines only add to it
        if max(1, (chars + more + max(0, shown + count - 1)) // 3) <= budget:
            for k in chain:
                chosen[k] = True
            chars, shown = chars + more, shown + count
        else:
            forget(undo[::-1])
    return {c: [x for x, yes in zip(rows[c], chosen, strict=False) if yes] for c in ("context_id", "identifier", "rank")}


def ways(roots: DataFrame, induced: DataFrame) -> DataFrame:
    """``context_id, identifier, parent``: the tree along which :func:`path_fill` goes from ``roots (context_id, id)``."""
    return graph.shortest_tree(roots, materialize(graph.undirected(induced), "near")).withColumnRenamed("id", "identifier")


def path_fill(ranked: DataFrame, induced: DataFrame, lines: DataFrame, budget: int, tree: DataFrame | None = None) -> DataFrame:
    """``context_id, identifier, rank`` of the nodes to show: all roots, then by rank each node with its way to a root.

    The ways come from a tree that joins build for all contexts at once (:func:`graphloom.operators.graph.shortest_tree`). What is
    left to the scan of one context, whose rows are a node and a line of its files each, is the budget: a node whose added
    lines would exceed it is passed over, not the end. Tokens are those of the rendered text. A written table: rendering reads
    it more than once, and the scan should not run again. Rankings of the same nodes may share the ``tree`` of their :func:`ways`.
    """
    keys = graph.file_keys(ranked, lines)
    name = F.concat_ws("\u001f", *keys)
    first = {c: F.min_by(c, "rank").alias(c) for c in (*keys, "line_start", "line_end")}
    nodes = ranked.groupBy("context_id", "identifier").agg(F.min("rank").alias("rank"), F.min("depth").alias("depth"), *first.values())
    nodes = materialize(nodes, "nodes")
    if tree is None:
        tree = ways(nodes.filter("depth = 0").select("context_id", F.col("identifier").alias("id")), induced)
    whole = lambda c, least: F.coalesce(F.col(c).cast("long"), F.lit(least)).alias
    placed = nodes.join(tree, ["context_id", "identifier"], "left").select(
        "context_id", F.lit(False).alias("_line"), name.alias("_file"), whole("line_start", 0)("_from"), whole("line_end", -1)("_to"), "identifier", "parent", F.col("rank").cast("int").alias("rank"), F.col("depth").cast("int").alias("depth")
    )
    spans = nodes.groupBy("context_id", *keys).agg(F.min("line_start").alias("_from"), F.max("line_end").alias("_to"))
    shown = lines.join(spans, keys).filter(F.col("line_no").between(F.col("_from"), F.col("_to")))
    none, zero = F.lit(None).cast("string"), F.lit(0)
    length = F.coalesce(F.char_length(text.sanitize_line(F.col("text"))), zero).cast("long")
    shown = shown.select("context_id", F.lit(True), name, F.col("line_no").cast("long"), length, none, none, zero, zero)
    rows = placed.union(shown)
    filled = by_context(rows, ["_line", "rank", "identifier", "_file", "_from"], lambda own: _fill(own, budget), "context_id string, identifier string, rank int")
    return materialize(filled, "selected")


def render(selected: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """``context_id, text, tokens``: the selected nodes' lines, each once, by file in rank order and then by line."""
    keys = graph.file_keys(nodes, lines)
    rows = selected.select("context_id", "identifier", "rank").join(nodes.select("identifier", *keys, "line_start", "line_end"), "identifier")
    numbers = F.array_distinct(F.flatten(F.collect_list(F.sequence("line_start", "line_end"))))
    files = rows.groupBy("context_id", *keys).agg(F.min("rank").alias("file_rank"), numbers.alias("numbers"))
    wanted = files.select("context_id", *keys, "file_rank", F.explode("numbers").alias("line_no"))
    shown = wanted.join(lines.select(*keys, "line_no", text.sanitize_line(F.col("text")).alias("t")), [*keys, "line_no"])
    body = F.array_sort(F.collect_list(F.struct("file_rank", "file_path", "line_no", "t")))
    out = shown.groupBy("context_id").agg(F.array_join(F.transform(body, lambda x: x["t"]), "\n").alias("text"))
    return out.withColumn("tokens", text.tokens(F.col("text")))


def snippets(nodes: DataFrame, lines: DataFrame, start: str = "line_start", end: str = "line_end", name: str = "snippet") -> DataFrame:
    """``nodes`` with the text of their lines, joined and right-trimmed; lines that do not exist are left out."""
    files = graph.file_keys(nodes, lines)
    keys = ["identifier", *files, start, end]
    spans = nodes.select(*keys).distinct().withColumn("line_no", F.explode(F.sequence(start, F.greatest(start, end))))
    got = spans.join(lines.select(*files, "line_no", "text"), [*files, "line_no"]).groupBy(*keys)
    body = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    got = got.agg(F.regexp_replace(F.array_join(body, "\n"), r"\s+$", "").alias(name))
    return nodes.join(got, keys, "left").withColumn(name, F.coalesce(name, F.lit("")))
