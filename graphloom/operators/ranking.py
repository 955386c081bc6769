"""The ranking strategies: each takes context nodes and adds ``score`` and ``rank`` within the context.

Input rows: ``context_id, identifier, kind, name, file_path, line_start, line_end, depth, repeats, finding_evidence_score,
security_path_score, taint_score, edge_depths, snippet, ord``. Ties end in ``ord`` and then ``identifier``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from graphloom import model
from graphloom.config import BudgetConfig, Coefficients
from graphloom.functions import scores, text


def _context() -> WindowSpec:
    return Window.partitionBy("context_id")


@dataclass(frozen=True)
class Hints:
    sink: tuple[str, ...] = model.SINK_HINTS
    source: tuple[str, ...] = model.SOURCE_HINTS
    guard: tuple[str, ...] = model.GUARD_HINTS


def aggregate(nodes: DataFrame) -> DataFrame:
    """One row a node: the first row's attributes, the least depth, all occurrences but one as ``repeats``."""
    others = [c for c in nodes.columns if c not in ("context_id", "identifier", "depth", "repeats")]
    first = F.min_by(F.struct(*others), F.struct("ord")).alias("_first")
    rows = nodes.groupBy("context_id", "identifier").agg(F.min("depth").alias("depth"), (F.sum(F.col("repeats") + 1) - 1).cast("int").alias("repeats"), first)
    return rows.select("context_id", "identifier", "depth", "repeats", "_first.*")


def _anchored(nodes: DataFrame) -> DataFrame:
    """Adds ``_most``, the largest ``repeats`` of a context, and ``_near``, which relates a node's file to the context's anchors.

    The anchors are the files of a context's shallowest nodes. No row carries all of them: a directory, or a leading one, has
    an anchor if its least depth is the context's, and paths of which one is the tail of the other have the same last
    segment. So a row meets the anchors of its own file name only, and for a plain tail of letters those in the root.
    One shuffle by context and two local sorts serve all windows. A null path is near nothing and no anchor.
    """
    path = F.col("file_path")
    up = F.when(path.isNotNull(), text.parent_dir(path))
    keys = {"_dir": up, "_lead": F.when(up != "", F.split_part(up, F.lit("/"), F.lit(1))), "_base": F.regexp_extract(path, "[^/]*$", 0), "_at": F.when(path.isNotNull(), F.col("depth"))}
    rows = nodes.withColumns(keys).repartition("context_id").sortWithinPartitions("context_id", "_lead", "_dir")
    in_lead, in_dir = (Window.partitionBy("context_id", *k) for k in (["_lead"], ["_lead", "_dir"]))
    rows = rows.withColumns({"_dir_least": F.min("_at").over(in_dir), "_lead_least": F.min("_at").over(in_lead), "_least": F.min("depth").over(_context()), "_most": F.max("repeats").over(_context())})
    anchor = F.when(F.col("_at") == F.col("_least"), path)
    rows = rows.withColumn("_top", F.collect_set(F.when(F.col("_dir") == "", anchor)).over(_context()))
    rows = rows.withColumn("_alike", F.collect_set(anchor).over(Window.partitionBy("context_id", "_base")))
    ends = lambda among: F.exists(among, lambda a: F.endswith(path, a))
    near = F.struct(
        (path.isNotNull() & F.exists("_alike", lambda a: text.path_match(path, a))).alias("same"),
        (path.isNotNull() & (ends(F.col("_alike")) | ends(F.col("_top")))).alias("ends"),
        (path.isNotNull() & F.coalesce(F.col("_dir_least") == F.col("_least"), F.lit(False))).alias("dir"),
        (F.col("_lead").isNotNull() & F.coalesce(F.col("_lead_least") == F.col("_least"), F.lit(False))).alias("lead"),
    )
    return rows.withColumn("_near", near).drop(*keys, "_dir_least", "_lead_least", "_least", "_top", "_alike")


def context_scores(nodes: DataFrame, c: Coefficients, edge_aware: bool = False) -> DataFrame:
    depth = scores.edge_aware_depth(F.col("depth"), F.col("edge_depths"), c) if edge_aware else scores.hop_decay(F.col("depth"), c)
    shape = scores.structure(F.col("kind"), F.col("repeats"), F.col("_most"), c)
    prior = scores.file_prior(F.col("_near"), text.generated(F.col("file_path"), F.col("snippet")), c)
    return _anchored(nodes).withColumn("context_score", scores.context(depth, shape, prior, c)).drop("_near", "_most")


def _ranked(nodes: DataFrame, keys: list[Column], tail: tuple[str, ...] = ("ord", "identifier")) -> DataFrame:
    order = _context().orderBy(F.col("depth") != 0, *keys, *tail)
    return nodes.withColumn("rank", F.row_number().over(order))


def current(nodes: DataFrame, c: Coefficients, **_) -> DataFrame:
    rows = context_scores(aggregate(nodes), c)
    rows = rows.withColumn("score", scores.additive(*map(F.col, ("finding_evidence_score", "security_path_score", "taint_score", "context_score")), c))
    return _ranked(rows, [F.desc("score"), F.col("depth")])


def multiplicative_boost(nodes: DataFrame, c: Coefficients, **_) -> DataFrame:
    rows = context_scores(aggregate(nodes), c)
    rows = rows.withColumn("score", scores.multiplicative(F.col("finding_evidence_score"), F.col("security_path_score"), F.col("context_score"), c))
    return _ranked(rows, [F.desc("score"), F.col("depth")])


def depth_repeats_context(nodes: DataFrame, c: Coefficients, **_) -> DataFrame:
    rows = context_scores(aggregate(nodes), c).withColumn("score", F.col("context_score"))
    return _ranked(rows, [F.col("depth"), F.desc("repeats"), F.desc("context_score")])


def random_picking(nodes: DataFrame, c: Coefficients, seed: int = 42, **_) -> DataFrame:
    """A seeded order inside the roots and inside the rest, the same on every run and cluster: by a digest of seed and id."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), "identifier").cast("binary"))
    return _ranked(aggregate(nodes).withColumns({"score": F.lit(0.0), "context_score": F.lit(0.0)}), [order])


def dummy(nodes: DataFrame, c: Coefficients, **_) -> DataFrame:
    """Input order, duplicates and all."""
    rows = nodes.withColumns({"score": F.lit(0.0), "context_score": F.lit(0.0)})
    return rows.withColumn("rank", F.row_number().over(_context().orderBy("ord", "identifier")))


def structural(nodes: DataFrame, c: Coefficients, hints: Hints = Hints(), **_) -> DataFrame:
    rows = context_scores(aggregate(nodes), c, edge_aware=True)
    has = {k: F.coalesce(F.bool_or(text.contains_any(F.col("snippet"), h)).over(_context()), F.lit(False)) for k, h in (("_sink", hints.sink), ("_source", hints.source))}
    rows = rows.withColumns(has)
    bonus = scores.flow_bonus(F.col("edge_depths"), F.col("_sink"), F.col("_source"), c)
    rows = rows.withColumn("security_path_score", F.when(bonus > 0, scores.clamp6(F.col("security_path_score") + bonus)).otherwise(F.col("security_path_score"))).drop("_sink", "_source")
    rows = rows.withColumn("score", scores.additive(*map(F.col, ("finding_evidence_score", "security_path_score", "taint_score", "context_score")), c))
    plain = ~(F.col("finding_evidence_score") + F.col("security_path_score") > c.security_tier_threshold)
    return _ranked(rows, [plain, F.desc("score"), F.col("depth")], ("file_path", "line_start", "ord", "identifier"))


def candidates(nodes: DataFrame, b: BudgetConfig, c: Coefficients, hints: Hints = Hints()) -> DataFrame:
    """Scored candidates of the budgeted strategy, oversized nodes clipped to a window around their first line.

    ``clipped_snippet`` may be given (the text of the clipped lines); otherwise the first ``2 r + 1`` lines stand for it.
    """
    rows = _anchored(aggregate(nodes)).withColumn("_full", F.when(F.coalesce("snippet", F.lit("")) == "", F.lit(0)).otherwise(text.tokens(F.col("snippet"))))
    big = F.col("_full") > b.small_node_token_threshold
    r = b.local_window_radius
    low = F.greatest(F.lit(1), F.col("line_start") - r)
    around = F.col("clipped_snippet") if "clipped_snippet" in nodes.columns else F.array_join(F.slice(F.split("snippet", "\n"), 1, r + 1), "\n")
    rows = rows.withColumns({
        "clipped_start": F.when(big, low).otherwise(F.col("line_start")),
        "clipped_end": F.when(big, F.greatest(low, F.col("line_start") + r)).otherwise(F.col("line_end")),
        "_text": F.rtrim(F.when(big, around).otherwise(F.col("snippet"))),
    })
    sink, source, guard = (text.contains_any(F.col("_text"), h) for h in (hints.sink, hints.source, hints.guard))
    made = text.generated(F.col("file_path"), F.col("_text"))
    edges, taint, fe = F.col("edge_depths"), F.col("taint_score"), F.col("finding_evidence_score")
    rows = rows.withColumns({"tokens": F.when(F.coalesce("_text", F.lit("")) == "", F.lit(0)).otherwise(text.tokens(F.col("_text"))), "roles": scores.roles(F.col("depth"), edges, taint, fe, made, sink, source, guard)})
    rows = rows.withColumns({
        "distance": scores.graph_distance(F.col("depth"), edges, b),
        "confidence": scores.edge_confidence(edges),
        "lexical": scores.lexical_only(F.col("roles"), edges, taint, fe, made, sink | source | guard),
        "context_score": scores.budget_context(F.col("roles"), F.col("kind"), F.col("repeats"), F.col("_most"), F.col("_near"), c),
    })
    rows = rows.withColumn("score", scores.relevance(fe, taint, F.col("roles"), F.col("distance"), F.col("confidence"), F.col("context_score"), F.col("lexical"), b))
    return rows.drop("_near", "_most", "_full", "_text")


def evidence_budgeted(nodes: DataFrame, c: Coefficients, budget: int = 2048, config: BudgetConfig = BudgetConfig(), hints: Hints = Hints(), **_) -> DataFrame:
    from graphloom.operators.selection import greedy

    return greedy(candidates(nodes, config, c, hints), budget, config)


@dataclass(frozen=True)
class Strategy:
    rank: Callable[..., DataFrame]
    edge_paths: bool
    taint: bool
    tuned: bool = True  # whether given weights count; else the built-in ones do


STRATEGIES = {
    "current": Strategy(current, False, True),
    "depth_repeats_context": Strategy(depth_repeats_context, False, True),
    "random_picking": Strategy(random_picking, False, True),
    "multiplicative_boost": Strategy(multiplicative_boost, False, True),
    "dummy": Strategy(dummy, False, False),
    "cpg_structural": Strategy(structural, True, True),
    "evidence_budgeted": Strategy(evidence_budgeted, True, True),
    "current_default": Strategy(current, False, True, tuned=False),
    "multiplicative_boost_default": Strategy(multiplicative_boost, False, True, tuned=False),
}


def pick(names: list[str] | None = None) -> dict[str, Strategy]:
    """The named strategies, or all; an unknown name is an error."""
    if unknown := sorted(set(names or ()) - set(STRATEGIES)):
        raise ValueError(f"no strategy {', '.join(unknown)}; there are {', '.join(STRATEGIES)}")
    return {k: s for k, s in STRATEGIES.items() if not names or k in names}


def rank(nodes: DataFrame, strategy: str, coefficients: Coefficients | None = None, **options) -> DataFrame:
    s = pick([strategy])[strategy]
    return s.rank(nodes, coefficients if coefficients and s.tuned else Coefficients(), **options)
