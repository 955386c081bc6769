"""Tuning as data: all weightings of a batch are judged in one job, and a study's batches are rows that a later run goes on from.

What is tried next follows from the judged trials (:mod:`graphloom.plans.parzen`).
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import config
from graphloom.config import BudgetConfig, Coefficients
from graphloom.functions import scores
from graphloom.operators import datasets, ranking, selection
from graphloom.plans import parzen, review
from graphloom.staging import materialize

Config = Coefficients | BudgetConfig
#: Bounds of a weight, by its dotted key; a third number is the step of a whole one.
Space = dict[str, tuple[float, ...]]

# The weights that each strategy is tuned by, and their bounds.
_COMBINER: Space = {"combiner.finding_evidence": (0.1, 0.5), "combiner.security_path": (0.1, 0.5), "combiner.taint": (0.1, 0.5), "combiner.context": (0.1, 0.5)}
_CONTEXT: Space = {"context_breakdown.depth": (0.2, 0.8), "context_breakdown.structure": (0.05, 0.5), "context_breakdown.file_prior": (0.05, 0.5)}
_BREAKDOWNS: Space = {
    "finding_evidence_breakdown.severity": (0.2, 0.7),
    "finding_evidence_breakdown.confidence": (0.1, 0.6),
    "finding_evidence_breakdown.agreement": (0.05, 0.5),
    "security_path_breakdown.sink": (0.1, 0.5),
    "security_path_breakdown.source": (0.1, 0.4),
    "security_path_breakdown.guard": (0.05, 0.3),
    "security_path_breakdown.path_evidence": (0.15, 0.6),
    "security_path_breakdown.high_risk_cwe_evidence_base": (0.3, 0.9),
    "structure_breakdown.render_kind": (0.05, 0.5),
    "structure_breakdown.repeat_bonus": (0.5, 1.0),
    "file_prior_breakdown.same_file": (0.3, 0.9),
    "file_prior_breakdown.same_module": (0.1, 0.6),
    "file_prior_breakdown.generated_penalty": (0.0, 0.5),
}
_EDGES: Space = {
    "edge_type_weights.flows_to": (0.6, 1.0),
    "edge_type_weights.sanitized_by": (0.5, 1.0),
    "edge_type_weights.calls": (0.3, 0.9),
    "edge_type_weights.called_by": (0.3, 0.9),
    "edge_type_weights.defined_by": (0.3, 0.8),
    "edge_type_weights.used_by": (0.2, 0.8),
    "edge_type_weights.contains": (0.1, 0.6),
    "edge_decay_rates.flows_to": (0.6, 0.95),
    "edge_decay_rates.sanitized_by": (0.6, 0.95),
    "edge_decay_rates.calls": (0.5, 0.9),
    "edge_decay_rates.called_by": (0.5, 0.9),
    "edge_decay_rates.defined_by": (0.5, 0.9),
    "edge_decay_rates.used_by": (0.5, 0.9),
    "edge_decay_rates.contains": (0.3, 0.8),
    "sanitizer_bypass_bonus": (0.0, 0.5),
    "sanitizer_presence_damp": (0.0, 1.0),
}
_BUDGET: Space = {
    "depth_decay": (0.25, 1.2),
    "context_strength": (0.1, 0.75),
    "role_prior_temperature": (0.6, 1.8),
    "finding_evidence_scale": (0.6, 1.5),
    "taint_evidence_scale": (0.6, 1.5),
    "cpg_role_evidence_scale": (0.6, 1.5),
    "lexical_fallback_cap": (0.2, 0.6),
    "token_cost_power": (0.0, 0.8),
    "novelty_penalty": (0.0, 0.7),
    "role_coverage_bonus": (0.05, 0.4),
    "small_node_token_threshold": (120, 420, 20),
    "local_window_radius": (1, 6, 1),
    "budget_safety_ratio": (0.85, 1.0),
}
SPACES: dict[str, Space] = {
    "current": _COMBINER | _CONTEXT | _BREAKDOWNS,
    "multiplicative_boost": {"security_boost_weight": (0.25, 3.0)} | _CONTEXT | _BREAKDOWNS,
    "cpg_structural": _COMBINER | _CONTEXT | _EDGES,
    "evidence_budgeted": _BUDGET,
}

_STUDY = "batch int, config_id string, weights map<string,double>, accuracy double"


def trials(nodes: DataFrame, configs: dict[str, Coefficients], threshold: float) -> DataFrame:
    """``config_id, n, invalid, accuracy``: how well each weighting's additive score tells ``label``."""
    rows = [(k, *asdict(c.combiner).values()) for k, c in configs.items()]
    weights = nodes.sparkSession.createDataFrame(rows, "config_id string, wf double, ws double, wt double, wc double")
    score = scores.clamp6(F.col("wf") * F.col("finding_evidence_score") + F.col("ws") * F.col("security_path_score") + F.col("wt") * F.col("taint_score") + F.col("wc") * F.col("context_score"))
    scored = nodes.join(F.broadcast(weights), F.lit(True))  # a handful of rows, made on the driver
    return datasets.accuracy(scored.select("config_id", (score >= threshold).alias("predicted"), "label"), ["config_id"])


def judged_contexts(
    around: DataFrame, edges: DataFrame, nodes: DataFrame, lines: DataFrame, labels: DataFrame, strategy: str, configs: dict[str, Config], send: review.Send,
    budget: int = 2048, rescore: Callable[[DataFrame, Coefficients], DataFrame] | None = None,
) -> DataFrame:
    """``config_id, n, invalid, accuracy``: what ``send`` says of the contexts that ``strategy`` shows under each weighting.

    ``around`` and ``edges`` are prepared neighbourhoods, which no weight changes; ``labels`` has ``context_id, label``.
    ``rescore`` sets the two security scores anew where a weighting changes them. A labelled context that shows nothing
    counts as an invalid answer.
    """
    shown = []
    for name, c in configs.items():
        scored = rescore(around, c) if rescore and isinstance(c, Coefficients) else around
        weights = {"coefficients": c} if isinstance(c, Coefficients) else {"config": c}
        order = ranking.rank(scored, strategy, budget=budget, **weights)
        text = selection.render(selection.path_fill(order, edges, lines, budget), nodes, lines)
        shown.append(text.select(F.lit(name).alias("config_id"), "context_id", "text"))
    texts = reduce(DataFrame.unionByName, shown)
    # The same text is asked about once, however many weightings show it.
    texts = materialize(texts.withColumn("sample_id", F.sha1(F.col("text").cast("binary"))), "shown")
    asked = texts.select("sample_id", review.prompt(F.col("text")).alias("prompt")).dropDuplicates(["sample_id"])
    answers = materialize(review.ask(asked, send).select("sample_id", "response"), "answers")
    names = labels.sparkSession.createDataFrame([(n,) for n in configs], "config_id string")
    wanted = labels.select("context_id", F.col("label").cast("int").alias("label")).join(F.broadcast(names), F.lit(True))
    rows = wanted.join(texts.join(answers, "sample_id"), ["config_id", "context_id"], "left")
    return review.judge(rows, ["config_id"])


def best(results: DataFrame) -> str | None:
    row = results.agg(F.max_by("config_id", F.struct("accuracy", "config_id")).alias("best")).first()
    return row["best"]


def studied(spark: SparkSession, path: str) -> DataFrame:
    """``batch, config_id, weights, accuracy`` of the batches that a study has judged; of none, where there is no study yet."""
    try:
        return spark.read.schema(_STUDY).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STUDY)


def search(base: Config, space: Space, judge: Callable[[dict[str, Config]], DataFrame], batches: int = 3, size: int = 16, seed: int = 7, study: str | None = None) -> tuple[Config, float]:
    """Batches of trials, one ``judge`` job each; the first is drawn evenly, each later one by :func:`graphloom.plans.parzen.batch`.

    Each judged batch is added to the folder ``study``. A later search with the same arguments goes on after the last one
    and ends where it would have ended at once; with more ``batches`` it goes further. A trial without a result is no trial.
    """
    spark = SparkSession.active()
    done = studied(spark, study).orderBy("batch", "config_id").collect() if study else []  # a row a trial
    top, top_score, trials = base, -1.0, []
    for b in range(batches):
        rows = [r for r in done if r["batch"] == b]
        if not rows:
            drawn = parzen.batch(random.Random(f"{seed}-{b}"), space, trials, size, size)
            made = {f"{b}-{i}": _whole(space, w) for i, w in enumerate(drawn)}
            found = {r["config_id"]: r["accuracy"] for r in judge({n: config.overlay(base, w) for n, w in made.items()}).collect()}
            rows = [{"batch": b, "config_id": n, "weights": {k: float(x) for k, x in w.items()}, "accuracy": found.get(n)} for n, w in sorted(made.items())]
            if study:
                spark.createDataFrame(rows, _STUDY).coalesce(1).write.mode("append").parquet(study)
        for r in rows:
            if r["accuracy"] is None:
                continue
            trials.append((dict(r["weights"]), r["accuracy"]))
            if r["accuracy"] > top_score:
                top, top_score = config.overlay(base, _whole(space, r["weights"])), r["accuracy"]
    return top, top_score


def _whole(space: Space, weights: dict[str, float]) -> dict[str, float]:
    return {k: int(x) if len(space.get(k, ())) == 3 else x for k, x in weights.items()}
