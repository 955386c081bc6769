"""Scores of context nodes as columns, so that all of them stay in generated code."""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom import model
from graphloom.config import BudgetConfig, Coefficients, Tiers
from graphloom.functions import text


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def clamp6(x: Column) -> Column:
    """Rounded to six places, then held to the unit interval."""
    return clamp(F.round(x, 6))


def lookup(key: Column, table: dict, default: float) -> Column:
    out = F.lit(float(default))
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(float(v))).otherwise(out)
    return out


def noisy_or(values: list[Column]) -> Column:
    return F.lit(1.0) - reduce(lambda a, b: a * b, [F.lit(1.0) - clamp(v) for v in values]) if values else F.lit(0.0)


def hop_decay(depth: Column, c: Coefficients) -> Column:
    return lookup(depth, dict(c.hop_decay_by_depth), c.hop_decay_default)


def taint_of_hop(hop: Column) -> Column:
    return lookup(hop, model.TAINT_BY_HOP, model.TAINT_FAR)


def tier_of_issue(issue: Column) -> Column:
    out = F.lit("MEDIUM")
    for lo, hi, tier in model.ISSUE_TIERS:
        out = F.when((issue >= lo) & (issue < hi), F.lit(tier)).otherwise(out)
    return out


def of_tier(tier: Column, t: Tiers, unknown: float) -> Column:
    return lookup(F.upper(tier), {k.upper(): v for k, v in asdict(t).items()}, unknown)


def structure(kind: Column, repeats: Column, most: Column, c: Coefficients) -> Column:
    p = c.structure_breakdown
    ratio = F.least(F.lit(1.0), repeats / F.greatest(most, F.lit(1)))
    return clamp6(p.render_kind * lookup(kind, dict(c.render_kind_scores), model.DEFAULT_KIND_SCORE) + p.repeat_bonus * ratio)


def module(near: Column, full: float = 1.0, part: float = 0.5) -> Column:
    """``full`` for a file in the directory of one of the context's shallowest nodes, ``part`` for a common leading directory."""
    return F.when(near["dir"], F.lit(full)).when(near["lead"], F.lit(part)).otherwise(F.lit(0.0))


def file_prior(near: Column, is_generated: Column, c: Coefficients) -> Column:
    """``near``: how the file relates to those of the context's shallowest nodes (``same, ends, dir, lead``)."""
    p = c.file_prior_breakdown
    same = near["same"].cast("double")
    return clamp6(F.greatest(F.lit(0.0), p.same_file * same + p.same_module * module(near) - p.generated_penalty * is_generated.cast("double")))


def context(depth_score: Column, structure_score: Column, prior: Column, c: Coefficients) -> Column:
    p = c.context_breakdown
    return clamp6(p.depth * depth_score + p.structure * structure_score + p.file_prior * prior)


def evidence(severity: Column, confidence: Column, both: Column, n: Column, c: Coefficients) -> Column:
    """From a node's aggregates: largest severity and confidence, whether both tools agree, how many findings."""
    p = c.finding_evidence_breakdown
    agreement = F.when(both, F.lit(1.0)).when(n > 1, F.lit(0.30)).otherwise(F.lit(0.0))
    return F.when(F.coalesce(n, F.lit(0)) > 0, clamp6(p.severity * severity + p.confidence * confidence + p.agreement * agreement)).otherwise(F.lit(0.0))


def security_path(sink: Column, source: Column, guard: Column, high_risk: Column, c: Coefficients) -> Column:
    p = c.security_path_breakdown
    s = sink.cast("double")
    found = F.when(high_risk, F.greatest(s, F.lit(p.high_risk_cwe_evidence_base))).otherwise(F.lit(0.0))
    return clamp6(p.sink * s + p.source * source.cast("double") + p.guard * guard.cast("double") + p.path_evidence * found)


def additive(fe: Column, sp: Column, taint: Column, ctx: Column, c: Coefficients) -> Column:
    w = c.combiner
    return clamp6(w.finding_evidence * fe + w.security_path * sp + w.taint * taint + w.context * ctx)


def multiplicative(fe: Column, sp: Column, ctx: Column, c: Coefficients) -> Column:
    return clamp6(ctx * (1 + c.security_boost_weight * (fe + sp)))


def edge_aware_depth(depth: Column, edge_depths: Column, c: Coefficients) -> Column:
    """The strongest ``weight * decay ** depth`` over a node's edge types; without a map the hop decay."""
    weights, rates = asdict(c.edge_type_weights), asdict(c.edge_decay_rates)
    at = {t: F.element_at(edge_depths, F.lit(t.upper())) for t in weights}
    each = [F.when(at[t].isNotNull(), F.lit(weights[t]) * F.pow(F.lit(rates[t]), F.greatest(F.lit(0), at[t]))).otherwise(F.lit(0.0)) for t in weights]
    mapped = clamp6(F.greatest(*each))
    return F.when(depth == 0, F.lit(1.0)).when(F.coalesce(F.size(edge_depths), F.lit(0)) <= 0, hop_decay(depth, c)).otherwise(mapped)


def flow_bonus(edge_depths: Column, has_sink: Column, has_source: Column, c: Coefficients) -> Column:
    """Bonus of a node near a data flow, in contexts that have both a sink and a source; damped near a sanitizer."""
    near = F.coalesce(F.element_at(edge_depths, F.lit("FLOWS_TO")) <= c.source_sink_path_max_depth, F.lit(False))
    clean = F.coalesce(F.element_at(edge_depths, F.lit("SANITIZED_BY")) <= c.source_sink_path_max_depth, F.lit(False))
    bonus = F.when(clean, F.lit(c.sanitizer_bypass_bonus * c.sanitizer_presence_damp)).otherwise(F.lit(c.sanitizer_bypass_bonus))
    return F.when(near & has_sink & has_source, bonus).otherwise(F.lit(0.0))


# ---- the budgeted strategy

def graph_distance(depth: Column, edge_depths: Column, b: BudgetConfig) -> Column:
    """The largest ``decay ** depth`` over the edge types, else over the plain depth."""
    powers = F.array_max(F.transform(F.map_values(edge_depths), lambda d: F.pow(F.lit(b.depth_decay), d)))
    return clamp(F.when(F.coalesce(F.size(edge_depths), F.lit(0)) > 0, powers).otherwise(F.pow(F.lit(b.depth_decay), depth)))


def edge_confidence(edge_depths: Column) -> Column:
    known = F.array(*[F.lit(t) for t in model.EDGE_TYPES])
    return F.coalesce(F.size(F.array_intersect(F.map_keys(edge_depths), known)) / F.lit(float(len(model.EDGE_TYPES))), F.lit(0.0))


def roles(depth: Column, edge_depths: Column, taint: Column, fe: Column, is_generated: Column, sink: Column, source: Column, guard: Column) -> Column:
    """The sorted role names of a node."""
    has = lambda t: F.coalesce(F.map_contains_key(edge_depths, t), F.lit(False))
    found = [F.when(depth == 0, F.lit("root"))]
    found += [F.when(has(t), F.lit(role)) for t, role in model.ROLE_OF_EDGE.items()]
    found += [F.when(taint > 0, F.lit("propagation")), F.when(sink | (fe >= 0.5), F.lit("sink")), F.when(source, F.lit("source")), F.when(guard, F.lit("guard"))]
    got = F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    return F.when(is_generated, F.array(F.lit("boilerplate"))).when(F.size(got) == 0, F.array(F.lit("enclosing_context"))).otherwise(got)


def lexical_only(role_names: Column, edge_depths: Column, taint: Column, fe: Column, is_generated: Column, lexical: Column) -> Column:
    """Whether nothing but words (or nothing at all) speaks for a node."""
    has = [F.coalesce(F.map_contains_key(edge_depths, t), F.lit(False)) for t in model.ROLE_OF_EDGE]
    backed = reduce(lambda a, b: a | b, has) | (taint > 0) | (fe >= 0.5)
    bare = F.size(F.array_except(role_names, F.array(F.lit("root")))) == 0
    weak = (lexical | bare | F.array_contains(role_names, "enclosing_context")) & ~backed
    return weak & ~is_generated


def budget_context(role_names: Column, kind: Column, repeats: Column, most: Column, near: Column, c: Coefficients) -> Column:
    ratio = F.least(F.lit(1.0), repeats / F.greatest(most, F.lit(1)))
    shape = 0.55 * lookup(kind, dict(c.render_kind_scores), model.DEFAULT_KIND_SCORE) + 0.45 * ratio
    score = clamp(0.5 * shape + 0.5 * F.when(near["ends"], F.lit(0.70)).otherwise(module(near, 0.20, 0.10)))
    return F.when(F.array_contains(role_names, "boilerplate"), F.lit(0.0)).otherwise(score)


def relevance(fe: Column, taint: Column, role_names: Column, distance: Column, confidence: Column, ctx: Column, lexical: Column, b: BudgetConfig) -> Column:
    prior = F.coalesce(F.array_max(F.transform(role_names, lambda r: lookup(r, model.ROLE_PRIORS, 0.0))), F.lit(0.0))
    role = clamp(b.cpg_role_evidence_scale * F.pow(prior, F.lit(b.role_prior_temperature)) * distance)
    security = noisy_or([clamp(b.finding_evidence_scale * fe), clamp(b.taint_evidence_scale * taint), role, confidence])
    total = noisy_or([security, b.context_strength * ctx])
    return F.when(lexical, F.least(total, F.lit(b.lexical_fallback_cap))).otherwise(total)
