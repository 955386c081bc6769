"""Weights of the ranking strategies: strict keys and ranges, YAML round trip, dotted-key overlays.

The default numbers are fixed values: results depend on them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

import yaml


def _unit(default: float, hi: float = 1.0, lo: float = 0.0, open_lo: bool = False) -> Any:
    return field(default=default, metadata={"lo": lo, "hi": hi, "open": open_lo})


class _Checked:
    def __post_init__(self) -> None:
        for f in fields(self):
            if "hi" in f.metadata:
                v, lo, hi = getattr(self, f.name), f.metadata["lo"], f.metadata["hi"]
                if isinstance(v, bool) or not isinstance(v, (int, float)) or not lo <= v <= hi or f.metadata["open"] and v == lo:
                    raise ValueError(f"{type(self).__name__}.{f.name} = {v!r} is outside [{lo}, {hi}]")


@dataclass(frozen=True)
class Combiner(_Checked):
    finding_evidence: float = _unit(0.25)
    security_path: float = _unit(0.20)
    taint: float = _unit(0.20)
    context: float = _unit(0.35)


@dataclass(frozen=True)
class ContextParts(_Checked):
    depth: float = _unit(0.45)
    structure: float = _unit(0.25)
    file_prior: float = _unit(0.30)


@dataclass(frozen=True)
class EvidenceParts(_Checked):
    severity: float = _unit(0.5)
    confidence: float = _unit(0.3)
    agreement: float = _unit(0.2)


@dataclass(frozen=True)
class SecurityParts(_Checked):
    sink: float = _unit(0.35)
    source: float = _unit(0.25)
    guard: float = _unit(0.20)
    path_evidence: float = _unit(0.20)
    high_risk_cwe_evidence_base: float = _unit(0.70)


@dataclass(frozen=True)
class StructureParts(_Checked):
    render_kind: float = _unit(0.15)
    repeat_bonus: float = _unit(0.85)


@dataclass(frozen=True)
class FilePriorParts(_Checked):
    same_file: float = _unit(0.70)
    same_module: float = _unit(0.20)
    generated_penalty: float = _unit(0.10)


@dataclass(frozen=True)
class Tiers(_Checked):
    low: float = _unit(0.33)
    medium: float = _unit(0.66)
    high: float = _unit(1.0)


@dataclass(frozen=True)
class PerEdge(_Checked):
    flows_to: float = _unit(1.00)
    sanitized_by: float = _unit(0.85)
    calls: float = _unit(0.70)
    called_by: float = _unit(0.70)
    defined_by: float = _unit(0.60)
    used_by: float = _unit(0.55)
    contains: float = _unit(0.35)


@dataclass(frozen=True)
class Coefficients(_Checked):
    """The nested weights of the additive, multiplicative and structural strategies."""

    combiner: Combiner = field(default_factory=Combiner)
    context_breakdown: ContextParts = field(default_factory=ContextParts)
    finding_evidence_breakdown: EvidenceParts = field(default_factory=EvidenceParts)
    security_path_breakdown: SecurityParts = field(default_factory=SecurityParts)
    structure_breakdown: StructureParts = field(default_factory=StructureParts)
    file_prior_breakdown: FilePriorParts = field(default_factory=FilePriorParts)
    hop_decay_by_depth: Mapping[int, float] = field(default_factory=lambda: {0: 1.0, 1: 0.85, 2: 0.70, 3: 0.55, 4: 0.45})
    hop_decay_default: float = _unit(0.35)
    severity_scores: Tiers = field(default_factory=Tiers)
    confidence_by_severity: Tiers = field(default_factory=lambda: Tiers(0.30, 0.60, 0.90))
    render_kind_scores: Mapping[str, float] = field(default_factory=lambda: {"FunctionNode": 1.0, "ClassNode": 0.8, "CodeBlockNode": 0.7, "VariableNode": 0.4})
    security_boost_weight: float = _unit(1.0, hi=float("inf"))
    security_tier_threshold: float = _unit(0.5, hi=2.0)
    edge_type_weights: PerEdge = field(default_factory=PerEdge)
    edge_decay_rates: PerEdge = field(default_factory=lambda: PerEdge(0.85, 0.80, 0.75, 0.75, 0.70, 0.70, 0.55))
    sanitizer_bypass_bonus: float = _unit(0.25)
    sanitizer_presence_damp: float = _unit(0.5)
    source_sink_path_max_depth: int = field(default=4, metadata={"lo": 0, "hi": 1 << 30, "open": False})


@dataclass(frozen=True)
class BudgetConfig(_Checked):
    """The flat operating point of the budgeted strategy."""

    depth_decay: float = _unit(0.60, hi=2.0)
    context_strength: float = _unit(0.45)
    role_prior_temperature: float = _unit(1.0, hi=5.0, open_lo=True)
    finding_evidence_scale: float = _unit(1.0, hi=5.0)
    taint_evidence_scale: float = _unit(1.0, hi=5.0)
    cpg_role_evidence_scale: float = _unit(1.0, hi=5.0)
    lexical_fallback_cap: float = _unit(0.40)
    token_cost_power: float = _unit(0.35, hi=2.0)
    novelty_penalty: float = _unit(0.40)
    role_coverage_bonus: float = _unit(0.20)
    small_node_token_threshold: int = field(default=220, metadata={"lo": 1, "hi": 1 << 30, "open": False})
    local_window_radius: int = field(default=3, metadata={"lo": 0, "hi": 1 << 30, "open": False})
    max_candidates_per_node: int = field(default=8, metadata={"lo": 1, "hi": 1 << 30, "open": False})
    budget_safety_ratio: float = _unit(0.95, open_lo=True)


def from_mapping(cls: type, raw: Any) -> Any:
    """A config of ``cls`` from nested mappings; unknown keys and values out of range are errors."""
    if not isinstance(raw, Mapping):
        raise ValueError(f"{cls.__name__} needs a mapping, not {type(raw).__name__}")
    base = cls()
    known = {f.name for f in fields(cls)}
    if unknown := sorted(map(str, set(raw) - known)):
        raise ValueError(f"{cls.__name__} has no {', '.join(unknown)}")
    made = {}
    for name, value in raw.items():
        now = getattr(base, name)
        made[name] = from_mapping(type(now), {**asdict(now), **value} if isinstance(value, Mapping) else value) if is_dataclass(now) else dict(value) if isinstance(now, Mapping) else value
    return replace(base, **made)


def load(cls: type, path: str | Path) -> Any:
    return from_mapping(cls, yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def save(config: Any, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(asdict(config), sort_keys=False), encoding="utf-8")


def overlay(config: Any, changes: Mapping[str, Any]) -> Any:
    """``config`` with values replaced by dotted keys, as in ``{"combiner.taint": 0.3}``."""
    raw = asdict(config)
    for key, value in changes.items():
        *path, last = key.split(".")
        at = raw
        for p in path:
            if not isinstance(at.get(p), dict):
                raise ValueError(f"no section {key}")
            at = at[p]
        at[int(last) if path and path[-1] == "hop_decay_by_depth" else last] = value
    return from_mapping(type(config), raw)
