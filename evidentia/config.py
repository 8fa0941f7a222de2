"""Defaults of the engine's knobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # Fixed values
    decay_per_day: float = 0.01
    saturation: float = 2.0
    gc_floor: float = 0.05
    edge_budget: int = 100_000
    expand_depth: int = 2
    relevance_floor: float = 0.45
    lexical_weight: float = 3.0
    dense_weight: float = 1.0
    rrf_k: int = 60
    candidates: int = 50
    limit: int = 10
    spans: int = 3
    window_tokens: int = 400
    pair_cosine: float = 0.85
    pair_jaccard: float = 0.2
    max_pairs: int = 50
    enrich_threshold: float = 0.35
    weight_central: float = 0.5
    weight_criticality: float = 0.5
    weight_demand: float = 0.0
    centrality_k: float = 5.0
    per_pass: int = 5
    lease_seconds: int = 600
    passage_chars: int = 2400
    claim_reliability: float = 0.5
    handle_threshold: float = 0.677
    precision_floor: float = 0.9
    escalation_tokens: int = 32_000
    hard_tokens: int = 64_000
    poll_ms: int = 1000
    gap_ms: int = 2000
    stall_seconds: int = 3600
    claim_seconds: int = 30
    queue_limit: int = 10_000
    vector_size: int = 1024


DEFAULT = EngineConfig()
