"""Weights and floors of binding, ranking and search."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Tuning:
    query_weight: float = 10.0
    vocab_weight: float = 12.0
    id_weight: float = 25.0
    neutral_scale: float = 0.15
    keyphrase_weight: float = 0.0
    semantic_weight: float = 60.0
    semantic_floor: float = 0.58
    breadth_penalty: float = 2.0
    breadth_threshold: int = 12
    domain_penalty: float = 0.0
    action_penalty: float = 0.0
    entity_penalty: float = 0.0
    gated_intents: tuple[str, ...] = ()
    quality_weight: float = 4.0
    price_outlier_penalty: float = 8.0
    dense_floor: float = 0.78
    sparse_floor: float = 0.035
    strong_sparse_floor: float = 0.12
    dense_margin: float = 0.02
    top_k: int = 1
    rrf_k: int = 60
    floor_overrides: dict[str, float] = field(default_factory=dict)
    domain_compatible: tuple[tuple[str, str], ...] = (("travel", "maps"), ("maps", "travel"), ("finance", "blockchain"), ("blockchain", "finance"))
    action_compatible: tuple[tuple[str, str], ...] = (("lookup", "search"), ("search", "lookup"))
