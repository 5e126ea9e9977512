"""Parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    entity_merge_threshold: float = 0.92
    score_scale: str = "cosine"  # "unit" for scores of (1 + cosine) / 2
    entity_score: float = 0.5  # least score of a recognised entity
    summary_relations: int = 15
    parts: int = 64  # of each stored table
    vector_top_k: int = 5
    graph_triple_limit: int = 40
    fulltext_limit: int = 10
    graph_limit: int = 120
    history_limit: int = 20
    title_threshold: float = 0.35
    extraction_method: str = "llm"
    predicate_mode: str = "label"  # "verb" returns the stored verb instead of the relationship label
    relation_label: str = "RELATION"
    min_confidence: float | None = None
