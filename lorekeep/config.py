"""Retrieval settings with their limits."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import datetime

#: An open end of validity.
OPEN = datetime(9999, 1, 1)

# Each setting's least and greatest value.
LIMITS = {
    "graph_weight": (0.0, 0.5), "confidence_boost": (0.0, 0.01), "expand_weight": (0.0, 0.5), "expand_depth": (1, 2), "expand_anchors": (10, 50),
    "expand_per_node": (3, 50), "entity_weight": (0.0, 0.3), "vec_weight": (0.0, 1.0), "bm25_weight": (0.0, 1.0), "temporal_boost": (0.0, 20.0),
}


@dataclass(frozen=True)
class RecallConfig:
    """Everything that steers retrieval, explicit and clamped; ``now`` is the time scores refer to."""

    now: datetime = datetime(2026, 7, 1)
    ef_search: int = 100
    include_unverified: bool = False
    as_of: datetime | None = None
    vec_weight: float = 0.4
    bm25_weight: float = 0.4
    rrf_k: int = 60
    graph_weight: float = 0.0
    confidence_boost: float = 0.0
    expand_weight: float = 0.0
    expand_depth: int = 1
    expand_anchors: int = 15
    expand_per_node: int = 10
    entity_weight: float = 0.0
    entity_min_overlap: int = 1
    entity_max_expansion: int = 50
    recency_weight: float = 0.05
    temporal_boost: float = 1.0
    tenant: str = ""
    dim: int = 64

    def clamped(self) -> RecallConfig:
        """The same settings, each within its limits."""
        inside = {f.name: min(max(getattr(self, f.name), LIMITS[f.name][0]), LIMITS[f.name][1]) for f in fields(self) if f.name in LIMITS}
        return replace(self, **inside, rrf_k=max(1, self.rrf_k), entity_min_overlap=max(1, self.entity_min_overlap), entity_max_expansion=max(1, self.entity_max_expansion))
