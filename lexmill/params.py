"""Retrieval parameters, their tuned values and sweep grid."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RagParams:
    chunk_size: int = 1800
    chunk_overlap: int = 100
    structure_aware: bool = False
    candidate_k: int = 20
    top_k: int = 8
    rrf_k: int = 60
    query_fusion: str = "rrf"
    query_decay: float = 1.0
    use_terms: bool = False
    heading_weight: float = 1
    lexical_weight: float = 0.5
    mmr_lambda: float = 1.0
    min_score_ratio: float = 0.0
    rerank_top: int = 12
    multi_query: int = 0
    neighbor_window: int = 0
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    user_doc_boost: float = 1.0
    max_context_chars: int = 24000

    def over(self, **changes) -> RagParams:
        """These parameters with some replaced; None leaves a value as it is."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


DEFAULT = RagParams()
TUNED = RagParams(chunk_size=600, top_k=12, heading_weight=3, lexical_weight=1.0, multi_query=3, bm25_k1=1.6)
GRID = {
    "chunk_size": (600, 900, 1200, 1800, 2400),
    "chunk_overlap": (0, 100, 180, 300),
    "structure_aware": (False, True),
    "candidate_k": (20, 40, 60),
    "top_k": (4, 6, 8, 10, 12),
    "rrf_k": (1, 3, 10, 30, 60, 120),
    "query_fusion": ("rrf", "best", "best-score", "weighted"),
    "query_decay": (0.5, 0.7, 0.85, 1.0),
    "heading_weight": (1, 2, 3, 4, 6, 8),
    "lexical_weight": (0.3, 0.5, 0.65, 0.8, 1.0),
    "mmr_lambda": (0.5, 0.7, 0.85, 1.0),
    "min_score_ratio": (0.0, 0.15, 0.3, 0.45),
    "multi_query": (0, 2, 3),
    "neighbor_window": (0, 1, 2),
    "bm25_k1": (0.9, 1.2, 1.6, 2.0),
    "bm25_b": (0.5, 0.65, 0.75, 0.9),
    "user_doc_boost": (1.0, 1.15, 1.35),
    "max_context_chars": (6000, 9000, 12000, 18000, 24000),
}
