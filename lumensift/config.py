"""Defaults of the engine in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    chunk_target: int = 500
    chunk_min: int = 200
    chunk_max: int = 800
    chunk_overlap: int = 75
    retrieval_top_k: int = 50
    search_top_k: int = 15
    display_top_papers: int = 15
    similar_source_chunks: int = 15
    similar_neighbours: int = 20
    similar_results: int = 10
    similar_min: float = 0.65
    similar_overlaps: int = 3
    similar_strength_pairs: int = 5
    similar_strength_weight: float = 0.70
    similar_coverage_weight: float = 0.30
    centrality_weight: float = 0.20
    usable_chars: int = 80
    usable_words: int = 10
    define_top_k: int = 30
    exact_bonus: float = 0.35
    normalised_bonus: float = 0.25
    partial_bonus: float = 0.10
    section_bonus: float = 0.05
    reference_penalty: float = 1.0
    context_before: int = 1
    context_after: int = 1
    define_context_words: int = 1800
    explain_context_words: int = 2500
    explain_anchors: int = 5
    define_batch: int = 5
    explain_batch: int = 5
    examples_batch: int = 3
    summary_batch: int = 3
    examples_results: int = 10
    facet_top_k: int = 10
    classify_chars: int = 4000
    define_chars: int = 2600
    explain_chars: int = 2200
    examples_chars: int = 6000
    summary_chars: int = 2200
    stitch_most: int = 75
    stitch_least: int = 4
    pipeline_version: str = "2"
    storage_dir: str = "storage"
    llm_enabled: bool = True


DEFAULT = EngineConfig()
