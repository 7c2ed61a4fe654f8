"""Defaults that are part of the results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Weights, thresholds and budgets of retrieval, chunking and retention."""

    # fixed values of the fused score
    lexical_weight: float = 0.48
    fts_weight: float = 0.18
    concept_weight: float = 0.22
    ontology_weight: float = 0.26
    literal_boost: float = 0.08
    recency_boost: float = 0.06
    half_life_days: float = 45.0
    code_boost: float = 0.12
    code_hint_ratio: float = 0.45
    normalized_penalty: float = 0.04
    wiki_boost_weight: float = 0.025
    structure_boost: float = 0.10
    substring_bonus: float = 0.07
    # candidates and results
    candidates: int = 120
    top_k: int = 5
    keep: int = 20
    fts_terms: int = 24
    substring_terms: int = 6
    concept_similarity: float = 0.84
    concept_terms: int = 6
    # gates
    top1_min: float = 0.33
    top1_soft: float = 0.26
    coverage_min: float = 0.22
    coverage_soft: float = 0.12
    coverage_rows: int = 8
    conflict_rows: int = 6
    per_section: int = 2
    per_file: int = 6
    max_normalized: int = 2
    # contexts
    context_chars: int = 5600
    result_chars: int = 700
    # chunking
    target_tokens: int = 620
    min_tokens: int = 420
    max_tokens: int = 780
    overlap: float = 0.15
    # facts
    min_confidence: float = 0.62
    max_hops: int = 2
    feedback_step: float = 0.08
    # retention
    retention_days: int = 30
    retention_rows: int = 50_000
    retention_batch: int = 2_000
    history_messages: int = 200
    history_runs: int = 10
    # the time that scores are computed for
    now_ts: int = 1_711_929_600


DEFAULTS = Settings()
