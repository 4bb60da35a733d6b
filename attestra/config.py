"""Tunable settings of the grounded question-answering pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """All knobs in one immutable value; pass a changed copy with ``dataclasses.replace``."""

    top_k: int = 3
    k1: float = 1.5
    b: float = 0.75
    min_score: float = 1.5
    filter_language: bool = True
    overlap_threshold: float = 0.60
    # completion requests
    provider_order: tuple[str, ...] = ("nvidia", "openrouter")
    temperature: float = 0.0
    seed: int = 42
    max_tokens: int = 1024
    requests_per_minute: int = 20
    timeout_seconds: int = 45
    reasoning_effort: str = ""
    replay_only: bool = False
    # request admission
    hits_per_window: int = 10
    window_seconds: float = 60.0
    daily_cap: int = 100
    max_question_chars: int = 500
    trust_proxy: bool = False
    # a table may be broadcast only after its row count was found to be at or below this
    broadcast_max_rows: int = 2_000_000
    # document blocks the query terms are replicated over when they are too many to broadcast
    salt_blocks: int = 64


#: minimum score that switches the relevance pre-check off
NO_PRECHECK = -999.0
