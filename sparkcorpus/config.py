"""Settings, with the values of the shipped configuration as defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Chunking:
    size: int = 600
    overlap: int = 80
    min_size: int = 80


@dataclass(frozen=True)
class Retrieval:
    mode: str = "hybrid"
    top_k: int = 8
    max_contexts: int = 24
    pool: int = 30
    max_distance: float = 0.6
    rrf_k: int = 60
    #: 1: ranks count from one (production); 0: from zero (evaluation replica).
    rank_base: int = 1
    min_hits: int = 2
    min_hit_share: float = 0.25
    max_terms: int = 24
    escape_wildcards: bool = False


@dataclass(frozen=True)
class Sentences:
    top_m: int = 20
    per_chunk: int = 3
    min_length: int = 12


@dataclass(frozen=True)
class Prompt:
    window_tokens: int = 16_384
    chars_per_token: float = 1.5


@dataclass(frozen=True)
class Conversation:
    window: int = 16
    guaranteed_turns: int = 2
    summary_batch: int = 6
    summary_items: int = 20
    memory_items: int = 30
    note_batch: int = 4
    vector_batch: int = 64


@dataclass(frozen=True)
class Topics:
    max_clusters: int = 30
    iterations: int = 30
    seed: int = 20260916
    representatives: int = 5
    clip: int = 220
    overview_chars: int = 700


@dataclass(frozen=True)
class Limits:
    nonce_seconds: int = 600
    clock_skew_seconds: int = 300
    failures: int = 10
    failure_seconds: int = 900
    quiet_seconds: int = 20
    flush_chars: int = 60
    page_chars: int = 60_000
    page_min_chars: int = 200


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    sentences: Sentences = field(default_factory=Sentences)
    prompt: Prompt = field(default_factory=Prompt)
    conversation: Conversation = field(default_factory=Conversation)
    topics: Topics = field(default_factory=Topics)
    limits: Limits = field(default_factory=Limits)
