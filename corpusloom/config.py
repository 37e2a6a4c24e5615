"""Defaults of all knobs. They must equal the reference's for right results."""

from __future__ import annotations

from dataclasses import dataclass, field

CORPORA = ("objects", "specs", "system")


@dataclass(frozen=True)
class ChunkOptions:
    target: int = 450
    least: int = 200
    most: int = 800
    flex: float = 0.8
    hash_length: int = 16


@dataclass(frozen=True)
class FieldWeight:
    weight: float
    b: float


@dataclass(frozen=True)
class Config:
    chunk: ChunkOptions = field(default_factory=ChunkOptions)
    k1: float = 1.2
    b: float = 0.75
    fields: dict[str, FieldWeight] = field(
        default_factory=lambda: {
            "heading": FieldWeight(3.0, 0.3), "terms": FieldWeight(2.0, 0.0), "body": FieldWeight(1.0, 0.75), "code": FieldWeight(0.6, 0.5),
        }
    )
    tiers: dict[str, float] = field(default_factory=lambda: {"original": 1.0, "alias": 1.0, "narrower": 0.7, "related": 0.4})
    expansion_cap: int = 20
    rrf_k: int = 60
    rrf_weights: dict[str, float] = field(default_factory=lambda: {"objects": 1.0, "specs": 0.7, "system": 0.3})
    adjacent_boost: float = 0.15
    spec_boost: float = 0.20
    crossref_boost: float = 0.10
    window_ratio: float = 2.15
    least_term_frequency: int = 2
    results: int = 30
    related: int = 5
    prompt_multiplier: float = 4.0
    session_budget: int = 30_000
    bridge_tail: int = 600
    rake_phrases: int = 4
    rake_words: int = 5
    history_bytes: int = 100 << 20
    history_keep: int = 5
    resolver_depth: int = 10


DEFAULTS = Config()
