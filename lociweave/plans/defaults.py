"""Settings of a run, by mode."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    identity: float
    family: float
    length: float
    min_trailing_support: int
    trailing_rounds: int | None
    min_variant_support: int
    remove_by_consensus: bool
    edge_support: float
    # the same in all modes: DNA identity of mistranslated copies, and the search for missing genes
    dna_error: float = 0.98
    search_radius: int = 5000
    search_match: float = 0.2


def settings(mode: str, genomes: int) -> Settings:
    """Of strict, moderate or sensitive mode, for the true number of genomes."""
    few = max(2, math.ceil(0.01 * genomes))
    if mode == "strict":
        return Settings(0.98, 0.7, 0.98, max(2, math.ceil(0.05 * genomes)), None, few, True, few)
    if mode == "moderate":
        return Settings(0.98, 0.7, 0.98, few, None, few, False, few)
    if mode == "sensitive":
        return Settings(0.98, 0.7, 0.98, 2, 0, 2, False, 0.0)
    raise ValueError(f"no mode {mode}")
