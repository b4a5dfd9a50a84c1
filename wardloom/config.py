"""Tunables of all operators, as frozen values that callers pass in."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


# All defaults below must equal those that results are compared by.


@dataclass(frozen=True)
class GapConfig:
    demand: float = 0.40
    absence: float = 0.35
    quality: float = 0.25
    target: float = 1.0
    degraded_age: int = 12
    earth_radius_m: float = 6_371_008.8
    max_assignment_m: float = 25_000.0

    def __post_init__(self) -> None:
        if abs(self.demand + self.absence + self.quality - 1) > 1e-9:
            raise ValueError("gap weights must sum to 1")


@dataclass(frozen=True)
class IntelConfig:
    radius_m: float = 12_000.0
    change_pct: float = 10.0
    spike_ratio: float = 2.0
    spike_min: int = 10
    new_min: int = 3
    stall_elapsed: float = 0.5
    stall_spend: float = 0.35


@dataclass(frozen=True)
class PriorityConfig:
    weights: dict[str, float] = field(default_factory=lambda: {"demand": 0.30, "severity": 0.20, "trend": 0.20, "coverage": 0.15, "service_failure": 0.15})
    per_1000: float = 5.0
    severity: float = 5.0
    growth: float = 100.0
    gap: float = 100.0
    stalled: float = 0.40
    delay: float = 180.0
    unspent: float = 0.50
    high: float = 70.0
    medium: float = 45.0

    def __post_init__(self) -> None:
        if abs(sum(self.weights.values()) - 1) > 1e-9:
            raise ValueError("priority weights must sum to 1")


@dataclass(frozen=True)
class DedupConfig:
    radius_m: float = 1_000.0
    horizon_hours: float = 720.0
    candidates: int = 200
    geo: float = 0.4
    text: float = 0.4
    time: float = 0.2
    least: float = 0.55
    least_text: float = 0.30


#: The moment that adapters of the test tables are looked at from.
AS_OF = dt.date(2000, 1, 1)
