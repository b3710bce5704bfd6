"""Thresholds of all screens, with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from ledgersieve import fixed_values as fv


@dataclass(frozen=True)
class RoundTier:
    multiple: float
    label: str
    points: int


def _default_tiers() -> tuple[RoundTier, ...]:
    return tuple(RoundTier(*tier) for tier in fv.ROUND_TIERS)


@dataclass(frozen=True)
class ScreenConfig:
    # First-digit test
    benford_tolerance: float = 0.01
    benford_min_sample: int = 300
    # Duplicate payments
    duplicate_window_days: float = 3
    # "group": rows without a counterparty form a key of their own; "ignore": skip them
    null_counterparty: str = "group"
    # Round amounts
    round_tiers: tuple[RoundTier, ...] = field(default_factory=_default_tiers)
    round_min_tier: float | None = None
    # Outliers
    modified_z_threshold: float = 3.5
    iqr_multiplier: float = 1.5
    z_threshold: float = 3.0
    min_account_rows: int = 4
    # Posting times
    business_start_hour: int = 8
    business_end_hour: int = 18
    concentration_ratio: float = 2.0
    concentration_min_flagged: int = 3
    # Related parties
    fuzzy_cutoff: float = 0.75
    # Risk score
    materiality_floor: float = 0.5
    materiality_ceiling: float = 2.0
    # Reconciliation
    clean_tolerance: float = 0.02
    timing_tolerance: float = 0.20
    closed_loan_floor: float = 5_000
