"""Numeric policy of the matching and scoring engines, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    """Distances in metres, times in seconds, scores between 0 and 1."""

    earth_radius_m: float = 6_371_000.0
    # duplicates
    duplicate_radius_m: float = 2_500.0
    duplicate_window_s: int = 3 * 3600
    candidate_cap: int = 50
    duplicate_confirmed: float = 0.75
    duplicate_possible: float = 0.55
    duplicate_text_floor: float = 0.40
    duplicate_text_only: float = 0.50
    # evidence
    evidence_radius_m: float = 25_000.0
    evidence_window_s: int = 48 * 3600
    positive_links: int = 10
    # observations
    observation_radius_m: float = 35_000.0
    observation_window_s: int = 24 * 3600
    stale_s: int = 48 * 3600
    trend_lookback_s: int = 6 * 3600
    trend_gap_s: int = 2 * 3600
    trend_steady_m: float = 0.05
    # credibility
    trust_floor: float = 0.10
    trust_ceiling: float = 0.95
    weak_gain: float = 0.03
    # images
    image_hamming: int = 10
    image_far_m: float = 50_000.0


POLICY = Policy()

# The credibility levels that weak links alone may not cross.
WEAK_LEVELS = (0.45, 0.50, 0.65, 0.70, 0.80, 0.82, 0.85, 0.88)
# The allowed changes of a verification status.
TRANSITIONS = {
    "PENDING": ("UNDER_REVIEW", "VERIFIED", "REJECTED", "DUPLICATE"),
    "UNDER_REVIEW": ("VERIFIED", "REJECTED", "DUPLICATE"),
    "VERIFIED": (),
    "REJECTED": (),
    "DUPLICATE": (),
}
