"""Constants of the engine, one row per sport and one dictionary per rule set (fixed values)."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Sport:
    name: str
    home_advantage: float
    high: float
    medium: float
    rounded_tier: bool
    features: int


SPORTS = {
    "NBA": Sport("NBA", 3.5, 7.0, 3.0, False, 8),
    "NFL": Sport("NFL", 2.5, 7.0, 3.0, True, 6),
    "MLB": Sport("MLB", 0.15, 2.0, 1.0, True, 8),
}

ENDPOINT_HOME_ADVANTAGE = 3.0
DEFAULT_STATS = {"win_pct": 0.5, "points_avg": 110.0, "points_against_avg": 110.0}
NEUTRAL_ERA = 4.0

RISK_WEIGHTS = {"confidence": 0.3, "odds": 0.25, "volatility": 0.25, "historical": 0.2}
RISK_LEVELS = {"low": 0.3, "medium": 0.6, "high": 0.8}
ENSEMBLE_WEIGHTS = (0.4, 0.4, 0.2)

IMPORTANCE = {"high": 0.15, "medium": 0.08, "low": 0.03}
CONFIDENCE = {"high": 0.8, "medium": 0.6, "low": 0.4}
