"""Default parameters, one dataclass per group of operators."""

from __future__ import annotations

from dataclasses import dataclass

# Enumerations.
FAMILIES = ("A", "B", "C", "D", "E", "F", "G")
REGIME_STATES = ("constructive_trend", "fresh_breakout", "extended_breakout", "sideways", "breakdown_risk")
CONTINUATION_STATES = ("constructive_trend", "fresh_breakout")
ADVERSE_STATES = ("extended_breakout", "breakdown_risk")
BENCHMARK_TICKERS = ("^NSEI",)


@dataclass(frozen=True)
class Detection:
    breakout_days: int = 40
    volume_multiplier: float = 1.5
    stop_pct: float = 7.0
    breakout_buffer_pct: float = 0.0
    stop_mode: str = "fixed_pct"  # fixed_pct | atr | structure_atr
    atr_multiplier: float = 2.5
    structure_atr_buffer: float = 0.5
    pullback_buffer_pct: float = 1.5
    rebound_min_pct: float = 0.2
    rsi_threshold: float = 30.0
    pivot_span: int = 3
    base_lookback: int = 100
    dryup_volume_ratio: float = 1.0
    consensus_bonus: float = 5.0


COVERAGE_SCAN = Detection(volume_multiplier=1.0)


@dataclass(frozen=True)
class ScoreWeights:
    trend: float = 0.20
    setup: float = 0.20
    volume: float = 0.13
    risk: float = 0.14
    rsi: float = 0.03
    family_cap: float = 30.0
    slope_bonus_cap: float = 3.0


@dataclass(frozen=True)
class Outcome:
    target_pct: float = 6.0
    stop_pct: float = 7.0
    horizon: int = 30


SHORT_TERM = Outcome(target_pct=3.0, stop_pct=2.0, horizon=7)
COVERAGE = Outcome(target_pct=6.0, stop_pct=7.0, horizon=60)


@dataclass(frozen=True)
class PenaltyLearning:
    min_samples: int = 25
    confidence_samples: int = 100
    quantiles: int = 5
    edge_scale: float = 50.0
    lookbacks: tuple = (5, 10, 20, 40)
    top1_weight: float = 0.65
    threshold_weight: float = 0.35
    score_threshold: float = 80.0


@dataclass(frozen=True)
class MarkovPolicy:
    horizon: int = 5
    half_life_months: float = 12.0
    min_transitions: float = 25.0
    max_bonus: float = 4.0
    max_penalty: float = 6.0
    continuation_center: float = 0.55
    adverse_center: float = 0.35


@dataclass(frozen=True)
class StopRiskPolicy:
    risk_floor: float = 0.25
    risk_full_penalty: float = 0.60
    max_penalty: float = 24.0
    power: float = 1.6
    hard_gate: bool = False
    hard_gate_threshold: float = 0.80
    reliability_cap_threshold: float = 75.0
    reliability_score_cap: float = 97.0


@dataclass(frozen=True)
class Backtest:
    stop_mode: str = "structure_atr"
    stop_pct: float = 9.0
    target_pct: float = 6.0
    atr_multiplier: float = 2.5
    structure_lookback: int = 5
    structure_atr_buffer: float = 0.5
    capital_per_trade: float = 10_000.0
    min_score: float = 90.0
    max_days: int = 60
    lockout_days: int = 7
