"""Model parameters.  Every operator takes them as arguments; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal


# Thresholds, windows and time limits of the two decision models.
@dataclass(frozen=True)
class PanelRules:
    """Four-condition SELL / REBUY panels."""

    return_window_ms: int = 60_000
    retention_ms: int = 600_000
    freshness_ms: int = 5_000
    news_freshness_ms: int = 30_000
    macro_arm_window_ms: int = 7_200_000
    cross_asset_minimum: int = 2
    relative_return_maximum: Decimal = Decimal("-0.0025")
    sell_ratio_maximum: Decimal = Decimal("0.6")
    sell_pressure_seconds: int = 3
    macro_quiet_seconds: int = 900
    no_new_low_seconds: int = 300
    relative_return_minimum: Decimal = Decimal("0")
    relative_recovery_seconds: int = 30
    rebuy_ratio_minimum: Decimal = Decimal("1.1")
    flow_normal_seconds: int = 30
    # per reference asset, in the order the assets are passed
    cross_asset_maximum: tuple[Decimal, ...] = (
        Decimal("-0.001"),
        Decimal("-0.0015"),
        Decimal("-0.005"),
    )


@dataclass(frozen=True)
class StagedRules:
    """Older staged SELL / REBUY decision with volatility thresholds and open interest."""

    window_ms: int = 60_000
    price_freshness_seconds: int = 3
    open_interest_freshness_seconds: int = 360
    maximum_clock_drift_ms: int = 1_000
    sigma_lookback_seconds: int = 3_600
    mad_factor: Decimal = Decimal("1.4826")
    mad_minimum_samples: int = 5
    zscore_minimum_samples: int = 20
    breadth_minimum: int = 2
    volume_anomaly_minimum: Decimal = Decimal("1.5")
    sell_ratio_maximum: Decimal = Decimal("0.6")
    sell_persistence_seconds: int = 3
    no_new_low_seconds: int = 300
    open_interest_decline: Decimal = Decimal("-0.05")
    rebuy_ratio_minimum: Decimal = Decimal("1.1")
    flow_persistence_seconds: int = 30
    stability_seconds: int = 30
    second_tranche_seconds: int = 300
    first_sell_fraction: Decimal = Decimal("0.25")
    second_sell_fraction: Decimal = Decimal("0.75")
    rebuy_fraction: Decimal = Decimal("0.5")
    volatility_multiplier: Decimal = Decimal("2")
    news_window_minutes: int = 120


@dataclass(frozen=True)
class QuoteRules:
    """Two-provider quote cross-check."""

    slippage_bps: Decimal = Decimal("50")
    maximum_deviation_bps: Decimal = Decimal("100")
    expiry_seconds: int = 5
    maximum_block_lag: int = 2
    amount_places: int = 6


@dataclass(frozen=True)
class ReportRules:
    contiguous_gap_ms: int = 30_000
    soak_ms: int = 3_600_000
    shadow_ms: int = 14 * 86_400_000
    snapshot_every_ms: int = 10_000
    raw_retention_days: int = 180
    latency_samples: int = 4_096
    timeline_size: int = 100
    page_limit: int = 100
    excerpt_characters: int = 600
    items_per_poll: int = 50


@dataclass(frozen=True)
class Rules:
    panel: PanelRules = field(default_factory=PanelRules)
    staged: StagedRules = field(default_factory=StagedRules)
    quote: QuoteRules = field(default_factory=QuoteRules)
    report: ReportRules = field(default_factory=ReportRules)


DEFAULT = Rules()

# Allowed stage changes, (model, from, to); "*" stands for any stage.
PANEL_TRANSITIONS = (
    ("SELL", "NO_ACTION", "NEWS_ARMED"),
    ("SELL", "NO_ACTION", "MARKET_ARMED"),
    ("SELL", "NEWS_ARMED", "SELL_READY"),
    ("SELL", "MARKET_ARMED", "SELL_READY"),
    ("SELL", "SELL_READY", "NO_ACTION"),
    ("SELL", "*", "DATA_UNAVAILABLE"),
    ("SELL", "DATA_UNAVAILABLE", "NO_ACTION"),
    ("SELL", "DATA_UNAVAILABLE", "NEWS_ARMED"),
    ("SELL", "DATA_UNAVAILABLE", "MARKET_ARMED"),
    ("REBUY", "NO_ACTION", "REBUY_WAIT"),
    ("REBUY", "REBUY_WAIT", "REBUY_READY"),
    ("REBUY", "REBUY_READY", "REBUY_WAIT"),
    ("REBUY", "*", "DATA_UNAVAILABLE"),
    ("REBUY", "DATA_UNAVAILABLE", "REBUY_WAIT"),
    ("REBUY", "DATA_UNAVAILABLE", "NO_ACTION"),
)
STAGED_TRANSITIONS = (
    ("SELL", "SELL_IDLE", "NEWS_ARMED"),
    ("SELL", "SELL_IDLE", "MARKET_ARMED"),
    ("SELL", "NEWS_ARMED", "SELL_PRETRIGGER"),
    ("SELL", "MARKET_ARMED", "SELL_PRETRIGGER"),
    ("SELL", "SELL_PRETRIGGER", "SELL_CONFIRMED"),
    ("SELL", "SELL_PRETRIGGER", "SELL_IDLE"),
    ("SELL", "SELL_CONFIRMED", "SELL_COOLDOWN"),
    ("SELL", "SELL_COOLDOWN", "SELL_CONFIRMED"),
    ("SELL", "SELL_COOLDOWN", "REBUY_WAIT"),
    ("SELL", "NEWS_ARMED", "SELL_IDLE"),
    ("SELL", "MARKET_ARMED", "SELL_IDLE"),
    ("SELL", "DATA_BLOCKED", "SELL_IDLE"),
    ("SELL", "DATA_BLOCKED", "NEWS_ARMED"),
    ("SELL", "DATA_BLOCKED", "MARKET_ARMED"),
    ("SELL", "*", "DATA_BLOCKED"),
    ("REBUY", "REBUY_INACTIVE", "REBUY_WAIT"),
    ("REBUY", "REBUY_WAIT", "REBUY_ARMED"),
    ("REBUY", "REBUY_ARMED", "REBUY_TRANCHE_1"),
    ("REBUY", "REBUY_TRANCHE_1", "REBUY_TRANCHE_2_WAIT"),
    ("REBUY", "REBUY_TRANCHE_2_WAIT", "REBUY_COMPLETE"),
    ("REBUY", "REBUY_ARMED", "REBUY_WAIT"),
    ("REBUY", "REBUY_TRANCHE_2_WAIT", "REBUY_WAIT"),
    ("REBUY", "REBUY_VETOED", "REBUY_WAIT"),
    ("REBUY", "*", "REBUY_VETOED"),
)
