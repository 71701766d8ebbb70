"""Table schemas and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- table schemas ---------------------------------------------------------------------------

TICKS = "time timestamp, symbol string, bid double, ask double, volume int"
BARS = (
    "time timestamp, symbol string, open double, high double, low double, close double, "
    "volume bigint"
)
EVENTS = (
    "id bigint, event_type string, aggregate_id string, data string, metadata string, "
    "timestamp timestamp, version int"
)
REGIME_EVENTS = (
    "symbol string, regime_type string, confidence double, features string, signals string, "
    "timestamp timestamp, regime_model string"
)
TRADES = "account string, symbol string, ts timestamp, id bigint, pnl double"

# --- fixed values: the instrument universe ---------------------------------------------------

SYMBOLS = [
    "GainX 400", "GainX 600", "GainX 800", "GainX 999", "GainX 1200",
    "PainX 400", "PainX 600", "PainX 800", "PainX 999", "PainX 1200",
    "FlipX 1", "FlipX 2", "FlipX 3", "FlipX 4", "FlipX 5",
    "FX Vol 20", "FX Vol 40", "FX Vol 60", "FX Vol 80", "FX Vol 99",
    "SFX Vol 20", "SFX Vol 40", "SFX Vol 60", "SFX Vol 80", "SFX Vol 99",
    "TrendX 600", "TrendX 1200", "TrendX 1800",
    "SwitchX 600", "SwitchX 1200", "SwitchX 1800",
    "BreakX 600", "BreakX 1200", "BreakX 1800",
]

# --- fixed values: symbol types by name pattern, first match wins ----------------------------

SYMBOL_TYPES = {
    "volatility": ["GainX", "PainX", "FX Vol", "SFX Vol"],
    "directional": ["FlipX", "TrendX", "BreakX", "SwitchX"],
    "synthetic": [
        "GainX", "PainX", "FlipX", "FX Vol", "SFX Vol", "TrendX", "SwitchX", "BreakX",
    ],
}

# --- fixed values: regimes, their base periods and allocation rules ---------------------------

REGIME_PERIODS = {
    "trending_high_vol": 50,
    "trending_low_vol": 34,
    "ranging_high_vol": 20,
    "ranging_low_vol": 14,
}
DEFAULT_REGIME = "ranging_low_vol"
RISK_MULTIPLIER = {
    "trending_high_vol": 1.0,
    "trending_low_vol": 0.8,
    "ranging_high_vol": 0.6,
    "ranging_low_vol": 0.4,
}
STRATEGY_WEIGHTS = {
    "trending_high_vol": {"nnfx": 0.7, "breakout": 0.3, "mean_reversion": 0.0},
    "trending_low_vol": {"nnfx": 0.8, "breakout": 0.2, "mean_reversion": 0.0},
    "ranging_high_vol": {"mean_reversion": 0.6, "breakout": 0.4, "nnfx": 0.0},
    "ranging_low_vol": {"mean_reversion": 0.9, "breakout": 0.1, "nnfx": 0.0},
}
FAMILY_BIAS = {
    "trending_high_vol": {"TrendX": 0.4, "GainX": 0.3, "BreakX": 0.3},
    "trending_low_vol": {"TrendX": 0.6, "FlipX": 0.4},
    "ranging_high_vol": {"GainX": 0.5, "PainX": 0.3, "SwitchX": 0.2},
    "ranging_low_vol": {"FlipX": 0.6, "SwitchX": 0.4},
}
DEFAULT_BIAS = 0.1
MODELS = ["basic", "technical", "nnfx", "comprehensive"]

# --- fixed values: lifetimes in seconds, look-backs in days, retention ------------------------

LIFETIME = {
    "high_frequency": 300,
    "medium_term": 3600,
    "long_term": 86400,
    "extended_history": 604800,
}
LOOKBACK_DAYS = {"M5": 30, "H1": 90, "D1": 365}
DEFAULT_LOOKBACK_DAYS = 30
RETENTION = {
    "market_tick_data": "6 months",
    "ohlcv_data": "3 years",
    "events": "2 years",
    "regime_events": "1 year",
    "ml_features": "6 months",
    "performance_metrics": "1 year",
}

# --- fixed values: hidden-state names of the two probabilistic models -------------------------

STATES = {
    "hmm": ["high_vol_trend", "low_vol_trend", "high_vol_range", "low_vol_range", "transition"],
    "gmm": ["high_vol_bull", "low_vol_bull", "high_vol_bear", "low_vol_bear", "neutral"],
}


def symbols(spark: SparkSession) -> DataFrame:
    """The universe as a table ``(symbol, family, pos)`` in listing order."""
    rows = [(name, name.rsplit(" ", 1)[0], i) for i, name in enumerate(SYMBOLS)]
    return spark.createDataFrame(rows, "symbol string, family string, pos int")


def regime_rules(spark: SparkSession) -> DataFrame:
    """One row per regime: base period and risk multiplier."""
    rows = [(r, REGIME_PERIODS[r], RISK_MULTIPLIER[r]) for r in REGIME_PERIODS]
    return spark.createDataFrame(rows, "regime string, base_period int, risk_multiplier double")


def strategy_rules(spark: SparkSession) -> DataFrame:
    rows = [(r, s, w) for r, ws in STRATEGY_WEIGHTS.items() for s, w in ws.items()]
    return spark.createDataFrame(rows, "regime string, strategy string, weight double")


def bias_rules(spark: SparkSession) -> DataFrame:
    rows = [(r, f, b) for r, bs in FAMILY_BIAS.items() for f, b in bs.items()]
    return spark.createDataFrame(rows, "regime string, family string, bias double")
