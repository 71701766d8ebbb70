"""Market regimes: features, classification, signals on features, history and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.catalog import MODELS
from barwise.functions.scalars import first_match, guarded, seconds_between
from barwise.operators.bars import newest_per_symbol
from barwise.operators.indicators import FEATURE_GATE
from barwise.operators.series import block, in_block, number, own_rows

# Class limits.
HIGH_VOL, TRENDING, ADX_TRENDING, ADX_STRONG = 0.05, 0.02, 25.0, 30.0
BASIC_FEATURES = [
    "volatility", "trend_strength", "volume_profile", "price_momentum", "mean_reversion",
    "regime_confidence",
]
TECHNICAL_FEATURES = ["adx", "atr", "rsi", "kama", "stoch_k", "stoch_d"]


def basic_features(bars: DataFrame) -> DataFrame:
    o, h, low, c = (F.coalesce(F.col(n), F.lit(0.0)) for n in ("open", "high", "low", "close"))
    typical = (h + low + c) / 3
    profile = F.least(F.coalesce(F.col("volume"), F.lit(1)) / 1000.0, F.lit(10.0))
    volatility, trend = guarded(h - low, o), guarded(F.abs(c - o), o)
    return bars.withColumns(
        {
            "volatility": volatility,
            "trend_strength": trend,
            "volume_profile": profile,
            "price_momentum": guarded(c - o, o),
            "mean_reversion": guarded(F.abs(c - typical), typical),
            "regime_confidence": F.least(volatility * 0.3 + trend * 0.4 + profile * 0.3, F.lit(1.0)),
        }
    )


def _regime(trending: Column, high_vol: Column) -> Column:
    return F.concat(
        F.when(trending, "trending").otherwise("ranging"),
        F.when(high_vol, "_high_vol").otherwise("_low_vol"),
    )


def basic_regime() -> Column:
    return _regime(F.col("trend_strength") > TRENDING, F.col("volatility") > HIGH_VOL)


def technical_regime() -> Column:
    """Before the ADX exists a market counts as ranging."""
    return _regime(F.coalesce(F.col("adx") > ADX_TRENDING, F.lit(False)), F.col("volatility") > HIGH_VOL)


def enhanced_confidence() -> Column:
    technical = (
        F.least(F.col("adx") / 50, F.lit(1.0)) * 0.4
        + F.least(F.col("atr") / (F.col("volatility") + 0.001), F.lit(2.0)) * 0.3
        + (1 - F.abs(F.col("rsi") - 50) / 50) * 0.3
    )
    # least() skips nulls, the sum does not: null until every indicator exists.
    ready = F.col("adx").isNotNull() & F.col("atr").isNotNull() & F.col("rsi").isNotNull()
    return F.when(ready, F.least(F.col("regime_confidence") * 0.6 + technical * 0.4, F.lit(1.0)))


def feature_signal() -> Column:
    """BUY / SELL / HOLD from the feature row, as a struct."""
    trending = F.col("regime_type").contains("trending")
    strong = F.col("adx") > ADX_STRONG
    bull = (F.col("rsi") > 50) & (F.col("stoch_k") > F.col("stoch_d")) & (F.col("stoch_k") > 50)
    bear = (F.col("rsi") < 50) & (F.col("stoch_k") < F.col("stoch_d")) & (F.col("stoch_k") < 50)
    above = F.col("close") > F.col("kama")
    capped = F.when(F.col("regime_confidence_enhanced").isNotNull(), F.least(F.lit(0.9), F.col("regime_confidence_enhanced")))

    def row(signal: str, baseline: str, confidence: Column, strength: Column) -> Column:
        return F.struct(
            F.lit(signal).alias("nnfx_signal"),
            confidence.alias("signal_confidence"),
            F.lit(baseline).alias("baseline_signal"),
            strength.alias("confirmation_strength"),
        )

    strength = F.col("adx") / 50
    return (
        F.when(~trending, row("HOLD", "NEUTRAL", F.lit(0.3), F.lit(0.0)))
        .when(above & strong & bull, row("BUY", "BULLISH", capped, strength))
        .when(~above & strong & bear, row("SELL", "BEARISH", capped, strength))
        .otherwise(row("HOLD", "NEUTRAL", F.lit(0.5), strength))
    )


def no_signal() -> Column:
    return F.struct(
        F.lit("HOLD").alias("nnfx_signal"),
        F.lit(0.0).alias("signal_confidence"),
        F.lit("NEUTRAL").alias("baseline_signal"),
        F.lit(0.0).alias("confirmation_strength"),
    )


def with_model(features: DataFrame, model: str = "comprehensive") -> DataFrame:
    """Regime and signal of one model. Below 20 bars every model falls back to the basic one.

    ``features`` carries the basic features, the gated technical ones and the bar number ``pos``.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    enough = F.lit(model != "basic") & (F.col("pos") >= FEATURE_GATE - 1)
    signals = model in ("nnfx", "comprehensive")
    out = features.withColumns({n: F.when(enough, F.col(n)) for n in TECHNICAL_FEATURES})
    out = out.withColumn("regime_confidence_enhanced", F.when(enough, enhanced_confidence()))
    out = out.withColumn("regime_type", F.when(enough, technical_regime()).otherwise(basic_regime()))
    signal = F.when(enough, feature_signal()).otherwise(no_signal()) if signals else no_signal()
    return (
        out.withColumn("_signal", signal)
        .select(*out.columns, "_signal.*")
        .withColumn("regime_model", F.lit(model))
    )


def all_models(features: DataFrame) -> DataFrame:
    """The four models stacked, in one pass over the features."""
    tagged = features.withColumn("regime_model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    model = F.col("regime_model")
    enough = (model != "basic") & (F.col("pos") >= FEATURE_GATE - 1)
    out = tagged.withColumns({n: F.when(enough, F.col(n)) for n in TECHNICAL_FEATURES})
    out = out.withColumn("regime_confidence_enhanced", F.when(enough, enhanced_confidence()))
    out = out.withColumn("regime_type", F.when(enough, technical_regime()).otherwise(basic_regime()))
    signal = F.when(enough & model.isin("nnfx", "comprehensive"), feature_signal()).otherwise(no_signal())
    return out.withColumn("_signal", signal).select(*out.columns, "_signal.*")


def regime_events(bars: DataFrame, model: str = "basic") -> DataFrame:
    """Basic regime per bar as an event row."""
    return basic_features(bars).select(
        "symbol",
        F.col("time").alias("timestamp"),
        basic_regime().alias("regime_type"),
        F.col("regime_confidence").alias("confidence"),
        F.lit(model).alias("regime_model"),
    )


# --- history and statistics ------------------------------------------------------------------


def current_regimes(events: DataFrame) -> DataFrame:
    """The newest event of each symbol, ties kept. Tasks keep only their newest rows per symbol
    before the shuffle (window group limit)."""
    w = Window.partitionBy("symbol").orderBy(F.desc("timestamp"))
    return (
        events.withColumn("_rank", F.rank().over(w))
        .where("_rank = 1")
        .select("symbol", "regime_type", "confidence", "timestamp")
    )


def lookup_regimes(requested: DataFrame, current: DataFrame) -> DataFrame:
    """Requested symbols with their current regime, null when there is none."""
    return requested.join(current, "symbol", "left")


def neighbours(events: DataFrame, back: int = 0, ahead: int = 0) -> DataFrame:
    """Events in blocks that also hold the neighbouring rows, for exact LAG and LEAD."""
    return block(number(events, ["symbol"], ["timestamp"]), back=back, ahead=ahead)


def regime_transitions(events: DataFrame) -> DataFrame:
    w = in_block(["symbol"])
    before = F.lag("timestamp").over(w)
    rows = neighbours(events.select("symbol", "timestamp", "regime_type"), back=1).withColumns(
        {
            "previous_regime": F.lag("regime_type").over(w),
            "seconds_since_change": seconds_between(F.col("timestamp"), before),
        }
    )
    return own_rows(rows).select(
        "symbol",
        "previous_regime",
        F.col("regime_type").alias("current_regime"),
        "timestamp",
        "seconds_since_change",
    )


def regime_periods(events: DataFrame, end: str) -> DataFrame:
    """Start and end of each period; the open end closes at ``end``."""
    w = in_block(["symbol"])
    rows = neighbours(events, ahead=1).withColumn(
        "end_time",
        F.coalesce(F.lead("timestamp").over(w), F.lit(end).cast("timestamp")),
    )
    return own_rows(rows).drop("pos", "block")


def regime_occupancy(events: DataFrame, start: str, end: str) -> DataFrame:
    """Per symbol and regime: count, mean confidence and total seconds within [start, end]."""
    inside = events.where(
        F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    ).select("symbol", "timestamp", "regime_type", "confidence")
    return (
        regime_periods(inside, end)
        .groupBy("symbol", "regime_type")
        .agg(
            F.count(F.lit(1)).alias("occurrence_count"),
            F.avg("confidence").alias("avg_confidence"),
            F.sum(seconds_between(F.col("end_time"), F.col("timestamp"))).alias("total_seconds"),
        )
    )


def daily_regime_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("symbol", "regime_type", F.date_trunc("day", "timestamp").alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("confidence").alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
    )


def since(as_of: str, days: int) -> Column:
    return F.expr(f"timestamp'{as_of}' - interval {days} days")


def regime_statistics(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per symbol and regime over the last ``days``: count, share in percent, mean confidence,
    first and last occurrence, and the symbol's most common regime (ties: name order)."""
    grouped = (
        events.where(F.col("timestamp") >= since(as_of, days))
        .groupBy("symbol", "regime_type")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("confidence").alias("avg_confidence"),
            F.min("timestamp").alias("first_occurrence"),
            F.max("timestamp").alias("last_occurrence"),
        )
    )
    per_symbol = Window.partitionBy("symbol")
    ranked = per_symbol.orderBy(F.desc("count"), "regime_type").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return grouped.withColumns(
        {
            "total_events": F.sum("count").over(per_symbol),
            "percentage": F.col("count") / F.sum("count").over(per_symbol) * 100,
            "most_common_regime": F.first("regime_type").over(ranked),
        }
    )


def regime_history(events: DataFrame, as_of: str, days: int = 30, symbol: str | None = None) -> DataFrame:
    """Events of the last ``days`` per symbol, newest first."""
    out = events.where(F.col("timestamp") >= since(as_of, days))
    if symbol is not None:
        out = out.where(F.col("symbol") == symbol)
    return out.select("symbol", "timestamp", "regime_type", "confidence").orderBy("symbol", F.desc("timestamp"))


def filter_regime_events(
    events: DataFrame,
    symbol: str | None = None,
    regime: str | None = None,
    start: str | None = None,
    end: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    out = events
    if symbol is not None:
        out = out.where(F.col("symbol") == symbol)
    if regime is not None:
        out = out.where(F.col("regime_type") == regime)
    if start is not None:
        out = out.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    if limit is None:
        return out
    return out.orderBy("timestamp", "symbol").limit(limit)


def stability(changed: Column, rows: Column) -> Column:
    """1 − changes/(n−1), 1 for a single row."""
    return F.when(rows <= 1, 1.0).otherwise(1 - F.sum(changed) / (rows - 1))


def regime_stability(events: DataFrame) -> DataFrame:
    """Stability over the whole history of each symbol."""
    w = in_block(["symbol"])
    rows = neighbours(events.select("symbol", "timestamp", "regime_type"), back=1).withColumn(
        "_changed", (F.col("regime_type") != F.lag("regime_type").over(w)).cast("int")
    )
    n = F.count(F.lit(1))
    return own_rows(rows).groupBy("symbol").agg(
        n.alias("periods"), stability(F.col("_changed"), n).alias("regime_stability")
    )


def recent_history(events: DataFrame, limit: int = 100) -> DataFrame:
    return newest_per_symbol(events, limit, time="timestamp")


def history_summary(events: DataFrame, limit: int = 100) -> DataFrame:
    """One row per symbol over its newest ``limit`` events."""
    recent = recent_history(events, limit)
    w = Window.partitionBy("symbol").orderBy("rank")
    recent = recent.withColumn("_changed", (F.col("regime_type") != F.lag("regime_type").over(w)).cast("int"))
    n = F.count(F.lit(1))
    summary = recent.groupBy("symbol").agg(
        n.alias("total_periods"),
        F.avg("confidence").alias("avg_confidence"),
        F.min_by("regime_type", "rank").alias("current_regime"),
        stability(F.col("_changed"), n).alias("regime_stability"),
    )
    # Ties between models go to the one seen first, newest row first.
    models = (
        recent.groupBy("symbol", F.coalesce("regime_model", F.lit("unknown")).alias("_model"))
        .agg(F.struct(n.alias("n"), (-F.min("rank")).alias("first")).alias("_weight"))
        .groupBy("symbol")
        .agg(F.max_by("_model", "_weight").alias("primary_model"))
    )
    return summary.join(models, "symbol")


def history_distribution(events: DataFrame, limit: int = 100) -> DataFrame:
    """Counts and shares over the newest ``limit`` events by regime, model and signal, long form."""
    dimensions = {"regime": "regime_type", "model": "regime_model", "signal": "nnfx_signal"}
    present = {d: c for d, c in dimensions.items() if c in events.columns}
    pairs = F.explode(
        F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in present.items()])
    )
    counted = (
        recent_history(events, limit)
        .select("symbol", pairs.alias("_p"))
        .select("symbol", "_p.*")
        .where(F.col("value").isNotNull())
        .groupBy("symbol", "dimension", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    total = F.sum("count").over(Window.partitionBy("symbol", "dimension"))
    return counted.withColumn("share", F.col("count") / total)


def regime_change_alert(events: DataFrame, n: int = 5, limit: float = 0.6) -> DataFrame:
    """Distinct regimes among the newest ``n`` as a ratio; symbols with fewer events give null."""
    recent = recent_history(events, n)
    rows = F.count(F.lit(1))
    ratio = F.when(rows >= n, F.count_distinct("regime_type") / rows)
    return recent.groupBy("symbol").agg(ratio.alias("distinct_ratio")).withColumn(
        "alert", F.col("distinct_ratio") > limit
    )


def top_regimes(distribution: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most frequent regimes per symbol, by share."""
    w = Window.partitionBy("symbol").orderBy(F.desc("share"), "value")
    return (
        distribution.where(F.col("dimension") == "regime")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .select("symbol", F.col("value").alias("regime_type"), "share", "rank")
    )


def regime_ranking(events: DataFrame) -> DataFrame:
    """Regimes over all symbols, most frequent first."""
    counted = events.groupBy("regime_type").agg(
        F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("avg_confidence")
    )
    return counted.orderBy(F.desc("count"), "regime_type")


def cluster_label(volatility: Column, volume: Column) -> Column:
    """Name of a volatility cluster from its means."""
    return first_match(
        [
            ((volatility > 0.06) & (volume > 5), "high_vol_high_volume"),
            ((volatility > 0.06) & (volume <= 5), "high_vol_low_volume"),
            ((volatility <= 0.03) & (volume > 5), "low_vol_high_volume"),
        ],
        "low_vol_low_volume",
    )
