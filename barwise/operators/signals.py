"""Strategy signals, sizes and order levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.functions.scalars import first_match, guarded
from barwise.operators.asof import asof_join
from barwise.operators.indicators import STRATEGY_GATE, strategy_indicators, with_indicators

# Limits of the strategy.
ADX_MIN, OVERBOUGHT, OVERSOLD = 25.0, 70.0, 30.0
DISTANCE, RANGE_CONFIDENCE, MIN_CONFIDENCE = 0.02, 0.7, 0.6
RISK_PER_TRADE, STOP_ATR, TARGET_ATR, REWARD_RATIO = 0.02, 1.5, 3.0, 2.0


def strategy_signal(regime: Column) -> tuple[Column, Column]:
    """(signal −1/0/1, confidence) from the strategy indicators; 0 before 50 bars."""
    c, hma, adx, rsi = (F.col(n) for n in ("close", "hma", "adx", "rsi"))
    trending = regime.contains("trending")
    distance = F.when(hma > 0, F.abs(c - hma) / hma).otherwise(F.lit(0.0))
    apart = distance > DISTANCE
    signal = first_match(
        [
            (F.col("pos") < STRATEGY_GATE - 1, 0),
            (trending & (adx > ADX_MIN) & (c > hma) & (rsi < OVERBOUGHT), 1),
            (trending & (adx > ADX_MIN) & (c < hma) & (rsi > OVERSOLD), -1),
            (trending, 0),
            (apart & (c > hma) & (rsi > OVERBOUGHT), -1),
            (apart & (c < hma) & (rsi < OVERSOLD), 1),
        ],
        0,
    )
    base = F.when(trending, F.least(F.lit(0.9), adx / 50)).otherwise(F.lit(RANGE_CONFIDENCE))
    agrees = (F.col("macd") - F.col("macd_signal")) * signal > 0
    turning = ((signal == 1) & (F.col("stoch_k") < 20)) | ((signal == -1) & (F.col("stoch_k") > 80))
    confirmed = (
        base * 0.6
        + F.when(agrees, 1.0).otherwise(0.5) * 0.2
        + F.when(turning, 1.0).otherwise(0.5) * 0.2
    )
    return signal, F.when(signal != 0, confirmed).otherwise(F.lit(0.0))


def with_strategy_signal(indicators: DataFrame, regime: Column) -> DataFrame:
    signal, confidence = strategy_signal(regime)
    return indicators.withColumn("signal", signal).withColumn("confidence", confidence)


def strategy_size(balance: float) -> dict[str, Column]:
    """Size and its measures; size 0 and null measures without a tradable signal."""
    tradable = (F.col("signal") != 0) & (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("atr") > 0)
    risk, stop = F.lit(balance * RISK_PER_TRADE), F.col("atr") * STOP_ATR
    size = risk / stop * F.col("confidence")
    return {
        "position_size": F.when(tradable, size).otherwise(F.lit(0.0)),
        "risk_amount": F.when(tradable, risk),
        "stop_loss_pips": F.when(tradable, stop),
        "risk_reward_ratio": F.when(tradable, F.lit(REWARD_RATIO)),
        "max_position_value": F.when(tradable, size * F.col("atr") * 100),
    }


def trade_levels() -> dict[str, Column]:
    """Trade type with stop and target distances; 0 when there is no trade. A missing input is
    reported in ``error`` with a null type, so it cannot be read as a sell."""
    missing = [(F.col("features_missing"), "NO_FEATURES"), (F.col("history_missing"), "NO_REGIME_HISTORY")]
    error = first_match(missing, None).cast("string")
    trade = (F.col("signal") != 0) & (F.col("confidence") >= MIN_CONFIDENCE)
    failed = error.isNotNull()

    def level(value: Column) -> Column:
        return F.when(~failed & trade, value).otherwise(F.lit(0.0))

    return {
        "error": error,
        "type": F.when(failed, F.lit(None)).when(trade, F.col("signal")).otherwise(F.lit(0)).cast("int"),
        "volume": level(F.col("position_size")),
        "sl": level(F.col("atr") * STOP_ATR),
        "tp": level(F.col("atr") * TARGET_ATR),
    }


def with_inputs(
    requests: DataFrame, features: DataFrame, history: DataFrame, columns: Sequence[str], features_age: int, history_age: int
) -> DataFrame:
    """Requests (symbol, time) with the newest features and the newest regime of their symbol, each by its own lifetime in seconds.

    Requests without them stay, with nulls and the flags ``features_missing`` and ``history_missing`` that :func:`trade_levels`
    reports. ``features`` holds symbol, time and ``columns``; ``history`` symbol, timestamp, regime_type.
    """
    found = asof_join(requests, features, ["symbol"], "time", "time", features_age, columns)
    found = found.withColumnRenamed("asof_time", "features_time")
    found = asof_join(found, history, ["symbol"], "time", "timestamp", history_age, ["regime_type"])
    return found.withColumnsRenamed({"asof_time": "history_time", "regime_type": "last_regime"}).withColumns(
        {"features_missing": F.col("features_time").isNull(), "history_missing": F.col("history_time").isNull()}
    )


def order_levels(point: float = 1.0) -> dict[str, Column]:
    """Entry, stop and target prices from the quote: a buy enters at the ask, a sell at the bid."""
    side, sl, tp = F.col("type"), F.col("sl") * point, F.col("tp") * point
    entry = F.when(side == 1, F.col("ask")).when(side == -1, F.col("bid"))
    return {"entry": entry, "sl_level": entry - side * sl, "tp_level": entry + side * tp}


def fold_of(window: int, step: int) -> Column:
    """Walk-forward fold of a bar by its position: the out-samples are disjoint and follow the
    first ``window`` bars; null before them."""
    return F.when(F.col("pos") >= window, F.expr(f"(pos - {window}) div {step}"))


def walk_forward(numbered: DataFrame, window: int = 252, step: int = 63, min_bars: int = 20) -> DataFrame:
    """Win rate per symbol and fold; indicators restart in each fold, the regime is fixed.

    Folds hold ``step`` bars each, so every fold is its own short series.
    """
    if window < STRATEGY_GATE:
        return numbered.select("symbol").where("false").selectExpr(
            "symbol", "0L fold", "0L trades", "0L wins", "0D win_rate"
        )
    keys = ["symbol", "fold"]
    lengths = numbered.groupBy("symbol").agg((F.max("pos") + 1).alias("_n"))
    folds = (
        numbered.withColumn("fold", fold_of(window, step))
        .where(F.col("fold").isNotNull())
        .join(lengths, "symbol")
        .where(F.col("fold") * step < F.col("_n") - window)
        .withColumn("pos", F.pmod(F.col("pos") - window, F.lit(step)))
        .drop("_n")
    )
    scored = with_strategy_signal(
        strategy_indicators(with_indicators(folds, keys, longest=step)), F.lit("trending_high_vol")
    )
    tested = F.col("pos") >= 20
    trades = F.count_if(tested & (F.col("signal") != 0))
    wins = F.count_if(tested & (F.col("signal") != 0) & (F.col("confidence") > 0.7))
    return (
        scored.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_bars"), trades.alias("trades"), wins.alias("wins"))
        .where(F.col("_bars") >= min_bars)
        .withColumn("win_rate", guarded(F.col("wins"), F.col("trades")))
        .drop("_bars")
    )


def walk_forward_summary(folds: DataFrame) -> DataFrame:
    return folds.groupBy("symbol").agg(
        F.avg("win_rate").alias("avg_win_rate"),
        F.count(F.lit(1)).alias("total_optimization_periods"),
    )
