"""Feature storage forms: key-value, snapshot, history, training package and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.catalog import LIFETIME
from barwise.functions.scalars import prefixed_keys
from barwise.operators.bars import newest_per_symbol
from barwise.operators.regimes import BASIC_FEATURES, TECHNICAL_FEATURES, since

SIGNAL_FIELDS = ["nnfx_signal", "signal_confidence", "baseline_signal", "confirmation_strength"]
ENHANCED = "regime_confidence_enhanced"


def _pairs(numbers: list[str], texts: list[str]):
    null_text, null_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    fields = [
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"), null_text.alias("text"))
        for n in numbers
    ]
    fields += [
        F.struct(F.lit(n).alias("feature"), null_number.alias("value"), F.col(n).alias("text")) for n in texts
    ]
    return F.array(*fields)


def _long(features: DataFrame, extra: list) -> DataFrame:
    always = _pairs(BASIC_FEATURES, ["regime"])
    pairs = F.concat(always, *[F.when(c, p).otherwise(F.array().cast("array<struct<feature:string,value:double,text:string>>")) for c, p in extra])
    return (
        features.withColumn("regime", F.col("regime_type"))
        .select("symbol", "time", F.explode(pairs).alias("_p"))
        .select("symbol", "time", "_p.*")
    )


def key_values(features: DataFrame) -> DataFrame:
    """Long form (symbol, time, feature, value | text). Technical features only where adx > 0,
    signal features only for BUY and SELL."""
    technical = (F.coalesce(F.col("adx"), F.lit(0.0)) > 0, _pairs([*TECHNICAL_FEATURES, ENHANCED], []))
    signal = (
        F.col("nnfx_signal") != "HOLD",
        _pairs(["signal_confidence", "confirmation_strength"], ["nnfx_signal", "baseline_signal"]),
    )
    return _long(features, [technical, signal])


def bulk_key_values(features: DataFrame) -> DataFrame:
    """The many-symbol form: technical features where the enhanced confidence is > 0, signals always."""
    technical = (F.coalesce(F.col(ENHANCED), F.lit(0.0)) > 0, _pairs(["adx", "atr", "rsi", ENHANCED], []))
    return _long(features, [technical, (F.lit(True), _pairs(["signal_confidence"], ["nnfx_signal"]))])


def wide_features(long: DataFrame) -> DataFrame:
    """Back to one row per symbol and time; the list of features is fixed, so no extra job runs."""
    names = [*BASIC_FEATURES, *TECHNICAL_FEATURES, ENHANCED, "signal_confidence"]
    return long.groupBy("symbol", "time").agg(
        *[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names],
        *[F.max(F.when(F.col("feature") == n, F.col("text"))).alias(n) for n in ("regime", "nnfx_signal")],
    )


def strategy_snapshot(features: DataFrame) -> DataFrame:
    """The newest row per symbol; enhanced fields only where that confidence is > 0."""
    enhanced = F.coalesce(F.col(ENHANCED), F.lit(0.0)) > 0
    row = F.struct(
        F.col("regime_type").alias("regime"),
        F.col("regime_confidence").alias("confidence"),
        "volatility",
        F.col("trend_strength").alias("trend"),
        F.col("time").alias("timestamp"),
        "regime_model",
        F.when(enhanced, F.col(ENHANCED)).alias("confidence_enhanced"),
        F.when(enhanced, F.col("adx")).alias("adx"),
        "nnfx_signal",
        "signal_confidence",
    )
    return features.groupBy("symbol").agg(F.max_by(row, "time").alias("_row")).select("symbol", "_row.*")


def regime_history_rows(features: DataFrame) -> DataFrame:
    return features.select(
        "symbol",
        F.col("time").alias("timestamp"),
        "regime_type",
        F.col("regime_confidence").alias("confidence"),
        "regime_model",
        "nnfx_signal",
        "signal_confidence",
    )


def bounded_history(history: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` entries per symbol (100, extended 1000)."""
    return newest_per_symbol(history, n, time="timestamp")


def pushed_history(stored: DataFrame | None, new: DataFrame, n: int = 100, time: str = "timestamp") -> DataFrame:
    """The bounded list of each symbol after a batch has been put in front of the stored one.

    Both sides are cut to ``n`` rows per symbol before they meet. Of a stored and a new entry of one time the new one comes first.
    """
    sides = [(new, 1)] if stored is None else [(stored.drop("rank"), 0), (new, 1)]
    cut = [newest_per_symbol(rows, n, time).withColumn("_new", F.lit(is_new)) for rows, is_new in sides]
    both = cut[0] if stored is None else cut[0].unionByName(cut[1])
    return newest_per_symbol(both.drop("rank"), n, time, tie=["_new"]).drop("_new")


def bulk_history(features: DataFrame, stored: DataFrame | None = None, n: int = 100) -> DataFrame:
    """History half of the many-symbol form: the rows of a batch as history entries in front of the stored ones."""
    return pushed_history(stored, regime_history_rows(features), n)


def recent_packages(package: DataFrame, stored: DataFrame | None = None, n: int = 1000, as_of: str | None = None) -> DataFrame:
    """The newest ``n`` training packages per symbol, nested as they are. The whole list of a symbol is gone once its newest
    package is older at ``as_of`` than the long-term lifetime."""
    rows = pushed_history(stored, package, n)
    if as_of is None:
        return rows
    newest = rows.groupBy("symbol").agg(F.max("timestamp").alias("_newest"))
    alive = F.unix_micros("_newest") + LIFETIME["long_term"] * 1_000_000 > F.unix_micros(F.lit(as_of).cast("timestamp"))
    return rows.join(newest.where(alive).select("symbol"), "symbol", "left_semi")


def training_package(features: DataFrame) -> DataFrame:
    """Nested rows for model training: basic, technical, signals and the bar."""
    technical = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in TECHNICAL_FEATURES]
    return features.select(
        "symbol",
        F.col("time").alias("timestamp"),
        F.struct(*BASIC_FEATURES).alias("basic_features"),
        F.struct(*technical).alias("technical_features"),
        F.col("regime_type").alias("regime"),
        F.coalesce(F.col(ENHANCED), F.lit(0.0)).alias(ENHANCED),
        F.struct(*SIGNAL_FIELDS).alias("signals"),
        F.struct("time", "symbol", "open", "high", "low", "close", "volume").alias("ohlcv"),
        "regime_model",
    )


def flatten_package(package: DataFrame, as_of: str | None = None, days: int = 30) -> DataFrame:
    """Flat export rows; the bar's fields get the prefix ``ohlcv_``."""
    rows = package if as_of is None else package.where(F.col("timestamp") >= since(as_of, days))
    bar = [f.name for f in package.schema["ohlcv"].dataType]
    return rows.select(
        "timestamp",
        "symbol",
        "regime",
        "regime_model",
        "basic_features.*",
        "technical_features.*",
        "signals.*",
        *[F.col(f"ohlcv.{f}").alias(f"ohlcv_{f}") for f in bar],
    )


def bar_map(bars: DataFrame) -> DataFrame:
    """The bar as a map with prefixed keys, for open-ended records."""
    fields = ["open", "high", "low", "close"]
    m = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])
    volume = F.when(F.col("volume").isNotNull(), F.create_map(F.lit("volume"), F.col("volume").cast("double")))
    merged = F.map_concat(m, F.coalesce(volume, F.create_map().cast("map<string,double>")))
    return bars.select("symbol", "time", prefixed_keys(merged, "ohlcv_").alias("fields"))


def training_stats(package: DataFrame) -> DataFrame:
    """Record counts in total, per symbol and per model in one pass."""
    rows = package.select("symbol", F.coalesce("regime_model", F.lit("unknown")).alias("regime_model"))
    level = F.col("_level")
    return (
        rows.groupingSets([["symbol"], ["regime_model"], []], "symbol", "regime_model")
        .agg(F.count(F.lit(1)).alias("records"), F.grouping_id().alias("_level"))
        .select(
            F.when(level == 1, "symbol").when(level == 2, "model").otherwise("total").alias("dimension"),
            F.coalesce("symbol", "regime_model").alias("value"),
            "records",
        )
    )


def training_totals(package: DataFrame) -> DataFrame:
    return package.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_distinct("symbol").alias("total_symbols")
    )


def assemble_training_rows(features: DataFrame, signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Stored features, signals and bars joined on (symbol, time)."""
    key = ["symbol", "time"]
    return bars.join(features, key).join(signals, key)


def symbol_profile(
    requested: DataFrame, current: DataFrame, summary: DataFrame, features: DataFrame,
    snapshot: DataFrame, package: DataFrame, model: str,
) -> DataFrame:
    """Everything known about each requested symbol; missing parts are null, flags or 0."""
    from barwise.operators.allocation import symbol_type

    there = F.lit(True)
    counts = package.groupBy("symbol").agg(F.count(F.lit(1)).alias("training_records"))
    return (
        requested.join(current.select("symbol", F.col("regime_type").alias("current_regime")), "symbol", "left")
        .join(summary.drop("current_regime"), "symbol", "left")
        .join(features.select("symbol").distinct().withColumn("_f", there), "symbol", "left")
        .join(snapshot.select("symbol").withColumn("_s", there), "symbol", "left")
        .join(counts, "symbol", "left")
        .select(
            "symbol",
            symbol_type(F.col("symbol")).alias("symbol_type"),
            "current_regime",
            "total_periods",
            "avg_confidence",
            "regime_stability",
            "primary_model",
            F.col("_f").isNotNull().alias("ml_features_available"),
            F.col("_s").isNotNull().alias("strategy_features_available"),
            F.coalesce("training_records", F.lit(0)).alias("training_records"),
            F.lit(model).alias("regime_model"),
        )
    )
