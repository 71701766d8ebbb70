"""Event history: versioned append, filters, state by fold, typed audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.operators.series import block, number, running

ORDER = ("timestamp", "version", "id")


def check_versions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming events with ``conflict``: a version above 1 that is not above the highest one known.

    Known are the stored events and the earlier ones of the batch. A rejected event never exceeds
    that maximum, so the running maximum over all earlier rows is exact.
    """
    batch = incoming.withColumn("version", F.coalesce("version", F.lit(1)))
    highest = stored.groupBy("aggregate_id").agg(F.max("version").alias("_stored"))
    rows = block(number(batch, ["aggregate_id"], ["timestamp", "id"])).drop("own")
    rows = running(rows, ["aggregate_id"], "max", "version", "_earlier", prior=True)
    known = F.greatest(F.col("_stored"), F.col("_earlier"))
    return (
        rows.join(highest, "aggregate_id", "left")
        .withColumn("conflict", F.coalesce((F.col("version") > 1) & (known >= F.col("version")), F.lit(False)))
        .drop("_stored", "_earlier", "pos", "block")
    )


def append_events(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events to append and events rejected for their version."""
    checked = check_versions(stored, incoming)
    return (
        checked.where(~F.col("conflict")).drop("conflict"),
        checked.where("conflict").drop("conflict"),
    )


def highest_versions(events: DataFrame) -> DataFrame:
    return events.groupBy("aggregate_id").agg(F.max("version").alias("version"))


def filter_events(
    events: DataFrame,
    aggregate_id: str | None = None,
    event_type: str | None = None,
    start: str | None = None,
    end: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Events that pass the filters; a ``limit`` keeps the earliest in time order."""
    out = events
    if aggregate_id is not None:
        out = out.where(F.col("aggregate_id") == aggregate_id)
    if event_type is not None:
        out = out.where(F.col("event_type") == event_type)
    if start is not None:
        out = out.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    return out if limit is None else out.orderBy(*ORDER).limit(limit)


def reconstruct_state(events: DataFrame, field: str = "regime") -> DataFrame:
    """Current state per aggregate: the last data of each event type it reacts to. The aggregate
    combines before the shuffle, so a long history costs one row per task."""
    order = F.struct(*ORDER)

    def last(kind: str) -> Column:
        return F.max_by(F.col("data"), F.when(F.col("event_type") == kind, order))

    return events.groupBy("aggregate_id").agg(
        last("signal_generated").alias("signal"),
        last("order_placed").alias("order"),
        last("data_ingested_with_regime").alias("last_data"),
    ).withColumn("last_regime", F.get_json_object("last_data", f"$.{field}"))


def audit_events(features: DataFrame, source: str) -> DataFrame:
    """One ``data_ingested_with_regime`` event per bar, data and metadata as JSON."""
    data = F.struct(
        "open",
        "close",
        F.col("regime_type").alias("regime"),
        F.col("regime_confidence").alias("confidence"),
        F.coalesce("regime_confidence_enhanced", F.lit(0.0)).alias("enhanced_confidence"),
        "volatility",
        "trend_strength",
        "nnfx_signal",
        "signal_confidence",
    )
    used = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("adx", "atr", "rsi")]
    metadata = F.struct(
        F.lit(source).alias("source"),
        "regime_model",
        F.struct("volatility", "trend_strength", "volume_profile", *used).alias("regime_features"),
    )
    return features.select(
        F.lit("data_ingested_with_regime").alias("event_type"),
        F.col("symbol").alias("aggregate_id"),
        F.to_json(data).alias("data"),
        F.to_json(metadata).alias("metadata"),
        F.col("time").alias("timestamp"),
        F.lit(1).alias("version"),
    )


def signal_events(signals: DataFrame, time: str = "time") -> DataFrame:
    """One ``trade_signal_generated`` event per trade, id ``signal_<symbol>_<time>``."""
    fields = ["type", "volume", "sl", "tp", "confidence", "regime", "symbol"]
    return signals.select(
        F.lit("trade_signal_generated").alias("event_type"),
        F.concat_ws("_", F.lit("signal"), "symbol", F.date_format(time, "yyyyMMdd_HHmmss")).alias("aggregate_id"),
        F.to_json(F.struct(*fields)).alias("data"),
        F.to_json(
            F.struct("symbol", F.lit("nnfx").alias("strategy"), F.col("confidence").alias("original_confidence"))
        ).alias("metadata"),
        F.col(time).alias("timestamp"),
        F.lit(1).alias("version"),
    )


def regime_event_rows(features: DataFrame) -> DataFrame:
    """Regime events for the store: features as JSON, signals null for HOLD without confidence."""
    names = ["volatility", "trend_strength", "volume_profile", "price_momentum", "mean_reversion"]
    has_signal = F.col("signal_confidence") > 0
    return features.select(
        "symbol",
        "regime_type",
        F.col("regime_confidence").alias("confidence"),
        F.to_json(F.struct(*names)).alias("features"),
        F.when(has_signal, F.to_json(F.struct("nnfx_signal", "signal_confidence"))).alias("signals"),
        F.col("time").alias("timestamp"),
        "regime_model",
    )


def parse_json(events: DataFrame, column: str, schema: str) -> DataFrame:
    """Decoded payloads; rows with malformed text are skipped."""
    return (
        events.withColumn("_parsed", F.from_json(column, schema))
        .where(F.col("_parsed").isNotNull() & F.try_parse_json(column).isNotNull())
        .select("*", "_parsed.*")
        .drop("_parsed")
    )
