"""Streams of ticks and bars: incremental daily tables, current regimes, the write path per batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barwise.operators import bars as bar_ops
from barwise.operators import events as event_ops
from barwise.operators import features as feature_ops
from barwise.operators import regimes
from barwise.operators.indicators import feature_indicators
from barwise.operators.series import BLOCK
from barwise.session import materialize, stored
from barwise.sources import sinks
from barwise.streaming.replay import BAR_COLUMNS, replayed_indicators

#: Rows later than this are not in the incremental tables; the batch refresh takes them in.
WATERMARK = "31 days"


def start(stream: DataFrame, checkpoint: str, each_batch, seconds: int | None = None, mode: str = "append") -> StreamingQuery:
    """Run ``each_batch`` every ``seconds``, or over all that is available when none are given."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each_batch)
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()


def daily_bars(bars: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Daily bars of a stream, kept as one small state row per symbol and day."""
    return (
        bars.withWatermark("time", watermark)
        .groupBy("symbol", F.window("time", "1 day").alias("_w"))
        .agg(
            F.min_by("open", "time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "time").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.col("_w.start").alias("time"), "open", "high", "low", "close", "volume")
    )


def daily_stats(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Daily regime statistics of a stream."""
    return (
        events.withWatermark("timestamp", watermark)
        .groupBy("symbol", "regime_type", F.window("timestamp", "1 day").alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("confidence").alias("avg_confidence"),
            F.min("confidence").alias("min_confidence"),
            F.max("confidence").alias("max_confidence"),
        )
        .select("symbol", "regime_type", F.col("_w.start").alias("bucket"), "count", "avg_confidence", "min_confidence", "max_confidence")
    )


def current_regimes(events: DataFrame) -> DataFrame:
    """The newest regime per symbol; one state row per symbol."""
    newest = F.max_by(F.struct("regime_type", "confidence", "timestamp"), "timestamp")
    return events.groupBy("symbol").agg(newest.alias("_r")).select("symbol", "_r.*")


def replace_rows(keys: list[str], path: str, time: str):
    """Batch writer for update mode: changed rows replace those with the same keys, date by date."""

    def write(batch: DataFrame, _: int) -> None:
        held = sinks.read_or_none(batch.sparkSession, path)
        if held is None:
            sinks.append(batch, path, time)
            return
        changed = materialize(batch, "changed-rows")
        old = sinks.on_dates(held, sinks.dates_of(changed, time)).join(changed, keys, "left_anti")
        sinks.replace_dates(materialize(old.unionByName(changed), "merged-rows"), path, time)

    return write


def versioned_rows(path: str):
    """Batch writer for small keyed results: every batch is its own folder, readers take the newest
    row of each key. A repeated batch overwrites its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/_batch={number}")

    return write


def newest_version(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "batch", "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def newest_batches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the newest batch that wrote a key; the other rows are of replaced versions."""
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*keys, "batch"], "left_semi").drop("batch")


# --- the write path --------------------------------------------------------------------------


def batch_features(store: str, number: int, new: DataFrame, model: str = "comprehensive", size: int = BLOCK) -> DataFrame:
    """Features, regime and signal of all bars whose values a batch changes: from its first bar of a symbol on."""
    rows = replayed_indicators(store, number, new, size)
    return regimes.with_model(regimes.basic_features(feature_indicators(rows)), model)


#: The tables that follow from the features of a batch.
OUTPUTS = ("regime_events", "key_values", "snapshot", "history", "package", "events")


def ingest(store: str, model: str = "comprehensive", source: str = "live", size: int = BLOCK, outputs: Sequence[str] = OUTPUTS):
    """Batch writer of the whole path: validate, normalize, upsert, features, regime, signal, then
    regime events, key-values, snapshot, history, training package and audit. Bad bars go to quarantine.
    ``outputs`` names the tables after the features that are wanted; bars, states and features are always kept.

    Every output lives under its batch number, so a repeated batch writes the same rows again. A bar that is sent
    again or comes late appears under a newer batch, with all later bars of its symbol; :func:`newest_batches` by symbol
    and time gives the current rows, equal to one run over all bars however the stream was cut.
    """

    def write(batch: DataFrame, number: int) -> None:
        part = f"batch={number}"
        arrived = batch if "seq" in batch.columns else batch.withColumn("seq", F.monotonically_increasing_id())
        arrived = materialize(arrived, "batch")
        good, bad = bar_ops.split_valid(bar_ops.normalize(arrived))
        bad.write.mode("overwrite").parquet(f"{store}/quarantine/{part}")
        new = materialize(bar_ops.last_write(good, "seq").select(*BAR_COLUMNS), "new-bars")
        if new.isEmpty():
            return
        sinks.upsert_bars(new.withColumn("seq", F.lit(0)), f"{store}/bars", "seq")
        rows = stored(batch_features(store, number, new, model, size), f"{store}/features/{part}")
        built = {
            "regime_events": lambda: event_ops.regime_event_rows(rows),
            "key_values": lambda: feature_ops.key_values(rows),
            "snapshot": lambda: feature_ops.strategy_snapshot(rows),
            "history": lambda: feature_ops.regime_history_rows(rows),
            "package": lambda: feature_ops.training_package(rows),
            "events": lambda: event_ops.audit_events(rows, source),
        }
        for name in outputs:
            built[name]().write.mode("overwrite").parquet(f"{store}/{name}/{part}")

    return write
