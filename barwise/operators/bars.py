"""Bars: validation, normalization, derived columns, resampling, keyed merge, retention."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.scalars import first_match, time_bucket, to_time

REQUIRED = ("time", "symbol", "open", "high", "low", "close")

# The timeframes and their widths; weeks and months follow the calendar.
TIMEFRAME_SECONDS = {"M5": 300, "M15": 900, "H1": 3600, "H4": 14400, "D1": 86400}
TIMEFRAME_UNITS = {"W1": "week", "MN1": "month"}


def reject_reason() -> Column:
    """The first rule a bar breaks, null for a good bar."""
    missing = [(F.col(c).isNull(), f"missing {c}") for c in REQUIRED]
    rules = [
        (F.col("high") < F.col("low"), "high below low"),
        ((F.col("open") <= 0) | (F.col("close") <= 0), "price not positive"),
    ]
    return first_match([*missing, *rules], None).cast("string")


def validate(bars: DataFrame) -> DataFrame:
    return bars.withColumn("reject_reason", reject_reason())


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good bars, and the quarantined ones with their reason."""
    checked = validate(bars)
    good = checked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, checked.where(F.col("reject_reason").isNotNull())


def normalize(bars: DataFrame) -> DataFrame:
    """Epoch times become timestamps, volumes whole numbers."""
    kind = dict(bars.dtypes)["time"]
    return bars.withColumns(
        {"time": to_time(F.col("time"), kind), "volume": F.col("volume").cast("bigint")}
    )


def with_derived(bars: DataFrame) -> DataFrame:
    change = F.col("close") - F.col("open")
    return bars.withColumns(
        {
            "price_range": F.col("high") - F.col("low"),
            "price_change": change,
            "price_change_pct": change / F.nullif(F.col("open"), F.lit(0.0)) * 100,
        }
    )


def bucket_start(time: str, timeframe: str) -> Column:
    if timeframe in TIMEFRAME_UNITS:
        return F.date_trunc(TIMEFRAME_UNITS[timeframe], F.col(time))
    return F.timestamp_micros(time_bucket(time, TIMEFRAME_SECONDS[timeframe]))


def resample(bars: DataFrame, timeframe: str = "D1", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, volume sum.

    All five aggregates combine before the shuffle, so a busy symbol costs one row per bucket and task.
    """
    return (
        bars.groupBy(*keys, bucket_start("time", timeframe).alias("bucket"))
        .agg(
            F.min_by("open", "time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "time").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bucket", "time")
    )


def all_timeframes(bars: DataFrame) -> DataFrame:
    """Every timeframe stacked. Each is built from the next finer one, so the input is read once
    and only the smallest bars pass through a wide shuffle."""
    fine = resample(bars, "M5")
    out = [("M5", fine)]
    for name in ("M15", "H1", "H4", "D1"):
        fine = resample(fine, name)
        out.append((name, fine))
    for name in ("W1", "MN1"):
        out.append((name, resample(fine, name)))
    stacked = None
    for name, table in out:
        part = table.withColumn("timeframe", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def ticks_to_bars(ticks: DataFrame, timeframe: str = "H1") -> DataFrame:
    """Bars of the bid with volume sum and mean spread; equal times are ordered by bid."""
    order = F.struct("time", "bid")
    return (
        ticks.groupBy("symbol", bucket_start("time", timeframe).alias("bucket"))
        .agg(
            F.min_by("bid", order).alias("open"),
            F.max("bid").alias("high"),
            F.min("bid").alias("low"),
            F.max_by("bid", order).alias("close"),
            F.sum("volume").alias("volume"),
            F.avg("spread").alias("mean_spread"),
        )
        .withColumnRenamed("bucket", "time")
    )


def merge_bars(existing: DataFrame, incoming: DataFrame, sequence: str) -> DataFrame:
    """Upsert by (time, symbol): the incoming row with the highest ``sequence`` replaces all values.

    The last write is found by an aggregate that combines before the shuffle, so a key sent many
    times does not grow one task; then one full join on the key. Missing values become 0.
    """
    keys = ["time", "symbol"]
    values = [c for c in ("open", "high", "low", "close", "volume") if c in existing.columns]
    newest = incoming.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values]), sequence).alias("_new")
    )
    return existing.join(newest, keys, "full").select(
        *keys,
        *[
            F.when(F.col("_new").isNotNull(), F.col("_new")[v]).otherwise(F.col(v)).alias(v)
            for v in values
        ],
    )


def last_write(incoming: DataFrame, sequence: str) -> DataFrame:
    """Only the final version of each (time, symbol) of a batch."""
    keys = ["time", "symbol"]
    rest = [c for c in incoming.columns if c not in (*keys, sequence)]
    return (
        incoming.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), sequence).alias("_row"))
        .select(*keys, "_row.*")
    )


def retain(df: DataFrame, time: str, interval: str, as_of: datetime | str) -> DataFrame:
    """Rows not older than ``interval`` at ``as_of``; a plain range filter, pushed to the scan."""
    limit = F.expr(f"timestamp'{as_of}' - interval {interval}")
    return df.where(F.col(time) >= limit)


def table_summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min("time").alias("earliest"),
        F.max("time").alias("latest"),
    )


def newest_per_symbol(
    df: DataFrame, n: int, time: str = "time", keys: Sequence[str] = ("symbol",), tie: Sequence[str] = ()
) -> DataFrame:
    """The newest ``n`` rows of each symbol with their rank; tasks keep ``n`` rows per symbol
    before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time), *[F.desc(t) for t in tie])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
