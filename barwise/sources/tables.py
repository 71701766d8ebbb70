"""Readers with explicit schemas; times are read as instants of a UTC session."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.catalog import BARS, DEFAULT_LOOKBACK_DAYS, LOOKBACK_DAYS


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: str, upper: str, parts: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of ``column``; filters are pushed to the database."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper,
            numPartitions=parts, **options,
        )
        .load()
    )


def bars_from_records(records: DataFrame) -> DataFrame:
    """Positional records ``(symbol, fields array)`` to named columns; volume 1000 when absent."""
    field = lambda i: F.get("fields", F.lit(i))
    return records.select(
        F.timestamp_seconds(field(0)).alias("time"),
        "symbol",
        field(1).alias("open"),
        field(2).alias("high"),
        field(3).alias("low"),
        field(4).alias("close"),
        F.coalesce(field(5), F.lit(1000.0)).cast("bigint").alias("volume"),
    )


def bar_history(
    bars: DataFrame,
    start: datetime | str,
    end: datetime | str,
    symbols: list[str] | None = None,
) -> DataFrame:
    """Bars of the given symbols with ``start <= time <= end``.

    Where the table is laid out by date, the date filter prunes partitions.
    """
    start, end = F.lit(str(start)).cast("timestamp"), F.lit(str(end)).cast("timestamp")
    out = bars.where(F.col("time").between(start, end))
    if "date" in bars.columns:
        out = out.where(F.col("date").between(F.to_date(start), F.to_date(end)))
    if symbols is not None:
        out = out.where(F.col("symbol").isin(symbols))
    return out.withColumn("volume", F.coalesce(F.col("volume"), F.lit(1000)).cast("bigint"))


def lookback_days(timeframe: str) -> int:
    return LOOKBACK_DAYS.get(timeframe, DEFAULT_LOOKBACK_DAYS)


def recent_bars(bars: DataFrame, timeframe: str, as_of: str) -> DataFrame:
    """Bars inside the timeframe's look-back at ``as_of``."""
    days = lookback_days(timeframe)
    return bars.where(F.col("time") >= F.expr(f"timestamp'{as_of}' - interval {days} days"))


def tick_bars(ticks: DataFrame) -> DataFrame:
    """A polled tick as a flat bar: all prices the bid, volume 1000."""
    bid = F.col("bid")
    return ticks.select(
        "time", "symbol", bid.alias("open"), bid.alias("high"), bid.alias("low"), bid.alias("close"),
        F.lit(1000).cast("bigint").alias("volume"),
    )


def with_spread(ticks: DataFrame) -> DataFrame:
    return ticks.withColumns(
        {
            "spread": F.col("ask") - F.col("bid"),
            "volume": F.coalesce(F.col("volume"), F.lit(0)).cast("int"),
        }
    )


def tick_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def bar_stream(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return tick_stream(spark, path, BARS, fmt, **options)
