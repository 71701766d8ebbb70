"""Market tables derived from the shared test tables, as whole-table transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise import catalog
from barwise.operators.regimes import regime_events
from barwise.sources.tables import read_table, with_spread

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string"
)
CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
SCHEMAS = {"events": EVENTS, "orders": ORDERS, "customer": CUSTOMER}
CAPITAL = 10_000.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read_table(spark, f"{folder}/{name}.parquet", SCHEMAS[name])


def bars_of(events: DataFrame, symbol, unit: str) -> DataFrame:
    return events.groupBy(symbol.alias("symbol"), F.date_trunc(unit, "ts").alias("time")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def bars_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars, one symbol per event type."""
    return bars_of(table(spark, folder, "events"), F.col("event_type"), "hour")


def bars_by_user(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars, one symbol per user."""
    return bars_of(table(spark, folder, "events"), F.col("user_id").cast("string"), "day")


def bars_by_instrument(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of the named instruments; every user trades one of them."""
    names = F.array(*[F.lit(s) for s in catalog.SYMBOLS])
    name = F.get(names, F.pmod("user_id", F.lit(len(catalog.SYMBOLS))).cast("int"))
    return bars_of(table(spark, folder, "events"), name, "day")


def bars_weekly(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly bars of order prices, one symbol per market segment."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    segments = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    price = 1000 + F.col("o_totalprice") / 10000
    priced = orders.join(segments, orders.o_custkey == segments.c_custkey).select(
        F.col("c_mktsegment").alias("symbol"), "o_orderkey", "o_orderdate", price.alias("p")
    )
    return priced.groupBy("symbol", F.date_trunc("week", "o_orderdate").alias("time")).agg(
        F.min_by("p", "o_orderkey").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "o_orderkey").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return with_spread(raw_ticks(spark, folder))


def raw_ticks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("ts").alias("time"),
        F.col("event_type").alias("symbol"),
        F.col("value").alias("bid"),
        (F.col("value") + F.pmod("event_id", F.lit(5)) * 0.01).alias("ask"),
        F.lit(None).cast("int").alias("volume"),
    )


def trades(spark: SparkSession, folder: str) -> DataFrame:
    pnl = F.when(F.col("event_id") % 17 == 0, 0.0).otherwise(F.col("value") - 50)
    return table(spark, folder, "events").select(
        F.lit("A").alias("account"),
        F.col("user_id").cast("string").alias("symbol"),
        "ts",
        F.col("event_id").alias("id"),
        pnl.alias("pnl"),
    )


def account_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Trades of several accounts, one with a third of them; one in eleven loses."""
    kind = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), F.col("event_id") % 8))
    size = F.abs(F.col("value") - 50)
    pnl = F.when(F.col("event_id") % 17 == 0, 0.0).when(F.col("event_id") % 11 == 0, -size).otherwise(size)
    return table(spark, folder, "events").select(
        kind.alias("account"), F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), pnl.alias("pnl")
    )


# How the test events stand for the event types of the store.
EVENT_TYPES = {"click": "signal_generated", "purchase": "order_placed", "view": "data_ingested_with_regime"}


def stored_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event history, one aggregate per user, versions in time order."""
    from barwise.operators.series import number

    kind = F.col("event_type")
    for old, new in EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == old, new).otherwise(kind)
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        kind.alias("event_type"),
        F.col("user_id").cast("string").alias("aggregate_id"),
        F.col("props").alias("data"),
        F.lit("{}").alias("metadata"),
        F.col("ts").alias("timestamp"),
    )
    return number(events, ["aggregate_id"], ["timestamp", "id"]).withColumn(
        "version", (F.col("pos") + 1).cast("int")
    ).drop("pos")


def regimes_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return regime_events(bars_by_user(spark, folder))


def regimes_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return regime_events(bars_hourly(spark, folder))


def regimes_by_instrument(spark: SparkSession, folder: str) -> DataFrame:
    return regime_events(bars_by_instrument(spark, folder))
