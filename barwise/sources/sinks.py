"""Tables on shared storage: append, keyed upsert, event append, retention, range refresh, export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.operators.bars import last_write, merge_bars, resample, retain
from barwise.operators.events import check_versions
from barwise.operators.regimes import daily_regime_stats
from barwise.session import materialize, remove


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where nothing is stored yet; any other fault is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def by_date(df: DataFrame, time: str) -> DataFrame:
    """Rows laid out by date, clustered by symbol inside the files. The rebalance lets adaptive
    execution split a date that is too large for one file and join small ones."""
    dated = df.withColumn("date", F.to_date(time)).hint("rebalance", "date")
    order = [c for c in ("symbol", "aggregate_id", time) if c in df.columns]
    return dated.sortWithinPartitions("date", *order)


def dates_of(df: DataFrame, time: str) -> list:
    """The distinct dates of a batch: calendar days, so a few thousand values for decades of data."""
    return [r[0] for r in df.select(F.to_date(time)).distinct().collect()]


def on_dates(stored: DataFrame, dates: list) -> DataFrame:
    """Stored rows of these dates; the literal list prunes all other partitions."""
    return stored.where(F.col("date").isin(dates)).drop("date")


def append(df: DataFrame, path: str, time: str = "time") -> None:
    by_date(df, time).write.mode("append").partitionBy("date").parquet(path)


def replace_dates(df: DataFrame, path: str, time: str = "time") -> None:
    """Replace exactly the dates that occur in ``df``; other dates stay."""
    (
        by_date(df, time)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def upsert_bars(incoming: DataFrame, path: str, sequence: str) -> None:
    """Write bars by (time, symbol), last write wins; missing values of a write become 0, on the first one as well.

    Only the dates of the batch are read and rewritten. The merged rows are staged before their
    dates are replaced, and the result depends on the input alone, so a repeated batch is harmless.
    """
    stored = read_or_none(incoming.sparkSession, path)
    if stored is None:
        existing = incoming.drop(sequence).limit(0)
    else:
        existing = on_dates(stored, dates_of(incoming, "time"))
    replace_dates(materialize(merge_bars(existing, incoming, sequence), "merged-bars"), path)


def append_events(incoming: DataFrame, path: str) -> DataFrame:
    """Append events without a version conflict; the rejected ones are returned.

    The highest versions are a log of their own beside the events, one small row per aggregate and append,
    so an append does not read the history. The log begins from the history where there is none.
    """
    spark, log = incoming.sparkSession, f"{path.rstrip('/')}-versions"
    known = read_or_none(spark, log)
    if known is None:
        stored = read_or_none(spark, path)
        if stored is None:
            known = incoming.select("aggregate_id", "version").limit(0)
        else:
            stored.groupBy("aggregate_id").agg(F.max("version").alias("version")).write.mode("overwrite").parquet(log)
            known = spark.read.parquet(log)
    known = known.join(incoming.select("aggregate_id").distinct(), "aggregate_id", "left_semi")
    checked = materialize(check_versions(known, incoming), "checked-events")
    accepted = checked.where(~F.col("conflict")).drop("conflict")
    append(accepted, path, "timestamp")
    accepted.groupBy("aggregate_id").agg(F.max("version").alias("version")).write.mode("append").parquet(log)
    return checked.where("conflict").drop("conflict")


def rewrite_retained(path: str, target: str, spark: SparkSession, time: str, interval: str, as_of: str) -> None:
    """Copy what is not expired; expired dates are pruned, not read."""
    limit = F.to_date(F.expr(f"timestamp'{as_of}' - interval {interval}"))
    kept = retain(spark.read.parquet(path).where(F.col("date") >= limit), time, interval, as_of)
    append(kept.drop("date"), target, time)


def refresh_range(as_of: str) -> tuple:
    """The refreshed range: whole days between one month and one hour before ``as_of``."""
    start = F.expr(f"timestamp'{as_of}' - interval 1 month")
    end = F.expr(f"timestamp'{as_of}' - interval 1 hour")
    first = F.date_trunc("day", start + F.expr("interval 1 day") - F.expr("interval 1 microsecond"))
    return first, F.date_trunc("day", end)


def _refresh(source: DataFrame, time: str, as_of: str, build, path: str, bucket: str) -> None:
    """Recompute the range and replace it: days of the range that have no rows any more are emptied."""
    spark = source.sparkSession
    first, end = refresh_range(as_of)
    inside = source.where((F.col(time) >= first) & (F.col(time) < end))
    if "date" in source.columns:
        inside = inside.where(F.col("date").between(F.to_date(first), F.to_date(end))).drop("date")
    built = materialize(build(inside), "refreshed")
    stored = read_or_none(spark, path)
    if stored is not None:
        days = stored.where((F.col("date") >= F.to_date(first)) & (F.col("date") < F.to_date(end))).select("date").distinct()
        gone = [r[0] for r in days.join(built.select(F.to_date(bucket).alias("date")).distinct(), "date", "left_anti").collect()]
        for day in gone:
            remove(spark, f"{path}/date={day}")
    replace_dates(built, path, bucket)


def refresh_daily_bars(bars: DataFrame, path: str, as_of: str) -> None:
    """Recompute the daily bars of the refreshed range from all bars in it, late ones included."""
    _refresh(bars, "time", as_of, lambda b: resample(b, "D1"), path, "time")


def refresh_regime_stats(events: DataFrame, path: str, as_of: str) -> None:
    _refresh(events, "timestamp", as_of, daily_regime_stats, path, "bucket")


def write_package(package: DataFrame, path: str) -> None:
    """Nested training rows by date and symbol cluster."""
    append(package, path, "timestamp")


def export_csv(flat: DataFrame, path: str) -> None:
    flat.write.mode("overwrite").option("header", True).csv(path)
