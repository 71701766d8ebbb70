"""Daily tables that follow their source: writes note which symbols and days they touch, a refresh recomputes those alone.

No row is lost for being late. A refresh reads the touched dates of the source, so its work grows with what has changed and not with
the range. Touched days outside the refreshed range stay noted until a later refresh reaches them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.session import materialize, remove
from barwise.sources.sinks import on_dates, read_or_none, refresh_range, replace_dates, upsert_bars

TOUCHED = ["symbol", "bucket"]


def note_touched(rows: DataFrame, log: str, batch: int, time: str = "time") -> None:
    """Note the symbols and days of ``rows`` under the batch number; a repeated batch notes the same."""
    touched = rows.select("symbol", F.date_trunc("day", time).alias("bucket")).distinct()
    touched.write.mode("overwrite").parquet(f"{log}/touched/batch={batch}")


def logged_upsert(path: str, log: str):
    """Batch writer: bars are noted first and then merged, so that a write cut short is refreshed once more instead of missed."""

    def write(batch: DataFrame, number: int) -> None:
        arrived = materialize(batch if "seq" in batch.columns else batch.withColumn("seq", F.monotonically_increasing_id()), "batch")
        if arrived.isEmpty():
            return
        note_touched(arrived, log, number)
        upsert_bars(arrived, path, "seq")

    return write


def refresh_touched(
    source: DataFrame, log: str, path: str, build: Callable[[DataFrame], DataFrame], time: str, bucket: str, as_of: str | None = None
) -> list[date]:
    """Recompute the noted symbols and days of the refreshed range (of all, without ``as_of``) and return the dates it has read.

    ``source`` is laid out by ``date``; ``build`` makes rows with symbol and ``bucket``. What is still noted goes to the next
    run's table before the consumed notes are removed, so a refresh that was cut short is repeated whole.
    """
    spark = source.sparkSession
    runs = read_or_none(spark, f"{log}/open")
    run = -1 if runs is None else runs.agg(F.max("run")).first()[0]
    notes = read_or_none(spark, f"{log}/touched")
    batches = [] if notes is None else [r[0] for r in notes.select("batch").distinct().collect()]
    parts = [] if runs is None else [runs.where((F.col("run") == run) & F.col("symbol").isNotNull()).select(*TOUCHED)]
    parts += [notes.where(F.col("batch").isin(batches)).select(*TOUCHED)] if batches else []
    if not parts:
        return []
    pending = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    first, end = refresh_range(as_of) if as_of else (F.lit(None), F.lit(None))
    inside = (F.col("bucket") >= first) & (F.col("bucket") < end) if as_of else F.lit(True)
    pending = materialize(pending.distinct().withColumn("_now", inside), "touched")
    keys = pending.where("_now").select(*TOUCHED)
    days = [r[0] for r in keys.select(F.to_date("bucket")).distinct().collect()]
    if days:
        rows = on_dates(source, days).withColumn("_day", F.date_trunc("day", time))
        named = keys.select("symbol", F.col("bucket").alias("_day"))
        built = build(rows.join(named, ["symbol", "_day"], "left_semi").drop("_day"))
        stored = read_or_none(spark, path)
        if stored is not None:
            same = keys.select("symbol", F.col("bucket").alias(bucket))
            built = built.unionByName(on_dates(stored, days).join(same, ["symbol", bucket], "left_anti"))
        built = materialize(built, "refreshed")
        left = {r[0] for r in built.select(F.to_date(bucket)).distinct().collect()}
        replace_dates(built, path, bucket)
        for day in days:
            if day not in left:
                remove(spark, f"{path}/date={day}")
    # The row without a symbol keeps the folder readable where nothing is left.
    nothing = spark.range(1).select(F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("timestamp").alias("bucket"))
    pending.where("not _now").select(*TOUCHED).unionByName(nothing).write.mode("overwrite").parquet(f"{log}/open/run={run + 1}")
    for batch in batches:
        remove(spark, f"{log}/touched/batch={batch}")
    if run >= 0:
        remove(spark, f"{log}/open/run={run}")
    return sorted(days)
