"""Indicators of a stream, continued from kept states and independent of how it is cut into batches.

After each batch the states of its symbols are kept under the batch number: the last bars, the values
of the recurrences, and the time they stand at. A later batch finds, per symbol, the newest state before its own
first bar that no batch in between has overtaken, and scans the stored bars from there. So late and corrected bars
change all values after them, exactly as in the whole series, and a new bar at the end costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.operators.indicators import FIRST_SCAN, INPUTS, SECOND_SCAN, frames
from barwise.operators.scan import block_totals, carries, finish
from barwise.operators.series import BLOCK, number
from barwise.session import materialize
from barwise.sources.sinks import read_or_none

TAIL = 45
BAR_COLUMNS = ["symbol", "time", "open", "high", "low", "close", "volume"]
KEYS = ["symbol"]


def _earlier(spark, path: str, n: int) -> DataFrame | None:
    """Rows that batches before ``n`` left under ``path``, with their ``batch``."""
    rows = read_or_none(spark, path)
    return None if rows is None else rows.where(F.col("batch") < n)


def _chosen(spark, store: str, n: int, first: DataFrame) -> DataFrame | None:
    """The state to continue from: ``symbol, batch, last, next``; symbols without one start anew."""
    ends = _earlier(spark, f"{store}/state/ends", n)
    if ends is None:
        return None
    touched = _earlier(spark, f"{store}/state/touched", n).select("symbol", F.col("batch").alias("_later"), F.col("first").alias("_from"))
    overtaken = ends.join(touched, "symbol").where((F.col("_later") > F.col("batch")) & (F.col("_from") <= F.col("last")))
    usable = ends.join(first, "symbol").where(F.col("last") < F.col("first"))
    usable = usable.join(overtaken.select("symbol", "batch").distinct(), ["symbol", "batch"], "left_anti")
    newest = usable.groupBy("symbol").agg(F.max_by(F.struct("batch", "last", "next"), "batch").alias("_c"))
    return materialize(newest.select("symbol", "_c.*"), "chosen-states")


def _kept(spark, store: str, name: str, chosen: DataFrame, batches: list[int]) -> DataFrame:
    """The chosen rows of one kind of state; the literal batch numbers prune all other folders."""
    rows = spark.read.parquet(f"{store}/state/{name}").where(F.col("batch").isin(batches))
    return rows.join(chosen.select("symbol", "batch"), ["symbol", "batch"], "left_semi").drop("batch")


def _end_states(totals: DataFrame, scan) -> DataFrame:
    """The state after the last row of each series: the carry into one block more."""
    ends = totals.groupBy(*KEYS).agg((F.max("block") + 1).alias("block"))
    probes = ends.withColumns({n: F.lit(v) for n, v in scan.unit.items()})
    return carries(totals.unionByName(probes), KEYS, scan).join(ends, [*KEYS, "block"], "left_semi").drop("block")


def replayed_indicators(store: str, n: int, new: DataFrame, size: int = BLOCK) -> DataFrame:
    """All indicators of the bars from the first bar of batch ``n`` on, per symbol of the batch.

    ``new`` are the batch's bars, one per symbol and time, already merged into ``{store}/bars`` (by date).
    A repeated batch uses the same earlier states and leaves the same files.
    """
    spark = new.sparkSession
    first = materialize(new.groupBy("symbol").agg(F.min("time").alias("first")), "touched")
    first.write.mode("overwrite").parquet(f"{store}/state/touched/batch={n}")
    chosen = _chosen(spark, store, n, first)
    bars = spark.read.parquet(f"{store}/bars")
    todo = bars.join(first.select("symbol"), "symbol", "left_semi")
    batches: list[int] = []
    if chosen is not None:
        batches = [r[0] for r in chosen.select("batch").distinct().collect()]
        if first.join(chosen, "symbol", "left_anti").isEmpty():
            todo = todo.where(F.col("date") >= F.lit(chosen.agg(F.to_date(F.min("last"))).first()[0]))
        todo = todo.join(chosen.select("symbol", "last", "next"), "symbol", "left")
        todo = todo.where(F.col("last").isNull() | (F.col("time") > F.col("last"))).withColumn("next", F.coalesce("next", F.lit(0)))
    else:
        todo = todo.withColumn("next", F.lit(0))
    todo = materialize(todo.select(*BAR_COLUMNS, "next"), "bars-to-scan")
    rows = number(todo, KEYS, ["time"]).withColumn("pos", F.col("pos") + F.col("next")).drop("next")
    rows = rows.withColumn("_seen", F.lit(False))
    if batches:
        tail = _kept(spark, store, "tail", chosen, batches)
        rows = rows.unionByName(tail.withColumn("_seen", F.lit(True)))
    rows = materialize(rows, "numbered-bars")
    framed = frames(rows, KEYS, size).withColumn("own", F.col("own") & ~F.col("_seen")).drop("_seen")
    slim = framed.select(*KEYS, "block", "own", "pos", *INPUTS)
    has_new = slim.where("own").select(*KEYS, "block").distinct()
    framed, slim = (x.join(has_new, [*KEYS, "block"], "left_semi") for x in (framed, slim))

    def with_old(totals: DataFrame, name: str) -> DataFrame:
        if not batches:
            return totals
        return totals.unionByName(_kept(spark, store, name, chosen, batches).withColumn("block", F.lit(-1).cast("bigint")))

    first_totals = with_old(block_totals(slim, KEYS, FIRST_SCAN), "first")
    firsts = carries(first_totals, KEYS, FIRST_SCAN).where("block >= 0")
    second_totals = with_old(block_totals(slim, KEYS, SECOND_SCAN, firsts), "second")
    seconds = carries(second_totals, KEYS, SECOND_SCAN).where("block >= 0")
    done = finish(framed, KEYS, SECOND_SCAN, firsts.join(seconds, [*KEYS, "block"]))
    done = done.drop("block", *[c for c in INPUTS if c != "close"])
    newest = rows.groupBy("symbol").agg(F.max("pos").alias("_top"), F.max("time").alias("last"))
    last = rows.join(newest, "symbol").where(F.col("pos") > F.col("_top") - TAIL)
    last.select(*BAR_COLUMNS, "pos").write.mode("overwrite").parquet(f"{store}/state/tail/batch={n}")
    _end_states(first_totals, FIRST_SCAN).write.mode("overwrite").parquet(f"{store}/state/first/batch={n}")
    _end_states(second_totals, SECOND_SCAN).write.mode("overwrite").parquet(f"{store}/state/second/batch={n}")
    newest.select("symbol", "last", (F.col("_top") + 1).alias("next")).write.mode("overwrite").parquet(f"{store}/state/ends/batch={n}")
    return done.join(first, "symbol").where(F.col("time") >= F.col("first")).drop("first")
