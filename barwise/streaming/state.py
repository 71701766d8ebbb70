"""Streams with state of their own: expiring features, rolling risk, rolling indicators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barwise.operators import risk
from barwise.operators.bars import last_write
from barwise.operators.series import BLOCK, block, in_block, number, own_rows, running
from barwise.session import materialize
from barwise.sources.sinks import read_or_none, upsert_bars
from barwise.streaming.replay import BAR_COLUMNS, replayed_indicators

# --- expiring state --------------------------------------------------------------------------

EXPIRING = "symbol string, regime string, confidence double, time timestamp, expired boolean"


def expiring_regimes(events: DataFrame, seconds: int, watermark: str | None = None) -> DataFrame:
    """The newest regime per symbol of a stream, and a row with ``expired`` once the watermark has
    passed ``seconds`` after it. Columns symbol, regime_type, confidence, timestamp.

    Rows may arrive up to the lifetime late (``watermark``, by default ``seconds``); per symbol the newest wins.
    Rows later than that could only be expired ones.
    """
    watermark = watermark or f"{seconds} seconds"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (symbol,) = key
        if state.hasTimedOut:
            regime, confidence, micros = state.get
            state.remove()
            yield _row(symbol, regime, confidence, micros, True)
            return
        best = state.get if state.exists else None
        for batch in batches:
            newest = batch.loc[batch["timestamp"].idxmax()]
            micros = int(newest["timestamp"].value // 1000)
            if best is None or micros >= best[2]:
                best = (newest["regime_type"], float(newest["confidence"]), micros)
        state.update(best)
        limit = best[2] // 1000 + seconds * 1000
        state.setTimeoutTimestamp(max(limit, state.getCurrentWatermarkMs() + 1))
        yield _row(symbol, *best, False)

    def _row(symbol, regime, confidence, micros, expired):
        time = pd.Timestamp(micros, unit="us")
        return pd.DataFrame(
            {"symbol": [symbol], "regime": [regime], "confidence": [confidence], "time": [time], "expired": [expired]}
        )

    return (
        events.withWatermark("timestamp", watermark)
        .groupBy("symbol")
        .applyInPandasWithState(
            update, EXPIRING, "regime string, confidence double, micros bigint", "update",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def expiring_table(folder: str, seconds: int, late: int = 0):
    """Batch writer of the newest regime per symbol with a lifetime, without rows of a symbol in one task.

    Columns as in :func:`expiring_regimes`. A batch is reduced to one row per symbol before its shuffle and merged with the table of
    the batch before, one row per living symbol. The clock is the latest time seen less ``late`` seconds; a regime expires when the clock reaches
    its time plus ``seconds``. ``{folder}/changes/batch=n`` gets a row per symbol whose regime is newer than before, and one
    with ``expired`` when it ends; ``{folder}/alive/batch=n`` is the state. Rows that had expired before their batch are left out,
    later rows of equal time win within a batch by regime name, over earlier batches not at all. A repeated batch gives the same.
    """
    entry = F.struct(F.col("timestamp").alias("time"), F.col("regime_type").alias("regime"), "confidence")

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        alive = read_or_none(spark, f"{folder}/alive/batch={n - 1}") if n else None
        clocks = read_or_none(spark, f"{folder}/clock/batch={n - 1}") if n else None
        before = clocks.first().clock if clocks is not None else None
        batch = batch.where(F.col("timestamp").isNotNull())
        newest = materialize(batch.groupBy("symbol").agg(F.max(entry).alias("new")).select("symbol", "new.*"), "newest-regimes")
        top = newest.agg(F.max(F.unix_micros("time")).alias("t")).first().t
        clock = max([c for c in (before, None if top is None else top - late * 1_000_000) if c is not None], default=None)
        ends = F.unix_micros("time") + seconds * 1_000_000
        if before is not None:
            newest = newest.where(ends > before)
        rows = newest.withColumn("_new", F.lit(1))
        if alive is not None:
            rows = rows.unionByName(alive.withColumn("_new", F.lit(0)))
        # Of equal times the stored row stays.
        best = F.max_by(F.struct("time", "regime", "confidence", "_new"), F.struct("time", -F.col("_new")))
        rows = rows.groupBy("symbol").agg(best.alias("_b")).select("symbol", "_b.*")
        rows = materialize(rows.withColumn("expired", F.lit(False) if clock is None else ends <= clock), "regimes-now")
        changes = rows.where((F.col("_new") == 1) | F.col("expired")).drop("_new")
        changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")
        rows.where("not expired").drop("_new", "expired").write.mode("overwrite").parquet(f"{folder}/alive/batch={n}")
        spark.range(1).select(F.lit(clock).cast("long").alias("clock")).write.mode("overwrite").parquet(f"{folder}/clock/batch={n}")

    return write


# --- rolling risk ----------------------------------------------------------------------------

TRADE = ["account", "symbol", "ts", "id", "pnl"]

def rolling_risk(folder: str, capital: float, size: int = BLOCK):
    """Batch writer of the risk state after each trade: drawdown, pnl of the day, open positions and VaR.

    Between batches an account keeps its drawdown and the pnl of its last day, its last 100 trades, and its open
    positions. They are put before the batch as trades that lead to just that state, and the block-parallel
    operators of the batch form run over both, so no account is one task. Trades of one batch are taken in time order,
    batches in the order in which they arrive. Rows are written under the batch number; a repeated batch gives the same.
    """

    def earlier(spark, name: str, n: int) -> DataFrame | None:
        return read_or_none(spark, f"{folder}/state/{name}/batch={n - 1}") if n else None

    def led_by(rows: DataFrame, carried: DataFrame | None) -> DataFrame:
        rows = rows.withColumn("_carried", F.lit(False))
        return rows if carried is None else carried.withColumn("_carried", F.lit(True)).unionByName(rows)

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = materialize(batch.select(*TRADE), "trades")
        accounts, recent, positions = (earlier(spark, name, n) for name in ("accounts", "recent", "positions"))
        before = F.lit(None).cast("string").alias("symbol"), F.lit(-1).cast("bigint").alias("id")
        # One row with the drawdown before all trades, one with the pnl of the last day at its begin; neither changes the other value.
        ahead = None if accounts is None else accounts.select("account", before[0], before[1], F.explode(F.array(
            F.struct(F.lit("1970-01-01").cast("timestamp").alias("ts"), F.lit(0.0).alias("pnl"), F.col("drawdown").alias("shift")),
            F.struct(F.date_trunc("day", "ts").alias("ts"), F.col("daily_pnl").alias("pnl"), F.lit(0.0).alias("shift")),
        )).alias("_a")).select("account", "symbol", "id", "_a.*")
        key = ["account", "id"]
        state = risk.trade_state(led_by(rows.withColumn("shift", F.lit(None).cast("double")), ahead), capital, size=size).where("not _carried")
        var = risk.rolling_var(led_by(rows, recent), capital).where("not _carried")
        book = materialize(risk.position_book(led_by(rows, positions), size=size), "positions")
        moves = block(book.select("account", "symbol", "ts", "id", "pos", "is_open"), back=1, size=size)
        was_open = F.coalesce(F.lag("is_open").over(in_block(["account", "symbol"])), F.lit(False))
        moves = own_rows(moves.withColumn("_move", F.col("is_open").cast("int") - was_open.cast("int"))).select(*key, "ts", "_move")
        idle = rows.where(F.col("symbol").isNull()).select(*key, "ts", F.lit(0).alias("_move"))
        moves = block(number(moves.unionByName(idle), ["account"], ["ts", "id"]), size=size).drop("own")
        active = running(moves, ["account"], "sum", "_move", "active_positions")
        out = (
            state.select(*key, "ts", "drawdown", "daily_pnl")
            .join(var.select(*key, "var"), key)
            .join(active.select(*key, F.col("active_positions").cast("int").alias("active_positions")), key)
        )
        out = materialize(out, "risk")
        out.write.mode("overwrite").parquet(f"{folder}/risk/batch={n}")
        newest = out.groupBy("account").agg(F.max_by(F.struct("drawdown", "ts", "daily_pnl"), F.struct("ts", "id")).alias("_s"))
        kept = newest.select("account", "_s.*")
        last = led_by(rows, recent).drop("_carried")
        held = risk.open_positions(book).select(
            "account", "symbol", F.col("opened").alias("ts"), before[1], F.col("position_pnl").alias("pnl")
        )
        if accounts is not None:
            kept = kept.unionByName(accounts.join(kept.select("account"), "account", "left_anti"))
        kept.write.mode("overwrite").parquet(f"{folder}/state/accounts/batch={n}")
        risk.last_trades(last, risk.VAR_TRADES).drop("rank").write.mode("overwrite").parquet(f"{folder}/state/recent/batch={n}")
        held.write.mode("overwrite").parquet(f"{folder}/state/positions/batch={n}")

    return write


# --- rolling indicators ----------------------------------------------------------------------


def rolling_indicators(folder: str, size: int = BLOCK):
    """Batch writer that continues all indicators bar by bar, late and corrected bars included.

    Bars are merged into ``{folder}/bars`` and scanned from the kept states (see ``replay``). Rows are written under
    the batch number; :func:`barwise.streaming.bars.newest_version` gives the current ones.
    """

    def write(batch: DataFrame, n: int) -> None:
        arrived = materialize(batch.select(*BAR_COLUMNS).withColumn("seq", F.monotonically_increasing_id()), "batch")
        if arrived.isEmpty():
            return
        new = materialize(last_write(arrived, "seq"), "new-bars")
        upsert_bars(new.withColumn("seq", F.lit(0)), f"{folder}/bars", "seq")
        rows = replayed_indicators(folder, n, new, size)
        rows.write.mode("overwrite").parquet(f"{folder}/indicators/batch={n}")

    return write
