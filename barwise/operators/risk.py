"""Position sizes, circuit breakers, drawdown, positions, value at risk and trade approval."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.scalars import first_match, interpolated_quantile
from barwise.operators import scan as scans
from barwise.operators.bars import newest_per_symbol
from barwise.operators.scan import Scan, prefix_scan
from barwise.operators.series import BLOCK, block, in_block, longest, number, own_rows, running
from barwise.session import materialize

# Limits of the risk rules.
RISK_SHARE, STOP_ATR, MAX_POSITION, MIN_LOT = 0.02, 1.5, 0.1, 0.01
MAX_DAILY_LOSS, RECOVERY, CORRELATED, HARD_LIMIT = 0.05, 0.1, 0.7, 0.145
VAR_TRADES, VAR_MIN, RETAINED = 100, 30, 1000


def drawdown_factor(drawdown: Column) -> Column:
    return first_match([(drawdown <= 0.02, 1.0), (drawdown <= 0.05, 0.75), (drawdown <= 0.10, 0.5)], 0.25)


def risk_size(capital: float) -> dict[str, Column]:
    """Size and measures from atr, price, confidence and drawdown; the lot floor comes after the cap."""
    atr, price = F.col("atr"), F.col("price")
    valid = (atr > 0) & (price > 0)
    base = F.lit(capital * RISK_SHARE) / (atr * STOP_ATR)
    confident = base * F.col("confidence")
    factor = drawdown_factor(F.col("drawdown"))
    largest = F.lit(capital * MAX_POSITION) / price
    final = F.greatest(F.lit(MIN_LOT), F.least(confident * factor, largest))

    def measure(x: Column) -> Column:
        return F.when(valid, x)

    return {
        "risk_amount": measure(F.lit(capital * RISK_SHARE)),
        "stop_loss_distance": measure(atr * STOP_ATR),
        "base_size": measure(base),
        "confidence_size": measure(confident),
        "drawdown_factor": measure(factor),
        "max_size": measure(largest),
        "final_size": F.when(valid, final).otherwise(F.lit(0.0)),
        "position_value": measure(final * price),
    }


def circuit_breakers(size: Column, capital: float, cumulative: bool = True) -> Column:
    """Size after the breakers on drawdown and daily pnl. Cumulative tiers multiply (.375 above
    10 %), otherwise the second tier stands alone (.5)."""
    drawdown, daily = F.col("drawdown"), F.col("daily_pnl")
    second = 0.75 * 0.5 if cumulative else 0.5
    return first_match(
        [
            ((drawdown > HARD_LIMIT) | (daily < -capital * MAX_DAILY_LOSS), 0.0),
            (drawdown > 0.10, second),
            (drawdown > 0.05, 0.75),
        ],
        1.0,
    ) * size


def approve_trades(requests: DataFrame, capital: float, cumulative: bool = True) -> DataFrame:
    """Approved size per request with atr, price, confidence, drawdown, daily_pnl and
    correlation_factor."""
    sized = requests.withColumns(risk_size(capital))
    before = F.col("final_size") * F.coalesce(F.col("correlation_factor"), F.lit(1.0))
    return (
        sized.withColumn("_before", before)
        .withColumn("approved_size", circuit_breakers(F.col("_before"), capital, cumulative))
        .withColumn("circuit_breaker_applied", F.col("_before") != F.col("approved_size"))
        .drop("_before")
    )


# --- trade state -----------------------------------------------------------------------------


def numbered_trades(trades: DataFrame, keys: Sequence[str] = ("account",), most: int | None = None) -> DataFrame:
    return number(trades, keys, ["ts", "id"], most=most)


def _together(first: Scan, second: Scan) -> Scan:
    """Two scans over the same rows as one; their state and output names differ."""

    def total(rows: pa.Table, before: dict) -> dict:
        return {**first.total(rows, before), **second.total(rows, before)}

    def merge(left: dict, right: dict) -> dict:
        return {**first.merge(left, right), **second.merge(left, right)}

    def run(rows: pa.Table, before: dict) -> dict:
        return {**first.run(rows, before), **second.run(rows, before)}

    return Scan(
        f"{first.state}, {second.state}", {**first.unit, **second.unit}, total, merge, run,
        f"{first.out}, {second.out}",
    )


def _daily_scan() -> Scan:
    """Running sum of ``pnl`` within runs of equal ``_day``. A block is its first and last day, the sum of its last day, and whether that is
    its only one."""

    def sums(day: np.ndarray, pnl: np.ndarray, last: int | None, tail: float) -> np.ndarray:
        # Each day is summed by itself: differences of one long sum would lose digits.
        runs = [np.cumsum(x) for x in np.split(pnl, np.flatnonzero(day[1:] != day[:-1]) + 1)]
        if last is not None and day[0] == last:
            runs[0] = runs[0] + tail
        return np.concatenate(runs)

    def total(rows: pa.Table, _: dict) -> dict:
        day, pnl = rows["_day"].to_numpy(), scans.values(rows, "pnl")
        return {"day_first": int(day[0]), "day_last": int(day[-1]), "day_sum": float(sums(day, pnl, None, 0.0)[-1]), "day_only": bool(day[0] == day[-1])}

    def merge(left: dict, right: dict) -> dict:
        if left["day_last"] is None or right["day_last"] is None:
            return {n: (right if left["day_last"] is None else left)[n] for n in left}
        joins = right["day_only"] and right["day_first"] == left["day_last"]
        return {
            "day_first": left["day_first"], "day_last": right["day_last"],
            "day_sum": right["day_sum"] + (left["day_sum"] if joins else 0.0), "day_only": joins and left["day_only"],
        }

    def run(rows: pa.Table, before: dict) -> dict[str, np.ndarray]:
        return {"daily_pnl": sums(rows["_day"].to_numpy(), scans.values(rows, "pnl"), before["day_last"], before["day_sum"])}

    unit = {"day_first": None, "day_last": None, "day_sum": 0.0, "day_only": True}
    return Scan("day_first bigint, day_last bigint, day_sum double, day_only boolean", unit, total, merge, run, "daily_pnl double")


def trade_state(trades: DataFrame, capital: float, size: int = BLOCK) -> DataFrame:
    """Drawdown after each trade of an account, and its pnl of the day so far.

    A loss adds its share of the capital, a gain takes a tenth of its share off, within [0, 1].
    The daily sum restarts at the first trade of a day. Where ``shift`` is given and not null, it takes the place of the trade's own effect on the
    drawdown.
    """
    share = F.abs(F.col("pnl")) / capital
    shift = F.when(F.col("pnl") < 0, share).otherwise(-share * RECOVERY)
    if "shift" in trades.columns:
        shift = F.coalesce("shift", shift)
    most = longest(trades, ["account"])
    rows = block(numbered_trades(trades, most=most), size=size).drop("own")
    rows = rows.withColumns(
        {"_shift": shift, "_day": F.unix_date(F.to_date("ts")).cast("long")}
    )
    if most > size:  # totals and rows are read apart
        rows = materialize(rows, "numbered-trades")
    both = _together(scans.clamp("_shift", "drawdown"), _daily_scan())
    return prefix_scan(rows, ["account"], both, most <= size).drop("shift", "_shift", "_day", "block")


def _position_scan() -> Scan:
    """Open/closed book of one symbol. A block is summed up for both cases of the state before it:
    ``c_*`` when closed, ``o_*`` when open; a null ``o_at`` means the old position is still open.

    Between two rows that differ in ``_stretch`` all positions close; ``first`` and ``last`` are those of the block."""

    def play(rows: pa.Table, opened: bool, pnl: float, at: int | None, last: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per trade: open or not, pnl since it opened, opening time, and whether that is in these rows."""
        won, reset, stretch = scans.values(rows, "pnl"), rows["_reset"].to_numpy(), rows["_stretch"].to_numpy()
        n, place = len(won), np.arange(len(won))
        cut = np.concatenate([[last is not None and stretch[0] != last], stretch[1:] != stretch[:-1]])
        # A reset closes; a trade that is not zero, or any after a cut, leaves the position open; zeros after one of these turn it each time.
        sure = reset | (won != 0) | cut
        latest = np.maximum.accumulate(np.where(sure, place, -1))
        turns = place - latest
        is_open = np.where(latest >= 0, ~reset[latest], opened) ^ (turns % 2 == 1)
        begins = is_open & (cut | ~np.concatenate([[opened], is_open[:-1]]))
        begun = np.maximum.accumulate(np.where(begins, place, -1))
        total = np.cumsum(won)
        since = np.where(begun >= 0, total - (total - won)[begun], total + pnl)
        return is_open, since, np.where(begun >= 0, rows["_at"].to_numpy()[begun], at or 0), (begun >= 0) | (at is not None)

    def total(rows: pa.Table, _: dict) -> dict:
        out = {}
        for side, opened in (("c", False), ("o", True)):
            is_open, pnl, at, known = (x[-1] for x in play(rows, opened, 0.0, None, None))
            out |= {f"{side}_open": bool(is_open), f"{side}_pnl": float(pnl) if is_open else 0.0, f"{side}_at": int(at) if is_open and known else None}
        return out | {"first": rows["_stretch"][0].as_py(), "last": rows["_stretch"][-1].as_py()}

    def merge(left: dict, right: dict) -> dict:
        if left["last"] is None or right["last"] is None:
            return right if left["last"] is None else left
        out = {"first": left["first"], "last": right["last"]}
        for side in "co":
            opened, pnl, at = (left[f"{side}_{n}"] for n in ("open", "pnl", "at"))
            if not opened or left["last"] != right["first"]:
                opened, pnl, at = right["c_open"], right["c_pnl"], right["c_at"]
            elif right["o_open"] and right["o_at"] is None:
                pnl = pnl + right["o_pnl"]
            else:
                opened, pnl, at = right["o_open"], right["o_pnl"], right["o_at"]
            out.update({f"{side}_open": opened, f"{side}_pnl": pnl, f"{side}_at": at})
        return out

    def run(rows: pa.Table, before: dict) -> dict:
        is_open, pnl, at, known = play(rows, before["c_open"], before["c_pnl"], before["c_at"], before["last"])
        return {
            "is_open": is_open,
            "position_pnl": pa.array(pnl, mask=~is_open),
            "_opened": pa.array(at.astype(np.int64), mask=~(is_open & known)),
        }

    unit = {"c_open": False, "c_pnl": 0.0, "c_at": None, "o_open": True, "o_pnl": 0.0, "o_at": None, "first": None, "last": None}
    ddl = ", ".join(f"{s}_open boolean, {s}_pnl double, {s}_at bigint" for s in "co") + ", first bigint, last bigint"
    return Scan(ddl, unit, total, merge, run, "is_open boolean, position_pnl double, _opened bigint")


def position_book(trades: DataFrame, size: int = BLOCK, keys: Sequence[str] = ("account", "symbol")) -> DataFrame:
    """Per trade the state of its symbol's position: open or not, pnl since it opened, opening time.

    Any trade opens a closed position, a zero closes an open one, others add to it. Rows with a true
    ``reset`` (an emergency close) clear it; where ``emergencies`` changes between two trades, all positions closed in between. Trades
    without a symbol have no position.
    """
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in trades.columns else F.lit(False)
    stretch = F.col("emergencies") if "emergencies" in trades.columns else F.lit(0)
    held = trades.where(F.col("symbol").isNotNull())
    most = longest(held, keys)
    rows = block(numbered_trades(held, keys, most), size=size)
    rows = rows.withColumns({"_at": F.unix_micros("ts"), "_reset": reset, "_stretch": stretch.cast("long")})
    if most > size:  # totals and rows are read apart
        rows = materialize(rows, "numbered-trades")
    return (
        prefix_scan(rows.drop("own"), keys, _position_scan(), most <= size)
        .withColumn("opened", F.timestamp_micros("_opened"))
        .drop("_at", "_reset", "_stretch", "_opened", "block")
    )


def emergency_book(trades: DataFrame, capital: float, size: int = BLOCK) -> DataFrame:
    """The position book where a drawdown above the hard limit closes all positions of the account.

    The drawdown follows from the pnl alone, so it is scanned first. ``emergencies`` counts the closes of the account before the trade: trades
    of a symbol that differ in it are parted by a close, and the scan of the symbol's book begins anew there. A trade with ``reset`` is itself
    followed by a close. Columns of the trades, ``pos`` (place in the account), ``drawdown``, ``daily_pnl``, ``emergencies``,
    ``reset``, and those of the book.
    """
    return _book_of_states(materialize(trade_state(trades, capital, size), "trade-states"), size)


def _book_of_states(state: DataFrame, size: int = BLOCK) -> DataFrame:
    """The emergency book of written trade states."""
    hit = F.col("drawdown") > HARD_LIMIT
    state = block(state.withColumns({"reset": hit, "_hit": hit.cast("long")}), size=size).drop("own")
    state = running(state, ["account"], "sum", "_hit", "emergencies", prior=True).drop("_hit", "block")
    book = position_book(state.withColumnRenamed("pos", "_place"), size)
    return book.drop("pos").withColumnRenamed("_place", "pos")


def open_positions(book: DataFrame) -> DataFrame:
    """The positions open after the last trade of each symbol; of an emergency book those that no later close has met."""
    names = ["is_open", "position_pnl", "opened"]
    if "emergencies" not in book.columns:
        last = book.groupBy("account", "symbol").agg(F.max_by(F.struct(*names), "pos").alias("_s"))
        return last.select("account", "symbol", "_s.*").where("is_open").drop("is_open")
    closes = book.groupBy("account").agg(F.max(F.col("emergencies") + F.col("reset").cast("long")).alias("_all"))
    last = book.groupBy("account", "symbol").agg(F.max_by(F.struct(*names, "emergencies"), "pos").alias("_s"))
    held = last.select("account", "symbol", "_s.*").where("is_open").join(closes, "account").where(F.col("emergencies") == F.col("_all"))
    return held.select("account", "symbol", "position_pnl", "opened")


def rolling_var(trades: DataFrame, capital: float, confidence: float = 0.95) -> DataFrame:
    """Value at risk at each trade over the account's last 100; 0 below 30 trades."""
    w = in_block(["account"]).rowsBetween(1 - VAR_TRADES, 0)
    rows = block(numbered_trades(trades), back=VAR_TRADES - 1)
    rows = rows.withColumn("_last", F.collect_list(F.col("pnl") / capital).over(w))
    quantile = interpolated_quantile(F.col("_last"), 1 - confidence)
    return own_rows(
        rows.withColumn("var", F.when(F.col("pos") + 1 >= VAR_MIN, quantile).otherwise(0.0))
    ).drop("_last", "block")


def last_trades(trades: DataFrame, n: int) -> DataFrame:
    return newest_per_symbol(trades, n, time="ts", keys=("account",), tie=("id",))


def value_at_risk(trades: DataFrame, capital: float, confidence: float = 0.95) -> DataFrame:
    """VaR and expected shortfall of each account over its last 100 trades."""
    recent = last_trades(trades, VAR_TRADES).groupBy("account").agg(
        F.collect_list(F.col("pnl") / capital).alias("_r")
    )
    return _tail_risk(recent, confidence).drop("_r")


def _tail_risk(recent: DataFrame, confidence: float) -> DataFrame:
    """``var_95`` and ``expected_shortfall`` of the returns in ``_r``."""
    enough = F.size("_r") >= VAR_MIN
    quantile = interpolated_quantile(F.col("_r"), 1 - confidence)
    tail = F.filter("_r", lambda x: x <= F.col("var_95"))
    mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)
    return recent.withColumn("var_95", F.when(enough, quantile).otherwise(0.0)).withColumn(
        "expected_shortfall", F.when(enough, mean).otherwise(0.0)
    )


def risk_report(trades: DataFrame, capital: float, retained: int | None = None, emergencies: bool = False) -> DataFrame:
    """One row per account: drawdown, pnl of the last day, open positions, VaR and trade counts, of all
    trades or of the newest ``retained`` ones. With ``emergencies`` positions close at the hard limit.

    The trades are numbered once; counts and value at risk are taken from the written states by their places. Positions of trades
    without a symbol do not exist, but such trades count.
    """
    state = materialize(trade_state(trades, capital).select("account", "symbol", "ts", "id", "pnl", "pos", "drawdown", "daily_pnl"), "trade-states")
    ends = state.groupBy("account").agg(F.max_by(F.struct("drawdown", "daily_pnl"), "pos").alias("_s"), (F.max("pos") + 1).alias("_n"))
    back = F.col("_n") - F.col("pos")
    counted = F.lit(True) if retained is None else back <= retained
    recent = F.when(back <= VAR_TRADES, F.col("pnl") / capital)
    sums = state.join(ends, "account").groupBy("account").agg(
        F.first("_s").alias("_s"),
        F.count_if(counted).alias("total_trades"),
        F.count_if(counted & (F.col("pnl") > 0)).alias("winning_trades"),
        F.count_if(counted & (F.col("pnl") < 0)).alias("losing_trades"),
        F.collect_list(recent).alias("_r"),  # nulls are left out: at most the last trades
    )
    book = _book_of_states(state) if emergencies else position_book(state.select("account", "symbol", "ts", "id", "pnl"))
    positions = open_positions(book).groupBy("account").agg(F.count(F.lit(1)).alias("active_positions"))
    return (
        _tail_risk(sums, 0.95)
        .select(
            "account", F.col("_s.drawdown").alias("current_drawdown"), "_s.daily_pnl", "total_trades", "winning_trades", "losing_trades",
            "var_95", "expected_shortfall",
        )
        .join(positions, "account", "left")
        .withColumn("active_positions", F.coalesce("active_positions", F.lit(0)))
    )


def _fold(states: Column, merge) -> Column:
    """Merge of an array of structs, first to last."""
    return F.aggregate(F.slice(states, 2, F.greatest(F.size(states) - 1, F.lit(0))), F.element_at(states, 1), merge)


def _fall(start: Column, values: Column) -> Column:
    """``sum``, ``high`` and ``low`` (of the running sum, 0 included) and ``fall`` (the largest, from any earlier high) of a list."""

    def step(s: Column, x: Column) -> Column:
        total = s["sum"] + x
        high = F.greatest(s["high"], total)
        return F.struct(
            total.alias("sum"), high.alias("high"), F.least(s["low"], total).alias("low"), F.greatest(s["fall"], high - total).alias("fall")
        )

    return F.aggregate(values, start, step)


def _falls_merged(a: Column, b: Column) -> Column:
    """The same of two lists in a row. Highs, lows and falls of the second are taken from the sum of the first on."""
    return F.struct(
        b["block"].alias("block"),
        (a["n"] + b["n"]).alias("n"),
        ((a["n"] * a["mean"] + b["n"] * b["mean"]) / (a["n"] + b["n"])).alias("mean"),
        (a["m2"] + b["m2"] + (b["mean"] - a["mean"]) ** 2 * a["n"] * b["n"] / (a["n"] + b["n"])).alias("m2"),
        (a["sum"] + b["sum"]).alias("sum"),
        F.greatest(a["high"], a["sum"] + b["high"]).alias("high"),
        F.least(a["low"], a["sum"] + b["low"]).alias("low"),
        F.greatest(a["fall"], b["fall"], a["high"] - a["sum"] - b["low"]).alias("fall"),
    )


def performance_metrics(trades: DataFrame, capital: float, size: int = BLOCK) -> DataFrame:
    """Per account, symbol and day: return, volatility, Sharpe ratio, largest drawdown of the
    cumulative pnl.

    One pass: a block of up to ``size`` trades is one state (count, mean and squares, sum, highest and lowest running sum, largest fall);
    the states of the blocks of a group are merged in order.
    """
    keys = ["account", "symbol", "day"]
    rows = trades.select("account", "symbol", F.to_date("ts").alias("day"), "ts", "id", "pnl")
    most = longest(rows, keys)
    rows = number(rows, keys, ["ts", "id"], rows=size).withColumn("block", F.expr(f"pos div {size}")) if most > size else rows.withColumn("block", F.lit(0).cast("long"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "pnl"))), lambda t: t["pnl"])
    zero = F.lit(0.0)
    start = F.struct(zero.alias("sum"), zero.alias("high"), zero.alias("low"), zero.alias("fall"))
    share = F.col("pnl") / capital
    blocks = rows.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(share).alias("mean"), (F.var_pop(share) * F.count(F.lit(1))).alias("m2"),
        _fall(start, listed).alias("_f"),
    )
    state = F.struct("block", "n", "mean", "m2", "_f.sum", "_f.high", "_f.low", "_f.fall")
    whole = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(state)).alias("_s")).withColumn("_t", _fold(F.col("_s"), _falls_merged))
    volatility = F.when(F.col("_t.n") > 1, F.sqrt(F.col("_t.m2") / (F.col("_t.n") - 1)))
    return whole.select(
        *keys,
        (F.col("_t.sum") / capital).alias("returns"),
        volatility.alias("volatility"),
        (F.col("_t.fall") / capital).alias("max_drawdown"),
        F.when(volatility > 0, F.col("_t.mean") / volatility).alias("sharpe_ratio"),
    )


# --- correlation -----------------------------------------------------------------------------


def close_returns(bars: DataFrame) -> DataFrame:
    """Return of each bar on the bar before; null for the first bar and after a zero close."""
    w = in_block(["symbol"])
    before = F.lag("close").over(w)
    rows = block(number(bars.select("symbol", "time", "close"), ["symbol"], ["time"]), back=1)
    return (
        own_rows(rows.withColumn("ret", F.when(before != 0, F.col("close") / before - 1)))
        .where(F.col("ret").isNotNull())
        .select("symbol", "time", "ret")
    )


#: Series of a tile and times of a stretch. A piece of a tile has ``TILE * STRETCH`` returns, a task the matrices of two tiles over one stretch.
TILE, STRETCH = 256, 4096
#: Symbols with equal series that share a column of a tile; rows per Arrow batch of pairs of symbols.
MEMBERS, SPREAD = 64, 500_000
#: Parts of a side of the product at least, tiles of a part on the left; returns (20 bytes each) that a task keeps of the right side.
SIDE, HELD = 16, 2_000_000
SUMS = ("n", "x", "y", "xx", "yy", "xy")
PIECE = "tile int, piece bigint, first bigint, last bigint, place binary, time binary, ret binary"
PAIRS = "candidate string, open_symbol string, common_bars bigint, correlation double"
HIGHEST = "candidate string, max_correlation double, own double, met boolean"


class _Piece:
    """Returns of the series of a tile in time order, and the symbols of each series."""

    def __init__(self, row: pa.StructScalar):
        columns = row["columns"]
        self.of = row["tile"].as_py(), row["piece"].as_py()
        self.series = pa.array(columns.values.field("series"))
        symbols = columns.values.field("symbols")
        self.symbols, self.starts = symbols.flatten(), np.concatenate([[0], np.cumsum(symbols.value_lengths().to_numpy(False))])
        self.place, self.time, self.ret = (np.frombuffer(row[n].as_buffer(), t) for n, t in (("place", "i4"), ("time", "i8"), ("ret", "f8")))
        self.times = self.time[np.concatenate([[True], self.time[1:] != self.time[:-1]])]
        self.columns: dict[str, list[int]] = {}
        for i, name in enumerate(self.series.to_pylist()):
            self.columns.setdefault(name, []).append(i)

    def matrices(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Returns and presence as matrices (times, series) over ``times``, which are sorted."""
        on = slice(np.searchsorted(self.time, times[0]), np.searchsorted(self.time, times[-1], "right"))
        line = np.searchsorted(times, self.time[on])
        kept = times[line] == self.time[on]
        line, column = line[kept], self.place[on][kept]
        value, there = np.zeros((len(times), len(self.series))), np.zeros((len(times), len(self.series)))
        value[line, column], there[line, column] = self.ret[on][kept], 1.0
        return value, there


def _packed(key: tuple, rows: pa.Table) -> pa.Table:
    """The rows of a piece as one."""
    rows = rows.sort_by("_t")
    time = rows["_t"].to_numpy()
    data = [rows["place"].to_numpy().astype("i4").tobytes(), time.astype("i8").tobytes(), rows["ret"].to_numpy().astype("f8").tobytes()]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    row = [*(k.as_py() for k in key), int(time[0]), int(time[-1]), *data]
    return pa.table({c.split()[0]: pa.array([x], k) for c, x, k in zip(PIECE.split(", "), row, kinds, strict=True)})


def _piece_sums(left: _Piece, right: _Piece, stretch: int) -> np.ndarray | None:
    """Sums over the common times of all pairs of series (one matrix for each of ``SUMS``)."""
    times = left.times if np.array_equal(left.times, right.times) else np.intersect1d(left.times, right.times, assume_unique=True)
    out = None
    for low in range(0, len(times), stretch):
        (x, x_there), (y, y_there) = (p.matrices(times[low : low + stretch]) for p in (left, right))
        sums = [x_there.T @ y_there, x.T @ y_there, x_there.T @ y, (x**2).T @ y_there, x_there.T @ (y**2), x.T @ y]
        out = sums if out is None else [a + b for a, b in zip(out, sums, strict=True)]
    return out


def _correlated(sums: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs have common times, and the correlation and whether it exists, per pair."""
    n, x, y, xx, yy, xy = sums
    spread = (n * xx - x**2) * (n * yy - y**2)
    known = spread > 0
    return n > 0, np.where(known, (n * xy - x * y) / np.sqrt(np.where(known, spread, 1.0)), -np.inf), known


def _same_series(left: _Piece, right: _Piece) -> list[tuple[int, int]]:
    """The places in the matrices where a series meets itself."""
    return [(i, j) for name in left.columns.keys() & right.columns.keys() for i in left.columns[name] for j in right.columns[name]]


def _pair_rows(left: _Piece, right: _Piece, sums: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row per pair of symbols, ``SPREAD`` at a time or those of one pair of series."""
    met, value, known = _correlated(sums)
    a, b = np.nonzero(met)
    wide, rows = np.diff(right.starts)[b], np.diff(left.starts)[a] * np.diff(right.starts)[b]
    ends, some = np.cumsum(rows), bool(_same_series(left, right))
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SPREAD, "right")))
        pair = np.repeat(np.arange(low, high), rows[low:high])
        nth = np.arange(len(pair)) - np.repeat(ends[low:high] - rows[low:high] - ends[low] + rows[low], rows[low:high])
        i, j = a[pair], b[pair]
        names = [left.symbols.take(pa.array(left.starts[i] + nth // wide[pair])), right.symbols.take(pa.array(right.starts[j] + nth % wide[pair]))]
        out = [*names, pa.array(sums[0][i, j].astype(np.int64)), pa.array(value[i, j], mask=~known[i, j])]
        out = pa.RecordBatch.from_arrays(out, [c.split()[0] for c in PAIRS.split(", ")])
        yield out.filter(pc.not_equal(*names)) if some else out
        low = high


def _highest_rows(left: _Piece, right: _Piece, sums: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Highest correlation with other series (``met``: there is one with common times), and with the series itself where it is on both sides."""
    met, value, known = _correlated(sums)
    value[~(met & known)] = -np.inf
    own = np.full(len(value), -np.inf)
    for i, j in _same_series(left, right):
        own[i], value[i, j], met[i, j] = value[i, j], -np.inf, False
    best = value.max(axis=1, initial=-np.inf)
    columns = [left.series, pa.array(best, mask=np.isinf(best)), pa.array(own, mask=np.isinf(own)), pa.array(met.any(axis=1))]
    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in HIGHEST.split(", ")])


def _equal_series(returns: DataFrame, opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``symbol, series, open`` of all symbols, and per series the number of its returns, symbols and open symbols.

    Symbols with the same returns at the same times (by number and two sums of 64-bit hashes) share a series, named by its smallest symbol.
    """
    flags = opened.select("symbol").distinct().withColumn("open", F.lit(True))
    prints = [F.sum(F.xxhash64(*c).cast("decimal(20,0)")).alias(n) for n, c in (("_a", ("time", "ret")), ("_b", ("ret", "time", F.lit(1))))]
    symbols = returns.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), *prints).join(flags, "symbol", "left")
    symbols = materialize(symbols.withColumn("open", F.coalesce("open", F.lit(False))), "series-prints")
    series = symbols.groupBy("_n", "_a", "_b").agg(F.min("symbol").alias("series"), F.count(F.lit(1)).alias("symbols"), F.count_if("open").alias("opened"))
    series = materialize(series, "equal-series")
    members = symbols.join(series, ["_n", "_a", "_b"]).select("symbol", "series", "open")
    return materialize(members, "series-members"), series.select(F.col("series").alias("symbol"), F.col("_n").alias("rows"), "symbols", "opened")


def _columns(series: DataFrame, members: DataFrame | None) -> DataFrame:
    """``series, rows, symbols`` of the columns of tiles: a series for up to ``MEMBERS`` or so of its symbols, without ``members`` once."""
    if members is None:
        return series.select(F.col("symbol").alias("series"), "rows", F.array().cast("array<string>").alias("symbols"))
    sizes = series.select(F.col("symbol").alias("series"), "rows", F.ceil(F.col("symbols") / MEMBERS).alias("_chunks"))
    chunk = F.pmod(F.xxhash64("symbol"), F.col("_chunks")).alias("_chunk")
    return members.join(sizes, "series").groupBy("series", "rows", chunk).agg(F.collect_list("symbol").alias("symbols")).drop("_chunk")


def _tiles(returns: DataFrame, columns: DataFrame, tile: int, stretch: int) -> tuple[DataFrame, int, int, int]:
    """Pieces of tiles as rows that hold them packed (``PIECE``, and ``columns``, ``pieces`` of the tile), their number, that of the tiles, and
    the most pieces of a series.

    Columns of about equal length share tiles, fewer the longer they are, so that a tile has ``tile * stretch`` returns or so. A longer series
    is cut by its times into pieces of that size. The returns are shuffled once.
    """
    budget = tile * stretch
    columns = materialize(columns.withColumn("column", F.monotonically_increasing_id()), "tile-columns")
    length = F.ceil(F.log2("rows")).cast("int")
    sizes = columns.groupBy(length.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("most"), F.sum("rows").alias("all")).orderBy("k").collect()  # one row per power of two
    place, tiles = F.lit(0), 0
    for k, n, *_ in sizes:
        here = max(1, -(-n // max(1, min(tile, budget >> k))))
        place = F.when(length == k, F.lit(tiles) + F.pmod(F.xxhash64("column"), F.lit(here)).cast("int")).otherwise(place)
        tiles += here
    most = max((r["most"] for r in sizes), default=0)
    order = Window.partitionBy("tile").orderBy("column")
    columns = columns.withColumn("tile", place).withColumn("place", (F.row_number().over(order) - 1).cast("int"))
    columns = materialize(columns, "tile-places")
    rows = returns.withColumnRenamed("symbol", "series")
    if most > budget:
        long = rows.join(columns.where(F.col("rows") > budget).select("series").distinct(), "series")
        long = number(long, ["series"], ["_t"], most=most).withColumn("piece", F.expr(f"pos div {budget}")).drop("pos")
        short = columns.where(F.col("rows") <= budget).select("series").distinct()
        rows = rows.join(short, "series").withColumn("piece", F.lit(0).cast("long")).unionByName(long)
    else:
        rows = rows.withColumn("piece", F.lit(0).cast("long"))
    packed = rows.join(columns.select("series", "tile", "place"), "series").select("tile", "piece", "place", "_t", "ret")
    packed = packed.groupBy("tile", "piece").applyInArrow(_packed, PIECE)
    held = columns.groupBy("tile").agg(
        F.sort_array(F.collect_list(F.struct("place", "series", "symbols"))).alias("columns"), F.ceil(F.max("rows") / budget).alias("pieces")
    )
    return materialize(packed.join(held, "tile"), "series-tiles"), tiles, sum(r["all"] for r in sizes), -(-most // budget)


def _over_tiles(returns: DataFrame, series: DataFrame, finish, later, schema: str, tile: int, stretch: int, members: DataFrame | None = None) -> DataFrame:
    """Rows that ``finish`` makes of the sums of every pair of tiles. Of equal series only one is read (see ``_equal_series``).

    Tiles of all and of open series are tables of the size of the returns; their product is formed as rows of two tiles, which are made,
    read and dropped one after the other, so no copy of a tile per partner is shuffled or written. Sums of series
    longer than a piece are added per pair of series, by Spark; ``later`` makes rows of these.
    """
    rows = returns.join(series.select("symbol"), "symbol")
    time = F.coalesce(F.unix_micros("time"), F.lit(-(1 << 62)))
    rows = materialize(rows.select("symbol", "ret", time.alias("_t")), "series-returns")
    opened = members.where("open") if members is not None else None
    sides, most = [], 1
    for name, columns in (("left", _columns(series, members)), ("right", _columns(series.where("opened > 0"), opened))):
        tiles, n, size, pieces = _tiles(rows, columns, tile, stretch)
        data = F.struct("tile", "piece", "columns", "place", "time", "ret")
        tiles = tiles.select(*[F.col(c).alias(f"{name}_{c}") for c in ("pieces", "first", "last")], data.alias(name))
        # The more parts on the right, the more rows of a series come together from different tasks: as few as the memory of a task lets.
        parts = max(SIDE, -(-n // SIDE)) if name == "left" else max(SIDE, -(-size // HELD))
        sides.append(tiles.repartition(max(1, min(n, parts))))
        most = max(most, pieces)
    both = sides[0].crossJoin(sides[1])
    single = (F.col("left_pieces") == 1) & (F.col("right_pieces") == 1)
    apart = (F.col("left_first") > F.col("right_last")) | (F.col("right_first") > F.col("left_last"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Piece, _Piece, Sequence[np.ndarray]]]:
        held: list[_Piece | None] = [None, None]
        for batch in batches:
            for i in range(batch.num_rows):
                for side in range(2):
                    row = batch.column(side)[i]
                    if held[side] is None or held[side].of != (row["tile"].as_py(), row["piece"].as_py()):
                        held[side] = _Piece(row)
                if (found := _piece_sums(*held, stretch)) is not None:
                    yield *held, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, found in sums(batches):
            yield from finish(left, right, found)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, found in sums(batches):
            a, b = np.nonzero(found[0])
            symbols = [pa.ListArray.from_arrays(pa.array(p.starts, pa.int32()), p.symbols).take(pa.array(i)) for p, i in ((left, a), (right, b))]
            names = [p.series.take(pa.array(i)) for p, i in ((left, a), (right, b))]
            yield pa.RecordBatch.from_arrays([*names, *symbols, *(pa.array(x[a, b]) for x in found)], ["left", "right", "lefts", "rights", *SUMS])

    out = both.where(single & ~apart).select("left", "right").mapInArrow(run, schema)
    if most == 1:
        return out
    keys = ["left", "right", "lefts", "rights"]
    ddl = "left string, right string, lefts array<string>, rights array<string>, " + ", ".join(f"{c} double" for c in SUMS)
    pairs = both.where(~single & ~apart).select("left", "right").mapInArrow(partial, ddl).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])
    spread = F.expr("(n * xx - x * x) * (n * yy - y * y)")
    pairs = pairs.withColumn("correlation", F.when(spread > 0, F.expr("n * xy - x * y") / F.sqrt(spread)))
    return out.unionByName(later(pairs))


def _pairs_later(pairs: DataFrame) -> DataFrame:
    pairs = pairs.select("rights", F.explode("lefts").alias("candidate"), F.col("n").cast("long").alias("common_bars"), "correlation")
    return pairs.select("candidate", F.explode("rights").alias("open_symbol"), "common_bars", "correlation").where("candidate != open_symbol")


def _highest_later(pairs: DataFrame) -> DataFrame:
    other = F.col("left") != F.col("right")
    return pairs.select(
        F.col("left").alias("candidate"), F.when(other, F.col("correlation")).alias("max_correlation"),
        F.when(~other, F.col("correlation")).alias("own"), other.alias("met"),
    )


def correlations(returns: DataFrame, opened: DataFrame, tile: int = TILE, stretch: int = STRETCH) -> DataFrame:
    """Correlation of every symbol with every open one over their common times; null where one does not vary.

    Pairs of different series are counted once; the task that counts them makes the rows of their symbols, which are written nowhere.
    """
    returns = materialize(returns.select("symbol", "time", "ret"), "returns")
    members, series = _equal_series(returns, opened)
    return _over_tiles(returns, series, _pair_rows, _pairs_later, PAIRS, tile, stretch, members)


def highest_correlations(returns: DataFrame, opened: DataFrame, tile: int = TILE, stretch: int = STRETCH) -> DataFrame:
    """``candidate, max_correlation``: the highest correlation with an open symbol. A tile pair gives one row per series, no row per pair.

    A symbol meets its own series where another symbol of it is open.
    """
    returns = materialize(returns.select("symbol", "time", "ret"), "returns")
    members, series = _equal_series(returns, opened)
    found = _over_tiles(returns, series, _highest_rows, _highest_later, HIGHEST, tile, stretch)
    found = found.groupBy(F.col("candidate").alias("series")).agg(F.max("max_correlation").alias("_other"), F.max("own").alias("_own"), F.max("met").alias("_met"))
    each = members.join(found, "series").join(series.select(F.col("symbol").alias("series"), "opened"), "series")
    twin = F.col("opened") > F.col("open").cast("long")
    highest = F.greatest("_other", F.when(twin, F.col("_own")))
    return each.where(F.col("_met") | twin).select(F.col("symbol").alias("candidate"), highest.alias("max_correlation"))


def correlation_factor(highest: DataFrame, limit: float = CORRELATED) -> DataFrame:
    """.5 for candidates with a correlation above the limit, else 1; from ``highest_correlations``."""
    return highest.withColumn("correlation_factor", F.when(F.col("max_correlation") > limit, 0.5).otherwise(1.0))
