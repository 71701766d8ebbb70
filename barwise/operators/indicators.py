"""Technical indicators per bar: bounded frames as block windows, recurrences as affine scans.

Inputs are bars numbered by :func:`barwise.operators.series.number`. Values are null until an
indicator has its full look-back. Seeds follow the usual conventions (mean of the first n values).
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.functions.scalars import guarded
from barwise.operators.scan import (
    Scan,
    affine_merge,
    affine_run,
    affine_state,
    affine_total,
    block_totals,
    carries,
    finish,
    nullable,
    values,
)
from barwise.operators.series import BLOCK, block, in_block, number, own_rows
from barwise.session import materialize


# Periods, KAMA smoothing constants, limits of the adaptive period.
ADX_N = RSI_N = 14
KAMA_N = 20
KAMA_FAST, KAMA_SLOW = 2 / 3, 2 / 31
STOCH_K, STOCH_SMOOTH = 5, 3
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
ADAPT_BASE, ADAPT_LOW, ADAPT_HIGH = 20, 10, 100
HMA_MAX = 40
STRATEGY_GATE, FEATURE_GATE = 50, 20


def wma(x: Column, n: int, w, size: int = BLOCK) -> Column:
    """Weighted mean with weights 1..n; null in the first n-1 rows of the frame's input.

    Weight k of a row is its distance from the frame start, so two plain sums suffice.
    The distance is taken inside the block, which keeps the numbers small.
    """
    here = F.col("pos") - F.col("block") * size
    frame = w.rowsBetween(1 - n, 0)
    weighted = F.sum(x * here).over(frame) - (here - n) * F.sum(x).over(frame)
    return F.when(F.count(x).over(frame) == n, weighted / (n * (n + 1) / 2))


def hull(df: DataFrame, keys: Sequence[str], period: int, column: str = "close", out: str = "hma") -> DataFrame:
    """Hull average of a numbered series: WMA over √n of 2·WMA(n/2) − WMA(n)."""
    half, root = max(1, period // 2), max(1, isqrt(period))
    w = in_block(keys)
    return own_rows(
        block(df, back=period + root)
        .withColumn("_raw", 2 * wma(F.col(column), half, w) - wma(F.col(column), period, w))
        .withColumn(out, wma(F.col("_raw"), root, w))
        .drop("_raw")
    ).drop("block")


def hull_weights(period: int) -> list[float]:
    """The Hull average as one weighted sum over the last ``period + √period − 1`` values,
    newest first."""
    half, root = max(1, period // 2), max(1, isqrt(period))

    def ramp(n: int, lag: int) -> float:
        return (n - lag) / (n * (n + 1) / 2) if 0 <= lag < n else 0.0

    return [
        sum(ramp(root, k) * (2 * ramp(half, lag - k) - ramp(period, lag - k)) for k in range(root))
        for lag in range(period + root - 1)
    ]


def _from(at: int, value: Column) -> Column:
    return F.when(F.col("pos") >= at, value)


# --- recurrences: name -> (input column, seed position, seed rows, seed is a mean, keep, add) ----


def _wilder(x: str, n: int) -> tuple:
    return x, n, n, True, (n - 1) / n, 1 / n


def _wilder_sum(x: str) -> tuple:
    return x, ADX_N - 1, ADX_N - 1, False, (ADX_N - 1) / ADX_N, 1.0


def _ema(x: str, n: int, at: int) -> tuple:
    return x, at, n, True, 1 - 2 / (n + 1), 2 / (n + 1)


FIRST = {
    "atr14": _wilder("_tr", 14),
    "atr20": _wilder("_tr", 20),
    "gain": _wilder("_gain", RSI_N),
    "loss": _wilder("_loss", RSI_N),
    "tr": _wilder_sum("_tr"),
    "up": _wilder_sum("_up"),
    "down": _wilder_sum("_down"),
    "slow": _ema("close", MACD_SLOW, MACD_SLOW - 1),
    "fast": _ema("close", MACD_FAST, MACD_SLOW - 1),
}
ADX_AT, SIGNAL_AT = 2 * ADX_N - 1, MACD_SLOW + MACD_SIGNAL - 2
FIRST_NAMES = [*FIRST, "kama"]
SECOND_NAMES = ["adx", "signal"]


def _steps(x: np.ndarray, pos: np.ndarray, at: int, n: int, mean: bool, keep: float, add: float):
    """(a, b) of a recursive average seeded at ``at`` from its last ``n`` values.

    The seed is a recurrence too: the values add up to it, so a series may be cut anywhere.
    """
    share = 1 / n if mean else 1.0
    adding = (pos > at - n) & (pos < at)
    a = np.where(pos < at, 1.0, np.where(pos == at, share, keep))
    b = np.where(adding, x, np.where(pos < at, 0.0, np.where(pos == at, x * share, x * add)))
    return a, b


def _first_steps(rows: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    pos = rows["pos"].to_numpy()
    steps = {n: _steps(values(rows, x), pos, *how) for n, (x, *how) in FIRST.items()}
    close, speed, at = values(rows, "close"), values(rows, "_speed"), KAMA_N - 1
    a = np.where(pos < at, 1.0, np.where(pos == at, 0.0, 1 - speed))
    steps["kama"] = a, np.where(pos < at, 0.0, np.where(pos == at, close, speed * close))
    return steps


def _second_steps(rows: pa.Table, y: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Steps of the ADX over the directional index and of the MACD signal over its line."""
    pos = rows["pos"].to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        plus = np.where(y["tr"] != 0, 100 * y["up"] / y["tr"], 0.0)
        minus = np.where(y["tr"] != 0, 100 * y["down"] / y["tr"], 0.0)
        index = np.where(plus + minus != 0, 100 * np.abs(plus - minus) / (plus + minus), 0.0)
    a, b = _steps(index, pos, ADX_AT, ADX_N, True, (ADX_N - 1) / ADX_N, 1 / ADX_N)
    idle = (pos > ADX_AT) & (plus + minus == 0)
    smooth = 2 / (MACD_SIGNAL + 1)
    return {
        "adx": (np.where(idle, 1.0, a), np.where(idle, 0.0, b)),
        "signal": _steps(y["fast"] - y["slow"], pos, SIGNAL_AT, MACD_SIGNAL, True, 1 - smooth, smooth),
    }


def _own(rows: pa.Table) -> pa.Table:
    return rows.filter(rows["own"])


def _run(steps: dict, before: dict) -> dict[str, np.ndarray]:
    return {n: affine_run(a, b, before.get(f"b_{n}", 0.0)) for n, (a, b) in steps.items()}


def _totals(steps: dict) -> dict[str, float]:
    out = {}
    for n, (a, b) in steps.items():
        out[f"a_{n}"], out[f"b_{n}"] = affine_total(a, b)
    return out


def _hull_by_period(close: np.ndarray, period: np.ndarray, own: int) -> np.ndarray:
    """Hull average of the last ``own`` rows, each with its own period; NaN until warm."""
    out = np.full(own, np.nan)
    for p in np.unique(period):
        weights = np.array(hull_weights(int(p)))
        if len(close) >= len(weights):
            whole = np.full(len(close), np.nan)
            whole[len(weights) - 1 :] = np.convolve(close, weights, mode="valid")
            out = np.where(period == p, whole[-own:], out)
    return out


def _first_total(rows: pa.Table, _: dict) -> dict:
    return _totals(_first_steps(_own(rows)))


def _second_total(rows: pa.Table, before: dict) -> dict:
    own = _own(rows)
    return _totals(_second_steps(own, _run(_first_steps(own), before)))


def _finish(rows: pa.Table, before: dict) -> dict:
    own = _own(rows)
    pos, close = own["pos"].to_numpy(), values(own, "close")
    y = _run(_first_steps(own), before)
    z = _run(_second_steps(own, y), before)
    moved = y["gain"] + y["loss"]
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(moved != 0, 100 * y["gain"] / moved, 0.0)
        ratio = np.where(close > 0, y["atr20"] / close, 0.0)
    factor = np.clip(1 / (ratio + 0.001), 0.5, 2.0)
    period = np.clip(np.floor(ADAPT_BASE * factor), ADAPT_LOW, ADAPT_HIGH)
    period = np.where(pos + 1 < 2 * ADAPT_BASE, ADAPT_BASE, period).astype("int32")
    hma = _hull_by_period(values(rows, "close"), period, len(pos))
    return {
        "atr14": nullable(y["atr14"], pos >= 14),
        "atr20": nullable(y["atr20"], pos >= 20),
        "rsi": nullable(rsi, pos >= RSI_N),
        "kama": nullable(y["kama"], pos >= KAMA_N - 1),
        "adx": nullable(z["adx"], pos >= ADX_AT),
        "macd": nullable(y["fast"] - y["slow"], pos >= MACD_SLOW - 1),
        "macd_signal": nullable(z["signal"], pos >= SIGNAL_AT),
        "period": period,
        "hma": nullable(hma, ~np.isnan(hma)),
    }


_FIRST_STATE, _FIRST_UNIT = affine_state(FIRST_NAMES)
_SECOND_STATE, _SECOND_UNIT = affine_state(SECOND_NAMES)
FIRST_SCAN = Scan(_FIRST_STATE, _FIRST_UNIT, _first_total, affine_merge(FIRST_NAMES), _finish, "")
SECOND_SCAN = Scan(
    _SECOND_STATE,
    _SECOND_UNIT,
    _second_total,
    affine_merge(SECOND_NAMES),
    _finish,
    "atr14 double, atr20 double, rsi double, kama double, adx double, macd double, "
    "macd_signal double, period int, hma double",
)


def frames(bars: DataFrame, keys: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Blocks of a numbered series with the bounded-frame inputs of all indicators."""
    w = in_block(keys)
    c, h, low, pos = F.col("close"), F.col("high"), F.col("low"), F.col("pos")

    def back(column: str, n: int = 1) -> Column:
        return F.lag(column, n).over(w)

    def frame(n: int):
        return w.rowsBetween(1 - n, 0)

    up, down = h - back("high"), back("low") - low
    moved = pos >= 1
    rows = block(bars, back=HMA_MAX + isqrt(HMA_MAX) - 1, size=size).withColumns(
        {
            "_tr": F.when(
                moved, F.greatest(h - low, F.abs(h - back("close")), F.abs(low - back("close")))
            ).otherwise(0.0),
            "_up": F.when(moved & (up > down) & (up > 0), up).otherwise(0.0),
            "_down": F.when(moved & (down > up) & (down > 0), down).otherwise(0.0),
            "_change": F.when(moved, c - back("close")).otherwise(0.0),
            "_far": back("close", KAMA_N),
            "_hh": F.max("high").over(frame(STOCH_K)),
            "_ll": F.min("low").over(frame(STOCH_K)),
        }
    )
    rows = rows.withColumns(
        {
            "_k": guarded((c - F.col("_ll")) * 100, F.col("_hh") - F.col("_ll")),
            "_path": F.sum(F.abs("_change")).over(frame(KAMA_N)),
        }
    )
    rows = rows.withColumn(
        "_sk", F.when(pos >= STOCH_K + STOCH_SMOOTH - 2, F.avg("_k").over(frame(STOCH_SMOOTH)))
    )
    stoch_at = STOCH_K + 2 * STOCH_SMOOTH - 3
    efficiency = F.when(F.col("_path") == 0, 1.0).otherwise(F.abs(c - F.col("_far")) / F.col("_path"))
    speed = F.pow(efficiency * (KAMA_FAST - KAMA_SLOW) + KAMA_SLOW, 2)
    return rows.withColumns(
        {
            "_gain": F.greatest("_change", F.lit(0.0)),
            "_loss": F.greatest(-F.col("_change"), F.lit(0.0)),
            "_speed": F.when(pos >= KAMA_N, speed).otherwise(0.0),
            "stoch_k": _from(stoch_at, F.col("_sk")),
            "stoch_d": _from(stoch_at, F.avg("_sk").over(frame(STOCH_SMOOTH))),
        }
    ).drop("_change", "_far", "_hh", "_ll", "_k", "_path", "_sk")


INPUTS = ["close", "_tr", "_up", "_down", "_gain", "_loss", "_speed"]


def with_indicators(
    bars: DataFrame, keys: Sequence[str] = ("symbol",), size: int = BLOCK, longest: int | None = None
) -> DataFrame:
    """All indicators of a numbered series: atr14, atr20, rsi, adx, kama, stoch_k, stoch_d, macd,
    macd_signal, period, hma.

    Three passes over the blocks: totals of the first recurrences, totals of the two that build on
    them (ADX, MACD signal), then the values. The first two read only the price columns. Series of
    at most ``size`` bars (``longest``, else looked up) are one block each and need the last alone.
    """
    rows = frames(bars, keys, size)
    if longest is None:
        longest = (bars.agg(F.max("pos")).first()[0] or 0) + 1
    last = (longest - 1) // size
    if last == 0:
        done = finish(rows, keys, SECOND_SCAN, None, {**FIRST_SCAN.unit, **SECOND_SCAN.unit})
    else:
        slim = rows.select(*keys, "block", "own", "pos", *INPUTS)
        first = carries(block_totals(slim, keys, FIRST_SCAN), keys, FIRST_SCAN, last)
        second = carries(block_totals(slim, keys, SECOND_SCAN, first), keys, SECOND_SCAN, last)
        done = finish(rows, keys, SECOND_SCAN, first.join(second, [*keys, "block"]))
    return done.drop("block", *[c for c in INPUTS if c != "close"])


def indicators(bars: DataFrame) -> DataFrame:
    """Number the bars of each symbol by time and add all indicators.

    The numbered bars are written once to the shared folder, as three passes read them.
    """
    return with_indicators(materialize(number(bars, ["symbol"], ["time"]), "numbered-bars"))


def strategy_indicators(with_all: DataFrame) -> DataFrame:
    """The strategy set: null before 50 bars."""
    ready = F.col("pos") >= STRATEGY_GATE - 1
    columns = ["hma", "adx", "atr", "atr_pct", "rsi", "stoch_k", "stoch_d", "macd", "macd_signal"]
    named = with_all.withColumns(
        {
            "atr": F.col("atr14"),
            "atr_pct": F.when(F.col("close") > 0, F.col("atr14") / F.col("close")).otherwise(0.0),
        }
    )
    return named.withColumns({c: F.when(ready, F.col(c)) for c in columns})


def feature_indicators(with_all: DataFrame) -> DataFrame:
    """The feature set: null before 20 bars."""
    ready = F.col("pos") >= FEATURE_GATE - 1
    columns = ["adx", "atr", "rsi", "kama", "stoch_k", "stoch_d"]
    named = with_all.withColumn("atr", F.col("atr14"))
    return named.withColumns({c: F.when(ready, F.col(c)) for c in columns})
