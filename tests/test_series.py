"""Blocks, scans and as-of joins against plain loops, with blocks far smaller than the series."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.operators import indicators, risk, scan
from barwise.operators.asof import asof_join
from barwise.operators.series import block, in_block, number, own_rows, parts, running

START = dt.datetime(2024, 1, 1)


def hours(i):
    return START + dt.timedelta(hours=i)


def random_bars(n, seed, gap=0):
    rnd, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        price = max(1.0, price + rnd.gauss(0, 1.5))
        o, c = price, price + rnd.gauss(0, 1)
        rows.append(
            (hours(i + (gap if i > n // 2 else 0)), o, max(o, c) + rnd.random(), min(o, c) - rnd.random(), c, 1000 + i)
        )
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    # One symbol holds most rows; the other has a gap longer than a bucket.
    rows = [("HOT", *r) for r in random_bars(400, 1)] + [("COLD", *r) for r in random_bars(90, 2, gap=500)]
    rows += [("NEW", *r) for r in random_bars(7, 3)]
    return spark.createDataFrame(
        rows, "symbol string, time timestamp, open double, high double, low double, close double, volume bigint"
    )


def test_number_is_dense_per_series(bars):
    rows = number(bars, ["symbol"], ["time"], rows=20).orderBy("symbol", "time").collect()
    for symbol in ("HOT", "COLD", "NEW"):
        mine = [r.pos for r in rows if r.symbol == symbol]
        assert mine == list(range(len(mine)))


@pytest.fixture(scope="module")
def bursts(spark):
    """Two thousand rows at one time, half of them with one id, and null times and ids."""
    rnd = random.Random(4)
    rows = [("HOT", hours(rnd.randrange(500)), rnd.randrange(10**6), "x") for _ in range(2000)]
    rows += [("HOT", hours(250), rnd.randrange(10**6) if i % 2 else 77, "y") for i in range(2000)]
    rows += [("HOT", None, i if i % 3 else None, "z") for i in range(300)] + [(None, hours(i), i, "n") for i in range(400)]
    rows += [("FEW", hours(i % 5), i, "f") for i in range(20)]
    return spark.createDataFrame(rows, "symbol string, time timestamp, id long, kind string").repartition(5)


@pytest.mark.parametrize("order", [["time", "id"], ["time"], ["kind", "time", "id"], ["id"]])
def test_positions_follow_the_order_within_bursts(bursts, order):
    rows = number(bursts, ["symbol"], order, rows=100).collect()
    assert len(rows) == 4720
    low = lambda x: (x is not None, x if x is not None else 0)
    for symbol in ("HOT", "FEW", None):
        mine = sorted((r for r in rows if r.symbol == symbol), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine)))
        values = [tuple((r[c] is not None, r[c]) if r[c] is None else low(r[c]) for c in order) for r in mine]
        assert all(a[0][0] <= b[0][0] for a, b in zip(values, values[1:]))
        known = [v for v in values if all(x[0] for x in v)]
        assert known == sorted(known)


def test_bursts_are_cut_into_parts(bursts, spark):
    cut, levels = parts(bursts, ["symbol"], ["time", "id"], 100)
    most = cut.groupBy("symbol", *levels).count().agg(F.max("count")).first()[0]
    assert most <= 200


def test_lag_and_lead_cross_blocks(bars):
    w = in_block(["symbol"])
    rows = block(number(bars, ["symbol"], ["time"], rows=25), back=2, ahead=1, size=10)
    rows = own_rows(rows.withColumns({"b": F.lag("close", 2).over(w), "a": F.lead("close").over(w)}))
    got = rows.orderBy("symbol", "pos").collect()
    assert len(got) == 497
    for symbol in ("HOT", "COLD", "NEW"):
        mine = [r for r in got if r.symbol == symbol]
        closes = [r.close for r in mine]
        assert [r.b for r in mine] == [None, None, *closes[:-2]]
        assert [r.a for r in mine] == [*closes[1:], None]


def test_frame_longer_than_a_block_is_refused(bars):
    with pytest.raises(ValueError):
        block(bars, back=11, size=10)


def test_running_sum_and_prior_max(bars):
    rows = block(number(bars, ["symbol"], ["time"], rows=25), size=16).drop("own")
    rows = running(rows, ["symbol"], "sum", "close", "total")
    rows = running(rows, ["symbol"], "max", "close", "highest", prior=True).orderBy("pos").collect()
    for symbol in ("HOT", "COLD"):
        mine = [r for r in rows if r.symbol == symbol]
        closes = np.array([r.close for r in mine])
        assert np.allclose([r.total for r in mine], closes.cumsum())
        assert mine[0].highest is None
        assert [r.highest for r in mine[1:]] == np.maximum.accumulate(closes)[:-1].tolist()


# --- indicators by plain loops, from their definitions --------------------------------------------


def wilder_loop(x, n):
    out, y = [None] * len(x), None
    for i in range(n, len(x)):
        y = sum(x[1 : n + 1]) / n if i == n else (y * (n - 1) + x[i]) / n
        out[i] = y
    return out


def loops(rows):
    h, lo, c = ([r[k] for r in rows] for k in ("high", "low", "close"))
    n = len(c)
    tr = [0.0] + [max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])) for i in range(1, n)]
    gain = [0.0] + [max(c[i] - c[i - 1], 0.0) for i in range(1, n)]
    loss = [0.0] + [max(c[i - 1] - c[i], 0.0) for i in range(1, n)]
    out = {"atr14": wilder_loop(tr, 14), "atr20": wilder_loop(tr, 20)}
    g, ls = wilder_loop(gain, 14), wilder_loop(loss, 14)
    out["rsi"] = [None if a is None else (100 * a / (a + b) if a + b else 0.0) for a, b in zip(g, ls)]
    kama, y = [None] * n, None
    for i in range(19, n):
        if i == 19:
            y = c[i]
        else:
            path = sum(abs(c[j] - c[j - 1]) for j in range(i - 19, i + 1))
            er = abs(c[i] - c[i - 20]) / path if path else 1.0
            y += (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (c[i] - y)
        kama[i] = y
    out["kama"] = kama
    up, down = [0.0] * n, [0.0] * n
    for i in range(1, n):
        a, b = h[i] - h[i - 1], lo[i - 1] - lo[i]
        up[i], down[i] = (a if a > b and a > 0 else 0.0), (b if b > a and b > 0 else 0.0)
    adx, dx, z = [None] * n, [], None
    st, su, sd = sum(tr[1:14]), sum(up[1:14]), sum(down[1:14])
    for i in range(14, n):
        st, su, sd = st * 13 / 14 + tr[i], su * 13 / 14 + up[i], sd * 13 / 14 + down[i]
        dx.append(100 * abs(su - sd) / (su + sd) if st and su + sd else 0.0)
        if i == 27:
            z = sum(dx) / 14
        elif i > 27 and su + sd:
            z = (z * 13 + dx[-1]) / 14
        adx[i] = z
    out["adx"] = adx
    macd, signal, slow, fast, s = [None] * n, [None] * n, None, None, None
    for i in range(25, n):
        if i == 25:
            slow, fast = sum(c[:26]) / 26, sum(c[14:26]) / 12
        else:
            slow, fast = slow + (c[i] - slow) * 2 / 27, fast + (c[i] - fast) * 2 / 13
        macd[i] = fast - slow
        if i == 33:
            s = sum(macd[25:34]) / 9
        elif i > 33:
            s += (macd[i] - s) * 0.2
        signal[i] = s
    out["macd"], out["macd_signal"] = macd, signal
    return out


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-8)


@pytest.mark.parametrize("size", [48, 65_536])
def test_indicators_equal_plain_loops(bars, size):
    numbered = number(bars, ["symbol"], ["time"], rows=100)
    got = indicators.with_indicators(numbered, size=size).orderBy("symbol", "pos").collect()
    for symbol in ("HOT", "COLD", "NEW"):
        mine = [r.asDict() for r in got if r.symbol == symbol]
        for name, want in loops(mine).items():
            assert all(same(r[name], w) for r, w in zip(mine, want)), (symbol, name)


def test_flat_market_gives_zero_not_nan(spark):
    rows = [("F", hours(i), 10.0, 10.0, 10.0, 10.0, 1) for i in range(60)]
    df = spark.createDataFrame(
        rows, "symbol string, time timestamp, open double, high double, low double, close double, volume bigint"
    )
    last = indicators.indicators(df).orderBy(F.desc("pos")).first()
    assert (last.rsi, last.adx, last.atr14, last.stoch_k) == (0.0, 0.0, 0.0, 0.0)
    assert last.kama == pytest.approx(10.0)


def test_hull_weights_equal_the_definition():
    x = np.random.default_rng(5).normal(size=200)

    def wma(v, n):
        return np.array([np.average(v[i - n + 1 : i + 1], weights=range(1, n + 1)) for i in range(n - 1, len(v))])

    for period in (10, 17, 20, 40):
        root = int(np.sqrt(period))
        raw = 2 * wma(x, period // 2)[period - period // 2 :] - wma(x, period)
        assert np.allclose(np.convolve(x, indicators.hull_weights(period), mode="valid"), wma(raw, root))


def test_hull_of_plain_windows_equals_weights(bars):
    numbered = number(bars.where("symbol = 'HOT'"), ["symbol"], ["time"], rows=100)
    rows = indicators.hull(numbered, ["symbol"], 20).orderBy("pos").collect()
    want = np.convolve([r.close for r in rows], indicators.hull_weights(20), mode="valid")
    assert [r.hma for r in rows[:22]] == [None] * 22
    assert np.allclose([r.hma for r in rows[22:]], want)


def test_adaptive_period_bounds(bars):
    rows = indicators.indicators(bars).collect()
    assert {r.period for r in rows if r.pos < 39} == {20}
    assert all(10 <= r.period <= 40 for r in rows)


# --- scans -------------------------------------------------------------------------------------


def random_trades(n, seed, symbols=4):
    rnd = random.Random(seed)
    rows, t = [], START
    for i in range(n):
        t += dt.timedelta(minutes=rnd.randint(0, 300))
        pnl = 0.0 if rnd.random() < 0.35 else rnd.choice([-1, 1]) * rnd.random() * 900
        rows.append(("A" if rnd.random() < 0.8 else "B", f"S{rnd.randint(1, symbols)}", t, i, pnl))
    return rows


def trade_frame(spark, rows):
    return spark.createDataFrame(rows, "account string, symbol string, ts timestamp, id bigint, pnl double")


@pytest.mark.parametrize("size", [7, 65_536])
def test_trade_state_equals_the_rule(spark, size):
    rows = random_trades(300, 7)
    got = {r.id: r for r in risk.trade_state(trade_frame(spark, rows), 10_000.0, size=size).collect()}
    state = {}
    for account, _, ts, i, pnl in rows:
        dd, day, daily = state.get(account, (0.0, None, 0.0))
        dd = min(1.0, dd + abs(pnl) / 10_000) if pnl < 0 else max(0.0, dd - abs(pnl) / 10_000 * 0.1)
        daily = daily + pnl if ts.date() == day else pnl
        state[account] = (dd, ts.date(), daily)
        assert abs(got[i].drawdown - dd) < 1e-12 and abs(got[i].daily_pnl - daily) < 1e-8


@pytest.mark.parametrize("size", [6, 65_536])
def test_emergencies_close_all_positions(spark, size):
    rows = [(a, s, t, i, p * 0.1 if p < 0 else p) for a, s, t, i, p in random_trades(500, 23)]
    capital, limit = 900.0, 0.145
    got = {r.id: r for r in risk.emergency_book(trade_frame(spark, rows), capital, size).collect()}
    books, falls, closes = {}, {}, {}
    for account, symbol, ts, i, pnl in rows:
        dd = falls.get(account, 0.0)
        dd = falls[account] = min(1.0, dd - pnl / capital) if pnl < 0 else max(0.0, dd - pnl / capital * 0.1)
        book = books.setdefault(account, {})
        if pnl == 0 and symbol in book:
            del book[symbol]
        elif symbol in book:
            book[symbol][0] += pnl
        else:
            book[symbol] = [pnl, ts]
        assert got[i].emergencies == closes.get(account, 0)
        if dd > limit:
            book.clear()
            closes[account] = closes.get(account, 0) + 1
        assert got[i].is_open == (symbol in book) and got[i].reset == (dd > limit)
        if symbol in book:
            assert abs(got[i].position_pnl - book[symbol][0]) < 1e-9 and got[i].opened == book[symbol][1]
    assert len(closes) > 1 and 0 < sum(closes.values()) < len(rows)
    held = {(r.account, r.symbol) for r in risk.open_positions(risk.emergency_book(trade_frame(spark, rows), capital, size)).collect()}
    assert held == {(a, s) for a, b in books.items() for s in b}


def test_closes_do_not_multiply_the_groups_of_the_book(spark, monkeypatch):
    """Every trade closes all positions; the book is still scanned by symbol and block."""
    rows = [("A", f"S{i % 3}", START + dt.timedelta(minutes=i), i, -500.0) for i in range(120)]
    groups = []

    def counted(df, keys, fold, one_block=False):
        groups.append(df.select(*keys, "block").distinct().count())
        return scan.prefix_scan(df, keys, fold, one_block)

    monkeypatch.setattr(risk, "prefix_scan", counted)
    got = risk.emergency_book(trade_frame(spark, rows), 900.0, 20).collect()
    assert len(got) == 120 and max(r.emergencies for r in got) == 119 and not any(r.is_open for r in got)
    assert groups == [6, 6]


@pytest.mark.parametrize("size", [4, 65_536])
def test_metrics_merge_over_blocks(spark, size):
    rows = random_trades(300, 31)
    got = {(r.account, r.symbol, r.day): r for r in risk.performance_metrics(trade_frame(spark, rows), 1000.0, size).collect()}
    groups = {}
    for account, symbol, ts, _, pnl in rows:
        groups.setdefault((account, symbol, ts.date()), []).append(pnl / 1000)
    assert set(got) == set(groups)
    for key, x in groups.items():
        cum = np.cumsum(x)
        assert got[key].returns == pytest.approx(cum[-1])
        assert got[key].max_drawdown == pytest.approx(max(np.maximum.accumulate(np.maximum(cum, 0)) - cum))
        if len(x) > 1:
            assert got[key].volatility == pytest.approx(np.std(x, ddof=1))
            assert got[key].sharpe_ratio == pytest.approx(np.mean(x) / np.std(x, ddof=1)) if np.std(x) else got[key].sharpe_ratio is None
        else:
            assert got[key].volatility is None


@pytest.mark.parametrize("size", [5, 65_536])
def test_position_book_equals_the_rule(spark, size):
    rows = random_trades(400, 11)
    got = {r.id: r for r in risk.position_book(trade_frame(spark, rows), size=size).collect()}
    book = {}
    for account, symbol, ts, i, pnl in rows:
        key = (account, symbol)
        if pnl == 0 and key in book:
            del book[key]
        elif key in book:
            book[key][0] += pnl
        else:
            book[key] = [pnl, ts]
        assert got[i].is_open == (key in book)
        if key in book:
            assert abs(got[i].position_pnl - book[key][0]) < 1e-9 and got[i].opened == book[key][1]


def test_reset_clears_a_position(spark):
    rows = [("A", "S", hours(i), i, p, r) for i, (p, r) in enumerate([(1.0, False), (2.0, True), (3.0, False)])]
    df = spark.createDataFrame(
        rows, "account string, symbol string, ts timestamp, id bigint, pnl double, reset boolean"
    )
    got = [(r.is_open, r.position_pnl) for r in risk.position_book(df).orderBy("id").collect()]
    assert got == [(True, 1.0), (False, None), (True, 3.0)]


def test_carries_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(scan, "FAN", 4)
    step = scan.affine(["y"])
    rnd = random.Random(3)
    rows = [("K", b, rnd.random(), rnd.random()) for b in range(150)]
    totals = spark.createDataFrame(rows, "key string, block bigint, a_y double, b_y double")
    got = {r.block: r.b_y for r in scan.carries(totals, ["key"], step).collect()}
    y = 0.0
    for _, b, a, add in rows:
        assert abs(got[b] - y) < 1e-12
        y = a * y + add


def test_affine_run_with_resets_and_long_decay():
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0.5, 1.0, 5000), rng.normal(size=5000)
    a[[0, 700, 701, 4999]] = 0.0
    y, want = 3.0, []
    for p, q in zip(a, b):
        y = p * y + q
        want.append(y)
    assert np.allclose(scan.affine_run(a, b, 3.0), want, atol=1e-9)


# --- as-of -------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [20, 65_536])
@pytest.mark.parametrize("tolerance", [60, 4000])
def test_asof_equals_brute_force(spark, rows, tolerance):
    rnd = random.Random(9)
    right = sorted({(rnd.choice("AB"), rnd.randint(0, 5000)) for _ in range(120)})
    left = [(rnd.choice("ABC"), rnd.randint(0, 5200), i) for i in range(300)]
    at = lambda s: START + dt.timedelta(seconds=s)
    r = spark.createDataFrame([(k, at(s), s) for k, s in right], "key string, rt timestamp, v int")
    ls = spark.createDataFrame([(k, at(s), i) for k, s, i in left], "key string, lt timestamp, i int")
    got = {x.i: x.v for x in asof_join(ls, r, ["key"], "lt", "rt", tolerance, ["v"], rows=rows).collect()}
    assert len(got) == len(left)
    for k, s, i in left:
        fits = [v for kk, v in right if kk == k and s - tolerance <= v <= s]
        assert got[i] == (max(fits) if fits else None)


def test_given_shifts_lead_to_a_drawdown_without_changing_the_day(spark):
    """A row with the drawdown and one with the pnl of the day, put before a trade, carry both states in one scan."""
    day = dt.datetime(2024, 1, 2)
    rows = [("A", None, dt.datetime(1970, 1, 1), -1, 0.0, 0.3), ("A", None, day, -1, 250.0, 0.0), ("A", "x", day + dt.timedelta(hours=1), 1, -100.0, None)]
    trades = spark.createDataFrame(rows, "account string, symbol string, ts timestamp, id long, pnl double, shift double")
    last = risk.trade_state(trades, 1000.0).where("id = 1").first()
    assert (last.drawdown, last.daily_pnl) == (pytest.approx(0.4), 150.0)
