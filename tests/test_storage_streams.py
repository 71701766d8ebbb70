"""Tables on storage and streams: late and repeated data, expiry, continued state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barwise.catalog import BARS
from barwise.operators import indicators, regimes
from barwise.session import shared_folder
from barwise.sources import sinks, tables
from barwise.streaming import bars as bar_streams
from barwise.streaming import state as state_streams
from tests.test_series import START, hours, random_bars, random_trades, trade_frame

BAR_COLUMNS = ["time", "symbol", "open", "high", "low", "close", "volume"]


def frame(spark, rows):
    return spark.createDataFrame(rows, BARS + ", seq bigint")


def bar(i, symbol="X", price=10.0, seq=0):
    return (hours(i), symbol, price, price + 1, price - 1, price, 5, seq)


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named.rstrip("/")


def test_without_the_setting_only_a_local_master_gets_a_folder():
    from types import SimpleNamespace

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("local[2]")) == shared_folder(session("local[4]"))
    with pytest.raises(ValueError):
        shared_folder(session("yarn"))


def test_upsert_last_write_wins_and_keeps_other_dates(spark, tmp_path):
    path = str(tmp_path / "bars")
    sinks.upsert_bars(frame(spark, [bar(0), bar(30), bar(60)]), path, "seq")
    late = [bar(30, price=20.0, seq=1), bar(30, price=30.0, seq=2), bar(31, price=40.0, seq=3)]
    for _ in range(2):  # a repeated batch changes nothing
        sinks.upsert_bars(frame(spark, late), path, "seq")
    got = {(r.time, r.symbol): r.close for r in spark.read.parquet(path).collect()}
    assert got == {(hours(0), "X"): 10.0, (hours(30), "X"): 30.0, (hours(31), "X"): 40.0, (hours(60), "X"): 10.0}


def test_missing_values_become_zero_on_every_write(spark, tmp_path):
    path = str(tmp_path / "bars")
    empty = [(hours(1), "X", 1.0, 1.0, 1.0, 1.0, None, 1)]
    for _ in range(2):
        sinks.upsert_bars(frame(spark, empty), path, "seq")
        assert [r.volume for r in spark.read.parquet(path).collect()] == [0]


def test_unreadable_tables_are_not_taken_for_new(spark, tmp_path):
    path = tmp_path / "broken"
    assert sinks.read_or_none(spark, str(path)) is None
    path.mkdir()
    (path / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        sinks.read_or_none(spark, str(path))


def test_refresh_empties_days_without_rows(spark, tmp_path):
    path = str(tmp_path / "daily")
    bars = frame(spark, [bar(0), bar(30)]).drop("seq")
    sinks.refresh_daily_bars(bars, path, "2024-01-03 02:00:00")
    sinks.refresh_daily_bars(bars.where(F.col("time") < hours(24)), path, "2024-01-03 02:00:00")
    assert [r.time for r in spark.read.parquet(path).collect()] == [hours(0)]


def test_appends_read_the_version_log(spark, tmp_path):
    path = str(tmp_path / "events")
    schema = "id int, aggregate_id string, version int, timestamp timestamp"
    event = lambda i, v: spark.createDataFrame([(i, "a", v, hours(i))], schema)
    assert sinks.append_events(event(1, 1), path).count() == 0
    assert sinks.append_events(event(2, 2), path).count() == 0
    assert sinks.append_events(event(3, 2), path).count() == 1
    assert spark.read.parquet(f"{path}-versions").agg(F.max("version")).first()[0] == 2


def test_append_events_returns_rejects(spark, tmp_path):
    path = str(tmp_path / "events")
    schema = "id bigint, event_type string, aggregate_id string, data string, metadata string, timestamp timestamp, version int"
    make = lambda rows: spark.createDataFrame([(i, "t", "a", "{}", "{}", hours(i), v) for i, v in rows], schema)
    assert sinks.append_events(make([(1, 1), (2, 2)]), path).count() == 0
    rejected = sinks.append_events(make([(3, 2), (4, 3)]), path)
    assert [r.id for r in rejected.collect()] == [3]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 4]


def test_retention_prunes_dates(spark, tmp_path):
    path, target = str(tmp_path / "bars"), str(tmp_path / "kept")
    sinks.append(frame(spark, [bar(0), bar(24 * 40), bar(24 * 80)]).drop("seq"), path)
    sinks.rewrite_retained(path, target, spark, "time", "1 month", "2024-03-20 12:00:00")
    assert [r.time for r in spark.read.parquet(target).collect()] == [hours(24 * 80)]


def test_refresh_takes_late_bars_of_the_range_only(spark, tmp_path):
    path = str(tmp_path / "daily")
    bars = frame(spark, [bar(0, price=10.0), bar(5, price=12.0), bar(30, price=7.0)]).drop("seq")
    sinks.refresh_daily_bars(bars, path, "2024-01-02 02:00:00")
    assert [(r.time, r.close) for r in spark.read.parquet(path).collect()] == [(hours(0), 12.0)]
    late = bars.unionByName(frame(spark, [bar(7, price=99.0)]).drop("seq"))
    sinks.refresh_daily_bars(late, path, "2024-01-03 02:00:00")
    assert {r.time: r.close for r in spark.read.parquet(path).collect()} == {hours(0): 99.0, hours(24): 7.0}


def test_date_filter_reaches_partitions(spark, tmp_path):
    path = str(tmp_path / "bars")
    sinks.append(frame(spark, [bar(0), bar(30), bar(60)]).drop("seq"), path)
    scan = tables.bar_history(spark.read.parquet(path), "2024-01-02 00:00:00", "2024-01-02 12:00:00", ["X"])
    assert scan.count() == 1
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(" in plan


def write_files(spark, parts, path):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)


def run(stream, folder, writer, mode="append"):
    bar_streams.start(stream, f"{folder}/checkpoint", writer, mode=mode).awaitTermination()


def test_daily_stream_over_several_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [frame(spark, rows).drop("seq") for rows in ([bar(0, price=1.0)], [bar(3, price=5.0), bar(25)], [bar(1, price=9.0)])]
    write_files(spark, parts, source)
    daily = bar_streams.daily_bars(tables.bar_stream(spark, source, maxFilesPerTrigger="1"))
    run(daily, str(tmp_path), bar_streams.replace_rows(["symbol", "time"], out, "time"), "update")
    got = {r.time: (r.open, r.high, r.close, r.volume) for r in spark.read.parquet(out).collect()}
    assert got == {hours(0): (1.0, 10.0, 5.0, 15), hours(24): (10.0, 11.0, 10.0, 5)}


def current(spark, path):
    return {(r.symbol, r.time): r for r in bar_streams.newest_version(spark.read.parquet(path), ["symbol", "time"]).collect()}


VALUES = ("atr14", "rsi", "adx", "kama", "macd_signal", "stoch_d", "hma", "period")


def assert_same_values(got, want, names=VALUES):
    assert set(got) == {(w.symbol, w.time) for w in want}
    for w in want:
        g = got[(w.symbol, w.time)]
        for name in names:
            assert (g[name] is None) == (w[name] is None), (name, w.pos)
            assert w[name] is None or g[name] == pytest.approx(w[name], abs=1e-8), (name, w.pos)


def test_ingest_does_not_depend_on_the_cut(spark, tmp_path):
    """Late, repeated and corrected bars over several batches, and all bars at once, give the same rows."""
    rows = [(t, s, o, h, lo, c, v) for s, seed in (("X", 5), ("Y", 6)) for t, o, h, lo, c, v in random_bars(70, seed)]
    bad = [(hours(100), "X", 1.0, 0.5, 2.0, 1.0, 1)]
    x, y = rows[:70], rows[70:]
    wrong = [(*x[30][:5], x[30][5] + 0.5, 9)]
    cuts = [x[:10] + x[11:30] + wrong + x[31:50] + y[:60], x[30:31] + x[50:60] + y[60:], x[10:11] + x[50:55] + bad, x[60:]]
    stores = {}
    for name, parts in (("many", cuts), ("one", [rows + bad])):
        source, stores[name] = str(tmp_path / f"in-{name}"), str(tmp_path / name)
        for part in parts:
            spark.createDataFrame(part, BARS).write.mode("append").parquet(source)
            run(tables.bar_stream(spark, source), str(tmp_path / f"c-{name}"), bar_streams.ingest(stores[name], size=48))
    assert spark.read.parquet(f"{stores['many']}/bars").count() == 140
    assert [r.reject_reason for r in spark.read.parquet(f"{stores['many']}/quarantine").collect()] == ["high below low"]
    got, want = (current(spark, f"{stores[n]}/features") for n in ("many", "one"))
    names = ("close", "adx", "rsi", "kama", "stoch_d", "regime_type", "nnfx_signal", "regime_confidence_enhanced")
    assert set(got) == set(want) and len(got) == 140
    for k, w in want.items():
        for name in names:
            same = got[k][name] == (w[name] if w[name] is None or isinstance(w[name], str) else pytest.approx(w[name], abs=1e-8))
            assert same, (k, name)
    for name, keys in (("key_values", ["symbol", "time"]), ("history", ["symbol", "timestamp"]), ("package", ["symbol", "timestamp"]), ("snapshot", ["symbol"])):
        rows_of = [bar_streams.newest_batches(spark.read.parquet(f"{stores[n]}/{name}"), keys) for n in ("many", "one")]
        assert rows_of[0].count() == rows_of[1].count() > 0


def test_only_the_wanted_outputs_are_written_and_features_once(spark, tmp_path):
    from pathlib import Path

    source, store = str(tmp_path / "in"), tmp_path / "store"
    rows = [(t, "X", o, h, lo, c, v) for t, o, h, lo, c, v in random_bars(40, 5)]
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, BARS).write.mode("append").parquet(source)
        before = set(Path(shared_folder(spark)).glob("batch-features-*"))
        run(tables.bar_stream(spark, source), str(tmp_path / "c"), bar_streams.ingest(str(store), size=48, outputs=("snapshot",)))
        assert set(Path(shared_folder(spark)).glob("batch-features-*")) == before
    assert {x.name for x in store.iterdir()} == {"bars", "quarantine", "state", "features", "snapshot"}
    newest = bar_streams.newest_batches(spark.read.parquet(f"{store}/snapshot"), ["symbol"]).collect()
    assert [r.timestamp for r in newest] == [rows[-1][0]]
    assert len(current(spark, f"{store}/features")) == 40


def test_only_touched_dates_are_read(spark, tmp_path):
    path = str(tmp_path / "bars")
    sinks.append(frame(spark, [bar(0), bar(30), bar(60)]).drop("seq"), path)
    dates = sinks.dates_of(frame(spark, [bar(31)]), "time")
    plan = sinks.on_dates(spark.read.parquet(path), dates)._jdf.queryExecution().executedPlan().toString()
    assert dates == [hours(30).date()] and "PartitionFilters: [isnotnull(date" in plan


def test_rolling_indicators_continue_exactly(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(t, s, o, h, lo, c, v) for s, seed in (("X", 5), ("Y", 6)) for t, o, h, lo, c, v in random_bars(90, seed)]
    df = spark.createDataFrame(rows, BARS)
    late = (F.col("time") == hours(3)) & (F.col("symbol") == "X")
    cuts = [hours(0), hours(9), hours(20), hours(90)]
    parts = [df.where((F.col("time") >= a) & (F.col("time") < b) & ~late) for a, b in zip(cuts, cuts[1:])]
    parts.append(df.where(late))
    for part in parts:
        part.write.mode("append").parquet(source)
        run(tables.bar_stream(spark, source), str(tmp_path), state_streams.rolling_indicators(out, size=48))
    assert_same_values(current(spark, f"{out}/indicators"), indicators.indicators(df).collect())


def test_rolling_risk_equals_the_batch_form(spark, tmp_path):
    from barwise.operators import risk

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = random_trades(200, 21)
    for part in (rows[:80], rows[80:130], rows[130:]):
        trade_frame(spark, part).write.mode("append").parquet(source)
        stream = tables.tick_stream(spark, source, trade_frame(spark, rows).schema)
        run(stream, str(tmp_path), state_streams.rolling_risk(out, 10_000.0, size=64))
    got = {r.id: r for r in spark.read.parquet(f"{out}/risk").collect()}
    trades = trade_frame(spark, rows)
    var = {r.id: r["var"] for r in risk.rolling_var(trades, 10_000.0).collect()}
    opened = {}
    assert len(got) == 200
    state = {r.id: r for r in risk.trade_state(trades, 10_000.0).collect()}
    for r in sorted(risk.position_book(trades).collect(), key=lambda r: (r.ts, r.id)):
        opened.setdefault(r.account, set())
        (opened[r.account].add if r.is_open else opened[r.account].discard)(r.symbol)
        assert got[r.id].active_positions == len(opened[r.account])
    for i, r in state.items():
        assert got[i].drawdown == pytest.approx(r.drawdown) and got[i].daily_pnl == pytest.approx(r.daily_pnl)
        assert got[i]["var"] == pytest.approx(var[i])


def test_regimes_expire(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "symbol string, regime_type string, confidence double, timestamp timestamp"
    at = lambda s: START + dt.timedelta(seconds=s)
    parts = [[("A", "t", 0.5, at(0)), ("B", "r", 0.5, at(100))], [("B", "t", 0.6, at(1000))], [("B", "t", 0.7, at(1010))]]
    write_files(spark, [spark.createDataFrame(p, schema) for p in parts], source)
    stream = tables.tick_stream(spark, source, schema, maxFilesPerTrigger="1")
    expiring = state_streams.expiring_regimes(stream, 300)
    run(expiring, str(tmp_path), bar_streams.versioned_rows(out), "update")
    rows = spark.read.parquet(out).drop("_batch")
    last = {r.symbol: (r.regime, r.expired) for r in bar_streams.newest_version(rows, ["symbol"]).collect()}
    assert last["A"] == ("t", True) and last["B"] == ("t", False)


def test_current_regime_of_a_stream_keeps_the_newest(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("A", "t", 0.5, hours(2))], "symbol string, regime_type string, confidence double, timestamp timestamp")
    older = df.withColumn("timestamp", F.lit(hours(1))).withColumn("regime_type", F.lit("old"))
    write_files(spark, [df, older], source)
    stream = tables.tick_stream(spark, source, df.schema, maxFilesPerTrigger="1")
    run(bar_streams.current_regimes(stream), str(tmp_path), bar_streams.versioned_rows(out), "update")
    rows = bar_streams.newest_version(spark.read.parquet(out).drop("_batch"), ["symbol"]).collect()
    assert [(r.symbol, r.regime_type) for r in rows] == [("A", "t")]
    assert regimes.current_regimes(df.unionByName(older)).first().regime_type == "t"
