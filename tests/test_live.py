"""Live sources, refreshes of touched days, expiry over batches, bounded lists, requests without inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barwise.catalog import BARS
from barwise.operators import bars, features, signals
from barwise.sources import rollup, ticklog
from barwise.sources.ticklog import TickLogReader
from barwise.streaming import bars as bar_streams
from barwise.streaming import state as state_streams
from tests.test_series import START, hours

EVENT = "symbol string, regime_type string, confidence double, timestamp timestamp"


def lines(numbers):
    return "".join(f"{n * 1_000_000},S{n % 3},{n}.5,{n}.75\n" for n in numbers)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_read_every_line_once(tmp_path, split):
    (tmp_path / "a.log").write_text(lines(range(40)))
    (tmp_path / "b.log").write_text(lines(range(40, 45)) + "99000000,S0,1")
    (tmp_path / "_hidden").write_text("no tick")
    reader = TickLogReader(str(tmp_path), split)
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert all(p.stop - p.start <= split for p in parts)
    got = [n // 1_000_000 for p in parts for batch in reader.read(p) for n in batch.column(0).to_pylist()]
    assert sorted(got) == list(range(45))


def test_offsets_follow_a_growing_file(tmp_path):
    path, reader = tmp_path / "a.log", TickLogReader(str(tmp_path), 50)
    assert reader.latestOffset() == {}
    seen, start = [], {}
    whole = lines(range(30))
    for cut in (0, 5, 100, 101, 333, len(whole)):
        path.write_text(whole[:cut])
        end = reader.latestOffset()
        seen += [n // 1_000_000 for p in reader.partitions(start, end) for b in reader.read(p) for n in b.column(0).to_pylist()]
        start = end
        assert len(seen) == whole[:cut].count("\n")
    assert seen == list(range(30))
    again = TickLogReader(str(tmp_path), 50)  # a new start of the query
    assert again.partitions(start, again.latestOffset()) == []


def test_a_stream_of_the_log_goes_on_after_a_restart(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    for n in range(3):
        log.mkdir(exist_ok=True)
        with (log / "feed.log").open("a") as file:
            file.write(lines(range(n * 10, n * 10 + 10)))
        stream = ticklog.tick_log(spark, str(log), split=64)
        bar_streams.start(stream, str(tmp_path / "checkpoint"), bar_streams.versioned_rows(out)).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r._batch, int(r.bid)) for r in rows) == [(n // 10, n) for n in range(30)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], BARS + ", seq bigint")


def bar(day, hour, symbol="X", price=10.0):
    return (hours(24 * day + hour), symbol, price, price + 1, price - 1, price, 5)


def test_a_refresh_reads_only_touched_days(spark, tmp_path):
    base, log, daily = (str(tmp_path / n) for n in ("bars", "log", "daily"))
    writer = rollup.logged_upsert(base, log)

    def refresh(as_of=None):
        return rollup.refresh_touched(spark.read.parquet(base), log, daily, lambda b: bars.resample(b, "D1"), "time", "time", as_of)

    def check(until=None):
        source = spark.read.parquet(base).drop("date")
        want = bars.resample(source if until is None else source.where(F.col("time") < F.lit(until)), "D1")
        pick = ["symbol", "time", "open", "high", "low", "close", "volume"]
        assert sorted(map(tuple, spark.read.parquet(daily).select(*pick).collect())) == sorted(map(tuple, want.select(*pick).collect()))

    writer(frame(spark, [bar(d, h, s) for d in range(6) for h in (1, 5) for s in "XY"]), 0)
    middle = hours(24 * 4)
    assert len(refresh(str(middle + dt.timedelta(hours=2)))) == 4
    check(middle)
    for _ in range(2):  # a repeated batch is harmless
        writer(frame(spark, [bar(2, 3, price=99.0)]), 1)
    assert refresh(str(middle + dt.timedelta(hours=2))) == [hours(48).date()]
    check(middle)
    assert refresh(str(middle + dt.timedelta(hours=2))) == []
    assert len(refresh()) == 2  # days that were not in the range are still noted
    check()


def test_expired_regimes_leave_the_state(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [
        [("A", "t", 0.5, at(0)), ("B", "r", 0.5, at(100)), ("B", "old", 0.5, at(50))],
        [("B", "t", 0.6, at(1000)), ("A", "late", 0.1, at(10)), (None, "n", 0.1, at(999))],
        [],
        [("A", "gone", 0.7, at(20)), ("A", "new", 0.7, at(1010)), ("C", "x", None, at(1010)), ("C", "x", 0.2, None)],
    ]
    writer = state_streams.expiring_table(str(tmp_path), 300)
    for n, rows in enumerate(batches):
        for _ in range(2):
            writer(spark.createDataFrame(rows, EVENT), n)
    got = {(r.batch, r.symbol, r.regime, r.expired) for r in spark.read.parquet(str(tmp_path / "changes")).collect()}
    assert got == {
        (0, "A", "t", False), (0, "B", "r", False),
        (1, "A", "late", True), (1, "B", "t", False), (1, None, "n", False),
        (3, "A", "new", False), (3, "C", "x", False),
    }
    alive = spark.read.parquet(str(tmp_path / "alive" / "batch=3")).collect()
    assert {r.symbol for r in alive} == {"A", "B", "C", None}


def test_bounded_lists_keep_the_newest_of_both_batches(spark):
    rows = lambda ns: spark.createDataFrame([("A", "t", float(n), hours(n)) for n in ns], EVENT)
    stored = features.pushed_history(None, rows(range(0, 10)), 4)
    assert [r.confidence for r in stored.orderBy("rank").collect()] == [9.0, 8.0, 7.0, 6.0]
    new = rows([8, 11]).withColumn("confidence", F.col("confidence") + 0.5)
    got = features.pushed_history(stored, new, 4).orderBy("rank").collect()
    assert [(r.rank, r.confidence) for r in got] == [(1, 11.5), (2, 9.0), (3, 8.5), (4, 8.0)]
    assert features.pushed_history(stored, rows([]), 4).count() == 4
    assert features.recent_packages(rows([1, 2]), as_of=str(hours(30))).count() == 0
    assert features.recent_packages(rows([1, 20]), as_of=str(hours(30))).count() == 2


def test_requests_without_inputs_report_what_is_missing(spark):
    requests = spark.createDataFrame([("A", hours(1)), ("B", hours(1)), ("C", hours(1)), ("A", hours(9))], "symbol string, time timestamp")
    known = spark.createDataFrame([("A", hours(1), 1, 0.9, 2.0, 3.0), ("B", hours(0), 1, 0.9, 2.0, 3.0)],
                                  "symbol string, time timestamp, signal int, confidence double, position_size double, atr double")
    history = spark.createDataFrame([("A", hours(0), "t"), ("B", hours(-99), "t")], "symbol string, timestamp timestamp, regime_type string")
    wanted = ["signal", "confidence", "position_size", "atr"]
    rows = signals.with_inputs(requests, known, history, wanted, 7200, 86400).withColumns(signals.trade_levels())
    got = {(r.symbol, r.time): (r.error, r.type, r.volume) for r in rows.collect()}
    assert got == {
        ("A", hours(1)): (None, 1, 2.0),
        ("B", hours(1)): ("NO_REGIME_HISTORY", None, 0.0),
        ("C", hours(1)): ("NO_FEATURES", None, 0.0),
        ("A", hours(9)): ("NO_FEATURES", None, 0.0),
    }
