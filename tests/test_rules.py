"""Worked values and truth tables."""

import pytest
from pyspark.sql import functions as F

from barwise import catalog
from barwise.functions import scalars
from barwise.operators import allocation, bars, events, features, regimes, risk, signals
from barwise.sources import tables

BAR = "symbol string, time timestamp, open double, high double, low double, close double, volume bigint"


def one_bar(spark, o=100.0, h=102.5, low=98.5, c=101.2, v=1500):
    df = spark.createDataFrame([("X", None, o, h, low, c, v)], BAR)
    return df.withColumn("time", F.lit("2024-01-01").cast("timestamp"))


def test_basic_features_of_the_worked_bar(spark):
    row = regimes.basic_features(one_bar(spark)).withColumn("regime", regimes.basic_regime()).first()
    assert row.volatility == pytest.approx(0.04) and row.trend_strength == pytest.approx(0.012)
    assert row.volume_profile == 1.5 and row.regime_confidence == pytest.approx(0.4668)
    assert row.regime == "ranging_low_vol"


def test_zero_open_is_guarded(spark):
    row = regimes.basic_features(one_bar(spark, 0.0, 0.0, 0.0, 0.0, None)).first()
    assert (row.volatility, row.trend_strength, row.mean_reversion, row.volume_profile) == (0, 0, 0, 0.001)
    assert bars.with_derived(one_bar(spark, o=0.0)).first().price_change_pct is None


@pytest.mark.parametrize(
    "volatility, trend, regime",
    [
        (0.06, 0.03, "trending_high_vol"),
        (0.06, 0.01, "ranging_high_vol"),
        (0.04, 0.03, "trending_low_vol"),
        (0.04, 0.01, "ranging_low_vol"),
    ],
)
def test_regime_truth_table(spark, volatility, trend, regime):
    df = spark.createDataFrame([(volatility, trend)], "volatility double, trend_strength double")
    assert df.select(regimes.basic_regime()).first()[0] == regime


def test_technical_regime_without_adx_is_ranging(spark):
    df = spark.createDataFrame([(None, 0.06), (26.0, 0.06), (25.0, 0.01)], "adx double, volatility double")
    got = [r[0] for r in df.select(regimes.technical_regime()).collect()]
    assert got == ["ranging_high_vol", "trending_high_vol", "ranging_low_vol"]


def history(spark, sequence, confidences=None):
    rows = [("S", r, (confidences or [0.5] * len(sequence))[i], i, "basic") for i, r in enumerate(sequence)]
    df = spark.createDataFrame(rows, "symbol string, regime_type string, confidence double, i int, regime_model string")
    return df.withColumn("timestamp", F.timestamp_seconds(F.col("i") * 3600 + 1_700_000_000)).drop("i")


@pytest.mark.parametrize(
    "sequence, stability", [(["t"] * 10, 1.0), (["t", "r"] * 5, 0.0), (["t"], 1.0), (["t", "t", "r"], 0.5)]
)
def test_stability(spark, sequence, stability):
    df = history(spark, sequence)
    assert regimes.regime_stability(df).first().regime_stability == stability
    assert regimes.history_summary(df).first().regime_stability == stability


def test_history_statistics(spark):
    newest_first = [("t", 0.8), ("t", 0.9), ("r", 0.6), ("t", 0.85)]
    df = history(spark, [r for r, _ in newest_first[::-1]], [c for _, c in newest_first[::-1]])
    row = regimes.history_summary(df).first()
    assert (row.total_periods, row.current_regime) == (4, "t")
    assert row.avg_confidence == pytest.approx(0.7875)
    shares = {r.value: r.share for r in regimes.history_distribution(df).collect() if r.dimension == "regime"}
    assert shares == {"t": 0.75, "r": 0.25}


def test_regime_change_alert_needs_five(spark):
    assert regimes.regime_change_alert(history(spark, ["a"] * 4)).first().distinct_ratio is None
    row = regimes.regime_change_alert(history(spark, ["x", "a", "b", "c", "d", "e"])).first()
    assert (row.distinct_ratio, row.alert) == (1.0, True)


def test_validation_reasons(spark):
    rows = [
        ("X", 1.0, 2.0, 0.5, 1.5), ("X", 1.0, 0.5, 2.0, 1.5), ("X", 0.0, 2.0, 0.5, 1.5), (None, 1.0, 2.0, 0.5, 1.5),
        ("X", 1.0, None, 0.5, 1.5),
    ]
    df = spark.createDataFrame(rows, "symbol string, open double, high double, low double, close double")
    df = df.withColumn("time", F.lit("2024-01-01").cast("timestamp"))
    got = [r.reject_reason for r in bars.validate(df).collect()]
    assert got == [None, "high below low", "price not positive", "missing symbol", "missing high"]
    good, bad = bars.split_valid(df)
    assert (good.count(), bad.count()) == (1, 4)


def test_records_default_volume(spark):
    df = spark.createDataFrame([("X", [0.0, 1.0, 2.0, 0.5, 1.5]), ("Y", [0.0, 1.0, 2.0, 0.5, 1.5, 7.0])], "symbol string, fields array<double>")
    assert [r.volume for r in tables.bars_from_records(df).collect()] == [1000, 7]


def test_lookbacks():
    assert [tables.lookback_days(t) for t in ("M5", "H1", "D1", "W1")] == [30, 90, 365, 30]


def sizing(spark, **values):
    row = {"atr": 1.5, "confidence": 0.8, "price": 100.0, "drawdown": 0.0, "daily_pnl": 0.0, **values}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


def test_risk_size(spark):
    row = sizing(spark).withColumns(risk.risk_size(10_000.0)).first()
    assert row.risk_amount == 200.0 and row.final_size == 10.0
    assert sizing(spark, atr=0.0).withColumns(risk.risk_size(10_000.0)).first().final_size == 0.0
    tiny = sizing(spark, price=1e9).withColumns(risk.risk_size(10_000.0)).first()
    assert tiny.final_size == 0.01 > tiny.max_size


@pytest.mark.parametrize("drawdown, factor", [(0.01, 1.0), (0.04, 0.75), (0.08, 0.5), (0.12, 0.25), (0.02, 1.0)])
def test_drawdown_factor(spark, drawdown, factor):
    assert spark.range(1).select(risk.drawdown_factor(F.lit(drawdown))).first()[0] == factor


@pytest.mark.parametrize(
    "drawdown, daily, tiers, single",
    [(0.0, 0, 1, 1), (0.06, 0, 0.75, 0.75), (0.11, 0, 0.375, 0.5), (0.15, 0, 0, 0), (0.0, -501, 0, 0), (0.0, -500, 1, 1)],
)
def test_breakers(spark, drawdown, daily, tiers, single):
    df = sizing(spark, drawdown=drawdown, daily_pnl=float(daily))
    got = df.select(
        risk.circuit_breakers(F.lit(1.0), 10_000.0), risk.circuit_breakers(F.lit(1.0), 10_000.0, cumulative=False)
    ).first()
    assert tuple(got) == (tiers, single)


def test_approval_multiplies_and_flags(spark):
    df = sizing(spark, drawdown=0.06).withColumn("correlation_factor", F.lit(0.5))
    row = risk.approve_trades(df, 10_000.0).first()
    assert row.final_size == pytest.approx(200 / 2.25 * 0.8 * 0.5 if 200 / 2.25 * 0.8 * 0.5 < 10 else 10.0)
    assert row.approved_size == pytest.approx(row.final_size * 0.5 * 0.75) and row.circuit_breaker_applied


def test_value_at_risk(spark):
    rows = [("A", f"S{i}", i, 10.0 if i % 2 == 0 else -5.0) for i in range(50)]
    df = spark.createDataFrame(rows, "account string, symbol string, id bigint, pnl double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("id") * 60))
    row = risk.value_at_risk(df, 10_000.0).first()
    assert row.var_95 == pytest.approx(-5 / 10_000) and row.expected_shortfall == pytest.approx(-5 / 10_000)
    assert risk.value_at_risk(df.where("id < 29"), 10_000.0).first().var_95 == 0.0
    report = risk.risk_report(df, 10_000.0).first()
    assert (report.total_trades, report.winning_trades, report.losing_trades, report.active_positions) == (50, 25, 25, 50)


@pytest.mark.parametrize("sizes", [{}, {"tile": 1}, {"tile": 2, "stretch": 20}, {"tile": 1, "stretch": 7}])
def test_correlation_against_pandas(spark, sizes):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.normal(size=300)
    data = {"A": base, "B": base + rng.normal(size=300) * 0.1, "C": rng.normal(size=300)}
    rows = [(s, i, float(v)) for s, x in data.items() for i, v in enumerate(x) if not (s == "B" and i % 3 == 0)]
    df = spark.createDataFrame(rows, "symbol string, i bigint, ret double").withColumn("time", F.timestamp_seconds(F.col("i") * 86_400))
    opened = spark.createDataFrame([("A",)], "symbol string")
    got = {r.candidate: r for r in risk.correlations(df, opened, **sizes).collect()}
    keep = np.arange(300) % 3 != 0
    assert set(got) == {"B", "C"} and got["B"].common_bars == keep.sum()
    assert got["B"].correlation == pytest.approx(np.corrcoef(data["A"][keep], data["B"][keep])[0, 1])
    factor = {r.candidate: r.correlation_factor for r in risk.correlation_factor(risk.highest_correlations(df, opened, **sizes)).collect()}
    assert factor == {"B": 0.5, "C": 1.0}


@pytest.mark.parametrize("sizes", [{}, {"tile": 1, "stretch": 7}])
def test_correlation_counts_equal_series_once(spark, sizes, monkeypatch):
    """Copies of a series are pairs like any other, but reach the tiles as one."""
    import numpy as np

    rng = np.random.default_rng(5)
    first, second = rng.normal(size=40), rng.normal(size=40)
    data = {"A1": first, "A2": first, "A3": first, "B1": second, "B2": second, "C": rng.normal(size=40), "D1": np.zeros(40), "D2": np.zeros(40)}
    rows = [(s, i, float(v)) for s, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, i bigint, ret double").withColumn("time", F.timestamp_seconds(F.col("i") * 86_400))
    open_ = ["A1", "B1", "B2", "D1"]
    opened = spark.createDataFrame([(s,) for s in open_], "symbol string")
    read = []

    def counted(returns, series, *rest):
        read.append(series.count())
        return over_tiles(returns, series, *rest)

    over_tiles = risk._over_tiles
    monkeypatch.setattr(risk, "_over_tiles", counted)
    got = {(r.candidate, r.open_symbol): r for r in risk.correlations(df, opened, **sizes).collect()}
    highest = {r.candidate: r.max_correlation for r in risk.highest_correlations(df, opened, **sizes).collect()}
    assert read == [4, 4]
    assert set(got) == {(a, b) for a in data for b in open_ if a != b} and set(highest) == set(data)
    for a in data:
        known = []
        for b in open_:
            if a == b:
                continue
            assert got[a, b].common_bars == 40
            if a[0] == "D" or b[0] == "D":
                assert got[a, b].correlation is None
            else:
                known.append(np.corrcoef(data[a], data[b])[0, 1])
                assert got[a, b].correlation == pytest.approx(known[-1])
        assert highest[a] == (pytest.approx(max(known)) if known else None)


def _series_of_unequal_length(spark):
    """Returns of series with 2 to 120 times each, equal ones among them, and their open symbols."""
    import numpy as np

    rng = np.random.default_rng(6)
    data = {}
    for i, n in enumerate([2, 5, 9, 30, 45, 90, 120]):
        data[f"S{i}"] = dict(zip(sorted(rng.choice(120, n, replace=False).tolist()), rng.normal(size=n).tolist(), strict=True))
    data |= {f"E{i}": data["S3"] for i in range(5)} | {"L": data["S5"]}
    df = spark.createDataFrame([(s, i, v) for s, x in data.items() for i, v in x.items()], "symbol string, i bigint, ret double")
    return data, df.withColumn("time", F.timestamp_seconds(F.col("i") * 86_400)), ["S0", "S3", "S5", "S6", "E0", "E1", "E2", "E3"]


@pytest.mark.parametrize("sizes", [{}, {"tile": 2, "stretch": 20}, {"tile": 1, "stretch": 7}])
def test_correlation_of_series_in_pieces(spark, sizes, monkeypatch):
    """Series longer and shorter than a piece meet, and so do columns that share a series."""
    import numpy as np

    monkeypatch.setattr(risk, "MEMBERS", 2)
    monkeypatch.setattr(risk, "SPREAD", 5)
    data, df, open_ = _series_of_unequal_length(spark)
    opened = spark.createDataFrame([(s,) for s in open_], "symbol string")
    rows = risk.correlations(df, opened, **sizes).collect()
    got = {(r.candidate, r.open_symbol): r for r in rows}
    highest = {r.candidate: r.max_correlation for r in risk.highest_correlations(df, opened, **sizes).collect()}
    common = {(a, b): sorted(data[a].keys() & data[b].keys()) for a in data for b in open_ if a != b}
    assert len(rows) == len(got) and set(got) == {k for k, at in common.items() if at} and set(highest) == {a for a, _ in got}
    for (a, b), r in got.items():
        at = common[a, b]
        assert r.common_bars == len(at)
        if len(at) > 1:
            assert r.correlation == pytest.approx(np.corrcoef([data[a][t] for t in at], [data[b][t] for t in at])[0, 1])
        else:
            assert r.correlation is None
    for a, value in highest.items():
        known = [r.correlation for (c, _), r in got.items() if c == a and r.correlation is not None]
        assert value == (pytest.approx(max(known)) if known else None)


def test_correlation_of_nothing(spark):
    _, df, open_ = _series_of_unequal_length(spark)
    opened = spark.createDataFrame([(s,) for s in open_], "symbol string")
    for returns, held in ((df.where("false"), opened), (df, opened.where("false"))):
        assert risk.correlations(returns, held).count() == risk.highest_correlations(returns, held).count() == 0


def test_correlation_copies_no_returns_per_tile(spark):
    """Neither the returns nor the pairs are shuffled once per partner: tiles meet as a product, and pairs are the last step."""
    _, df, open_ = _series_of_unequal_length(spark)
    pairs = risk.correlations(df, spark.createDataFrame([(s,) for s in open_], "symbol string"), tile=2)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Generate" not in plan and plan.count("MapInArrow") == 1


def test_highest_correlation_copies_no_returns_per_tile(spark):
    _, df, open_ = _series_of_unequal_length(spark)
    found = risk.highest_correlations(df, spark.createDataFrame([(s,) for s in open_], "symbol string"), tile=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan and "hashpartitioning(left" not in plan


def test_allocation_of_the_worked_universe(spark):
    names = ["GainX 600", "PainX 400", "TrendX 600"]
    universe = spark.createDataFrame([(n, n.split(" ")[0], i) for i, n in enumerate(names)], "symbol string, family string, pos int")
    current = spark.createDataFrame(
        list(zip(names, ["trending_high_vol", "ranging_high_vol", "trending_high_vol"])), "symbol string, regime_type string"
    )
    rows = {r.symbol: r for r in allocation.tactical_allocation(universe, current).collect()}
    raw = {"GainX 600": 0.3 * 1.5, "PainX 400": 0.1 * 0.5, "TrendX 600": 0.4 * 1.5}
    total = sum(raw.values())
    assert all(rows[n].weight == pytest.approx(raw[n] / total) for n in names)
    assert {r.dominant_regime for r in rows.values()} == {"trending_high_vol"}
    assert rows[names[0]].confidence == pytest.approx(2 / 3) and rows[names[0]].risk_multiplier == 1.0


def test_allocation_without_history_uses_the_default(spark):
    empty = spark.createDataFrame([], "symbol string, regime_type string")
    rows = allocation.tactical_allocation(catalog.symbols(spark), empty).collect()
    assert len(rows) == 34 and {r.dominant_regime for r in rows} == {"ranging_low_vol"}
    assert sum(r.weight for r in rows) == pytest.approx(1.0)


def test_symbol_types(spark):
    got = {r.symbol: r.t for r in catalog.symbols(spark).withColumn("t", allocation.symbol_type(F.col("symbol"))).collect()}
    assert got["SFX Vol 20"] == "volatility" and got["FlipX 1"] == "directional"


def test_order_levels(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 10.0, 10.5), (-1, 1.0, 2.0, 10.0, 10.5)], "type int, sl double, tp double, bid double, ask double")
    got = [(r.entry, r.sl_level, r.tp_level) for r in df.withColumns(signals.order_levels(1.0)).collect()]
    assert got == [(10.5, 9.5, 12.5), (10.0, 11.0, 8.0)]


def test_missing_inputs_are_not_a_sell(spark):
    df = spark.createDataFrame(
        [(1, 0.9, 1.0, 5.0, True, False), (1, 0.9, 1.0, 5.0, False, True), (1, 0.5, 1.0, 5.0, False, False), (-1, 0.9, 1.0, 5.0, False, False)],
        "signal int, confidence double, atr double, position_size double, features_missing boolean, history_missing boolean",
    )
    got = [(r.error, r.type) for r in df.withColumns(signals.trade_levels()).collect()]
    assert got == [("NO_FEATURES", None), ("NO_REGIME_HISTORY", None), (None, 0), (None, -1)]


def test_event_versions(spark):
    schema = "id bigint, event_type string, aggregate_id string, data string, metadata string, timestamp timestamp, version int"
    def event(i, version, aggregate="a"):
        return (i, "t", aggregate, "{}", "{}", None, version)
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("timestamp", F.timestamp_seconds(F.col("id")))
    stored = frame([event(1, 1), event(2, 3)])
    incoming = frame([event(3, 3), event(4, 4), event(5, 4), event(6, None), event(7, 2, "b"), event(8, 2, "b")])
    got = {r.id: r.conflict for r in events.check_versions(stored, incoming).collect()}
    assert got == {3: True, 4: False, 5: True, 6: False, 7: False, 8: True}


def test_malformed_json_is_skipped(spark):
    df = spark.createDataFrame([("{\"k\": 1}",), ("{broken",), (None,)], "data string")
    assert [r.k for r in events.parse_json(df, "data", "k int").collect()] == [1]


def test_fold_to_state(spark):
    rows = [(1, "signal_generated", "a", "s1"), (2, "signal_generated", "a", "s2"), (3, "data_ingested_with_regime", "a", '{"regime":"x"}')]
    df = spark.createDataFrame(rows, "id bigint, event_type string, aggregate_id string, data string")
    df = df.withColumn("timestamp", F.timestamp_seconds("id")).withColumn("version", F.lit(1))
    row = events.reconstruct_state(df).first()
    assert (row.signal, row.order, row.last_regime) == ("s2", None, "x")


def test_scalar_helpers(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0],)], "v array<double>")
    row = df.select(scalars.argmax(F.col("v")).alias("i"), scalars.interpolated_quantile(F.col("v"), 0.25).alias("q")).first()
    assert (row.i, row.q) == (1, 3.0)
    key = spark.range(1).select(scalars.feature_key("ml", F.lit("A"), F.lit("b"))).first()[0]
    assert key == "ml:A:b"


def test_key_values_conditions(spark):
    base = regimes.basic_features(one_bar(spark)).withColumn("pos", F.lit(30))
    base = base.withColumns({n: F.lit(v) for n, v in zip(regimes.TECHNICAL_FEATURES, (35.0, 1.0, 60.0, 100.0, 70.0, 60.0))})
    rows = regimes.with_model(base.withColumn("trend_strength", F.lit(0.0)))
    assert rows.first().nnfx_signal == "BUY"
    names = {r.feature for r in features.key_values(rows).collect()}
    assert {"adx", "nnfx_signal", "regime", "baseline_signal"} <= names and len(names) == 18
    quiet = regimes.with_model(base, "basic")
    assert len({r.feature for r in features.key_values(quiet).collect()}) == 7
