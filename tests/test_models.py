"""Mixtures and hidden Markov models on planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.catalog import STATES
from barwise.operators import em, hidden_markov, mixture

SCHEMA = "symbol string, i bigint, volatility double, trend_strength double, volume_profile double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("time", F.timestamp_seconds(F.col("i") * 3600))


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(8)
    rows = []
    for symbol, n in (("BIG", 900), ("SMALL", 90)):
        for i in range(n):
            level = i % 3
            rows.append((symbol, i, float(0.02 + 0.06 * level + rng.normal() * 0.004), 0.01, float(2 + 3 * level + rng.normal() * 0.2)))
    rows += [("SHORT", i, 0.1, 0.1, 1.0) for i in range(49)]
    return table(spark, rows)


def test_short_histories_are_left_out(planted):
    assert {r.symbol for r in mixture.feature_matrix(planted).select("symbol").distinct().collect()} == {"BIG", "SMALL"}


def test_planted_clusters_are_found(planted):
    rows = mixture.volatility_clusters(planted).orderBy("symbol", "cluster").collect()
    big = [r for r in rows if r.symbol == "BIG"]
    assert [r["count"] for r in big] == [300, 300, 300]
    assert [r.mean_volatility for r in big] == pytest.approx([0.02, 0.08, 0.14], abs=0.002)
    assert [r.regime_label for r in big] == ["low_vol_low_volume", "high_vol_low_volume", "high_vol_high_volume"]
    assert [r.is_current for r in big] == [False, False, True] and big[2].confidence > 0.99
    assert [r["count"] for r in rows if r.symbol == "SMALL"] == [30, 30, 30]


COLUMNS = ["volatility", "volume_profile"]
PLAIN = {"tolerance": float("-inf"), "accelerate": False}


def test_likelihood_grows_and_posteriors_sum_to_one(planted):
    packed = mixture.pack(mixture.feature_matrix(planted), COLUMNS)
    short = mixture.fit(packed, COLUMNS, 3, steps=2, **PLAIN)
    long = mixture.fit(packed, COLUMNS, 3, steps=4, **PLAIN)
    a, b = ({r.symbol: r.likelihood for r in p.collect()} for p in (short, long))
    assert all(b[s] >= a[s] - 1e-9 for s in a)
    assert {(r.step, r.converged) for r in long.collect()} == {(4, False)}
    rows = mixture.classify(packed, long, COLUMNS, 3)
    low, high, n = rows.select(F.aggregate("posterior", F.lit(0.0), lambda x, y: x + y).alias("p")).agg(F.min("p"), F.max("p"), F.count("p")).first()
    assert low == pytest.approx(1.0) and high == pytest.approx(1.0) and n == 990


def test_start_groups_are_exact_quantiles(spark):
    df = table(spark, [("S", i, float((i * 37) % 100), 0.0, float(i % 7)) for i in range(100)] + [("T", i, 1.0, 0.0, float(i)) for i in range(60)])
    packed = mixture.pack(mixture.feature_matrix(df), COLUMNS, size=13)
    sums = {r.symbol: r.sums for r in mixture.quantile_sums(packed, COLUMNS, 3).collect()}
    assert sums["S"][1:4] == [34, 33, 33] and sums["S"][4] == sum(range(34))
    assert sums["T"][1:4] == [20, 20, 20] and sums["T"][5] == sum(range(20))  # ties go by time


@pytest.mark.parametrize("size", [8192, 64])
def test_extrapolation_needs_fewer_passes_for_the_same_fit(planted, size):
    packed = mixture.pack(mixture.feature_matrix(planted), COLUMNS, size)
    plain = {r.symbol: r for r in mixture.fit(packed, COLUMNS, 3, 1e-7, 400, accelerate=False).collect()}
    fast = {r.symbol: r for r in mixture.fit(packed, COLUMNS, 3, 1e-7, 400).collect()}
    assert set(plain) == set(fast) == {"BIG", "SMALL"}
    for symbol in plain:
        assert plain[symbol].converged and fast[symbol].converged
        assert fast[symbol].likelihood >= plain[symbol].likelihood - 1e-5
        assert fast[symbol].step <= plain[symbol].step + 2


def test_blocks_do_not_change_the_mixture(planted):
    whole = mixture.pack(mixture.feature_matrix(planted), COLUMNS)
    cut = mixture.pack(mixture.feature_matrix(planted), COLUMNS, size=40)
    a, b = ({r.symbol: r for r in mixture.fit(p, COLUMNS, 3, steps=4, **PLAIN).collect()} for p in (whole, cut))
    for symbol in a:
        assert np.allclose(a[symbol].theta, b[symbol].theta, rtol=1e-6, atol=1e-9)
        assert a[symbol].step == b[symbol].step == 4


def test_extrapolation_that_fails_is_taken_back():
    model = mixture.mixture(COLUMNS, 2)
    theta = np.concatenate([[0.5, 0.5], [0, 0, 1, 1], np.eye(2).ravel(), np.eye(2).ravel()])
    row = {"symbol": "S", "n": 10, "theta": (theta * 3).tolist(), "likelihood": -5.0, "step": 4, "phase": 2, "memory": [*theta, -4.0]}
    sums = np.concatenate([[-1000.0], [5, 5], [0, 0, 5, 5], 5 * np.eye(2).ravel(), 10 * np.eye(2).ravel()])
    out = em._advanced(model, {**row, "sums": sums}, 1e-3, True)
    assert out["theta"] == theta.tolist() and out["likelihood"] == -4.0 and out["phase"] == 0 and not out["converged"]
    assert em._advanced(model, {**row, "sums": sums * 0.01}, 1e-3, True)["theta"] != theta.tolist()


def switching(spark):
    rng, state, rows = np.random.default_rng(2), 0, []
    for i in range(240):
        state = state if rng.random() < 0.9 else int(rng.integers(0, 5))
        level = [0.01, 0.05, 0.1, 0.2, 0.4][state]
        rows.append(("S", i, float(level + rng.normal() * 0.003), float(level / 2), 1.0 + state))
    return table(spark, rows), state


def test_blocks_do_not_change_the_hidden_markov_fit(spark):
    df, _ = switching(spark)
    whole = hidden_markov.hidden_markov_regimes(df, steps=3).first()
    cut = hidden_markov.hidden_markov_regimes(df, steps=3, size=37).first()
    assert cut.log_likelihood == pytest.approx(whole.log_likelihood, rel=1e-9)
    assert cut.regime == whole.regime and cut.regime in STATES["hmm"]
    assert cut.confidence == pytest.approx(whole.confidence, abs=1e-9)
    assert sum(cut.probabilities) == pytest.approx(1.0) and max(cut.probabilities) == cut.confidence
    assert whole.converged is False


def test_hidden_markov_fit_converges(spark):
    df, _ = switching(spark)
    row, early = hidden_markov.hidden_markov_regimes(df).first(), hidden_markov.hidden_markov_regimes(df, steps=3).first()
    assert row.converged and row.regime in STATES["hmm"]
    assert row.log_likelihood > early.log_likelihood


def plain_pass(x, theta, k=5):
    """Forward-backward in log space, row by row."""
    start, moves, means, spreads = hidden_markov.parted(np.array(theta), k)
    with np.errstate(divide="ignore"):
        moves, start = np.log(moves), np.log(start)
    logs = -0.5 * (np.log(2 * np.pi * spreads).sum(1) + ((x[:, None] - means) ** 2 / spreads).sum(2))
    alpha, beta = np.full((len(x), k), -np.inf), np.zeros((len(x), k))
    alpha[0] = start + logs[0]
    for t in range(1, len(x)):
        alpha[t] = np.logaddexp.reduce(alpha[t - 1][:, None] + moves, axis=0) + logs[t]
    for t in range(len(x) - 2, -1, -1):
        beta[t] = np.logaddexp.reduce(moves + logs[t + 1] + beta[t + 1], axis=1)
    total = np.logaddexp.reduce(alpha[-1])
    gamma = np.exp(alpha + beta - total)
    pairs = np.zeros((k, k))
    for t in range(1, len(x)):
        pairs += np.exp(alpha[t - 1][:, None] + moves + logs[t] + beta[t] - total)
    return total, gamma, pairs


def wild(spark):
    """Values so far from every state that most densities are below the smallest double."""
    rng = np.random.default_rng(6)
    return table(spark, [("W", i, float(rng.normal() * 0.01 + (1000 if i % 50 == 9 else i % 3)), 0.0, float(i % 2)) for i in range(180)])


@pytest.mark.parametrize("size", [8192, 50, 7, 1])
@pytest.mark.parametrize("data", ["switching", "wild"])
def test_hidden_markov_pass_equals_plain_forward_backward(spark, size, data):
    df = switching(spark)[0] if data == "switching" else wild(spark)
    k = 5
    packed = hidden_markov.pack(df, size)
    state = hidden_markov.start(df, k, stay=0.9)
    theta = state.first().theta
    if data == "wild":  # one state cannot be left
        theta = np.array(theta)
        theta[k : 2 * k] = [1, 0, 0, 0, 0]
        state = state.withColumn("theta", F.array(*[F.lit(float(v)) for v in theta]))
    last = packed.agg(F.max("block")).first()[0]
    summed = em._sums(hidden_markov.with_ends(packed, state.drop("gain", "converged"), k, last), hidden_markov.markov(k))
    sums = np.sum([r.sums for r in summed.collect()], axis=0)
    x = np.array([[r.volatility, r.trend_strength, r.volume_profile] for r in df.orderBy("i").collect()])
    total, gamma, pairs = plain_pass(x, theta)
    likelihood, first, moves, weight, values, squares = np.split(sums, np.cumsum([1, k, k * k, k, 3 * k]))
    assert likelihood[0] == pytest.approx(total, rel=1e-9)
    assert np.allclose(weight, gamma.sum(0)) and np.allclose(first, gamma[0])
    assert np.allclose(moves.reshape(k, k), pairs)
    assert np.allclose(values.reshape(k, 3), gamma.T @ x) and np.allclose(squares.reshape(k, 3), gamma.T @ x**2)
