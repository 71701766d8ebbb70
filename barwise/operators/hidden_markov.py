"""Gaussian hidden Markov models per symbol (diagonal covariances), fitted as Spark jobs (see :mod:`barwise.operators.em`).

In each pass every block gives the product of its transition steps; these small matrices are chained over the blocks of a
symbol to give each block the state before it and after it; then every block adds up its expected
counts on its own. This equals the forward-backward pass over the undivided series. The packed blocks
are read in place, only matrices and counts are shuffled.

All products are sums in log space, so no path is lost however unlikely an observation is. Inside a task nothing is computed row
by row: the blocks of an Arrow batch are cut into strips of about the root of their length, and step ``t`` of all
strips of all blocks is one array operation; strips are then chained in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.catalog import STATES
from barwise.functions.scalars import argmax
from barwise.operators import em, mixture
from barwise.operators.em import Model
from barwise.operators.mixture import FEATURES, FLOOR, feature_matrix
from barwise.operators.scan import Scan, carries
from barwise.session import materialize

# States, stop criterion of the total log likelihood, largest number of steps.
STATE_COUNT, TOLERANCE, MAX_STEPS = 5, 1e-2, 1000
#: Variance added to that of the first groups.
START_FLOOR = 1e-3
LEAST_WEIGHT = 1e-10
#: Rows whose steps a task holds at once, at some 500 bytes each.
STEPS_AT_ONCE = 1 << 17
D = len(FEATURES)


def pack(features: DataFrame, size: int = em.PACKED_ROWS) -> DataFrame:
    """One row per block: the features in time order."""
    return em.pack(feature_matrix(features), FEATURES, ["time"], size)


def parted(theta: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, moves, means and variances from flat parameters, also of many models at once (rows)."""
    lead = theta.shape[:-1]
    cuts = np.cumsum([k, k * k, k * D])
    start, moves, means, spreads = np.split(theta, cuts, axis=-1)
    return start, moves.reshape(*lead, k, k), means.reshape(*lead, k, D), spreads.reshape(*lead, k, D)


def _logs(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def added(x: np.ndarray, axis: int) -> np.ndarray:
    """Log of the sum of exponentials; minus infinity where all terms are."""
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return _logs(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix products of log matrices (the last two axes)."""
    return added(a[..., :, :, None] + b[..., None, :, :], axis=-2)


def unit(k: int) -> np.ndarray:
    return _logs(np.eye(k))


class Steps:
    """The transition steps of a batch of blocks as strips: arrays (blocks, strips, steps of a strip, ..).

    ``emitted`` are the log densities, ``held`` tells which places are rows; the others change nothing. The first row of a series is
    entered by no move.
    """

    def __init__(self, x: list[np.ndarray], first: np.ndarray, models: np.ndarray, k: int):
        self.k, self.x = k, x
        self.start, moves, means, spreads = parted(models, k)
        self.moves, self.first = _logs(moves), first
        longest = max(len(m) for m in x)
        self.length = max(1, int(np.ceil(np.sqrt(longest))))
        self.strips = -(-longest // self.length)
        shape = (len(x), self.strips * self.length)
        values, self.held = np.zeros((*shape, D)), np.zeros(shape, dtype=bool)
        for i, m in enumerate(x):
            values[i, : len(m)], self.held[i, : len(m)] = m, True
        away = (values[:, :, None, :] - means[:, None]) ** 2 / spreads[:, None]
        emitted = -0.5 * (np.log(2 * np.pi * spreads).sum(axis=-1)[:, None] + away.sum(axis=-1))
        cut = (len(x), self.strips, self.length)
        self.emitted, self.held, self.values = emitted.reshape(*cut, k), self.held.reshape(cut), values.reshape(*cut, D)

    def step(self, t: int) -> np.ndarray:
        """Step ``t`` of every strip as log matrices (blocks, strips, k, k)."""
        moved = np.where((self._opening(t))[..., None, None], unit(self.k), self.moves[:, None])
        out = moved + self.emitted[:, :, t, None, :]
        return np.where(self.held[:, :, t, None, None], out, unit(self.k))

    def _opening(self, t: int) -> np.ndarray:
        out = np.zeros(self.held.shape[:2], dtype=bool)
        if t == 0:
            out[:, 0] = self.first
        return out

    def totals(self) -> np.ndarray:
        """The product of every strip."""
        out = self.step(0)
        for t in range(1, self.length):
            out = times(out, self.step(t))
        return out

    def products(self) -> np.ndarray:
        """The product of every block (blocks, k, k)."""
        return _chained(self.totals())

    def forward(self, before: np.ndarray) -> np.ndarray:
        """Log weights of the states after every row; ``before`` (blocks, k): those before the block, the start where it opens a series."""
        totals = self.totals()
        lead = np.empty((len(self.x), self.strips, self.k))
        now = before
        for s in range(self.strips):
            lead[:, s] = now
            now = added(now[:, :, None] + totals[:, s], axis=1)
        out = np.empty_like(self.emitted)
        for t in range(self.length):
            lead = added(lead[..., :, None] + self.step(t), axis=-2)
            out[:, :, t] = lead
        return out

    def backward(self, after: np.ndarray) -> np.ndarray:
        """Log weights of what follows every row, by its state; ``after`` (blocks, k): of what follows the block."""
        totals = self.totals()
        tail = np.empty((len(self.x), self.strips, self.k))
        now = after
        for s in range(self.strips - 1, -1, -1):
            tail[:, s] = now
            now = added(totals[:, s] + now[:, None, :], axis=2)
        out = np.empty_like(self.emitted)
        for t in range(self.length - 1, -1, -1):
            out[:, :, t] = tail
            tail = added(self.step(t) + tail[..., None, :], axis=-1)
        return out

    def counts(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected sums per block: log likelihood (of a series' first block), first state, moves, weights, values and squares; and
        the posterior of the last row."""
        alpha, beta = self.forward(before), self.backward(after)
        n, k = len(self.x), self.k
        total = added((alpha + beta)[:, 0, 0], axis=-1)  # the same at every row of a series
        shares = np.exp(alpha + beta - total[:, None, None, None]) * self.held[..., None]
        flat = shares.reshape(n, -1, k)
        values = self.values.reshape(n, -1, D)
        pairs = np.zeros((n, k, k))
        lead = np.concatenate([before[:, None], alpha.reshape(n, -1, k)[:, :-1]], axis=1).reshape(alpha.shape)
        for t in range(self.length):
            counted = self.held[:, :, t] & ~self._opening(t)
            joint = lead[:, :, t, :, None] + self.step(t) + beta[:, :, t, None, :] - total[:, None, None, None]
            pairs += (np.exp(joint) * counted[..., None, None]).sum(axis=1)
        last = flat[np.arange(n), [len(m) - 1 for m in self.x]]
        sums = [
            np.where(self.first, total, 0.0)[:, None], flat[:, 0] * self.first[:, None], pairs.reshape(n, -1), flat.sum(axis=1),
            np.einsum("nrk,nrd->nkd", flat, values).reshape(n, -1), np.einsum("nrk,nrd->nkd", flat, values**2).reshape(n, -1),
        ]
        return np.concatenate(sums, axis=1), last / last.sum(axis=1, keepdims=True)


def _chained(totals: np.ndarray) -> np.ndarray:
    """Products along the second axis, halving it each time."""
    while totals.shape[1] > 1:
        if totals.shape[1] % 2:
            totals = np.concatenate([totals, np.broadcast_to(unit(totals.shape[-1]), (len(totals), 1, *totals.shape[2:]))], axis=1)
        totals = times(totals[:, ::2], totals[:, 1::2])
    return totals[:, 0]


def _groups(batch: pa.RecordBatch, thetas: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, Steps]]:
    """The blocks of a batch, alike in length, some at a time: their places and steps."""
    x, first = list(em.matrices(batch, FEATURES)), batch.column("block").to_numpy() == 0
    order = sorted(range(len(x)), key=lambda i: len(x[i]))
    while order:
        n = max(1, STEPS_AT_ONCE // len(x[order[-1]]))
        some, order = np.array(order[-n:]), order[:-n]
        yield some, Steps([x[i] for i in some], first[some], thetas[some], k)


def _ends(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Products of the blocks before and after every block; of a lone block, which changes nothing."""
    if "before" not in batch.schema.names:
        alone = np.broadcast_to(unit(k), (batch.num_rows, k, k))
        return alone, alone
    return tuple(em.lists(batch, c)[0].reshape(-1, k, k) for c in ("before", "after"))


def _counts(batch: pa.RecordBatch, thetas: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of every block and posterior of its last row."""
    before, after = _ends(batch, k)
    sums, last = np.empty((batch.num_rows, 1 + k + k * k + k + 2 * k * D)), np.empty((batch.num_rows, k))
    for some, steps in _groups(batch, thetas, k):
        lead = added(_logs(steps.start)[:, :, None] + before[some], axis=1)
        sums[some], last[some] = steps.counts(lead, added(after[some], axis=2))
    return sums, last


def markov(k: int) -> Model:
    def expect(batch: pa.RecordBatch, thetas: np.ndarray) -> np.ndarray:
        return _counts(batch, thetas, k)[0]

    def update(sums: np.ndarray) -> np.ndarray:
        _, first, pairs, weight, values, squares = np.split(sums, np.cumsum([1, k, k * k, k, k * D]))
        pairs, held = pairs.reshape(k, k), np.maximum(weight, LEAST_WEIGHT)[:, None]
        rows = pairs.sum(axis=1, keepdims=True)
        moves = np.where(rows > 0, pairs / np.where(rows > 0, rows, 1.0), 1.0 / k)
        means = values.reshape(k, D) / held
        spreads = np.maximum(squares.reshape(k, D) / held - means**2, 0) + FLOOR
        return np.concatenate([first / first.sum(), moves.ravel(), means.ravel(), spreads.ravel()])

    def free(theta: np.ndarray) -> np.ndarray:
        start, moves, means, spreads = parted(theta, k)
        # A state that is never entered stays out: its log is bounded from below.
        return np.concatenate([np.log(np.maximum(start, 1e-100)), np.log(np.maximum(moves, 1e-100)).ravel(), means.ravel(), np.log(spreads).ravel()])

    def bound(values: np.ndarray) -> np.ndarray:
        start, moves, means, spreads = parted(values, k)
        start, moves = np.exp(start - start.max()), np.exp(moves - moves.max(axis=1, keepdims=True))
        moves /= moves.sum(axis=1, keepdims=True)
        return np.concatenate([start / start.sum(), moves.ravel(), means.ravel(), np.maximum(np.exp(spreads), FLOOR).ravel()])

    return Model(expect, update, free, bound, per_row=False)


def start(features: DataFrame, k: int, stay: float | None = None) -> DataFrame:
    """First parameters: groups of equal size by the first feature; a state stays with probability ``stay`` (all moves alike
    if not given) and moves to the others alike."""
    stay = 1 / k if stay is None else stay
    moves = np.where(np.eye(k) == 1, stay, (1 - stay) / (k - 1)).ravel()
    sums = mixture.quantile_sums(mixture.pack(feature_matrix(features), FEATURES), FEATURES, k)

    def update(found: np.ndarray) -> np.ndarray:
        held = np.maximum(found[1 : 1 + k], LEAST_WEIGHT)[:, None]
        means = found[1 + k : 1 + k + k * D].reshape(k, D) / held
        squares = np.diagonal(found[1 + k + k * D :].reshape(k, D, D), axis1=1, axis2=2) / held
        spreads = np.maximum(squares - means**2, 0) + START_FLOOR
        return np.concatenate([np.full(k, 1 / k), moves, means.ravel(), spreads.ravel()])

    return em.initial(sums, Model(None, update, None, None, False))


def _chain(reverse: bool, k: int) -> Scan:
    """Chaining of block products; in reverse for what follows a block."""

    def merge(left: dict, right: dict) -> dict:
        a, b = (np.array(s["m"]).reshape(k, k) for s in (left, right))
        return {"m": times(b, a).ravel().tolist() if reverse else times(a, b).ravel().tolist()}

    return Scan("m array<double>", {"m": unit(k).ravel().tolist()}, lambda *_: {}, merge, lambda *_: {}, "")


def _products(blocks: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.empty((batch.num_rows, k * k))
                for some, steps in _groups(batch, em.thetas(batch), k):
                    found[some] = steps.products().reshape(len(some), -1)
                stops = pa.array(np.arange(len(found) + 1) * k * k, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("symbol"), batch.column("block"), pa.ListArray.from_arrays(stops, pa.array(found.ravel()))], ["symbol", "block", "m"]
                )

    return materialize(blocks.mapInArrow(run, "symbol string, block bigint, m array<double>"), "block-totals")


def with_ends(packed: DataFrame, state: DataFrame, k: int, last: int) -> DataFrame:
    """Packed blocks with their symbol's parameters and the products of the blocks before and after them.

    ``last`` is the highest block number; without a second block there is nothing to chain.
    """
    modelled = packed.join(state, "symbol")
    if last == 0:
        same = F.array(*[F.lit(float(x)) for x in unit(k).ravel()])
        return modelled.withColumn("before", same).withColumn("after", same)
    totals = _products(modelled, k)
    ends = totals.groupBy("symbol").agg(F.max("block").alias("_last"))
    mirrored = totals.join(ends, "symbol").withColumn("block", F.col("_last") - F.col("block"))
    before = carries(totals, ["symbol"], _chain(False, k), last).withColumnRenamed("m", "before")
    after = carries(mirrored.drop("_last"), ["symbol"], _chain(True, k), last).join(ends, "symbol")
    after = after.select("symbol", (F.col("_last") - F.col("block")).alias("block"), F.col("m").alias("after"))
    return modelled.join(before, ["symbol", "block"]).join(after, ["symbol", "block"])


def fit(packed: DataFrame, first: DataFrame, k: int, tolerance: float = TOLERANCE, steps: int = MAX_STEPS, accelerate: bool = True) -> DataFrame:
    """Parameters per symbol; a symbol stops when a step adds less than ``tolerance`` to its log likelihood."""
    last = packed.agg(F.max("block")).first()[0] or 0
    return em.fit(packed, first, markov(k), tolerance, steps, accelerate, lambda blocks, state: with_ends(blocks, state, k, last))


def newest_states(packed: DataFrame, parameters: DataFrame, k: int) -> DataFrame:
    """``symbol, log_likelihood, posterior``: of the newest row, states by rising mean of the first feature."""
    last = packed.agg(F.max("block")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums, posterior = _counts(batch, em.thetas(batch), k)
                order = np.argsort(parted(em.thetas(batch), k)[2][:, :, 0], axis=1, kind="stable")
                ranked = np.take_along_axis(posterior, order, axis=1)
                stops = pa.array(np.arange(len(ranked) + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("symbol"), batch.column("block"), pa.array(sums[:, 0]), pa.ListArray.from_arrays(stops, pa.array(ranked.ravel()))],
                    ["symbol", "block", "part", "posterior"],
                )

    rows = with_ends(packed, parameters, k, last).mapInArrow(run, "symbol string, block bigint, part double, posterior array<double>")
    return rows.groupBy("symbol").agg(F.sum("part").alias("log_likelihood"), F.max_by("posterior", "block").alias("posterior"))


def hidden_markov_regimes(
    features: DataFrame, tolerance: float = TOLERANCE, steps: int = MAX_STEPS, size: int = em.PACKED_ROWS, accelerate: bool = True
) -> DataFrame:
    """The newest bar of each symbol under five hidden states: name, its posterior probability and those of all states.

    States are numbered by rising mean volatility, so names are stable between fits. ``converged`` is false where ``steps`` ended the fit.
    """
    k, names = STATE_COUNT, STATES["hmm"]
    packed = pack(features, size)
    parameters = fit(packed, start(features, k), k, tolerance, steps, accelerate)
    newest = newest_states(packed, parameters, k).join(parameters.select("symbol", "converged"), "symbol")
    return newest.select(
        "symbol",
        F.get(F.array(*[F.lit(n) for n in names]), argmax(F.col("posterior"))).alias("regime"),
        F.array_max("posterior").alias("confidence"),
        F.col("posterior").alias("probabilities"),
        "log_likelihood",
        F.lit("hmm").alias("model"),
        "converged",
    )
