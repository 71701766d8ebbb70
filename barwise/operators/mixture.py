"""Gaussian mixtures with full covariances per symbol, fitted for all symbols at once (see :mod:`barwise.operators.em`)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.catalog import STATES
from barwise.functions.scalars import argmax
from barwise.operators import em
from barwise.operators.em import Model
from barwise.operators.regimes import cluster_label

# Stop criterion, variance floor, smallest history.
TOLERANCE, MAX_STEPS, FLOOR, MIN_ROWS = 1e-3, 100, 1e-6, 50
LEAST_WEIGHT = 1e-10
FEATURES = ["volatility", "trend_strength", "volume_profile"]


def feature_matrix(features: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """Model inputs of the symbols with at least ``least`` rows; missing values count as 0."""
    rows = features.select(
        "symbol", "time", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FEATURES]
    )
    long_enough = features.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return rows.join(long_enough.select("symbol"), "symbol")


def _parted(theta: np.ndarray, k: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances from flat parameters."""
    return theta[:k], theta[k : k + k * d].reshape(k, d), theta[k + k * d :].reshape(k, d, d)


def log_densities(x: np.ndarray, theta: np.ndarray, k: int) -> np.ndarray:
    """Log of weight times density, per row and component."""
    d = x.shape[1]
    weights, means, spreads = _parted(theta, k, d)
    # The floor on the diagonal keeps determinants positive up to rounding.
    det = np.maximum(np.linalg.det(spreads), FLOOR**d)
    adjugate = np.linalg.inv(spreads) * (np.linalg.det(spreads) / det)[:, None, None]
    away = x[:, None, :] - means
    distance = np.einsum("nki,kij,nkj->nk", away, adjugate, away)
    return np.log(weights) - (np.log(det) + distance + d * np.log(2 * np.pi)) / 2


def posteriors(x: np.ndarray, theta: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every component and log density, per row."""
    logs = log_densities(x, theta, k)
    top = logs.max(axis=1)
    total = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
    return np.exp(logs - total[:, None]), total


def _moments(x: np.ndarray, shares: np.ndarray, likelihood: float) -> np.ndarray:
    """The log likelihood, then per component the weight, weighted values and weighted products."""
    products = np.einsum("nk,ni,nj->kij", shares, x, x)
    return np.concatenate([[likelihood], shares.sum(axis=0), (shares.T @ x).ravel(), products.ravel()])


def mixture(columns: Sequence[str], k: int) -> Model:
    d = len(columns)

    def expect(batch: pa.RecordBatch, thetas: np.ndarray) -> np.ndarray:
        out = []
        for x, theta in zip(em.matrices(batch, columns), thetas, strict=True):
            shares, logs = posteriors(x, theta, k)
            out.append(_moments(x, shares, logs.sum()))
        return np.array(out)

    def update(sums: np.ndarray) -> np.ndarray:
        held = sums[1 : 1 + k]
        weight = np.maximum(held, LEAST_WEIGHT)
        means = sums[1 + k : 1 + k + k * d].reshape(k, d) / weight[:, None]
        spreads = sums[1 + k + k * d :].reshape(k, d, d) / weight[:, None, None] - means[:, :, None] * means[:, None, :]
        own = np.arange(d)
        spreads[:, own, own] = np.maximum(spreads[:, own, own], 0) + FLOOR
        return np.concatenate([weight / held.sum(), means.ravel(), spreads.ravel()])

    def free(theta: np.ndarray) -> np.ndarray:
        weights, means, spreads = _parted(theta, k, d)
        roots = np.linalg.cholesky(spreads)
        own = np.arange(d)
        roots[:, own, own] = np.log(roots[:, own, own])
        return np.concatenate([np.log(weights), means.ravel(), roots.ravel()])

    def bound(values: np.ndarray) -> np.ndarray:
        weights, means, roots = _parted(values, k, d)
        roots = np.tril(roots)
        own = np.arange(d)
        roots[:, own, own] = np.exp(roots[:, own, own])
        shares = np.exp(weights - weights.max())
        return np.concatenate([shares / shares.sum(), means.ravel(), (roots @ roots.transpose(0, 2, 1)).ravel()])

    return Model(expect, update, free, bound, per_row=True)


def quantile_sums(packed: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Sums for first parameters: the rows in ``k`` groups of equal size by their place. Blocks must be packed in the order of the groups."""
    d = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, first, n in zip(em.matrices(batch, columns), batch.column("first").to_pylist(), batch.column("n").to_pylist(), strict=True):
                group = (first + np.arange(len(x))) * k // n
                out.append(_moments(x, (group[:, None] == np.arange(k)).astype(float), 0.0).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), pa.array(out, pa.list_(pa.float64()))], ["symbol", "sums"])

    sums = packed.mapInArrow(run, "symbol string, sums array<double>")
    return sums.groupBy("symbol").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(1 + k + k * d + k * d * d)]).alias("sums"))


def pack(rows: DataFrame, columns: Sequence[str], size: int = em.PACKED_ROWS) -> DataFrame:
    """Blocks in the order of the first feature, so that groups at its quantiles are exact (equal values: by time)."""
    return em.pack(rows, columns, [columns[0], "time"], size)


def fit(
    packed: DataFrame, columns: Sequence[str], k: int, tolerance: float = TOLERANCE, steps: int = MAX_STEPS, accelerate: bool = True
) -> DataFrame:
    """Parameters per symbol of a mixture of ``k`` Gaussians, components by rising mean of the first feature.

    Starts at the quantile groups of the first feature; a symbol stops when a step adds less than ``tolerance`` to its mean log likelihood.
    """
    model = mixture(columns, k)
    start = em.initial(quantile_sums(packed, columns, k), model)
    return em.fit(packed, start, model, tolerance, steps, accelerate)


def _ordered(theta: np.ndarray, k: int, d: int) -> np.ndarray:
    weights, means, spreads = _parted(theta, k, d)
    order = np.argsort(means[:, 0], kind="stable")
    return np.concatenate([weights[order], means[order].ravel(), spreads[order].ravel()])


def classify(packed: DataFrame, parameters: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Rows with the posterior of every component (numbered by rising mean of the first feature), the likeliest one and its posterior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("time").value_lengths()
            shares = [posteriors(x, _ordered(t, k, len(columns)), k)[0] for x, t in zip(em.matrices(batch, columns), em.thetas(batch), strict=True)]
            if not shares:
                continue
            table = np.concatenate(shares)
            stops = pa.array(np.arange(len(table) + 1) * k, pa.int32())
            symbols = batch.column("symbol").take(pa.array(np.repeat(np.arange(batch.num_rows), sizes.to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays(
                [symbols, batch.column("time").flatten(), *[batch.column(c).flatten() for c in columns], pa.ListArray.from_arrays(stops, pa.array(table.ravel()))],
                ["symbol", "time", *columns, "posterior"],
            )

    joined = packed.join(parameters.select("symbol", "theta"), "symbol")
    schema = f"symbol string, time timestamp, {', '.join(f'{c} double' for c in columns)}, posterior array<double>"
    rows = joined.mapInArrow(run, schema)
    return rows.withColumns({"component": argmax(F.col("posterior")), "confidence": F.array_max("posterior")})


def volatility_clusters(
    features: DataFrame, k: int = 3, tolerance: float = TOLERANCE, steps: int = MAX_STEPS, accelerate: bool = True, size: int = em.PACKED_ROWS
) -> DataFrame:
    """Clusters of (volatility, volume profile) per symbol: means, count, label, and whether the
    newest row is in the cluster, with that row's confidence."""
    columns = ["volatility", "volume_profile"]
    packed = pack(feature_matrix(features), columns, size)
    fitted = fit(packed, columns, k, tolerance, steps, accelerate)
    scored = classify(packed, fitted, columns, k)
    stats = scored.groupBy("symbol", "component").agg(
        F.avg("volatility").alias("mean_volatility"),
        F.avg("volume_profile").alias("mean_volume"),
        F.count(F.lit(1)).alias("count"),
    )
    current = (
        scored.groupBy("symbol")
        .agg(F.max_by(F.struct("component", "confidence"), "time").alias("_now"))
        .select("symbol", F.col("_now.component").alias("_current"), F.col("_now.confidence").alias("confidence"))
    )
    label = cluster_label(F.col("mean_volatility"), F.col("mean_volume"))
    return stats.join(current, "symbol").join(fitted.select("symbol", "converged"), "symbol").select(
        "symbol",
        F.col("component").alias("cluster"),
        "mean_volatility",
        "mean_volume",
        "count",
        label.alias("regime_label"),
        (F.col("component") == F.col("_current")).alias("is_current"),
        F.when(F.col("component") == F.col("_current"), F.col("confidence")).alias("confidence"),
        "converged",
    )


def mixture_regimes(
    features: DataFrame, tolerance: float = TOLERANCE, steps: int = MAX_STEPS, accelerate: bool = True, size: int = em.PACKED_ROWS
) -> DataFrame:
    """The newest row of each symbol under a mixture of five states: name, confidence and posterior of every state."""
    names = STATES["gmm"]
    packed = pack(feature_matrix(features), FEATURES, size)
    fitted = fit(packed, FEATURES, len(names), tolerance, steps, accelerate)
    scored = classify(packed, fitted, FEATURES, len(names))
    newest = scored.groupBy("symbol").agg(F.max_by(F.struct("component", "confidence", "posterior"), "time").alias("_now"))
    labels = F.array(*[F.lit(n) for n in names])
    return newest.join(fitted.select("symbol", "converged"), "symbol").select(
        "symbol",
        F.get(labels, F.col("_now.component")).alias("regime"),
        F.col("_now.confidence").alias("confidence"),
        F.col("_now.posterior").alias("probabilities"),
        F.lit("gmm").alias("model"),
        "converged",
    )
