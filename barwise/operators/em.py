"""Expectation maximisation for all symbols at once, as Spark jobs over packed blocks.

A series is packed once into blocks of a bounded number of rows, one row per block. A pass is one job: it joins the blocks with the parameters
of their symbol, takes the expected sums of each block in NumPy, adds them up per task, so one row per task and symbol is shuffled, and makes
new parameters, one row per symbol. Parameters are written after every pass, which cuts the lineage; the pass itself counts the
symbols that go on. A symbol that has converged leaves: it is not in the parameters of later passes.
Series of a single block need no sums from elsewhere, so the task that holds the block makes all their passes.

Passes are accelerated: after two plain steps the parameters are extrapolated along their change (in a form that has no bounds), and the next
pass shows whether that raised the likelihood; if not, the second plain step counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from barwise.operators.series import number
from barwise.session import materialize

PACKED_ROWS = 8192
CARRIED = {
    "symbol": "string", "n": "bigint", "theta": "array<double>", "likelihood": "double", "step": "int", "phase": "int",
    "memory": "array<double>", "sums": "array<double>",
}
STATE = "symbol string, theta array<double>, likelihood double, gain double, step int, converged boolean, phase int, memory array<double>"


@dataclass(frozen=True)
class Model:
    """What a pass needs to know. Parameters and sums are flat arrays.

    ``expect`` turns an Arrow batch of blocks and their parameters into one row of sums per block, the log likelihood first; ``update`` turns the sums
    of a symbol into parameters; ``free`` and ``bound`` take parameters to a form without bounds and back.
    """

    expect: Callable[[pa.RecordBatch, np.ndarray], np.ndarray]
    update: Callable[[np.ndarray], np.ndarray]
    free: Callable[[np.ndarray], np.ndarray]
    bound: Callable[[np.ndarray], np.ndarray]
    per_row: bool


def pack(rows: DataFrame, columns: Sequence[str], order: Sequence[str], size: int = PACKED_ROWS) -> DataFrame:
    """One row per symbol and block: ``first`` (position of its first row), ``n`` (rows of the series), times and values in order."""
    numbered = number(rows.select("symbol", "time", *columns), ["symbol"], order)
    lengths = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    items = F.sort_array(F.collect_list(F.struct("pos", "time", *columns)))
    blocks = numbered.withColumn("block", F.expr(f"pos div {size}")).groupBy("symbol", "block").agg(items.alias("_rows"))
    blocks = blocks.join(lengths, "symbol").select(
        "symbol", "block", (F.col("block") * size).alias("first"), "n", *[F.col(f"_rows.{c}").alias(c) for c in ("time", *columns)]
    )
    return materialize(blocks, "packed-series")


def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's begin (with the end of the last)."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])


def matrices(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[np.ndarray]:
    """The values of each block, one row per time."""
    flat = [lists(batch, c) for c in columns]
    table = np.column_stack([x for x, _ in flat])
    for low, high in zip(flat[0][1][:-1], flat[0][1][1:], strict=True):
        yield table[low:high]


def thetas(batch: pa.RecordBatch) -> np.ndarray:
    return lists(batch, "theta")[0].reshape(batch.num_rows, -1)


def _sums(blocks: DataFrame, model: Model) -> DataFrame:
    """``symbol, n, sums`` and the state of blocks joined with it: one row per symbol and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        states: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                fresh = []
                for i, (symbol, sums) in enumerate(zip(batch.column("symbol").to_pylist(), model.expect(batch, thetas(batch)), strict=True)):
                    if symbol not in held:
                        fresh.append(i)
                    held[symbol] = held.get(symbol, 0) + sums
                states.append(batch.select([x for x in CARRIED if x != "sums"]).take(pa.array(fresh, pa.int64())))
        if states:
            table = pa.Table.from_batches(states)
            added = pa.array([held[s].tolist() for s in table.column("symbol").to_pylist()], pa.list_(pa.float64()))
            yield from table.append_column("sums", added).select(CARRIED).to_batches()

    return blocks.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in CARRIED.items()))


def initial(sums: DataFrame, model: Model) -> DataFrame:
    """First parameters, from ``symbol, sums, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"symbol": s, "theta": model.update(np.array(x)).tolist(), "likelihood": float("-inf"), "gain": float("inf"), "step": 0, "converged": False, "phase": 0, "memory": []}
                for s, x in zip(batch.column("symbol").to_pylist(), batch.column("sums").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow())

    return materialize(sums.select("symbol", "sums").mapInArrow(run, STATE), "parameters")


def _arrow() -> pa.Schema:
    many = pa.list_(pa.float64())
    kinds = [pa.string(), many, pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.int32(), many]
    return pa.schema(list(zip([x.split()[0] for x in STATE.split(", ")], kinds, strict=True)))


def _extrapolated(model: Model, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Parameters beyond ``third``, along the change of the steps from ``first`` on; ``third`` where that has no finite value."""
    with np.errstate(all="ignore"):
        try:
            a, b, c = (model.free(x) for x in (first, second, third))
            change, bend = b - a, (c - b) - (b - a)
            stretch = min(-1.0, -np.linalg.norm(change) / max(np.linalg.norm(bend), 1e-300))
            out = model.bound(a - 2 * stretch * change + stretch**2 * bend)
        except np.linalg.LinAlgError:
            return third
    return out if np.isfinite(out).all() else third


def _advanced(model: Model, row: dict, tolerance: float, accelerate: bool) -> dict:
    """The state of a symbol after a pass."""
    sums, theta, memory, phase = row["sums"], np.array(row["theta"]), np.array(row["memory"]), row["phase"]
    likelihood = sums[0] / (row["n"] if model.per_row else 1)
    fresh, width = model.update(sums), len(theta)
    gain, converged = likelihood - row["likelihood"], False
    if not accelerate:
        converged, phase = gain < tolerance, 0
    elif phase == 0:  # memory: the parameters before the step
        memory, phase = theta, 1
    elif phase == 1:  # a plain step later; memory: both plain steps and the likelihood before the last
        converged = gain < tolerance
        memory, fresh, phase = np.concatenate([fresh, [likelihood]]), _extrapolated(model, memory, theta, fresh), 2
        if converged:
            fresh = memory[:width]
    else:  # after the extrapolation
        if not likelihood >= memory[width]:
            likelihood, fresh = memory[width], memory[:width]
        memory, phase = np.zeros(0), 0
    return {
        "symbol": row["symbol"], "theta": fresh.tolist(), "likelihood": float(likelihood), "gain": float(gain), "step": row["step"] + 1,
        "converged": bool(converged), "phase": phase, "memory": memory.tolist(),
    }


def fit(
    packed: DataFrame, start: DataFrame, model: Model, tolerance: float, steps: int, accelerate: bool = True,
    blocks: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Parameters per symbol (``STATE``): after ``steps`` passes, or fewer where a plain step adds less than ``tolerance`` to the log
    likelihood; ``converged`` tells which. ``blocks`` joins packed blocks and parameters, by default on the symbol."""
    join = blocks or (lambda packed, state: packed.join(state, "symbol"))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select([x for x in CARRIED if x != "sums"]).to_pylist()
            going = np.arange(len(rows))
            for _ in range(steps):
                if not len(going):
                    break
                part = batch.take(pa.array(going))
                found = model.expect(part, np.array([rows[i]["theta"] for i in going]))
                for i, sums in zip(going, found, strict=True):
                    rows[i] = {**_advanced(model, {**rows[i], "sums": sums}, tolerance, accelerate), "n": rows[i]["n"]}
                going = going[[not rows[i]["converged"] for i in going]]
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in _arrow().names} for r in rows], schema=_arrow())

    def advance(key: tuple, rows: pa.Table) -> pa.Table:
        row = rows.slice(0, 1).to_pylist()[0]
        row["sums"] = np.sum([np.array(x) for x in rows.column("sums").to_pylist()], axis=0)
        return pa.Table.from_pylist([_advanced(model, row, tolerance, accelerate)], schema=_arrow())

    whole = F.size("time") == F.col("n")
    fresh = start.drop("gain", "converged")
    done = materialize(packed.where(whole).join(fresh, "symbol").mapInArrow(alone, STATE), "parameters")
    packed = packed.where(~whole)
    state = start.join(packed.select("symbol").distinct(), "symbol", "left_semi")
    for _ in range(steps):
        moved = _sums(join(packed, state.drop("gain", "converged")), model).groupBy("symbol").applyInArrow(advance, STATE)
        counts = Observation()
        moved = moved.observe(counts, F.count(F.lit(1)).alias("all"), F.count_if("converged").alias("out"))
        state = materialize(moved, "parameters")
        found = counts.get
        if found["out"]:
            done = done.unionByName(state.where("converged"))
        state = state.where("not converged")
        if found["all"] == found["out"]:
            break
    return materialize(done.unionByName(state), "parameters")
