"""Recurrences over long series as block-parallel prefix scans.

A recurrence is described by a :class:`Scan`: how a block of rows sums up to one state, how two
states merge, and how the rows of a block follow from the state before it. Then

1. every block yields its total, all blocks in parallel; totals are one small row per 65 536 rows
   and are written to the shared folder, so the input is not computed again for each later step;
2. totals are merged ``FAN`` at a time, over as many levels as the longest series needs, giving
   each block the state before it;
3. every block is finished from that state, again in parallel.

No task ever holds more than one block or ``FAN`` totals. The folds inside a block are Arrow
batches with NumPy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwise.session import materialize

FAN = 4096
State = dict
SUB = 256


@dataclass(frozen=True)
class Scan:
    """``state`` and ``out`` are column lists in DDL; ``before`` is the state of earlier scans."""

    state: str
    unit: State
    total: Callable[[pa.Table, State], State]
    merge: Callable[[State, State], State]
    run: Callable[[pa.Table, State], dict[str, np.ndarray]]
    out: str


def _fields(df: DataFrame, names: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[n] for n in names])


def _ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def _one(table: pa.Table) -> State:
    return table.slice(0, 1).to_pylist()[0] if table.num_rows else {}


def _row(keys: Sequence[str], key: tuple, state: State, schema: pa.Schema) -> pa.Table:
    values = {k: v.as_py() if isinstance(v, pa.Scalar) else v for k, v in zip(keys, key)}
    return pa.Table.from_pylist([{**values, **state}], schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def block_totals(
    df: DataFrame, keys: Sequence[str], scan: Scan, before: DataFrame | None = None
) -> DataFrame:
    """One state per (keys, block), written to the shared folder."""
    by = [*keys, "block"]
    schema = T.StructType([*_fields(df, by), *_ddl(scan.state)])
    arrow = arrow_schema(schema)

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        return _row(by, key, scan.total(rows.sort_by("pos"), {}), arrow)

    def total_after(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return arrow.empty_table()
        return _row(by, key, scan.total(rows.sort_by("pos"), _one(state)), arrow)

    if before is None:
        out = df.groupBy(*by).applyInArrow(total, schema)
    else:
        out = df.groupBy(*by).cogroup(before.groupBy(*by)).applyInArrow(total_after, schema)
    return materialize(out, "block-totals")


def carries(totals: DataFrame, keys: Sequence[str], scan: Scan, last: int | None = None) -> DataFrame:
    """The merged state of all earlier blocks, per (keys, block); ``last`` is the highest block."""
    first = 0
    if last is None:
        first, last = totals.agg(F.min("block"), F.max("block")).first()
        first, last = first or 0, last or 0
    if first == last == 0:
        start = {f.name: F.lit(scan.unit[f.name]).cast(f.dataType) for f in _ddl(scan.state)}
        return totals.withColumns(start)
    levels = 0
    while last >= FAN:
        last, levels = last // FAN, levels + 1
    return _carries(totals, keys, scan, levels)


def _carries(totals: DataFrame, keys: Sequence[str], scan: Scan, levels: int) -> DataFrame:
    schema = totals.schema
    arrow = arrow_schema(schema)
    names = [f.name for f in _ddl(scan.state)]

    def states(rows: pa.Table) -> list[State]:
        return rows.sort_by("block").to_pylist()

    def fold(key: tuple, rows: pa.Table) -> pa.Table:
        acc = dict(scan.unit)
        for row in states(rows):
            acc = scan.merge(acc, {n: row[n] for n in names})
        return _row([*keys, "block"], key, acc, arrow)

    def spread(rows: pa.Table, acc: State) -> pa.Table:
        out = []
        for row in states(rows):
            out.append({**{n: row[n] for n in (*keys, "block")}, **acc})
            acc = scan.merge(acc, {n: row[n] for n in names})
        return pa.Table.from_pylist(out, schema=arrow)

    if not levels:
        return totals.groupBy(*keys).applyInArrow(
            lambda key, rows: spread(rows, dict(scan.unit)), schema
        )
    grouped = totals.withColumn("_up", F.expr(f"block div {FAN}"))
    by = [*keys, "_up"]
    above = _carries(grouped.groupBy(*by).applyInArrow(fold, schema), keys, scan, levels - 1)
    above = above.withColumnRenamed("block", "_up")
    return grouped.groupBy(*by).cogroup(above.groupBy(*by)).applyInArrow(
        lambda key, rows, start: spread(rows, {n: v for n, v in _one(start).items() if n in names}),
        schema,
    )


def finish(
    df: DataFrame, keys: Sequence[str], scan: Scan, before: DataFrame | None, start: State | None = None
) -> DataFrame:
    """Rows of ``df`` (own rows only) with the columns of ``scan.out``.

    ``before`` holds the state before each block; without it every block begins at ``start``.
    """
    by = [*keys, "block"]
    kept = [f for f in df.schema if f.name != "own"]
    schema = T.StructType([*kept, *_ddl(scan.out)])
    arrow = arrow_schema(schema)
    passed = [f.name for f in kept]
    has_own = "own" in df.columns

    def run(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
        return run_from(rows, _one(state)) if rows.num_rows else arrow.empty_table()

    def run_from(rows: pa.Table, state: State) -> pa.Table:
        rows = rows.sort_by("pos")
        new = scan.run(rows, state)
        if has_own:
            rows = rows.filter(rows["own"])
        columns = [rows[n] for n in passed]
        columns += [pa.array(new[f.name], type=f.type) for f in arrow if f.name not in passed]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=arrow)

    if before is None:
        return df.groupBy(*by).applyInArrow(lambda key, rows: run_from(rows, start), schema)
    return df.groupBy(*by).cogroup(before.groupBy(*by)).applyInArrow(run, schema)


def prefix_scan(df: DataFrame, keys: Sequence[str], scan: Scan, one_block: bool = False) -> DataFrame:
    """``df`` (with ``pos`` and ``block``) plus the columns of the scan.

    ``one_block`` says that no series has a second block, so there is nothing to carry.
    """
    if one_block:
        return finish(df, keys, scan, None, scan.unit)
    return finish(df, keys, scan, carries(block_totals(df, keys, scan), keys, scan))


# --- the folds inside a block ----------------------------------------------------------------


def values(rows: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, nulls as NaN."""
    return rows[name].to_numpy().astype("float64")


def nullable(x: np.ndarray, present: np.ndarray) -> pa.Array:
    return pa.array(x, type=pa.float64(), mask=~present)


def affine_run(a: np.ndarray, b: np.ndarray, start: float) -> np.ndarray:
    """y = a*y + b from ``start``. Stretches of 256 rows in closed form, chained one by one;
    a zero coefficient (a seed or a reset) begins a new stretch."""
    n = len(a)
    y = np.empty(n)
    cuts = np.union1d(np.arange(0, n, SUB), np.flatnonzero(a == 0.0))
    for i, lo in enumerate(cuts):
        hi = cuts[i + 1] if i + 1 < len(cuts) else n
        if a[lo] == 0.0:
            y[lo] = start = b[lo]
            lo += 1
        if lo < hi:
            weight = np.cumprod(a[lo:hi])
            y[lo:hi] = weight * (start + np.cumsum(b[lo:hi] / weight))
        start = y[hi - 1]
    return y


def affine_total(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    return float(np.prod(a)), float(affine_run(a, b, 0.0)[-1]) if len(a) else 0.0


def affine_merge(names: Sequence[str]) -> Callable[[State, State], State]:
    def merge(left: State, right: State) -> State:
        out = {}
        for n in names:
            a, b = f"a_{n}", f"b_{n}"
            out[a] = left[a] * right[a]
            out[b] = right[a] * left[b] + right[b]
        return out

    return merge


def affine_state(names: Sequence[str]) -> tuple[str, State]:
    ddl = ", ".join(f"a_{n} double, b_{n} double" for n in names)
    return ddl, {k: v for n in names for k, v in ((f"a_{n}", 1.0), (f"b_{n}", 0.0))}


def affine(names: Sequence[str]) -> Scan:
    """y = a*y + b for each name, from the columns ``a_<name>`` and ``b_<name>``, started at 0."""
    ddl, unit = affine_state(names)

    def total(rows: pa.Table, _: State) -> State:
        out = {}
        for n in names:
            out[f"a_{n}"], out[f"b_{n}"] = affine_total(values(rows, f"a_{n}"), values(rows, f"b_{n}"))
        return out

    def run(rows: pa.Table, before: State) -> dict[str, np.ndarray]:
        return {
            n: affine_run(values(rows, f"a_{n}"), values(rows, f"b_{n}"), before[f"b_{n}"]) for n in names
        }

    return Scan(ddl, unit, total, affine_merge(names), run, ", ".join(f"{n} double" for n in names))


def clamp(column: str, out: str) -> Scan:
    """x = min(1, max(0, x + c)) with c in ``column``, started at 0.

    A block acts on the incoming x as min(hi, max(lo, x + c)); two such steps merge into one.
    """

    def total(rows: pa.Table, _: State) -> State:
        shift, lo, hi = 0.0, 0.0, 1.0
        for c in values(rows, column).tolist():
            shift, lo, hi = shift + c, min(1.0, max(0.0, lo + c)), min(1.0, max(0.0, hi + c))
        return {"c": shift, "lo": lo, "hi": hi}

    def merge(left: State, right: State) -> State:
        def through(x: float) -> float:
            return min(right["hi"], max(right["lo"], x + right["c"]))

        return {"c": left["c"] + right["c"], "lo": through(left["lo"]), "hi": through(left["hi"])}

    def run(rows: pa.Table, before: State) -> dict[str, np.ndarray]:
        x, y = before["lo"], []
        for c in values(rows, column).tolist():
            x = min(1.0, max(0.0, x + c))
            y.append(x)
        return {out: np.array(y)}

    return Scan(
        "c double, lo double, hi double",
        {"c": 0.0, "lo": 0.0, "hi": 1.0},
        total,
        merge,
        run,
        f"{out} double",
    )
