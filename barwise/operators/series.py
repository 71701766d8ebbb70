"""Ordered work on long series without one task per key.

A market has few symbols, so ``Window.partitionBy("symbol")`` would put a large part of all rows
into one task. Every order-dependent operator here works on blocks of a bounded number of rows:

1. :func:`number` gives each row its position in its series. Long series are cut into parts of about equal
   numbers of rows; a prefix sum over the counts of parts and the order inside a part give the position.
2. :func:`block` cuts a series into blocks of ``size`` rows. Rows that the next (previous) block
   needs for its frames travel there too, so any frame up to that length is exact.
3. :mod:`barwise.operators.scan` folds a recurrence over the blocks of a series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwise.session import materialize

BLOCK = 65_536
#: Rows of one key that are ordered in one task.
PART_ROWS = 100_000
#: Cut points of one key at most, at one level.
MOST_CUTS = 4095


def number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], pos: str = "pos", rows: int = PART_ROWS, most: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row in its series, by the columns ``order``; nulls come first.

    Series of up to ``rows`` rows are numbered as they are. Longer ones are cut into parts (:func:`parts`), whose counts give the position of a
    part. ``most`` is the length of the longest series, if known.
    """
    most = longest(df, keys) if most is None else most
    if most <= rows:
        return df.withColumn(pos, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    cut, levels = parts(df, keys, order, rows, most)
    by = [*keys, *levels]
    earlier = Window.partitionBy(*keys).orderBy(*levels).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    numbered = cut.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return numbered.join(starts, same).withColumn(pos, F.col("_start") + F.col("_row") - 1).select(*df.columns, pos)


def parts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = PART_ROWS, most: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Series cut into parts of about ``rows`` rows: ``df`` with columns that number the parts in order, and their names.

    Cut points are quantiles of the first column of ``order`` per long key, from a sketch. A value that fills several parts (a burst at one
    time) is cut by the next column in the same way, and rows equal in all columns by their place in the table, which is written for that.
    Each level multiplies the number of parts by up to ``MOST_CUTS``. ``most`` is the length of the longest series, if known.
    """
    levels: list[str] = []
    within = list(keys)
    out = df.withColumn("_whole", F.lit(True))
    for i in range(len(order) + 1):
        most = longest(out.where("_whole"), within) if most is None or i else most
        if most <= rows:
            break
        kind = df.schema[order[i]].dataType if i < len(order) else None
        level, tail, at = f"_part{i}", f"_tail{i}", f"_value{i}"
        out = out.withColumn(at, _as_number(F.col(order[i]), kind) if kind else F.monotonically_increasing_id())
        if not kind:
            out = materialize(out, "series-places")
        n = min(MOST_CUTS, -(-2 * most // rows))
        sketch = F.percentile_approx(at, [j / (n + 1) for j in range(1, n + 1)], 4 * (n + 1))
        cuts = out.where("_whole").groupBy(*within).agg(F.count(F.lit(1)).alias("_n"), sketch.alias("_points")).where(F.col("_n") > rows)
        filled = F.filter("_points", lambda x, j: x == F.get("_points", j + 1))
        cuts = materialize(cuts.select(*within, F.array_distinct("_points").alias("_cuts"), F.array_distinct(filled).alias("_filled")), "cut-points")
        out = _searched(_with_table(out, cuts, within, ["_cuts", "_filled"]), "_cuts", at, level, n)
        # A value at two cut points or more fills a part by itself. Inside the part its rows come first, and go on to the next column.
        whole = F.col("_whole") & F.coalesce(F.array_contains("_filled", F.col(at)), F.lit(False))
        out = out.withColumn("_whole", whole).withColumn(tail, F.when(F.col("_whole"), 0).otherwise(1)).drop("_cuts", "_filled")
        levels += [level, tail]
        within.append(at)
        if isinstance(kind, T.StringType) or cuts.where(F.size("_filled") > 0).isEmpty():  # a text's number does not tell all texts apart
            break
        out = materialize(out, "series-parts")
    return out, levels


def _as_number(value: Column, kind: T.DataType) -> Column:
    """A number that never falls as the value rises, null lowest; of texts the first seven bytes."""
    if isinstance(kind, T.TimestampType):
        return F.coalesce(F.unix_micros(value), F.lit(-(1 << 62)))
    if isinstance(kind, T.DateType):
        return F.coalesce(F.unix_date(value).cast("long"), F.lit(-(1 << 62)))
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 7)), 14, "0")
        return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1).cast("long"))
    if isinstance(kind, T.IntegralType):
        return F.coalesce(value.cast("long"), F.lit(-(1 << 63)))
    return F.coalesce(value if isinstance(kind, T.DecimalType) else value.cast("double"), F.lit(float("-inf")))


def _with_table(df: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join that matches null keys."""
    named = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(named, same, "left").select(*df.columns, *columns)


def _searched(df: DataFrame, cuts: str, value: str, out: str, most: int) -> DataFrame:
    """How many of the sorted ``cuts`` are at most ``value``: a binary search in steps; 0 without cuts or value."""
    df = df.withColumn(out, F.lit(0))
    step = 1 << max(0, most.bit_length() - 1)
    while step:
        there = F.get(cuts, F.col(out) + (step - 1)) <= F.col(value)
        df = df.withColumn(out, F.col(out) + F.when(there, step).otherwise(0))
        step //= 2
    return df


def longest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the longest series: one aggregation over the keys, one number to the driver."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def block(df: DataFrame, back: int = 0, ahead: int = 0, size: int = BLOCK) -> DataFrame:
    """Add ``block`` and ``own``; the last ``back`` rows of a block also join the next one and
    the first ``ahead`` rows the previous one, there with ``own`` false."""
    if max(back, ahead) > size:
        raise ValueError(f"frame of {max(back, ahead)} rows does not fit a block of {size}")
    home = F.expr(f"pos div {size}")
    if not back and not ahead:
        return df.withColumn("block", home).withColumn("own", F.lit(True))
    inside = F.pmod(F.col("pos"), F.lit(size))
    steps = [F.lit(0)]
    if back:
        steps.append(F.when(inside >= size - back, F.lit(1)))
    if ahead:
        steps.append(F.when((inside < ahead) & (home > 0), F.lit(-1)))
    return (
        df.withColumn("_step", F.explode(F.array_compact(F.array(*steps))))
        .withColumn("block", home + F.col("_step"))
        .withColumn("own", F.col("_step") == 0)
        .drop("_step")
    )


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the visiting rows of :func:`block`; the block number stays for later scans."""
    return df.where("own").drop("own")


def in_block(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "block").orderBy("pos")


def running(df: DataFrame, keys: Sequence[str], kind: str, column: str, out: str, prior: bool = False) -> DataFrame:
    """Running ``sum`` or ``max`` of a numbered, blocked series; ``prior`` leaves out the row itself.

    Runs inside blocks; the totals of earlier blocks come from a window over one row per block.
    """
    fn = {"sum": F.sum, "max": F.max}[kind]
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest}[kind]
    by = [*keys, "block"]
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(*by).agg(fn(column).alias("_t")).select(*by, fn("_t").over(earlier).alias("_before"))
    inside = in_block(keys).rowsBetween(Window.unboundedPreceding, -1 if prior else 0)
    return (
        df.withColumn("_inside", fn(column).over(inside))
        .join(before, by)
        .withColumn(out, join(F.col("_before"), F.col("_inside")))
        .drop("_before", "_inside")
    )
