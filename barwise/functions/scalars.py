"""Column helpers shared by the operators; all of them are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def guarded(num: Column, den: Column) -> Column:
    """``num / den``, 0 where the denominator is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def first_match(cases: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first condition that is true."""
    out = F.lit(default)
    for cond, value in reversed(cases):
        out = F.when(cond, value).otherwise(out)
    return out


def contains_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in patterns])


def time_bucket(time: str | Column, seconds: int) -> Column:
    """Start of the bucket in epoch microseconds; integer arithmetic, so exact at the edges."""
    micros = F.unix_micros(col(time))
    return micros - F.pmod(micros, F.lit(seconds * 1_000_000))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference in seconds as a double, keeping the fraction."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def to_time(value: Column, kind: str) -> Column:
    """An epoch number becomes a timestamp, a timestamp passes through."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return value.cast("timestamp")
    return F.timestamp_seconds(value)


def argmax(values: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def feature_key(prefix: str, *parts: str | Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *[col(p) for p in parts])


def prefixed_keys(m: Column, prefix: str) -> Column:
    return F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix), k))


def interpolated_quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of an unsorted array of doubles."""
    ordered = F.sort_array(values)
    rank = (F.size(values) - 1) * F.lit(q)
    low = F.floor(rank).cast("int")
    at_low = F.element_at(ordered, low + 1)
    at_high = F.element_at(ordered, F.least(low + 2, F.size(values)))
    return at_low + (rank - low) * (at_high - at_low)
