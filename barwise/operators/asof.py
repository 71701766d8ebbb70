"""As-of lookup with a tolerance: the newest right row not later and not too old."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.operators.series import PART_ROWS, longest, parts
from barwise.session import materialize


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    tolerance: int,
    columns: Sequence[str],
    rows: int = PART_ROWS,
) -> DataFrame:
    """Left rows with ``columns`` and the time of the newest right row of the same keys that is at
    most ``tolerance`` seconds old; null when there is none. Right times are unique per key.

    Both sides form one series per key. A series of up to ``rows`` rows is one window; a longer one is cut into parts of about as many rows by
    its own distribution, whatever the tolerance, and a part that does not begin with a right row takes the last one of the parts before it. Of
    those only one row per part is read.
    """
    features = right.select(
        *keys,
        F.col(right_time).alias("_at"),
        F.lit(0).alias("_side"),
        F.struct(F.col(right_time).alias("_rt"), *[F.col(c) for c in columns]).alias("_right"),
    )
    rest = [c for c in left.columns if c not in keys]
    requests = left.select(*keys, F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.struct(*rest).alias("_left"))
    both = features.unionByName(requests, allowMissingColumns=True)
    most = longest(both, keys)
    if most <= rows:
        found = both.withColumn("_found", _last(keys))
    else:
        found = _over_parts(both, keys, rows, most)
    fresh = F.unix_micros("_at") - F.unix_micros(F.col("_found._rt")) <= tolerance * 1_000_000
    return (
        found.where("_side = 1")
        .withColumn("_found", F.when(fresh, F.col("_found")))
        .select(
            *keys,
            "_left.*",
            F.col("_found._rt").alias("asof_time"),
            *[F.col(f"_found.{c}").alias(c) for c in columns],
        )
    )


def _last(by: Sequence[str]):
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return F.last("_right", ignorenulls=True).over(w)


def _over_parts(both: DataFrame, keys: Sequence[str], rows: int, most: int) -> DataFrame:
    """``_found`` for series that are cut into parts."""
    cut, levels = parts(both, keys, ["_at", "_side"], rows, most)
    cut = materialize(cut.select(*both.columns, *levels), "asof-parts")
    by = [*keys, *levels]
    ends = cut.groupBy(*by).agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_at"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy(*levels).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    inside = cut.withColumn("_inside", _last(by)).where("_side = 1")
    return inside.join(carried, same, "left").withColumn("_found", F.coalesce("_inside", "_carried"))
