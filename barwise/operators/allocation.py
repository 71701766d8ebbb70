"""Tactical allocation over the symbol universe and the reports built on it.

The universe, the current regimes and the rules hold one row per symbol or regime; they are
dimension tables, so the windows over all of them below run on as many rows as there are symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise import catalog
from barwise.functions.scalars import contains_any, first_match


def symbol_type(symbol: Column) -> Column:
    return first_match(
        [(contains_any(symbol, patterns), kind) for kind, patterns in catalog.SYMBOL_TYPES.items()], "unknown"
    )


def regime_counts(universe: DataFrame, current: DataFrame) -> DataFrame:
    """Regimes of the universe by count, ties by the position of their first symbol."""
    return (
        universe.join(current.select("symbol", "regime_type"), "symbol")
        .groupBy("regime_type")
        .agg(F.count(F.lit(1)).alias("count"), F.min("pos").alias("first_pos"))
    )


def dominant_regime(counts: DataFrame) -> DataFrame:
    """One row: the most frequent regime, the number of regimes; the default if there is none."""
    best = F.max_by("regime_type", F.struct("count", -F.col("first_pos")))
    return counts.agg(
        F.coalesce(best, F.lit(catalog.DEFAULT_REGIME)).alias("dominant"),
        F.count(F.lit(1)).alias("regimes"),
    )


def rule_regime(dominant: Column) -> Column:
    """Regimes without rules use those of the default."""
    return F.when(dominant.isin(list(catalog.REGIME_PERIODS)), dominant).otherwise(F.lit(catalog.DEFAULT_REGIME))


def tactical_allocation(universe: DataFrame, current: DataFrame) -> DataFrame:
    """Weight per symbol with the dominant regime, its risk multiplier and the confidence.

    The base weight is the bias of the symbol's family under the dominant regime (.1 without one),
    times 1.5 where the symbol is in that regime, else .5; weights sum to 1.
    """
    spark = universe.sparkSession
    one = F.lit(1).alias("_one")
    dominant = dominant_regime(regime_counts(universe, current)).select("*", one)
    placed = (
        universe.join(current.select("symbol", "regime_type"), "symbol", "left")
        .select("*", one)
        .join(F.broadcast(dominant), "_one")  # one row
        .withColumn("regime", rule_regime(F.col("dominant")))
        .join(F.broadcast(catalog.bias_rules(spark)), ["regime", "family"], "left")  # fixed rules
        .join(F.broadcast(catalog.regime_rules(spark)), "regime", "left")
    )
    same = F.coalesce(F.col("regime_type") == F.col("dominant"), F.lit(False))
    raw = F.coalesce(F.col("bias"), F.lit(catalog.DEFAULT_BIAS)) * F.when(same, 1.5).otherwise(0.5)
    everything = Window.partitionBy("_one")
    return placed.withColumn("_raw", raw).select(
        "symbol",
        "family",
        "pos",
        F.col("regime_type").alias("symbol_regime"),
        F.col("dominant").alias("dominant_regime"),
        (F.col("_raw") / F.sum("_raw").over(everything)).alias("weight"),
        "risk_multiplier",
        (F.col("regimes") / F.count(F.lit(1)).over(everything)).alias("confidence"),
    )


def strategy_weights(allocation: DataFrame, above: float | None = None) -> DataFrame:
    """Strategy weights of the dominant regime; ``above`` keeps those over a limit."""
    rules = catalog.strategy_rules(allocation.sparkSession)
    out = (
        allocation.select("dominant_regime")
        .distinct()
        .withColumn("regime", rule_regime(F.col("dominant_regime")))
        .join(F.broadcast(rules), "regime")
        .select("dominant_regime", "strategy", "weight")
    )
    return out if above is None else out.where(F.col("weight") > above)


def opportunities(current: DataFrame) -> DataFrame:
    return current.where(F.col("regime_type").contains("trending"))


def top_symbols(allocation: DataFrame, n: int = 5) -> DataFrame:
    return allocation.orderBy(F.desc("weight"), "pos").limit(n)


def risk_level(multiplier: Column) -> Column:
    return first_match([(multiplier > 0.7, "HIGH"), (multiplier > 0.4, "MEDIUM")], "LOW")


def risk_advice(multiplier: Column) -> Column:
    return first_match([(multiplier > 0.8, "reduce"), (multiplier < 0.4, "favorable")], "keep")


def stability_label(stability: Column) -> dict[str, Column]:
    return {
        "stability_label": F.when(stability < 0.6, "unstable").otherwise("stable"),
        "volatility_alert": stability < 0.5,
    }


def dashboard_regimes(universe: DataFrame, current: DataFrame) -> DataFrame:
    """Regime counts with their percentage of all symbols, including those without a regime."""
    total = universe.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    return (
        regime_counts(universe, current)
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")  # one row
        .select("regime_type", "count", (F.col("count") / F.col("_n") * 100).alias("percentage"))
    )


def dashboard_symbols(allocation: DataFrame, summary: DataFrame) -> DataFrame:
    """Per symbol: regime, stability in percent (0 without history), weight."""
    return allocation.join(summary.select("symbol", "regime_stability"), "symbol", "left").select(
        "symbol",
        F.coalesce("symbol_regime", F.lit("Unknown")).alias("regime"),
        (F.coalesce("regime_stability", F.lit(0.0)) * 100).alias("stability_pct"),
        "weight",
    )
