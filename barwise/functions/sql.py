"""SQL table functions over a registered view of regime events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Times are explicit, so that results can be repeated.
HISTORY = """
CREATE OR REPLACE TEMPORARY FUNCTION get_regime_history(
    p_symbol STRING, p_as_of TIMESTAMP, p_days INT DEFAULT 30)
RETURNS TABLE (timestamp TIMESTAMP, regime_type STRING, confidence DOUBLE)
RETURN SELECT e.timestamp, e.regime_type, e.confidence FROM {view} e
       WHERE e.symbol = p_symbol AND e.timestamp >= p_as_of - make_dt_interval(p_days)
       ORDER BY e.timestamp DESC
"""

STATS = """
CREATE OR REPLACE TEMPORARY FUNCTION calculate_regime_stats(
    p_symbol STRING, p_start TIMESTAMP, p_end TIMESTAMP)
RETURNS TABLE (regime_type STRING, occurrence_count BIGINT, avg_confidence DOUBLE, total_duration INTERVAL DAY TO SECOND)
RETURN SELECT q.regime_type, count(*), avg(q.confidence), sum(q.end_time - q.timestamp)
       FROM (SELECT e.regime_type, e.confidence, e.timestamp,
                    coalesce(lead(e.timestamp) OVER (PARTITION BY e.symbol ORDER BY e.timestamp), p_end) AS end_time
             FROM {view} e
             WHERE e.symbol = p_symbol AND e.timestamp BETWEEN p_start AND p_end) q
       GROUP BY q.regime_type
       ORDER BY count(*) DESC, q.regime_type
"""


def register(spark: SparkSession, events: DataFrame, view: str = "regime_events") -> None:
    """Register the view and both functions. They take one symbol; for all symbols at once, and for
    very long series, use the operators of :mod:`barwise.operators.regimes`."""
    events.createOrReplaceTempView(view)
    spark.sql(HISTORY.format(view=view))
    spark.sql(STATS.format(view=view))
