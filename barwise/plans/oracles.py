"""The same queries as ANSI SQL over the shared test tables, to check results independently."""

from __future__ import annotations

import re

from barwise import catalog
from barwise.plans import model_sql
from barwise.plans.queries import ACCOUNT_CAPITAL, AS_OF, CAPITAL, CLUSTER_STEPS, MIXTURE_STEPS, STAY


def values(rows) -> str:
    def lit(x):
        return f"'{x}'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)


def bars(symbol: str, unit: str) -> str:
    return f"""SELECT {symbol} AS symbol, date_trunc('{unit}', ts)::TIMESTAMP AS time,
        arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
        count(*) AS volume FROM events GROUP BY 1, 2"""


def features(source: str) -> str:
    return f"""SELECT *, (high + low + close) / 3 AS typical,
        CASE WHEN open <> 0 THEN (high - low) / open ELSE 0 END AS volatility,
        CASE WHEN open <> 0 THEN abs(close - open) / open ELSE 0 END AS trend_strength,
        least(volume / 1000.0, 10.0) AS volume_profile,
        CASE WHEN open <> 0 THEN (close - open) / open ELSE 0 END AS price_momentum,
        CASE WHEN (high + low + close) / 3 <> 0
             THEN abs(close - (high + low + close) / 3) / ((high + low + close) / 3) ELSE 0 END AS mean_reversion
        FROM {source}"""


def regimes(source: str) -> str:
    return f"""SELECT *, least(0.3 * volatility + 0.4 * trend_strength + 0.3 * volume_profile, 1.0) AS regime_confidence,
        CASE WHEN volatility > 0.05 AND trend_strength > 0.02 THEN 'trending_high_vol'
             WHEN volatility > 0.05 THEN 'ranging_high_vol'
             WHEN trend_strength > 0.02 THEN 'trending_low_vol' ELSE 'ranging_low_vol' END AS regime_type
        FROM {source}"""


def regime_rows(source: str) -> str:
    return f"""SELECT symbol, time AS timestamp, regime_type, regime_confidence AS confidence,
        'basic' AS regime_model FROM {source}"""


def indicator_steps(source: str) -> str:
    return f"""SELECT *, row_number() OVER w - 1 AS i,
        lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl,
        lag(close, 20) OVER w AS c20
        FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY time)"""


def indicator_inputs(source: str) -> str:
    return f"""SELECT *,
        greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
        greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss,
        CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up,
        CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS down,
        abs(close - pc) AS move FROM {source}"""


def indicator_seeds(source: str) -> str:
    return f"""SELECT *,
        avg(tr) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) AS tr14,
        avg(tr) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING) AS tr20,
        avg(gain) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) AS gain14,
        avg(loss) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) AS loss14,
        sum(tr) OVER (PARTITION BY symbol ORDER BY i ROWS 12 PRECEDING) AS str,
        sum(up) OVER (PARTITION BY symbol ORDER BY i ROWS 12 PRECEDING) AS sup,
        sum(down) OVER (PARTITION BY symbol ORDER BY i ROWS 12 PRECEDING) AS sdown,
        avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS 25 PRECEDING) AS c26,
        avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS 11 PRECEDING) AS c12,
        sum(move) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING) AS path FROM {source}"""


def recursion(source: str, name: str) -> str:
    kama = """pow((CASE WHEN d.path = 0 THEN 1 ELSE abs(d.close - d.c20) / d.path END)
              * (2.0/3 - 2.0/31) + 2.0/31, 2)"""
    return f"""SELECT symbol, i, CAST(NULL AS DOUBLE) AS atr14, CAST(NULL AS DOUBLE) AS atr20,
        CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l, CAST(NULL AS DOUBLE) AS s_tr,
        CAST(NULL AS DOUBLE) AS s_up, CAST(NULL AS DOUBLE) AS s_down, CAST(NULL AS DOUBLE) AS kama,
        CAST(NULL AS DOUBLE) AS slow, CAST(NULL AS DOUBLE) AS fast FROM {source} WHERE i = 0
      UNION ALL
      SELECT d.symbol, d.i,
        CASE WHEN d.i = 14 THEN d.tr14 WHEN d.i > 14 THEN (r.atr14 * 13 + d.tr) / 14 END,
        CASE WHEN d.i = 20 THEN d.tr20 WHEN d.i > 20 THEN (r.atr20 * 19 + d.tr) / 20 END,
        CASE WHEN d.i = 14 THEN d.gain14 WHEN d.i > 14 THEN (r.g * 13 + d.gain) / 14 END,
        CASE WHEN d.i = 14 THEN d.loss14 WHEN d.i > 14 THEN (r.l * 13 + d.loss) / 14 END,
        CASE WHEN d.i = 13 THEN d.str WHEN d.i > 13 THEN r.s_tr - r.s_tr / 14 + d.tr END,
        CASE WHEN d.i = 13 THEN d.sup WHEN d.i > 13 THEN r.s_up - r.s_up / 14 + d.up END,
        CASE WHEN d.i = 13 THEN d.sdown WHEN d.i > 13 THEN r.s_down - r.s_down / 14 + d.down END,
        CASE WHEN d.i = 19 THEN d.close WHEN d.i > 19 THEN r.kama + {kama} * (d.close - r.kama) END,
        CASE WHEN d.i = 25 THEN d.c26 WHEN d.i > 25 THEN r.slow + (d.close - r.slow) * 2 / 27 END,
        CASE WHEN d.i = 25 THEN d.c12 WHEN d.i > 25 THEN r.fast + (d.close - r.fast) * 2 / 13 END
      FROM {name} r JOIN {source} d ON d.symbol = r.symbol AND d.i = r.i + 1"""


def index_rows(recursive: str) -> str:
    return f"""SELECT *, fast - slow AS line,
        CASE WHEN i >= 14 THEN CASE WHEN s_tr = 0 OR s_up + s_down = 0 THEN 0
             ELSE 100 * abs(s_up - s_down) / (s_up + s_down) END END AS dx FROM {recursive}"""


def index_seeds(source: str) -> str:
    return f"""SELECT *, avg(dx) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) AS dx14,
        avg(line) OVER (PARTITION BY symbol ORDER BY i ROWS 8 PRECEDING) AS line9 FROM {source}"""


def second_recursion(source: str, name: str) -> str:
    return f"""SELECT symbol, i, CAST(NULL AS DOUBLE) AS adx, CAST(NULL AS DOUBLE) AS sig FROM {source} WHERE i = 0
      UNION ALL
      SELECT d.symbol, d.i,
        CASE WHEN d.i = 27 THEN d.dx14
             WHEN d.i > 27 THEN CASE WHEN d.s_up + d.s_down = 0 THEN r.adx ELSE (r.adx * 13 + d.dx) / 14 END END,
        CASE WHEN d.i = 33 THEN d.line9 WHEN d.i > 33 THEN r.sig + (d.line - r.sig) * 0.2 END
      FROM {name} r JOIN {source} d ON d.symbol = r.symbol AND d.i = r.i + 1"""


CTES: dict[str, str] = {
    "bars_h": bars("event_type", "hour"),
    "bars_u": bars("user_id::VARCHAR", "day"),
    "symbols": "SELECT * FROM (VALUES "
    + values((s, s.rsplit(" ", 1)[0], i) for i, s in enumerate(catalog.SYMBOLS))
    + ") t(symbol, family, pos)",
    "bars_i": """SELECT s.symbol, date_trunc('day', ts)::TIMESTAMP AS time, arg_min(value, ts) AS open,
        max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume
        FROM events JOIN symbols s ON s.pos = user_id % 34 GROUP BY 1, 2""",
    "bars_p": """SELECT c_mktsegment AS symbol, date_trunc('week', o_orderdate)::TIMESTAMP AS time,
        arg_min(1000 + o_totalprice / 10000, o_orderkey) AS open, max(1000 + o_totalprice / 10000) AS high,
        min(1000 + o_totalprice / 10000) AS low, arg_max(1000 + o_totalprice / 10000, o_orderkey) AS close,
        count(*) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "feat_u": features("bars_u"),
    "feat_h": features("bars_h"),
    "bars_m": bars("event_type", "minute"),
    "feat_m": features("bars_m"),
    "reg_m": regimes("feat_m"),
    "ev_m": regime_rows("reg_m"),
    "sent_u": """SELECT *, least(floor(date_diff('day', DATE '2024-01-01', timestamp::DATE) / 8.0)
        + ((symbol::BIGINT + date_diff('day', DATE '2024-01-01', timestamp::DATE)) % 5 = 0)::INT, 3) AS part FROM ev_u""",
    "seen_u": """SELECT n, symbol, max(timestamp) AS time, arg_max(regime_type, timestamp) AS regime, arg_max(confidence, timestamp) AS confidence
        FROM sent_u JOIN (VALUES (-1), (0), (1), (2), (3)) b(n) ON part <= n GROUP BY 1, 2""",
    "clock_u": "SELECT n, max(time) AS clock FROM seen_u GROUP BY 1",
    "live_h": """SELECT symbol, time + INTERVAL 1 HOUR AS at, i, regime, signal, confidence, atr, CASE WHEN ok THEN raw_size ELSE 0 END AS size
        FROM size_h""",
    "asked": """SELECT t.*, h.regime AS last_regime, h.at >= t.time - INTERVAL 86400 SECOND AS has_history FROM
        (SELECT t.symbol, t.time, t.bid, f.at >= t.time - INTERVAL 300 SECOND AS has_features, f.signal, f.confidence, f.atr, f.size
         FROM ticks t ASOF LEFT JOIN (SELECT * FROM live_h WHERE i >= 19) f ON t.symbol = f.symbol AND t.time >= f.at) t
        ASOF LEFT JOIN (SELECT * FROM live_h WHERE i >= 24) h ON t.symbol = h.symbol AND t.time >= h.at""",
    "feat_i": features("bars_i"),
    "reg_u": regimes("feat_u"),
    "reg_h": regimes("feat_h"),
    "reg_i": regimes("feat_i"),
    "ev_u": regime_rows("reg_u"),
    "ev_h": regime_rows("reg_h"),
    "ev_i": regime_rows("reg_i"),
    "flat": """SELECT event_type AS symbol, ts AS time, value AS open, value AS high, value AS low, value AS close,
        1000 AS volume FROM events""",
    "flat_feat": features("flat"),
    "flat_reg": regimes("flat_feat"),
    "flat_ev": regime_rows("flat_reg"),
    "ticks": """SELECT ts AS time, event_type AS symbol, value AS bid, value + 0.01 * (event_id % 5) AS ask
        FROM events""",
    "trades": """SELECT 'A' AS account, user_id::VARCHAR AS symbol, ts, event_id AS id,
        CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE value - 50 END AS pnl FROM events""",
    "es": """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'signal_generated'
        WHEN 'purchase' THEN 'order_placed' WHEN 'view' THEN 'data_ingested_with_regime' ELSE event_type END AS event_type,
        user_id::VARCHAR AS aggregate_id, props AS data, '{}' AS metadata, ts AS timestamp,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events""",
    "incoming": """SELECT date_trunc('minute', ts)::TIMESTAMP AS time, event_type AS symbol, value AS open, value + 1 AS high,
        value - 1 AS low, value AS close, 1000 AS volume, event_id FROM events""",
    "incoming_last": """SELECT time, symbol, arg_max(open, event_id) AS open, arg_max(high, event_id) AS high,
        arg_max(low, event_id) AS low, arg_max(close, event_id) AS close, 1000 AS volume
        FROM incoming GROUP BY 1, 2""",
    # indicators
    "step_h": indicator_steps("bars_h"),
    "input_h": indicator_inputs("step_h"),
    "seed_h": indicator_seeds("input_h"),
    "rec_h": recursion("seed_h", "rec_h"),
    "index_h": index_rows("rec_h"),
    "iseed_h": index_seeds("index_h"),
    "rec2_h": second_recursion("iseed_h", "rec2_h"),
    "step_p": indicator_steps("bars_p"),
    "input_p": indicator_inputs("step_p"),
    "seed_p": indicator_seeds("input_p"),
    "rec_p": recursion("seed_p", "rec_p"),
    "index_p": index_rows("rec_p"),
    "iseed_p": index_seeds("index_p"),
    "rec2_p": second_recursion("iseed_p", "rec2_p"),
    "fast_k": """SELECT *, CASE WHEN hh <> ll THEN 100 * (close - ll) / (hh - ll) ELSE 0 END AS k FROM (
        SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING) AS hh,
        min(low) OVER (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING) AS ll FROM step_h)""",
    "slow_k": """SELECT *, CASE WHEN i >= 6 THEN avg(k) OVER (PARTITION BY symbol ORDER BY i ROWS 2 PRECEDING) END AS sk
        FROM fast_k""",
    "stoch_h": """SELECT symbol, i, CASE WHEN i >= 8 THEN sk END AS stoch_k, CASE WHEN i >= 8 THEN
        avg(sk) OVER (PARTITION BY symbol ORDER BY i ROWS 2 PRECEDING) END AS stoch_d FROM slow_k""",
    "rows_h": "SELECT symbol, list(close ORDER BY i) AS closes FROM step_h GROUP BY symbol",
    "period_h": """SELECT s.symbol, s.i, s.close, CASE WHEN s.i + 1 < 40 THEN 20 ELSE greatest(10, least(100,
        floor(20 * least(greatest(1 / (CASE WHEN s.close > 0 THEN r.atr20 / s.close ELSE 0 END + 0.001), 0.5), 2.0))))::INT
        END AS period FROM step_h s JOIN rec_h r USING (symbol, i)""",
    "hull_raw": """SELECT p.symbol, p.i, p.period, k.k, floor(sqrt(p.period))::INT AS root,
        (SELECT sum(j.j * x.closes[p.i + 1 - k.k - (p.period // 2) + j.j]) FROM range(1, p.period // 2 + 1) j(j))
          / ((p.period // 2) * (p.period // 2 + 1) / 2.0) AS half,
        (SELECT sum(j.j * x.closes[p.i + 1 - k.k - p.period + j.j]) FROM range(1, p.period + 1) j(j))
          / (p.period * (p.period + 1) / 2.0) AS whole
        FROM period_h p JOIN rows_h x USING (symbol) CROSS JOIN range(0, 6) k(k)
        WHERE k.k < floor(sqrt(p.period)) AND p.i + 1 >= p.period + floor(sqrt(p.period)) - 1""",
    "hull_h": """SELECT symbol, i, sum((root - k) * (2 * half - whole)) / any_value(root * (root + 1) / 2.0) AS hma
        FROM hull_raw GROUP BY symbol, i""",
    "ind_h": """SELECT s.*, r.atr14, r.atr20, CASE WHEN s.i >= 14 THEN CASE WHEN r.g + r.l = 0 THEN 0
          ELSE 100 * r.g / (r.g + r.l) END END AS rsi, r.kama, x.line AS macd, z.sig AS macd_signal, z.adx,
          t.stoch_k, t.stoch_d, p.period, h.hma
        FROM step_h s JOIN rec_h r USING (symbol, i) JOIN index_h x USING (symbol, i) JOIN rec2_h z USING (symbol, i)
        JOIN stoch_h t USING (symbol, i) JOIN period_h p USING (symbol, i) LEFT JOIN hull_h h USING (symbol, i)""",
    "tech_h": """SELECT f.*, n.i, CASE WHEN n.i >= 19 THEN n.adx END AS adx, CASE WHEN n.i >= 19 THEN n.atr14 END AS atr,
        CASE WHEN n.i >= 19 THEN n.rsi END AS rsi, CASE WHEN n.i >= 19 THEN n.kama END AS kama,
        CASE WHEN n.i >= 19 THEN n.stoch_k END AS stoch_k, CASE WHEN n.i >= 19 THEN n.stoch_d END AS stoch_d
        FROM reg_h f JOIN ind_h n USING (symbol, time)""",
    "techreg_h": """SELECT * REPLACE (CASE WHEN i < 19 THEN regime_type ELSE
          (CASE WHEN coalesce(adx > 25, FALSE) THEN 'trending' ELSE 'ranging' END) ||
          (CASE WHEN volatility > 0.05 THEN '_high_vol' ELSE '_low_vol' END) END AS regime_type),
        CASE WHEN adx IS NOT NULL AND i >= 19 THEN least(1.0, 0.6 * regime_confidence + 0.4 * (0.4 * least(adx / 50, 1.0)
          + 0.3 * least(atr / (volatility + 0.001), 2.0) + 0.3 * (1 - abs(rsi - 50) / 50))) END AS enhanced
        FROM tech_h""",
    "flag_h": """SELECT *, i >= 19 AND regime_type LIKE '%trending%' AS t,
        close > kama AND adx > 30 AND rsi > 50 AND stoch_k > stoch_d AND stoch_k > 50 AS bull,
        NOT (close > kama) AND adx > 30 AND rsi < 50 AND stoch_k < stoch_d AND stoch_k < 50 AS bear FROM techreg_h""",
    "nnfx_h": """SELECT *, CASE WHEN t AND bull THEN 'BUY' WHEN t AND bear THEN 'SELL' ELSE 'HOLD' END AS nnfx_signal,
        CASE WHEN i < 19 THEN 0 WHEN NOT t THEN 0.3 WHEN bull OR bear THEN least(0.9, enhanced) ELSE 0.5 END AS signal_confidence,
        CASE WHEN t AND bull THEN 'BULLISH' WHEN t AND bear THEN 'BEARISH' ELSE 'NEUTRAL' END AS baseline_signal,
        CASE WHEN t THEN adx / 50 ELSE 0 END AS confirmation_strength FROM flag_h""",
    "raw_sig": """SELECT f.symbol, f.time, f.regime_type AS regime, n.i, n.close, n.hma, n.adx, n.rsi, n.macd, n.macd_signal,
        n.stoch_k, n.stoch_d, n.atr14 AS atr,
        CASE WHEN n.i < 49 THEN 0
          WHEN f.regime_type LIKE 'trending%' THEN CASE WHEN n.adx > 25 AND n.close > n.hma AND n.rsi < 70 THEN 1
            WHEN n.adx > 25 AND n.close < n.hma AND n.rsi > 30 THEN -1 ELSE 0 END
          WHEN n.hma > 0 AND abs(n.close - n.hma) / n.hma > 0.02 THEN CASE WHEN n.close > n.hma AND n.rsi > 70 THEN -1
            WHEN n.close < n.hma AND n.rsi < 30 THEN 1 ELSE 0 END
          ELSE 0 END AS signal FROM reg_h f JOIN ind_h n USING (symbol, time)""",
    "sig_h": """SELECT *, CASE WHEN signal = 0 THEN 0 ELSE
        0.6 * (CASE WHEN regime LIKE 'trending%' THEN least(0.9, adx / 50) ELSE 0.7 END)
        + 0.2 * (CASE WHEN (signal = 1 AND macd > macd_signal) OR (signal = -1 AND macd < macd_signal) THEN 1 ELSE 0.5 END)
        + 0.2 * (CASE WHEN (signal = 1 AND stoch_k < 20) OR (signal = -1 AND stoch_k > 80) THEN 1 ELSE 0.5 END)
        END AS confidence FROM raw_sig""",
    "size_h": f"""SELECT *, signal <> 0 AND confidence >= 0.6 AND atr > 0 AS ok,
        {CAPITAL} * 0.02 / (atr * 1.5) * confidence AS raw_size FROM sig_h""",
    "trade_h": """SELECT symbol, time, regime, confidence,
        CASE WHEN i < 19 THEN 'NO_FEATURES' WHEN i = 19 THEN 'NO_REGIME_HISTORY' END AS error,
        CASE WHEN i <= 19 THEN NULL WHEN signal <> 0 AND confidence >= 0.6 THEN signal ELSE 0 END AS type,
        CASE WHEN i > 19 AND signal <> 0 AND confidence >= 0.6 THEN CASE WHEN ok THEN raw_size ELSE 0 END ELSE 0 END AS volume,
        CASE WHEN i > 19 AND signal <> 0 AND confidence >= 0.6 THEN atr * 1.5 ELSE 0 END AS sl,
        CASE WHEN i > 19 AND signal <> 0 AND confidence >= 0.6 THEN atr * 3.0 ELSE 0 END AS tp FROM size_h""",
    # current regimes, history
    "cur_u": """SELECT symbol, regime_type, confidence, timestamp FROM ev_u e WHERE timestamp =
        (SELECT max(timestamp) FROM ev_u x WHERE x.symbol = e.symbol)""",
    "cur_i": """SELECT symbol, regime_type, confidence, timestamp FROM ev_i e WHERE timestamp =
        (SELECT max(timestamp) FROM ev_i x WHERE x.symbol = e.symbol)""",
    "hist_h": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rank FROM ev_h
        QUALIFY rank <= 100""",
    "hist_h1000": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rank FROM ev_h
        QUALIFY rank <= 1000""",
    "hist_i": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rank FROM ev_i
        QUALIFY rank <= 100""",
    "sum_i": """SELECT symbol, count(*) AS total_periods, avg(confidence) AS avg_confidence,
        CASE WHEN count(*) <= 1 THEN 1 ELSE 1 - sum(changed) / (count(*) - 1) END AS regime_stability FROM
        (SELECT *, (regime_type <> lag(regime_type) OVER (PARTITION BY symbol ORDER BY rank))::INT AS changed FROM hist_i)
        GROUP BY symbol""",
    "counts_i": """SELECT regime_type, count(*) AS n, min(pos) AS first_pos FROM symbols JOIN cur_i USING (symbol)
        GROUP BY regime_type""",
    "dom_i": """SELECT (SELECT regime_type FROM counts_i ORDER BY n DESC, first_pos LIMIT 1) AS dominant,
        (SELECT count(*) FROM counts_i) AS regimes""",
    "bias": "SELECT * FROM (VALUES "
    + values((r, f, b) for r, bs in catalog.FAMILY_BIAS.items() for f, b in bs.items())
    + ") t(regime, family, bias)",
    "rules": "SELECT * FROM (VALUES "
    + values((r, catalog.REGIME_PERIODS[r], m) for r, m in catalog.RISK_MULTIPLIER.items())
    + ") t(regime, base_period, risk_multiplier)",
    "strategies": "SELECT * FROM (VALUES "
    + values((r, s, w) for r, ws in catalog.STRATEGY_WEIGHTS.items() for s, w in ws.items())
    + ") t(regime, strategy, weight)",
    "alloc_raw": """SELECT s.symbol, s.family, s.pos, c.regime_type AS symbol_regime, d.dominant AS dominant_regime,
        d.regimes, coalesce(b.bias, 0.1) * (CASE WHEN c.regime_type = d.dominant THEN 1.5 ELSE 0.5 END) AS w,
        r.risk_multiplier FROM symbols s CROSS JOIN dom_i d LEFT JOIN cur_i c ON c.symbol = s.symbol
        LEFT JOIN bias b ON b.regime = d.dominant AND b.family = s.family LEFT JOIN rules r ON r.regime = d.dominant""",
    "alloc": """SELECT symbol, family, pos, symbol_regime, dominant_regime, w / sum(w) OVER () AS weight, risk_multiplier,
        regimes / count(*) OVER () AS confidence FROM alloc_raw""",
    # risk
    "t_n": "SELECT *, row_number() OVER (ORDER BY ts, id) AS n FROM trades",
    "dd": f"""SELECT n, greatest(0.0, least(1.0, CASE WHEN pnl < 0 THEN -pnl / {CAPITAL} ELSE 0 END))::DOUBLE AS dd FROM t_n WHERE n = 1
      UNION ALL SELECT t.n, CASE WHEN t.pnl < 0 THEN least(1.0, r.dd - t.pnl / {CAPITAL})
        ELSE greatest(0.0, r.dd - t.pnl / {CAPITAL} * 0.1) END FROM dd r JOIN t_n t ON t.n = r.n + 1""",
    "daily": """SELECT *, sum(pnl) OVER (PARTITION BY ts::DATE ORDER BY ts, id) AS daily_pnl FROM t_n""",
    # Positions by the closed form: zeros since the last non-zero trade decide the state.
    "pz": """SELECT *, row_number() OVER w AS n, count(*) FILTER (pnl = 0) OVER (PARTITION BY symbol ORDER BY ts, id) AS zeros,
        max(CASE WHEN pnl <> 0 THEN id END) OVER (PARTITION BY symbol ORDER BY ts, id) AS last_id FROM trades
        WINDOW w AS (PARTITION BY symbol ORDER BY ts, id)""",
    "pk": """SELECT *, zeros - coalesce(max(CASE WHEN pnl <> 0 THEN zeros END) OVER (PARTITION BY symbol ORDER BY n), 0) AS k
        FROM pz""",
    "ps": """SELECT *, CASE WHEN pnl <> 0 THEN TRUE WHEN last_id IS NULL THEN k % 2 = 1 ELSE k % 2 = 0 END AS is_open FROM pk""",
    "pe": """SELECT *, sum((is_open AND NOT was_open)::INT) OVER (PARTITION BY symbol ORDER BY n) AS epoch FROM
        (SELECT *, coalesce(lag(is_open) OVER (PARTITION BY symbol ORDER BY n), FALSE) AS was_open FROM ps)""",
    "book": """SELECT account, symbol, id, n, is_open,
        CASE WHEN is_open THEN sum(CASE WHEN is_open THEN pnl ELSE 0 END) OVER (PARTITION BY symbol, epoch ORDER BY n) END AS position_pnl,
        CASE WHEN is_open THEN min(ts) OVER (PARTITION BY symbol, epoch ORDER BY n) END AS opened FROM pe""",
    "open_u": """SELECT account, symbol, position_pnl, opened FROM book
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC) = 1 AND is_open""",
    # Several accounts, with emergency closes.
    "at_n": """SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, id) AS n FROM (SELECT
        CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'a' || (event_id % 8) END AS account, event_type AS symbol, ts, event_id AS id,
        CASE WHEN event_id % 17 = 0 THEN 0.0 WHEN event_id % 11 = 0 THEN -abs(value - 50) ELSE abs(value - 50) END AS pnl FROM events)""",
    "adr": f"""SELECT account, n, least(1.0, CASE WHEN pnl < 0 THEN -pnl / {ACCOUNT_CAPITAL} ELSE 0 END)::DOUBLE AS dd FROM at_n WHERE n = 1
      UNION ALL SELECT t.account, t.n, CASE WHEN t.pnl < 0 THEN least(1.0, r.dd - t.pnl / {ACCOUNT_CAPITAL})
        ELSE greatest(0.0, r.dd - t.pnl / {ACCOUNT_CAPITAL} * 0.1) END FROM adr r JOIN at_n t ON t.account = r.account AND t.n = r.n + 1""",
    "ahit": """SELECT t.*, dd, dd > 0.145 AS hit, coalesce(sum((dd > 0.145)::INT) OVER (PARTITION BY t.account ORDER BY t.n
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS emergencies,
        sum(pnl) OVER (PARTITION BY t.account, ts::DATE ORDER BY t.n) AS day_pnl FROM at_n t JOIN adr USING (account, n)""",
    "aseg": """SELECT *, count(*) FILTER (pnl = 0) OVER w AS zeros, max(CASE WHEN pnl <> 0 THEN n END) OVER w AS last_n FROM ahit
        WINDOW w AS (PARTITION BY account, symbol, emergencies ORDER BY n)""",
    "aturn": """SELECT *, zeros - coalesce(max(CASE WHEN pnl <> 0 THEN zeros END) OVER (PARTITION BY account, symbol, emergencies ORDER BY n), 0) AS k
        FROM aseg""",
    "aopen": """SELECT *, NOT hit AND CASE WHEN pnl <> 0 THEN TRUE WHEN last_n IS NULL THEN k % 2 = 1 ELSE k % 2 = 0 END AS is_open FROM aturn""",
    "astart": """SELECT *, sum((is_open AND NOT was_open)::INT) OVER (PARTITION BY account, symbol, emergencies ORDER BY n) AS epoch FROM
        (SELECT *, coalesce(lag(is_open) OVER (PARTITION BY account, symbol, emergencies ORDER BY n), FALSE) AS was_open FROM aopen)""",
    "abook": """SELECT *, CASE WHEN is_open THEN sum(CASE WHEN is_open THEN pnl ELSE 0 END) OVER v END AS position_pnl,
        CASE WHEN is_open THEN min(ts) OVER v END AS opened FROM astart WINDOW v AS (PARTITION BY account, symbol, emergencies, epoch ORDER BY n)""",
    "ahold": """SELECT account, count(*) AS active FROM (SELECT b.*, max(emergencies + hit::INT) OVER (PARTITION BY account) AS closes FROM abook b
        QUALIFY row_number() OVER (PARTITION BY account, symbol ORDER BY n DESC) = 1) WHERE is_open AND closes = emergencies GROUP BY 1""",
    "arow": "SELECT *, count(*) OVER (PARTITION BY account) - n AS back FROM ahit",
    "avar": f"""SELECT account, CASE WHEN count(*) >= 30 THEN quantile_cont(pnl / {ACCOUNT_CAPITAL}, 0.05) ELSE 0 END AS var_95 FROM arow
        WHERE back < 100 GROUP BY 1""",
    "ashort": f"""SELECT account, avg(pnl / {ACCOUNT_CAPITAL}) AS expected_shortfall FROM arow JOIN avar USING (account)
        WHERE back < 100 AND pnl / {ACCOUNT_CAPITAL} <= var_95 GROUP BY 1""",
    "last100": "SELECT * FROM t_n ORDER BY n DESC LIMIT 100",
    "var_a": f"""SELECT CASE WHEN count(*) >= 30 THEN quantile_cont(pnl / {CAPITAL}, 0.05) ELSE 0 END AS var_95 FROM last100""",
    "es_a": f"""SELECT avg(pnl / {CAPITAL}) AS expected_shortfall FROM last100, var_a WHERE pnl / {CAPITAL} <= var_95""",
    "ret_u": """SELECT symbol, time, close / pc - 1 AS ret FROM (SELECT symbol, time, close,
        lag(close) OVER (PARTITION BY symbol ORDER BY time) AS pc FROM bars_u) WHERE pc <> 0""",
    "ret_h": """SELECT symbol, time, close / pc - 1 AS ret FROM (SELECT symbol, time, close,
        lag(close) OVER (PARTITION BY symbol ORDER BY time) AS pc FROM bars_h) WHERE pc <> 0""",
    "pairs_u": """SELECT a.symbol AS candidate, b.symbol AS open_symbol, count(*) AS common_bars,
        CASE WHEN count(*) > 1 AND stddev_pop(a.ret) > 0 AND stddev_pop(b.ret) > 0 THEN corr(a.ret, b.ret) END AS correlation
        FROM ret_u a JOIN ret_u b ON a.time = b.time AND a.symbol <> b.symbol
        WHERE b.symbol IN (SELECT symbol FROM open_u) GROUP BY 1, 2""",
    "req": """SELECT symbol, time, high - low AS atr, close AS price, regime_confidence AS confidence,
        least(trend_strength / 10, 1.0) AS drawdown, (close - open) * 10 AS daily_pnl FROM reg_u""",
    "sized": f"""SELECT *, atr > 0 AND price > 0 AS ok, {CAPITAL} * 0.02 / nullif(atr * 1.5, 0) AS base,
        CASE WHEN drawdown <= 0.02 THEN 1 WHEN drawdown <= 0.05 THEN 0.75 WHEN drawdown <= 0.1 THEN 0.5 ELSE 0.25 END AS factor,
        {CAPITAL} * 0.1 / nullif(price, 0) AS largest FROM req""",
    "final_s": """SELECT *, CASE WHEN ok THEN greatest(0.01, least(base * confidence * factor, largest)) ELSE 0 END AS final_size
        FROM sized""",
    "breaker": f"""SELECT *, CASE WHEN drawdown > 0.145 OR daily_pnl < -{CAPITAL} * 0.05 THEN 0 WHEN drawdown > 0.1 THEN 0.375
        WHEN drawdown > 0.05 THEN 0.75 ELSE 1 END AS b,
        CASE WHEN drawdown > 0.145 OR daily_pnl < -{CAPITAL} * 0.05 THEN 0 WHEN drawdown > 0.1 THEN 0.5
        WHEN drawdown > 0.05 THEN 0.75 ELSE 1 END AS b1 FROM final_s""",
    "perf": """SELECT *, sum(pnl) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts, id) AS cum FROM trades""",
    "perf2": """SELECT *, greatest(0, max(cum) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts, id)) AS peak FROM perf""",
    # walk-forward over folds of the hourly bars
    **{
        name: sql
        for tag, window, step in (("w", 252, 63), ("v", 126, 90), ("f", 0, 0))
        for name, sql in {
            f"fold_{tag}": "SELECT * FROM flat" if tag == "f" else f"""SELECT symbol || '|' || ((i - {window}) // {step}) AS symbol, time, open, high, low, close, volume
                FROM (SELECT *, max(i) OVER (PARTITION BY symbol) + 1 AS total FROM step_h)
                WHERE i >= {window} AND ((i - {window}) // {step}) * {step} < total - {window}""",
            f"step_{tag}": indicator_steps(f"fold_{tag}"),
            f"input_{tag}": indicator_inputs(f"step_{tag}"),
            f"seed_{tag}": indicator_seeds(f"input_{tag}"),
            f"rec_{tag}": recursion(f"seed_{tag}", f"rec_{tag}"),
            f"index_{tag}": index_rows(f"rec_{tag}"),
            f"iseed_{tag}": index_seeds(f"index_{tag}"),
            f"rec2_{tag}": second_recursion(f"iseed_{tag}", f"rec2_{tag}"),
            f"rows_{tag}": f"SELECT symbol, list(close ORDER BY i) AS closes FROM step_{tag} GROUP BY symbol",
        }.items()
    },
}


def _derived_fold(tag: str) -> dict[str, str]:
    """Stochastic, adaptive Hull average and signals of the fold series, as for the hourly bars."""

    def swap(text: str) -> str:
        for name in (*names, *given):
            text = re.sub(rf"\b{name}\b", name.removesuffix("_h") + f"_{tag}", text)
        return text

    given = ["step_h", "rec_h", "rows_h", "index_h", "rec2_h"]
    names = ["fast_k", "slow_k", "stoch_h", "period_h", "hull_raw", "hull_h", "ind_h"]
    if tag == "f":  # the tick bars go on to regimes and signals
        names = [*names[:3], "ind_h", "tech_h", "techreg_h", "flag_h", "nnfx_h"]
        plain = CTES["ind_h"].replace(", p.period, h.hma", "").replace(" JOIN period_h p USING (symbol, i) LEFT JOIN hull_h h USING (symbol, i)", "")
        bodies = {**{n: CTES[n] for n in names}, "ind_h": plain, "tech_h": CTES["tech_h"].replace("reg_h", "flat_reg")}
        return {swap(n): swap(bodies[n]) for n in names}
    out = {swap(n): swap(CTES[n]) for n in names}
    out[f"score_{tag}"] = f"""SELECT symbol, i, CASE WHEN i < 49 THEN 0 WHEN adx > 25 AND close > hma AND rsi < 70 THEN 1
        WHEN adx > 25 AND close < hma AND rsi > 30 THEN -1 ELSE 0 END AS signal, adx, macd, macd_signal, stoch_k
        FROM ind_{tag}"""
    out[f"win_{tag}"] = f"""SELECT symbol, i, signal, CASE WHEN signal = 0 THEN 0 ELSE 0.6 * least(0.9, adx / 50)
        + 0.2 * (CASE WHEN (signal = 1 AND macd > macd_signal) OR (signal = -1 AND macd < macd_signal) THEN 1 ELSE 0.5 END)
        + 0.2 * (CASE WHEN (signal = 1 AND stoch_k < 20) OR (signal = -1 AND stoch_k > 80) THEN 1 ELSE 0.5 END) END AS confidence
        FROM score_{tag}"""
    out[f"fold_rate_{tag}"] = f"""SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2)::BIGINT AS fold,
        count(*) FILTER (i >= 20 AND signal <> 0) AS trades,
        count(*) FILTER (i >= 20 AND signal <> 0 AND confidence > 0.7) AS wins
        FROM win_{tag} GROUP BY 1, 2 HAVING count(*) >= 20"""
    return out


for _tag in ("w", "v", "f"):
    CTES.update(_derived_fold(_tag))
_FEATURES = ["volatility", "trend_strength", "volume_profile"]
CTES.update(model_sql.mixture("vc", ["volatility", "volume_profile"], 3, CLUSTER_STEPS))
CTES.update(model_sql.mixture("gm", _FEATURES, 5, MIXTURE_STEPS))
CTES.update(model_sql.markov("hm", _FEATURES, 5, STAY))


def _needs(text: str) -> list[str]:
    seen: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\b[a-z]\w*\b", body):
            if name in CTES and name not in seen and name not in active:
                active.append(name)
                visit(CTES[name])
                active.remove(name)
                seen.append(name)

    active: list[str] = []
    visit(text)
    return seen


def sql(body: str) -> str:
    needed = _needs(body)
    if not needed:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" if not _recursive(n) else f"{n} AS ({CTES[n]})" for n in needed)
    return f"WITH RECURSIVE {parts}\n{body}"


def _recursive(name: str) -> bool:
    return name in re.findall(r"\b[a-z]\w*\b", CTES[name])


def rnd(digits: int, *names: str) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


OHLC = rnd(6, "open", "high", "low", "close")
BAR = f"symbol, time, {OHLC}, volume"
BASIC = rnd(6, "volatility", "trend_strength", "volume_profile", "price_momentum", "mean_reversion", "regime_confidence")
FLAT = "round(value, 6) AS open, round(value, 6) AS high, round(value, 6) AS low, round(value, 6) AS close"
EVENT = "symbol, timestamp, regime_type, round(confidence, 6) AS confidence"


def timeframe_rows() -> str:
    parts = []
    starts = {
        "M5": "time_bucket(INTERVAL '5 minutes', ts)",
        "M15": "time_bucket(INTERVAL '15 minutes', ts)",
        "H1": "date_trunc('hour', ts)",
        "H4": "time_bucket(INTERVAL '4 hours', ts)",
        "D1": "date_trunc('day', ts)",
        "W1": "date_trunc('week', ts)",
        "MN1": "date_trunc('month', ts)",
    }
    for name, start in starts.items():
        parts.append(
            f"""SELECT '{name}' AS timeframe, event_type AS symbol, ({start})::TIMESTAMP AS time,
            round(arg_min(value, ts), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low,
            round(arg_max(value, ts), 6) AS close, 1000 * count(*) AS volume FROM events GROUP BY 2, 3"""
        )
    return " UNION ALL ".join(parts)


def key_rows(source: str, always: list[str], groups: list[tuple[str, list[str], list[str]]]) -> str:
    parts = [
        f"SELECT symbol, time, '{n}' AS feature, round({n}, 4) AS value, CAST(NULL AS VARCHAR) AS text FROM {source}"
        for n in always
    ]
    parts.append(f"SELECT symbol, time, 'regime', NULL, regime_type FROM {source}")
    for condition, numbers, texts in groups:
        parts += [f"SELECT symbol, time, '{n}', round({e}, 4), NULL FROM {source} WHERE {condition}" for n, e in numbers]
        parts += [f"SELECT symbol, time, '{n}', NULL, {n} FROM {source} WHERE {condition}" for n in texts]
    return " UNION ALL ".join(parts)


ALWAYS = ["volatility", "trend_strength", "volume_profile", "price_momentum", "mean_reversion", "regime_confidence"]
TECH = ["adx", "atr", "rsi", "kama", "stoch_k", "stoch_d"]


def symbol_type_case(column: str) -> str:
    arms = []
    for kind, patterns in catalog.SYMBOL_TYPES.items():
        arms.append(f"WHEN {' OR '.join(f'contains({column}, {chr(39)}{p}{chr(39)})' for p in patterns)} THEN '{kind}'")
    return f"CASE {' '.join(arms)} ELSE 'unknown' END"


_BODIES: dict[str, str] = {
    "bar_history": f"SELECT {BAR} FROM bars_h WHERE time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '{AS_OF}'",
    "lookback_bars": f"SELECT {BAR} FROM bars_h WHERE time >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY",
    "bar_records": """SELECT event_type AS symbol, date_trunc('second', ts)::TIMESTAMP AS time, round(value, 6) AS open,
        round(value + 1, 6) AS high, round(value - 1, 6) AS low, round(value, 6) AS close, 1000 AS volume FROM events""",
    "tick_bars": f"SELECT event_type AS symbol, ts AS time, {FLAT}, 1000 AS volume FROM events",
    "tick_spread": """SELECT time, symbol, round(bid, 6) AS bid, round(ask, 6) AS ask, 0 AS volume,
        round(ask - bid, 6) AS spread FROM ticks""",
    "bar_validation": """SELECT symbol, time, round(open - 2, 6) AS open, round(open, 6) AS high, round(close, 6) AS low,
        round(close, 6) AS close, volume, CASE WHEN open < close THEN 'high below low'
        WHEN open - 2 <= 0 OR close <= 0 THEN 'price not positive' END AS reject_reason FROM bars_u""",
    "bar_normalize": """SELECT event_type AS symbol, date_trunc('second', ts)::TIMESTAMP AS time, round(value, 6) AS close,
        trunc(value)::BIGINT AS volume FROM events""",
    "bar_derived": f"""SELECT {BAR}, round(high - low, 6) AS price_range, round(close - open, 6) AS price_change,
        round((close - open) / nullif(open, 0) * 100, 6) AS price_change_pct FROM bars_u""",
    "bars_daily": """SELECT symbol, date_trunc('day', time)::TIMESTAMP AS time, round(arg_min(open, time), 6) AS open,
        round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, time), 6) AS close,
        sum(volume)::BIGINT AS volume FROM bars_h GROUP BY 1, 2""",
    "bars_all_timeframes": timeframe_rows(),
    "bars_from_ticks": """SELECT symbol, date_trunc('hour', time)::TIMESTAMP AS time, round(arg_min(bid, time), 6) AS open,
        round(max(bid), 6) AS high, round(min(bid), 6) AS low, round(arg_max(bid, time), 6) AS close, 0 AS volume,
        round(avg(ask - bid), 6) AS mean_spread FROM ticks GROUP BY 1, 2""",
    "bar_upsert": """SELECT symbol, time, round(CASE WHEN n.open IS NOT NULL THEN n.open ELSE b.open END, 6) AS open,
        round(CASE WHEN n.open IS NOT NULL THEN n.high ELSE b.high END, 6) AS high,
        round(CASE WHEN n.open IS NOT NULL THEN n.low ELSE b.low END, 6) AS low,
        round(CASE WHEN n.open IS NOT NULL THEN n.close ELSE b.close END, 6) AS close,
        CASE WHEN n.open IS NOT NULL THEN n.volume ELSE b.volume END AS volume
        FROM bars_h b FULL JOIN incoming_last n USING (symbol, time)""",
    "bar_last_write": f"SELECT {BAR} FROM incoming_last",
    "bar_retention": f"SELECT {BAR} FROM bars_p WHERE time >= TIMESTAMP '1998-08-02' - INTERVAL 3 YEAR",
    "table_summary": """SELECT symbol, count(*) AS record_count, min(time) AS earliest, max(time) AS latest
        FROM bars_h GROUP BY symbol""",
    "basic_features": f"SELECT symbol, time, {BASIC} FROM reg_u",
    "basic_regimes": f"SELECT {EVENT}, regime_model FROM ev_u",
    "daily_regime_stats": """SELECT symbol, regime_type, date_trunc('day', timestamp)::TIMESTAMP AS bucket, count(*) AS count,
        round(avg(confidence), 6) AS avg_confidence, round(min(confidence), 6) AS min_confidence,
        round(max(confidence), 6) AS max_confidence FROM ev_h GROUP BY 1, 2, 3""",
    "newest_regimes": f"""SELECT {EVENT}, regime_model, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rank
        FROM ev_u QUALIFY rank <= 20""",
    "current_regimes": f"SELECT {EVENT} FROM cur_u",
    "regime_lookup": """SELECT c_custkey::VARCHAR AS symbol, regime_type, round(confidence, 6) AS confidence, timestamp
        FROM customer LEFT JOIN cur_u ON symbol = c_custkey::VARCHAR""",
    "regime_transitions": """SELECT symbol, lag(regime_type) OVER w AS previous_regime, regime_type AS current_regime,
        timestamp, round(epoch_us(timestamp) / 1e6 - epoch_us(lag(timestamp) OVER w) / 1e6, 6) AS seconds_since_change
        FROM ev_u WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)""",
    "regime_periods": f"""SELECT {EVENT}, regime_model, coalesce(lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp),
        TIMESTAMP '{AS_OF}') AS end_time FROM ev_h""",
    "regime_occupancy": f"""SELECT symbol, regime_type, count(*) AS occurrence_count, round(avg(confidence), 6) AS avg_confidence,
        round(sum((epoch_us(e) - epoch_us(timestamp)) / 1e6), 6) AS total_seconds FROM (SELECT *,
        coalesce(lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp), TIMESTAMP '{AS_OF}') AS e FROM ev_u
        WHERE timestamp BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '{AS_OF}') GROUP BY 1, 2""",
    "regime_statistics": f"""SELECT *, sum(count) OVER (PARTITION BY symbol)::BIGINT AS total_events,
        round(count / sum(count) OVER (PARTITION BY symbol) * 100, 6) AS percentage,
        first(regime_type) OVER (PARTITION BY symbol ORDER BY count DESC, regime_type) AS most_common_regime FROM (
        SELECT symbol, regime_type, count(*) AS count, round(avg(confidence), 6) AS avg_confidence,
        min(timestamp) AS first_occurrence, max(timestamp) AS last_occurrence FROM ev_u
        WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1, 2)""",
    "regime_history": f"""SELECT {EVENT} FROM ev_h WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY""",
    "regime_event_filter": f"""SELECT {EVENT}, regime_model FROM ev_u WHERE regime_type = 'trending_high_vol'
        AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY timestamp, symbol LIMIT 1000""",
    "regime_event_filter_all": f"""SELECT {EVENT}, regime_model FROM ev_u WHERE regime_type = 'trending_high_vol'
        AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'""",
    "history_summary": """SELECT symbol, count(*) AS total_periods, round(avg(confidence), 6) AS avg_confidence,
        arg_min(regime_type, rank) AS current_regime, round(CASE WHEN count(*) <= 1 THEN 1 ELSE
        1 - sum(changed) / (count(*) - 1) END, 6) AS regime_stability, 'basic' AS primary_model FROM
        (SELECT *, (regime_type <> lag(regime_type) OVER (PARTITION BY symbol ORDER BY rank))::INT AS changed FROM hist_h)
        GROUP BY symbol""",
    "history_summary_1000": """SELECT symbol, count(*) AS total_periods, round(avg(confidence), 6) AS avg_confidence,
        arg_min(regime_type, rank) AS current_regime, round(CASE WHEN count(*) <= 1 THEN 1 ELSE
        1 - sum(changed) / (count(*) - 1) END, 6) AS regime_stability, 'basic' AS primary_model FROM
        (SELECT *, (regime_type <> lag(regime_type) OVER (PARTITION BY symbol ORDER BY rank))::INT AS changed FROM hist_h1000)
        GROUP BY symbol""",
    "history_distribution": """SELECT symbol, dimension, value, count, round(count / sum(count) OVER (PARTITION BY symbol, dimension), 6) AS share
        FROM (SELECT symbol, 'regime' AS dimension, regime_type AS value, count(*) AS count FROM hist_h GROUP BY 1, 3
        UNION ALL SELECT symbol, 'model', regime_model, count(*) FROM hist_h GROUP BY symbol, regime_model)""",
    "history_signals": """SELECT symbol, dimension, value, count, round(count / sum(count) OVER (PARTITION BY symbol, dimension), 6) AS share
        FROM (WITH h AS (SELECT * FROM nnfx_h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 100)
        SELECT symbol, 'regime' AS dimension, regime_type AS value, count(*) AS count FROM h GROUP BY 1, 3
        UNION ALL SELECT symbol, 'model', 'comprehensive', count(*) FROM h GROUP BY symbol
        UNION ALL SELECT symbol, 'signal', nnfx_signal, count(*) FROM h WHERE nnfx_signal IS NOT NULL GROUP BY symbol, nnfx_signal)""",
    "tick_trades": """SELECT symbol, time, round(bid, 4) AS bid, CASE WHEN has_history THEN last_regime END AS last_regime,
        CASE WHEN NOT coalesce(has_features, FALSE) THEN 'NO_FEATURES' WHEN NOT coalesce(has_history, FALSE) THEN 'NO_REGIME_HISTORY' END AS error,
        CASE WHEN has_features AND has_history THEN CASE WHEN signal <> 0 AND confidence >= 0.6 THEN signal ELSE 0 END END AS type,
        CASE WHEN has_features AND has_history AND signal <> 0 AND confidence >= 0.6 THEN round(size, 4) ELSE 0 END AS volume,
        CASE WHEN has_features AND has_history AND signal <> 0 AND confidence >= 0.6 THEN round(atr * 1.5, 4) ELSE 0 END AS sl,
        CASE WHEN has_features AND has_history AND signal <> 0 AND confidence >= 0.6 THEN round(atr * 3.0, 4) ELSE 0 END AS tp FROM asked""",
    "top_regimes": """SELECT symbol, regime_type, round(n / sum(n) OVER (PARTITION BY symbol), 6) AS share,
        row_number() OVER (PARTITION BY symbol ORDER BY n DESC, regime_type) AS rank FROM
        (SELECT symbol, regime_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k
        FROM ev_u) WHERE k <= 100 GROUP BY 1, 2) QUALIFY rank <= 3""",
    "regime_stability": """SELECT symbol, count(*) AS periods, round(CASE WHEN count(*) <= 1 THEN 1 ELSE
        1 - sum(c) / (count(*) - 1) END, 6) AS regime_stability FROM (SELECT symbol, (regime_type <>
        lag(regime_type) OVER (PARTITION BY symbol ORDER BY timestamp))::INT AS c FROM ev_u) GROUP BY symbol""",
    "regime_ranking": """SELECT regime_type, count(*) AS count, round(avg(confidence), 6) AS avg_confidence FROM ev_u
        GROUP BY 1 ORDER BY 2 DESC, 1""",
    "stability_labels": """SELECT symbol, n AS periods, round(s, 6) AS regime_stability,
        CASE WHEN s < 0.6 THEN 'unstable' ELSE 'stable' END AS stability_label, s < 0.5 AS volatility_alert FROM
        (SELECT symbol, count(*) AS n, CASE WHEN count(*) <= 1 THEN 1 ELSE 1 - sum(c) / (count(*) - 1) END AS s FROM
        (SELECT symbol, (regime_type <> lag(regime_type) OVER (PARTITION BY symbol ORDER BY timestamp))::INT AS c FROM ev_u)
        GROUP BY symbol)""",
    "regime_change_alert": """SELECT symbol, round(r, 6) AS distinct_ratio, r > 0.6 AS alert FROM (SELECT symbol,
        CASE WHEN count(*) >= 5 THEN count(DISTINCT regime_type) / 5 END AS r FROM (SELECT *,
        row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k FROM ev_u) WHERE k <= 5 GROUP BY symbol)""",
    "cluster_labels": """SELECT symbol, time, round(volatility, 6) AS volatility, round(volume_profile, 6) AS volume_profile,
        CASE WHEN volatility > 0.06 AND volume_profile > 5 THEN 'high_vol_high_volume' WHEN volatility > 0.06 THEN 'high_vol_low_volume'
        WHEN volatility <= 0.03 AND volume_profile > 5 THEN 'low_vol_high_volume' ELSE 'low_vol_low_volume' END AS label FROM reg_u""",
    "atr": f"SELECT symbol, time, round(atr14 + 1e-9, 4) AS atr14, round(atr20 + 1e-9, 4) AS atr20 FROM ind_h",
    "rsi": f"SELECT symbol, time, {rnd(4, 'rsi')} FROM ind_h",
    "adx": f"SELECT symbol, time, {rnd(4, 'adx')} FROM ind_h",
    "kama": f"SELECT symbol, time, {rnd(4, 'kama')} FROM ind_h",
    "macd": f"SELECT symbol, time, {rnd(4, 'macd', 'macd_signal')} FROM ind_h",
    "indicators_weekly": """SELECT s.symbol, s.time, round(r.atr14, 4) AS atr14, round(CASE WHEN s.i >= 14 THEN CASE WHEN r.g + r.l = 0 THEN 0
        ELSE 100 * r.g / (r.g + r.l) END END, 4) AS rsi, round(z.adx, 4) AS adx, round(r.kama, 4) AS kama,
        round(z.sig, 4) AS macd_signal FROM step_p s JOIN rec_p r USING (symbol, i) JOIN rec2_p z USING (symbol, i)""",
    "stochastic": f"SELECT symbol, time, {rnd(4, 'stoch_k', 'stoch_d')} FROM stoch_h JOIN step_h USING (symbol, i)",
    "weighted_average": """SELECT s.symbol, s.time, round(CASE WHEN s.i >= 9 THEN (SELECT sum(j.j * x.closes[s.i + 1 - 10 + j.j])
        FROM range(1, 11) j(j)) / 55.0 END, 4) AS wma FROM step_h s JOIN rows_h x USING (symbol)""",
    "hull_average": """SELECT s.symbol, s.time, round(CASE WHEN s.i >= 22 THEN (SELECT sum((4 - k.k) * (
          2 * (SELECT sum(j.j * x.closes[s.i + 1 - k.k - 10 + j.j]) FROM range(1, 11) j(j)) / 55.0
          - (SELECT sum(j.j * x.closes[s.i + 1 - k.k - 20 + j.j]) FROM range(1, 21) j(j)) / 210.0))
        FROM range(0, 4) k(k)) / 10.0 END, 4) AS hma FROM step_h s JOIN rows_h x USING (symbol)""",
    "adaptive_hull": f"SELECT symbol, time, period, {rnd(4, 'hma')} FROM ind_h",
    "strategy_indicators": "SELECT symbol, time, "
    + ", ".join(
        f"round(CASE WHEN i >= 49 THEN {e} END, 4) AS {n}"
        for n, e in [
            ("hma", "hma"), ("adx", "adx"), ("atr", "atr14"),
            ("atr_pct", "CASE WHEN close > 0 THEN atr14 / close ELSE 0 END"), ("rsi", "rsi"),
            ("stoch_k", "stoch_k"), ("stoch_d", "stoch_d"), ("macd", "macd"), ("macd_signal", "macd_signal"),
        ]
    )
    + " FROM ind_h",
    "technical_features": f"SELECT symbol, time, {rnd(4, *TECH)} FROM tech_h",
    "technical_regimes": """SELECT symbol, time, regime_type, round(enhanced, 4) AS regime_confidence_enhanced FROM techreg_h""",
    "feature_signals": f"""SELECT symbol, time, nnfx_signal, {rnd(4, 'signal_confidence')}, baseline_signal,
        {rnd(4, 'confirmation_strength')} FROM nnfx_h""",
    "regime_models": """SELECT regime_model, symbol, regime_type, nnfx_signal, count(*) AS n,
        round(avg(signal_confidence), 4) AS avg_signal_confidence FROM (
        SELECT 'basic' AS regime_model, symbol, regime_type, 'HOLD' AS nnfx_signal, 0 AS signal_confidence FROM reg_h
        UNION ALL SELECT 'technical', symbol, regime_type, 'HOLD', 0 FROM techreg_h
        UNION ALL SELECT 'nnfx', symbol, regime_type, nnfx_signal, signal_confidence FROM nnfx_h
        UNION ALL SELECT 'comprehensive', symbol, regime_type, nnfx_signal, signal_confidence FROM nnfx_h) GROUP BY 1, 2, 3, 4""",
    "strategy_signals": f"SELECT symbol, time, regime, signal, {rnd(4, 'confidence')} FROM sig_h",
    "strategy_sizes": f"""SELECT symbol, time, round(CASE WHEN ok THEN raw_size ELSE 0 END, 4) AS position_size,
        round(CASE WHEN ok THEN {CAPITAL} * 0.02 END, 4) AS risk_amount, round(CASE WHEN ok THEN atr * 1.5 END, 4) AS stop_loss_pips,
        CASE WHEN ok THEN 2.0 END AS risk_reward_ratio, round(CASE WHEN ok THEN raw_size * atr * 100 END, 4) AS max_position_value
        FROM size_h""",
    "trade_levels": f"SELECT symbol, time, error, type, {rnd(4, 'volume', 'sl', 'tp')} FROM trade_h",
    "order_levels": """SELECT w.symbol, w.time, w.type, round(e, 4) AS entry, round(e - w.type * w.sl * 0.01, 4) AS sl_level,
        round(e + w.type * w.tp * 0.01, 4) AS tp_level FROM (SELECT t.*, CASE WHEN k.time >= t.time - INTERVAL 1 HOUR THEN
        CASE WHEN t.type = 1 THEN k.ask ELSE k.bid END END AS e FROM (SELECT * FROM trade_h WHERE type <> 0) t
        ASOF LEFT JOIN ticks k ON t.symbol = k.symbol AND t.time >= k.time) w""",
    "walk_forward": """SELECT symbol, fold, trades, wins, round(CASE WHEN trades > 0 THEN wins / trades ELSE 0 END, 4) AS win_rate
        FROM fold_rate_w""",
    "walk_forward_summary": """SELECT symbol, round(avg(CASE WHEN trades > 0 THEN wins / trades ELSE 0 END), 4) AS avg_win_rate,
        count(*) AS total_optimization_periods FROM fold_rate_v GROUP BY symbol""",
    "asof_features": """SELECT t.symbol, t.time, round(t.bid, 6) AS bid, round(t.ask, 6) AS ask,
        CASE WHEN ok THEN f_time END AS asof_time, CASE WHEN ok THEN regime_type END AS regime,
        round(CASE WHEN ok THEN volatility END, 6) AS volatility FROM (SELECT t.*, f.time AS f_time, f.regime_type, f.volatility,
        f.time >= t.time - INTERVAL 300 SECOND AS ok FROM ticks t ASOF LEFT JOIN (SELECT symbol, time + INTERVAL 1 HOUR AS time, regime_type, volatility FROM reg_h) f
        ON t.symbol = f.symbol AND t.time >= f.time) t""",
    "asof_features_day": """SELECT t.symbol, t.time, round(t.bid, 6) AS bid, round(t.ask, 6) AS ask,
        CASE WHEN ok THEN f_time END AS asof_time, CASE WHEN ok THEN regime_type END AS regime,
        round(CASE WHEN ok THEN volatility END, 6) AS volatility FROM (SELECT t.*, f.time AS f_time, f.regime_type, f.volatility,
        f.time >= t.time - INTERVAL 86400 SECOND AS ok FROM ticks t ASOF LEFT JOIN (SELECT symbol, time + INTERVAL 1 HOUR AS time, regime_type, volatility FROM reg_h) f
        ON t.symbol = f.symbol AND t.time >= f.time) t""",
    "asof_features_week": """SELECT t.symbol, t.time, round(t.bid, 6) AS bid, round(t.ask, 6) AS ask,
        CASE WHEN ok THEN f_time END AS asof_time, CASE WHEN ok THEN regime_type END AS regime,
        round(CASE WHEN ok THEN volatility END, 6) AS volatility FROM (SELECT t.*, f.time AS f_time, f.regime_type, f.volatility,
        f.time >= t.time - INTERVAL 604800 SECOND AS ok FROM ticks t ASOF LEFT JOIN (SELECT symbol, time + INTERVAL 1 HOUR AS time, regime_type, volatility FROM reg_h) f
        ON t.symbol = f.symbol AND t.time >= f.time) t""",
    "training_rows": f"""SELECT {BAR}, {rnd(6, 'volatility', 'regime_confidence')}, regime_type FROM reg_u""",
    "correlation": f"SELECT candidate, open_symbol, common_bars, {rnd(4, 'correlation')} FROM pairs_u",
    "correlation_factor": """SELECT candidate, round(m, 4) AS max_correlation, CASE WHEN m > 0 THEN 0.5 ELSE 1.0 END AS correlation_factor
        FROM (SELECT candidate, max(c) AS m FROM (SELECT a.symbol AS candidate, b.symbol AS o, corr(a.ret, b.ret) AS c
        FROM ret_h a JOIN ret_h b ON a.time = b.time AND a.symbol <> b.symbol GROUP BY 1, 2) GROUP BY candidate)""",
    "symbol_profile": f"""SELECT s.symbol, {symbol_type_case('s.symbol')} AS symbol_type, c.regime_type AS current_regime,
        h.total_periods, round(h.avg_confidence, 4) AS avg_confidence, round(h.regime_stability, 4) AS regime_stability,
        CASE WHEN h.symbol IS NOT NULL THEN 'basic' END AS primary_model, n.n IS NOT NULL AS ml_features_available,
        n.n IS NOT NULL AS strategy_features_available, coalesce(n.n, 0) AS training_records, 'basic' AS regime_model
        FROM symbols s LEFT JOIN cur_i c USING (symbol) LEFT JOIN sum_i h USING (symbol)
        LEFT JOIN (SELECT symbol, count(*) AS n FROM bars_i GROUP BY symbol) n USING (symbol)""",
    "dominant_regime": "SELECT dominant, regimes FROM dom_i",
    "tactical_allocation": """SELECT symbol, family, pos, symbol_regime, dominant_regime, round(weight, 6) AS weight,
        round(risk_multiplier, 6) AS risk_multiplier, round(confidence, 6) AS confidence FROM alloc""",
    "strategy_weights": """SELECT dominant AS dominant_regime, strategy, weight FROM dom_i JOIN strategies
        ON regime = dominant WHERE weight > 0.1""",
    "top_symbols": """SELECT symbol, family, pos, symbol_regime, dominant_regime, round(weight, 6) AS weight,
        round(risk_multiplier, 6) AS risk_multiplier, round(confidence, 6) AS confidence FROM alloc
        ORDER BY alloc.weight DESC, pos LIMIT 5""",
    "symbol_types": f"""SELECT symbol, count(*) AS bars, {symbol_type_case('symbol')} AS symbol_type FROM bars_i GROUP BY symbol""",
    "risk_labels": """SELECT symbol, regime_type, risk_multiplier, base_period, CASE WHEN risk_multiplier > 0.7 THEN 'HIGH'
        WHEN risk_multiplier > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, CASE WHEN risk_multiplier > 0.8 THEN 'reduce'
        WHEN risk_multiplier < 0.4 THEN 'favorable' ELSE 'keep' END AS risk_advice FROM cur_u JOIN rules ON regime = regime_type""",
    "opportunities": f"SELECT {EVENT} FROM cur_u WHERE contains(regime_type, 'trending')",
    "dashboard_regimes": """SELECT regime_type, n AS count, round(n / (SELECT count(*) FROM symbols) * 100, 6) AS percentage
        FROM counts_i""",
    "dashboard_symbols": """SELECT symbol, coalesce(symbol_regime, 'Unknown') AS regime,
        round(coalesce(regime_stability, 0) * 100, 6) AS stability_pct, round(weight, 6) AS weight
        FROM alloc LEFT JOIN sum_i USING (symbol)""",
    "training_stats": """SELECT CASE WHEN GROUPING(symbol) = 0 THEN 'symbol' WHEN GROUPING(regime_model) = 0 THEN 'model'
        ELSE 'total' END AS dimension, coalesce(symbol, regime_model) AS value, count(*) AS records FROM ev_u
        GROUP BY GROUPING SETS ((symbol), (regime_model), ())""",
    "training_totals": "SELECT count(*) AS total_records, count(DISTINCT symbol) AS total_symbols FROM ev_u",
    "risk_sizes": f"""SELECT symbol, time, {rnd(6, 'atr', 'price', 'confidence', 'drawdown', 'daily_pnl')},
        CASE WHEN ok THEN {CAPITAL} * 0.02 END AS risk_amount, round(CASE WHEN ok THEN atr * 1.5 END, 6) AS stop_loss_distance,
        round(CASE WHEN ok THEN base END, 6) AS base_size, round(CASE WHEN ok THEN base * confidence END, 6) AS confidence_size,
        CASE WHEN ok THEN factor END AS drawdown_factor, round(CASE WHEN ok THEN largest END, 6) AS max_size,
        round(final_size, 6) AS final_size, round(CASE WHEN ok THEN final_size * price END, 6) AS position_value FROM final_s""",
    "circuit_breakers": """SELECT symbol, time, round(drawdown, 6) AS drawdown, round(daily_pnl, 6) AS daily_pnl,
        b AS size, b1 AS size_single FROM breaker""",
    "approve_trades": """SELECT symbol, time, round(final_size, 4) AS final_size, f AS correlation_factor,
        round(final_size * coalesce(f, 1.0) * b, 4) AS approved_size,
        final_size * coalesce(f, 1.0) <> final_size * coalesce(f, 1.0) * b AS circuit_breaker_applied FROM breaker LEFT JOIN
        (SELECT candidate AS symbol, CASE WHEN max(correlation) > 0.7 THEN 0.5 ELSE 1.0 END AS f FROM pairs_u GROUP BY 1) USING (symbol)""",
    "trade_state": """SELECT account, id, round(dd, 8) AS drawdown, round(daily_pnl, 8) AS daily_pnl FROM daily JOIN dd USING (n)""",
    "position_book": "SELECT account, symbol, id, is_open, round(position_pnl, 6) AS position_pnl, opened FROM book",
    "emergency_book": """SELECT account, symbol, id, round(dd, 9) AS drawdown, round(day_pnl, 9) AS daily_pnl, emergencies, hit AS reset, is_open,
        round(position_pnl, 9) AS position_pnl, opened FROM abook""",
    "account_reports": """SELECT account, round(arg_max(dd, n), 9) AS current_drawdown, round(arg_max(day_pnl, n), 9) AS daily_pnl,
        count(*) FILTER (back < 1000) AS total_trades, count(*) FILTER (back < 1000 AND pnl > 0) AS winning_trades,
        count(*) FILTER (back < 1000 AND pnl < 0) AS losing_trades, round(any_value(var_95), 9) AS var_95,
        round(any_value(expected_shortfall), 9) AS expected_shortfall, coalesce(any_value(active), 0) AS active_positions
        FROM arow JOIN avar USING (account) JOIN ashort USING (account) LEFT JOIN ahold USING (account) GROUP BY account""",
    "open_positions": "SELECT account, symbol, round(position_pnl, 8) AS position_pnl, opened FROM open_u",
    "rolling_var": f"""SELECT account, id, round(CASE WHEN n >= 30 THEN quantile_cont(pnl / {CAPITAL}, 0.05) OVER
        (ORDER BY n ROWS 99 PRECEDING) ELSE 0 END, 9) AS var FROM t_n""",
    "value_at_risk": """SELECT 'A' AS account, round(var_95, 6) AS var_95, round(expected_shortfall, 6) AS expected_shortfall
        FROM var_a, es_a""",
    "risk_report": """SELECT 'A' AS account, round((SELECT dd FROM dd ORDER BY n DESC LIMIT 1), 8) AS current_drawdown,
        round((SELECT daily_pnl FROM daily ORDER BY n DESC LIMIT 1), 8) AS daily_pnl, total_trades, winning_trades, losing_trades,
        round(var_95, 8) AS var_95, round(expected_shortfall, 8) AS expected_shortfall,
        (SELECT count(*) FROM open_u) AS active_positions FROM var_a, es_a, (SELECT count(*) AS total_trades,
        count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl < 0) AS losing_trades
        FROM (SELECT * FROM t_n ORDER BY n DESC LIMIT 1000))""",
    "risk_report_all": """SELECT 'A' AS account, round((SELECT dd FROM dd ORDER BY n DESC LIMIT 1), 8) AS current_drawdown,
        round((SELECT daily_pnl FROM daily ORDER BY n DESC LIMIT 1), 8) AS daily_pnl, total_trades, winning_trades, losing_trades,
        round(var_95, 8) AS var_95, round(expected_shortfall, 8) AS expected_shortfall,
        (SELECT count(*) FROM open_u) AS active_positions FROM var_a, es_a, (SELECT count(*) AS total_trades,
        count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl < 0) AS losing_trades
        FROM (SELECT * FROM t_n  ))""",
    "performance_metrics": f"""SELECT account, symbol, ts::DATE AS day, round(sum(pnl) / {CAPITAL}, 6) AS returns,
        round(stddev_samp(pnl / {CAPITAL}), 6) AS volatility, round(max(peak - cum) / {CAPITAL}, 6) AS max_drawdown,
        round(CASE WHEN stddev_samp(pnl / {CAPITAL}) > 0 THEN avg(pnl / {CAPITAL}) / stddev_samp(pnl / {CAPITAL}) END, 6) AS sharpe_ratio
        FROM perf2 GROUP BY 1, 2, 3""",
    "event_versions": """SELECT id, e.aggregate_id, e.version, e.version > 1 AND coalesce(greatest(s.m, e.version - 1) >= e.version, FALSE) AS conflict
        FROM es e LEFT JOIN (SELECT aggregate_id, max(version) AS m FROM es WHERE timestamp < TIMESTAMP '2024-01-16' GROUP BY 1) s
        ON s.aggregate_id = e.aggregate_id""",
    "highest_versions": "SELECT aggregate_id, max(version) AS version FROM es GROUP BY 1",
    "event_filter": """SELECT id, event_type, aggregate_id, data, metadata, timestamp, version FROM es WHERE event_type = 'order_placed'
        AND timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' ORDER BY timestamp, version, id LIMIT 1000""",
    "event_filter_all": """SELECT id, event_type, aggregate_id, data, metadata, timestamp, version FROM es WHERE event_type = 'order_placed'
        AND timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28'""",
    "event_state": """SELECT aggregate_id, signal, "order", last_data, json_extract_string(last_data, '$.k') AS last_regime FROM (
        SELECT aggregate_id, arg_max(data, version) FILTER (event_type = 'signal_generated') AS signal,
        arg_max(data, version) FILTER (event_type = 'order_placed') AS "order",
        arg_max(data, version) FILTER (event_type = 'data_ingested_with_regime') AS last_data FROM es GROUP BY 1)""",
    "event_json": "SELECT id, aggregate_id, json_extract(data, '$.k')::BIGINT AS k FROM es",
    "audit_events": """SELECT 'data_ingested_with_regime' AS event_type, symbol AS aggregate_id, time AS timestamp, 1 AS version,
        regime_type AS regime, round(volatility, 6) AS volatility, 'historical' AS source,
        round(volume_profile, 6) AS volume_profile FROM reg_u""",
    "signal_events": """SELECT 'trade_signal_generated' AS event_type, 'signal_' || symbol || '_' || strftime(time, '%Y%m%d_%H%M%S') AS aggregate_id,
        time AS timestamp, 1 AS version, type, round(sl, 4) AS sl, 'nnfx' AS strategy FROM trade_h WHERE type <> 0""",
    "regime_event_rows": """SELECT symbol, time AS timestamp, regime_type, round(regime_confidence, 6) AS confidence,
        CAST(NULL AS VARCHAR) AS signals, 'basic' AS regime_model, round(mean_reversion, 6) AS mean_reversion FROM reg_u""",
    "key_values": key_rows(
        "nnfx_h",
        ALWAYS,
        [
            ("coalesce(adx, 0) > 0", [*((t, t) for t in TECH), ("regime_confidence_enhanced", "enhanced")], []),
            ("nnfx_signal <> 'HOLD'", [(c, c) for c in ("signal_confidence", "confirmation_strength")], ["nnfx_signal", "baseline_signal"]),
        ],
    ),
    "bulk_key_values": key_rows("reg_u", ALWAYS, [("TRUE", [("signal_confidence", "0.0")], [])]).replace(", 4)", ", 6)")
    + " UNION ALL SELECT symbol, time, 'nnfx_signal', NULL, 'HOLD' FROM reg_u",
    "wide_features": f"""SELECT symbol, time, {BASIC}, CAST(NULL AS DOUBLE) AS adx, regime_type AS regime,
        CAST(NULL AS VARCHAR) AS nnfx_signal FROM reg_u""",
    "feature_keys": "SELECT 'ml:' || symbol || ':' || f AS key, count(*) AS rows, max(time) AS newest FROM reg_u, "
    + "(SELECT unnest([" + ", ".join(f"'{n}'" for n in [*ALWAYS, "regime"]) + "]) AS f) GROUP BY 1",
    "strategy_snapshot": """SELECT symbol, regime_type AS regime, round(regime_confidence, 4) AS confidence, round(volatility, 4) AS volatility,
        round(trend_strength, 4) AS trend, time AS timestamp, 'comprehensive' AS regime_model,
        round(CASE WHEN enhanced > 0 THEN enhanced END, 4) AS confidence_enhanced, round(CASE WHEN enhanced > 0 THEN adx END, 4) AS adx,
        nnfx_signal, round(signal_confidence, 4) AS signal_confidence FROM nnfx_h
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1""",
    "bounded_history": f"""SELECT {EVENT}, regime_model, 'HOLD' AS nnfx_signal, 0.0 AS signal_confidence,
        row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rank FROM ev_u QUALIFY rank <= 10""",
    "bounded_history_100": f"""SELECT {EVENT}, regime_model, 'HOLD' AS nnfx_signal, 0.0 AS signal_confidence,
        row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rank FROM ev_u QUALIFY rank <= 100""",
    "bounded_history_1000": f"""SELECT {EVENT}, regime_model, 'HOLD' AS nnfx_signal, 0.0 AS signal_confidence,
        row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rank FROM ev_u QUALIFY rank <= 1000""",
    "bulk_history": f"""SELECT {EVENT}, regime_model, 'HOLD' AS nnfx_signal, 0.0 AS signal_confidence,
        row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS rank FROM ev_m QUALIFY rank <= 100""",
    "recent_packages": f"""SELECT symbol, time AS timestamp, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS rank,
        regime_type AS regime, round(volatility, 6) AS volatility, round(close, 6) AS close FROM reg_m
        WHERE symbol IN (SELECT symbol FROM reg_m GROUP BY 1 HAVING max(time) > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) QUALIFY rank <= 1000""",
    "training_export": f"""SELECT time AS timestamp, symbol, regime_type AS regime, 'comprehensive' AS regime_model, {rnd(4, *ALWAYS)},
        {', '.join(f'round(coalesce({t}, 0), 4) AS {t}' for t in TECH)}, nnfx_signal, {rnd(4, 'signal_confidence')}, baseline_signal,
        {rnd(4, 'confirmation_strength')}, time AS ohlcv_time, symbol AS ohlcv_symbol, round(open, 4) AS ohlcv_open,
        round(high, 4) AS ohlcv_high, round(low, 4) AS ohlcv_low, round(close, 4) AS ohlcv_close, volume AS ohlcv_volume
        FROM nnfx_h WHERE time >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""",
    "feature_matrix": f"""SELECT symbol, time, {rnd(6, 'volatility', 'trend_strength', 'volume_profile')} FROM reg_h
        WHERE symbol IN (SELECT symbol FROM reg_h GROUP BY 1 HAVING count(*) >= 50)""",
    "sql_regime_history": f"""SELECT symbol, timestamp, regime_type, round(confidence, 6) AS confidence FROM ev_h
        WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY""",
    "sql_regime_stats": f"""SELECT symbol, regime_type, count(*) AS occurrence_count, round(avg(confidence), 6) AS avg_confidence,
        round(sum((epoch_us(e) - epoch_us(timestamp)) / 1e6), 6) AS total_seconds FROM (SELECT *,
        coalesce(lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp), TIMESTAMP '{AS_OF}') AS e FROM ev_h
        ) GROUP BY 1, 2""",
    "stored_bars": """SELECT symbol, time, round(CASE WHEN n.open IS NOT NULL THEN n.open ELSE b.open END, 6) AS open,
        round(CASE WHEN n.open IS NOT NULL THEN n.high ELSE b.high END, 6) AS high,
        round(CASE WHEN n.open IS NOT NULL THEN n.low ELSE b.low END, 6) AS low,
        round(CASE WHEN n.open IS NOT NULL THEN n.close ELSE b.close END, 6) AS close,
        CASE WHEN n.open IS NOT NULL THEN n.volume ELSE b.volume END AS volume
        FROM bars_h b FULL JOIN incoming_last n USING (symbol, time)""",
    "stored_events": """SELECT id, event_type, aggregate_id, data, metadata, timestamp, version FROM es
        WHERE timestamp < TIMESTAMP '2024-01-16' UNION ALL SELECT e.id, event_type, e.aggregate_id, data, metadata, timestamp, e.version
        FROM es e LEFT JOIN (SELECT aggregate_id, max(version) AS m FROM es WHERE timestamp < TIMESTAMP '2024-01-16' GROUP BY 1) s
        ON s.aggregate_id = e.aggregate_id WHERE NOT (e.version > 1 AND coalesce(s.m >= e.version, FALSE))""",
    "refreshed_daily_bars": """SELECT symbol, date_trunc('day', time)::TIMESTAMP AS time, round(arg_min(open, time), 6) AS open,
        round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, time), 6) AS close,
        sum(volume)::BIGINT AS volume FROM bars_h WHERE time >= TIMESTAMP '2023-12-26' AND time < TIMESTAMP '2024-01-25' GROUP BY 1, 2""",
    "refreshed_regime_stats": """SELECT symbol, regime_type, date_trunc('day', timestamp)::TIMESTAMP AS bucket, count(*) AS count,
        round(avg(confidence), 6) AS avg_confidence, round(min(confidence), 6) AS min_confidence,
        round(max(confidence), 6) AS max_confidence FROM ev_h WHERE timestamp >= TIMESTAMP '2023-12-26'
        AND timestamp < TIMESTAMP '2024-01-25' GROUP BY 1, 2, 3""",
    "exported_package": """SELECT symbol, time AS timestamp, regime_type AS regime, round(volatility, 6) AS volatility,
        round(close, 6) AS ohlcv_close FROM reg_u""",
    "tick_log_bars": """SELECT symbol, time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume,
        least(dayofmonth(time) // 11, 2) AS batch FROM flat""",
    "stream_daily_bars": """SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS time, round(arg_min(value, ts), 6) AS open,
        round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, ts), 6) AS close,
        1000 * count(*) AS volume FROM events GROUP BY 1, 2""",
    "stream_regime_stats": """SELECT symbol, regime_type, date_trunc('day', timestamp)::TIMESTAMP AS bucket, count(*) AS count,
        round(avg(confidence), 6) AS avg_confidence, round(min(confidence), 6) AS min_confidence,
        round(max(confidence), 6) AS max_confidence FROM flat_ev GROUP BY 1, 2, 3""",
    "stream_current_regimes": f"""SELECT {EVENT} FROM flat_ev
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1""",
    "stream_expiring_regimes": """SELECT symbol, regime_type AS regime, timestamp AS time FROM flat_ev
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1""",
    "stream_regime_expiry": """SELECT c.n AS batch, c.symbol, c.regime, round(c.confidence, 6) AS confidence, c.time, c.time + INTERVAL 1 DAY <= k.clock AS expired
        FROM seen_u c JOIN clock_u k USING (n) LEFT JOIN seen_u p ON p.symbol = c.symbol AND p.n = c.n - 1 LEFT JOIN clock_u b ON b.n = c.n - 1
        WHERE coalesce(c.time + INTERVAL 1 DAY > b.clock, TRUE) AND (p.time IS NULL OR c.time > p.time OR c.time + INTERVAL 1 DAY <= k.clock)""",
    "stream_ingest": """SELECT symbol, regime_type, nnfx_signal, count(*) AS n, min(time) AS first_time, max(time) AS last_time,
        round(avg(adx), 4) AS adx, round(avg(rsi), 4) AS rsi, round(avg(kama), 4) AS kama, round(avg(stoch_d), 4) AS stoch_d,
        round(avg(enhanced), 4) AS regime_confidence_enhanced FROM nnfx_f GROUP BY 1, 2, 3""",
    "stream_ingest_bars": "SELECT symbol, time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM flat",
    "stream_ingest_outputs": """SELECT output, count(*) AS n, count(DISTINCT symbol) AS symbols, min(time) AS first_time, max(time) AS last_time
        FROM flat CROSS JOIN (VALUES ('features'), ('regime_events'), ('history'), ('package')) o(output) GROUP BY 1""",
    "stream_ingest_snapshot": """SELECT symbol, regime_type AS regime, round(volatility, 4) AS volatility, round(trend_strength, 4) AS trend,
        time AS timestamp, nnfx_signal, round(CASE WHEN enhanced > 0 THEN enhanced END, 4) AS confidence_enhanced,
        round(CASE WHEN enhanced > 0 THEN adx END, 4) AS adx FROM nnfx_f
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1""",
    "stream_risk_state": f"""SELECT account, daily.id, round(CASE WHEN daily.n >= 30 THEN quantile_cont(pnl / {CAPITAL}, 0.05) OVER
        (ORDER BY daily.n ROWS 99 PRECEDING) ELSE 0 END, 8) AS var, round(dd, 8) AS drawdown, round(daily_pnl, 8) AS daily_pnl,
        (sum(is_open::INT - was_open::INT) OVER (ORDER BY daily.n))::BIGINT AS active_positions FROM daily JOIN dd USING (n)
        JOIN (SELECT id, is_open, was_open FROM pe) p ON p.id = daily.id""",
    "stream_indicators": f"SELECT symbol, time, {rnd(4, 'rsi', 'adx', 'kama', 'macd_signal', 'stoch_d')}, period, {rnd(4, 'hma')} FROM ind_h",
    "volatility_clusters_steps": model_sql.clusters("vc", CLUSTER_STEPS),
    "mixture_steps": model_sql.newest("gm", MIXTURE_STEPS, catalog.STATES["gmm"]),
    "markov_forward": model_sql.markov_newest("hm", 0, 5),
    "markov_step": model_sql.markov_newest("hm", 1, 5),
    "bar_maps": """SELECT symbol, time, round(close, 6) AS ohlcv_close, volume::DOUBLE AS ohlcv_volume, 5 AS n FROM bars_u""",
}

_BODIES["touched_daily_bars"] = _BODIES["refreshed_daily_bars"]
_BODIES["touched_regime_stats"] = _BODIES["refreshed_regime_stats"]

ORACLES: dict[str, str] = {name: sql(body) for name, body in _BODIES.items()}
