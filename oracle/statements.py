"""Query name -> SQL statement."""

from __future__ import annotations

from barloom.sources.fixtures import (
    EQUITY_SNAPSHOTS_SQL, EVENT_BARS_SQL, FAULTY_BARS_SQL, LEDGER_FILLS_SQL, WALK_BARS_SQL)
from oracle import sql

W = WALK_BARS_SQL
ORACLE: dict[str, str] = {}

ORACLE["bar_file_scan"] = """
  SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(max(value), 6) AS top
  FROM events GROUP BY 1"""

ORACLE["range_scan"] = f"""SELECT ts, open, high, low, close, volume FROM ({W})
  WHERE symbol = 'S7' AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1999-01-01'"""

ORACLE["upsert_bars"] = f"""WITH b AS MATERIALIZED ({W}),
  o AS (SELECT * FROM b WHERE ts < TIMESTAMP '2001-01-01'),
  n AS (SELECT symbol, ts, open, high + 1 AS high, low, close + 1 AS close, volume FROM b WHERE ts >= TIMESTAMP '2000-01-01')
  SELECT symbol, ts, open, high, low, close, volume FROM n
  UNION ALL SELECT o.* FROM o ANTI JOIN n ON n.symbol = o.symbol AND n.ts = o.ts"""

ORACLE["stream_upsert"] = ORACLE["upsert_bars"]

ORACLE["candle_objects"] = f"""SELECT symbol, ts, open, high, low,
    round(close + CASE WHEN day(ts) % 10 = 0 THEN 1 ELSE 0 END, 6) AS close, volume
  FROM ({W}) WHERE ts < TIMESTAMP '2001-06-01'"""
ORACLE["candle_arrays"] = f"SELECT * FROM ({W}) WHERE ts < TIMESTAMP '2001-06-01'"

ORACLE["params_pairing"] = """SELECT concat('S', cast(s_suppkey AS varchar)) AS symbol,
  CASE WHEN s_suppkey % 4 < 2 THEN cast(s_suppkey AS double) ELSE 50.0 END AS ema_fast,
  CASE WHEN s_suppkey % 4 = 1 THEN 2.5 ELSE 3.0 END AS atr_mult FROM supplier"""

ORACLE["symbol_and_timeframe"] = """
  WITH t(k, tf, sec, bpy) AS (VALUES (0, '5m', 300, 105120.0), (1, '15m', 900, 35040.0), (2, '1h', 3600, 8760.0),
    (3, '4h', 14400, 2190.0), (4, '1d', 86400, 365.0), (5, '2w', NULL, 365.0))
  SELECT o_orderkey, concat('C', cast(o_custkey AS varchar)) AS coin, tf AS timeframe, cast(sec AS bigint) AS seconds,
         cast(sec AS bigint) * 1000 AS millis, cast(bpy AS double) AS per_year, epoch_ms(o_orderdate) AS ts_ms,
         epoch_ms(o_orderdate) - 63072000000 AS since_ms
  FROM orders JOIN t ON t.k = o_orderkey % 6"""

ORACLE["order_responses"] = """
  WITH x AS (SELECT *, o_orderkey % 6 AS p, cast(o_custkey % 50 AS double) AS q FROM orders)
  SELECT o_orderkey, q AS qty,
    CASE WHEN p IN (2, 3) THEN 'rejected' WHEN p IN (1, 5) THEN 'filled' ELSE 'submitted' END AS status,
    CASE WHEN p IN (0, 1, 5) THEN cast(o_orderkey AS varchar) END AS venue_order_id,
    CASE WHEN p = 1 THEN cast(o_orderkey % 9 + 1 AS double) WHEN p = 5 THEN q ELSE 0.0 END AS filled_qty,
    CASE WHEN p = 1 THEN o_totalprice ELSE 0.0 END AS avg_fill_price,
    CASE WHEN p = 2 THEN concat('rejected by ', o_orderpriority)
         WHEN p = 3 THEN '{"status":"err","response":"bad"}' END AS reason
  FROM x"""

ORACLE["status_mapping"] = """
  SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'new' WHEN 1 THEN 'submitted' WHEN 2 THEN 'partial'
    WHEN 3 THEN 'filled' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'submitted' WHEN 6 THEN 'rejected' ELSE 'submitted' END AS status
  FROM orders"""

ORACLE["account_positions"] = """
  SELECT c_custkey, concat('A', cast(c_custkey % 7 AS varchar)) AS symbol, cast(c_custkey % 5 - 2 AS double) AS qty,
         c_acctbal AS avg_price, -c_acctbal AS unrealized_pnl
  FROM customer WHERE c_custkey % 5 <> 2
  UNION ALL SELECT c_custkey, 'B', cast(c_custkey % 3 AS double), 0.0, 0.0 FROM customer WHERE c_custkey % 3 <> 0"""
ORACLE["account_balances"] = """SELECT c_custkey, 'USDC' AS currency, cast(c_custkey AS double) AS free,
  c_acctbal AS total FROM customer"""

ORACLE["position_sizing"] = """
  WITH x AS (SELECT o_orderkey, 10000.0 + o_custkey AS eq, round(o_totalprice / 1000, 2) AS px,
                    (o_orderkey % 20) / 1000.0 AS risk, cast(o_orderkey % 7 AS double) AS atr FROM orders),
  y AS (SELECT *, px * (0.9 + (o_orderkey % 13) / 100.0) AS st, least(greatest(risk, 0.005), 0.01) AS cl FROM x),
  z AS (SELECT *, least(CASE WHEN px - st > 0 THEN eq * cl / (px - st) ELSE eq / px END, eq / px) AS q,
               CASE WHEN atr > 0 THEN least(eq * cl / (3 * atr), eq / px) ELSE 0 END AS vq FROM y)
  SELECT o_orderkey, round(cl, 8) AS clamped, round(q, 8) AS fixed_qty, round(q * px, 8) AS fixed_notional,
         round(eq * cl, 8) AS risk_cash, round(trunc(q), 8) AS whole_qty, round(vq, 8) AS vol_qty,
         round(vq * px, 8) AS vol_notional FROM z"""


def quality_cte(bars: str, order: str, step: int) -> str:
    return f"""x AS (SELECT *, lag(ts) OVER w AS pts, lag(close) OVER w AS pc FROM ({bars})
               WINDOW w AS (PARTITION BY symbol ORDER BY {order})),
  r AS (SELECT *, coalesce(epoch(ts) - epoch(pts) > {step} * 1.5, false) AS gap, coalesce(pts > ts, false) AS late,
               CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END AS lr FROM x),
  g AS (SELECT symbol, count(*) AS n_candles, count(*) - count(DISTINCT ts) AS n_duplicates,
               count(*) FILTER (gap) AS n_gaps,
               count(*) FILTER (coalesce(high < low, false) OR coalesce(high < open, false) OR coalesce(high < close, false)
                 OR coalesce(low > open, false) OR coalesce(low > close, false) OR coalesce(open <= 0, false)
                 OR coalesce(close <= 0, false)) AS n_ohlc_violations,
               count(*) * 5 - count(open) - count(high) - count(low) - count(close) - count(volume) AS n_nan,
               count(*) FILTER (volume < 0) AS n_negative_volume, bool_or(late) AS late,
               count(lr) AS nr, avg(lr) AS m, stddev_pop(lr) AS sd, min(pts) FILTER (gap) AS first_gap
        FROM r GROUP BY symbol),
  a AS (SELECT r.symbol, count(*) FILTER (nr > 20 AND abs((lr - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END) > 12) AS n_anomalies
        FROM r JOIN g USING (symbol) GROUP BY 1),
  q AS (SELECT symbol, cast(n_candles AS bigint) AS n_candles, cast(n_duplicates AS bigint) AS n_duplicates,
               cast(n_gaps AS bigint) AS n_gaps, cast(n_ohlc_violations AS bigint) AS n_ohlc_violations,
               cast(n_nan AS bigint) AS n_nan, cast(n_negative_volume AS bigint) AS n_negative_volume,
               cast(n_anomalies AS bigint) AS n_anomalies,
               NOT late AND n_ohlc_violations = 0 AND n_nan = 0 AND n_negative_volume = 0 AS passed,
               concat_ws('; ', CASE WHEN n_duplicates > 0 THEN n_duplicates || ' duplicate timestamps' END,
                 CASE WHEN late THEN 'timestamps not strictly increasing' END,
                 CASE WHEN n_ohlc_violations > 0 THEN n_ohlc_violations || ' OHLC sanity violations' END,
                 CASE WHEN n_nan > 0 THEN n_nan || ' NaN/non-finite values' END,
                 CASE WHEN n_negative_volume > 0 THEN n_negative_volume || ' negative volumes' END,
                 CASE WHEN n_anomalies > 0 THEN n_anomalies || ' anomalous return spikes (review)' END) AS messages,
               first_gap, cast(least(n_gaps, 50) AS bigint) AS kept_gaps
        FROM g JOIN a USING (symbol))"""


_FAULTY = quality_cte(FAULTY_BARS_SQL, "ingest_seq", 86400)
_HOURLY = quality_cte(EVENT_BARS_SQL, "ts", 3600)
ORACLE["quality_report"] = f"WITH {_FAULTY} SELECT * FROM q"
ORACLE["quality_report_hourly"] = f"""WITH {_HOURLY} SELECT * EXCLUDE (first_gap) FROM q
  UNION ALL SELECT concat('none-', r_name), 0, 0, 0, 0, 0, 0, 0, false, 'empty dataframe', 0 FROM region"""
ORACLE["quality_run_rows"] = f"""WITH {_FAULTY} SELECT 'testx' AS exchange, symbol, '1d' AS timeframe, n_candles, n_gaps,
  n_duplicates, n_anomalies, passed FROM q"""
ORACLE["bar_gaps"] = f"WITH {_HOURLY} SELECT symbol, pts AS gap_start, ts AS gap_end FROM r WHERE gap"
ORACLE["return_anomalies"] = f"""WITH {quality_cte(W, 'ts', 86400)}
  SELECT symbol, ts, round(lr, 6) AS log_ret FROM r JOIN g USING (symbol)
  WHERE nr > 20 AND abs((lr - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END) > 1.6"""
ORACLE["clean_bars"] = f"""SELECT symbol, ts, open, high, low, close, volume FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY ingest_seq DESC) AS rn FROM ({FAULTY_BARS_SQL}))
  WHERE rn = 1 AND close IS NOT NULL"""

# --- indicators ---------------------------------------------------------------
NB = f"WITH b AS MATERIALIZED ({sql.numbered()})"
ORACLE["returns"] = f"""{NB} SELECT symbol, ts, round(lr, 8) AS log_ret, round(close / pclose - 1, 8) AS simple_ret,
  round(chg, 8) AS diff FROM b"""
ORACLE["moving_averages"] = f"""WITH RECURSIVE {sql.smoothed({'e50': ('b.close', sql.ema('50')), 'e20': ('b.close', sql.ema('20'))})}
  SELECT b.symbol, b.ts, round(CASE WHEN b.i >= 49 THEN e50 END, 6) AS ema50, round(CASE WHEN b.i >= 19 THEN e20 END, 6) AS ema20,
         round({sql.frame('avg', 'close', 20)}, 8) AS sma,
         coalesce(b.volume > 1.2 * {sql.frame('avg', 'volume', 20)}, false) AS vol_ok
  FROM nb b JOIN sm s ON s.symbol = b.symbol AND s.i = b.i"""
ORACLE["true_range_atr"] = f"""WITH RECURSIVE {sql.smoothed({'atr_': ('b.tr', sql.wilder('14'))})}
  SELECT b.symbol, b.ts, round(tr, 6) AS true_range, round(CASE WHEN b.i >= 13 THEN atr_ END, 6) AS atr
  FROM nb b JOIN sm s ON s.symbol = b.symbol AND s.i = b.i"""
ORACLE["rsi"] = f"""WITH RECURSIVE {sql.smoothed({k: sql.ALL_SMOOTH[k] for k in ('ag', 'al')})}
  SELECT b.symbol, b.ts, round({sql.rsi_of('ag', 'al', 'b.i', 14)}, 6) AS rsi
  FROM nb b JOIN sm s ON s.symbol = b.symbol AND s.i = b.i"""
ORACLE["adx"] = f"""WITH RECURSIVE {sql.smoothed({k: sql.ALL_SMOOTH[k] for k in ('atr_', 'sp', 'sn')}, sql.wilder('14'))}
  SELECT b.symbol, b.ts, round(CASE WHEN nadx >= 14 THEN adx END, 6) AS adx
  FROM nb b JOIN sm s ON s.symbol = b.symbol AND s.i = b.i"""
_mid, _sd = sql.frame("avg", "close", 20), sql.frame("stddev_pop", "close", 20)
_top, _low = sql.frame("max", "high", 20), sql.frame("min", "low", 20)
ORACLE["channels"] = f"""{NB} SELECT symbol, ts, round({_mid} - 2 * {_sd}, 8) AS bb_lower, round({_mid}, 8) AS bb_mid,
  round({_mid} + 2 * {_sd}, 8) AS bb_upper, round({_low}, 8) AS dc_lower, round(({_top} + {_low}) / 2, 8) AS dc_mid,
  round({_top}, 8) AS dc_upper FROM b"""
ORACLE["zscore_volatility"] = f"""{NB} SELECT symbol, ts, round((close - {_mid}) / nullif({_sd}, 0), 6) AS zscore,
  round({sql.frame('stddev_pop', 'lr', 20)} * sqrt(365.0), 6) AS rvol FROM b"""
ORACLE["crosses"] = f"""{NB}, c AS (SELECT symbol, ts, coalesce(round(close - {_mid}, 6) > 0, false) AS above FROM b),
  d AS (SELECT *, coalesce(lag(above) OVER (PARTITION BY symbol ORDER BY ts), false) AS was FROM c)
  SELECT symbol, ts, above AND NOT was AS crossed_up, NOT above AND was AS crossed_down FROM d WHERE above <> was"""
ORACLE["drawdown_compounding"] = f"""{NB} SELECT symbol, ts, round(max(close) OVER w, 9) AS peak,
  round(close / max(close) OVER w - 1, 9) AS drawdown, round(exp(sum(ln(coalesce(close / pclose, 1))) OVER w), 9) AS growth
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""

for _s in ("trend_following", "momentum_breakout", "mean_reversion", "regime_adaptive", "breakout_rr"):
    ORACLE[f"signals_{_s}"] = sql.signals(_s)
    ORACLE[f"trades_{_s}"] = sql.blotter(_s)
    ORACLE[f"metrics_{_s}"] = sql.metrics(_s)
ORACLE["trades_whole_units"] = sql.blotter("momentum_breakout", whole=True)
ORACLE["equity_curve"] = sql.equity("momentum_breakout")
_LINES = (("CAGR", "cagr", "%"), ("Total Return", "total_return", "%"), ("Sharpe", "sharpe", "f"), ("Sortino", "sortino", "f"),
          ("Calmar", "calmar", "f"), ("Max Drawdown", "max_drawdown", "%"), ("Volatility (ann.)", "volatility", "%"),
          ("Win Rate", "win_rate", "%"), ("Profit Factor", "profit_factor", "f"), ("Avg Trade", "avg_trade", "f"),
          ("Expectancy", "expectancy", "f"), ("# Trades", "n_trades", "d"))


def _printed(column: str, kind: str) -> str:
    if kind == "d":
        return f"cast({column} AS varchar)"
    shown = f"printf('%.2f%%', {column} * 100)" if kind == "%" else f"printf('%.2f', {column})"
    return f"CASE WHEN isinf({column}) THEN 'inf' ELSE {shown} END"


ORACLE["metrics_printed"] = f"""WITH RECURSIVE {sql.signals_cte('momentum_breakout')}, {sql.trades_cte()}, {sql.EQ},
  mt AS ({sql.metrics_of('eq')}) """ + " UNION ALL ".join(
    f"SELECT symbol, cast({i} AS bigint) AS line, '{label}' AS metric, {_printed(c, kind)} AS value FROM mt"
    for i, (label, c, kind) in enumerate(_LINES))
ORACLE["metrics_printed_full"] = ORACLE["metrics_printed"]

# --- validation, resampling, sweeps ---------------------------------------------
KEY = "split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2) AS segment"
ORACLE["in_out_split"] = f"""SELECT {KEY}, ts, row_number() OVER w - 1 AS bar_no, count(*) OVER (PARTITION BY symbol) AS n_bars
  FROM ({sql.split_bars(0.7, 25)}) WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""
WKEY = "split_part(symbol, '|', 1) AS symbol, cast(split_part(symbol, '|', 2) AS bigint) AS segment"
ORACLE["walk_forward_windows"] = f"""SELECT {WKEY}, first_ts, last_ts, n_rows, test_size
  FROM (SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, max(size) AS test_size
        FROM ({sql.window_bars()}) GROUP BY symbol)"""

SPLIT = f"WITH RECURSIVE {sql.signals_cte('momentum_breakout', sql.split_bars())}, {sql.trades_cte()}, {sql.EQ}"
ORACLE["split_metrics"] = f"""{SPLIT}, mt AS ({sql.metrics_of('eq')}) SELECT {KEY}, {sql.ROUNDED} FROM mt"""
WIDE = ", ".join(f"max({m}) FILTER (seg = '{g}') AS {g}_{m}" for g in ("is", "oos") for m in (
    "total_return", "sharpe", "cagr", "profit_factor", "max_drawdown", "n_trades"))


def _gates(wide: str, key: str, sharpe: str, factor: str, deepest: str, least: str, trades: str) -> str:
    """Checks, verdict and reasons of a table of is_ and oos_ metrics; limits as printed."""
    return f"""ck AS (SELECT {key}oos_total_return > 0 AS oos_positive, oos_sharpe >= {sharpe} AS sharpe, oos_profit_factor >= {factor} AS profit_factor,
                abs(least(is_max_drawdown, oos_max_drawdown)) <= {deepest} AS max_drawdown, oos_n_trades >= {trades} AS min_trades,
                CASE WHEN is_sharpe > 0 THEN oos_sharpe / is_sharpe >= {least} END AS is_oos_consistency,
                printf('OOS total return not positive (%.2f%%)', oos_total_return * 100) AS r1, printf('OOS Sharpe %.2f < {sharpe}', oos_sharpe) AS r2,
                printf('OOS profit factor %.2f < {factor}', oos_profit_factor) AS r3,
                printf('Max drawdown %.2f%% > {float(deepest) * 100:.0f}%%', abs(least(is_max_drawdown, oos_max_drawdown)) * 100) AS r4,
                'Only ' || cast(oos_n_trades AS bigint) || ' OOS trades (< {trades})' AS r5,
                printf('OOS/IS Sharpe ratio %.2f < {least} (overfit risk)', oos_sharpe / nullif(is_sharpe, 0)) AS r6 FROM {wide}),
  rs AS (SELECT *, concat_ws('; ', CASE WHEN NOT oos_positive THEN r1 END, CASE WHEN NOT sharpe THEN r2 END, CASE WHEN NOT profit_factor THEN r3 END,
                CASE WHEN NOT max_drawdown THEN r4 END, CASE WHEN NOT min_trades THEN r5 END,
                CASE WHEN NOT coalesce(is_oos_consistency, true) THEN r6 END) AS reasons,
                cast((NOT oos_positive)::int + (NOT sharpe)::int + (NOT profit_factor)::int + (NOT max_drawdown)::int + (NOT min_trades)::int
                + (NOT coalesce(is_oos_consistency, true))::int AS bigint) AS n_reasons FROM ck)
  SELECT {key}oos_positive, sharpe, profit_factor, max_drawdown, min_trades, is_oos_consistency, n_reasons = 0 AS passed, n_reasons, reasons FROM rs"""


ORACLE["acceptance_gates"] = f"""{SPLIT}, mt AS ({sql.metrics_of('eq')}),
  wd AS (SELECT sy AS symbol, {WIDE} FROM (SELECT *, split_part(symbol, '|', 1) AS sy, split_part(symbol, '|', 2) AS seg FROM mt) GROUP BY 1),
  {_gates('wd', 'symbol, ', '0.2', '1.0', '0.05', '0.5', '2')}"""

MOMENTUM = f"WITH RECURSIVE {sql.signals_cte('momentum_breakout')}, {sql.trades_cte()}, {sql.EQ}"


def _bootstrap(key: str, numbered: str, runs: str, n_sims: int) -> str:
    """Bootstrap summary per run of ``runs`` from trades (key, r, t), t counted from 0."""
    draws = f"SELECT t.{key}, t.n, s.sim, d.j FROM cnt t, range({n_sims}) s(sim), range(t.n) d(j)"
    names = ("cagr_mean", "cagr_p05", "cagr_p95", "max_dd_mean", "max_dd_p95", "prob_profit")
    shown = ", ".join([f"round(coalesce({c}, 0), 6) AS {c}" for c in names]
                      + [f"round(coalesce(terminal_{c}, 10000), 6) AS terminal_{c}" for c in ("p05", "p50", "p95")])
    return f"""tr AS MATERIALIZED ({numbered}),
  cnt AS (SELECT {key}, count(*) AS n FROM tr GROUP BY 1 HAVING count(*) >= 3),
  dr AS ({sql.draw_columns(draws, 42, 'sim', 'j', 'n')}),
  pa AS (SELECT dr.{key}, sim, j, exp(sum(ln(1 + r)) OVER (PARTITION BY dr.{key}, sim ORDER BY j)) AS g
         FROM dr JOIN tr ON tr.{key} = dr.{key} AND tr.t = dr.pick),
  pk AS (SELECT *, greatest(max(g) OVER (PARTITION BY {key}, sim ORDER BY j), 1.0) AS peak FROM pa),
  sm2 AS (SELECT {key}, sim, arg_max(g, j) AS g, least(min(g / peak - 1), 0) AS dd FROM pk GROUP BY 1, 2),
  st AS (SELECT {key}, count(*) AS n_sims, avg(g - 1) AS cagr_mean, quantile_cont(g - 1, 0.05) AS cagr_p05,
                quantile_cont(g - 1, 0.95) AS cagr_p95, avg(dd) AS max_dd_mean, quantile_cont(dd, 0.05) AS max_dd_p95,
                avg(CASE WHEN g * 10000.0 > 10000.0 THEN 1.0 ELSE 0.0 END) AS prob_profit, quantile_cont(g * 10000.0, 0.05) AS terminal_p05,
                quantile_cont(g * 10000.0, 0.5) AS terminal_p50, quantile_cont(g * 10000.0, 0.95) AS terminal_p95
         FROM sm2 GROUP BY 1)
  SELECT b.{key}, coalesce(n_sims, 0) AS n_sims, {shown} FROM ({runs}) b LEFT JOIN st USING ({key})"""


ORACLE["trade_bootstrap"] = f"""{MOMENTUM}, {_bootstrap(
    'symbol', 'SELECT symbol, tret AS r, row_number() OVER (PARTITION BY symbol ORDER BY bar_no) - 1 AS t FROM eq WHERE tret IS NOT NULL',
    'SELECT DISTINCT symbol FROM sg', 2000)}"""
ORACLE["portfolio_bootstrap"] = f"""{SPLIT}, {_bootstrap(
    'segment', "SELECT 'oos' AS segment, tret AS r, row_number() OVER (ORDER BY split_part(symbol, '|', 1), bar_no) - 1 AS t "
    "FROM eq WHERE tret IS NOT NULL AND split_part(symbol, '|', 2) = 'oos'", "SELECT 'oos' AS segment", 200)}"""

_blocks = "SELECT c.symbol, c.n, s.sim, d.b FROM cnt c, range(1000) s(sim), range(cast(ceil(c.n / 20.0) AS bigint)) d(b)"
ORACLE["block_bootstrap"] = f"""WITH nb AS MATERIALIZED ({sql.numbered()}),
  rt AS MATERIALIZED (SELECT symbol, i - 1 AS t, ln(close / pclose) AS lr FROM nb WHERE i >= 1),
  cnt AS (SELECT symbol, count(*) AS n FROM rt GROUP BY 1 HAVING count(*) >= 40),
  dr AS ({sql.draw_columns(_blocks, 42, 'sim', 'b', 'n - 20')}),
  bars AS (SELECT symbol, sim, pick + o.k AS t FROM dr, range(20) o(k) WHERE b * 20 + o.k < n)
  SELECT bars.symbol, sim, round(exp(sum(lr)), 6) AS terminal FROM bars JOIN rt ON rt.symbol = bars.symbol AND rt.t = bars.t GROUP BY 1, 2"""



def _drawn_sets(n: int, space: tuple) -> list[dict]:
    """Parameter sets by the definition of the draws: a hash of (seed 42, trial, place of the parameter)."""
    prime, sets = 2**31 - 1, []
    for trial in range(n):
        drawn = {}
        for place, (name, kind, low, high) in enumerate(space):
            a = (42 * 97 + trial * 2654435761 + place * 40503) % prime
            b = ((a * a + 12345) % prime * 48271 + a) % prime
            c = (b * b + 777) % prime
            drawn[name] = low + c % (high - low + 1) if kind == "int" else round(low + (high - low) * c / prime, 6)
        sets.append(drawn)
    return sets


_SETS = _drawn_sets(60, (("channel", "int", 10, 55), ("exit_channel", "int", 5, 20), ("atr_period", "int", 10, 21),
                         ("atr_mult", "float", 2.0, 5.0), ("vol_mult", "float", 1.0, 2.0)))
_SWEEP = f"""WITH RECURSIVE {sql.momentum_sets_cte(sql.split_bars(0.7, 250), _SETS)}, {sql.trades_cte()}, {sql.EQ},
  mt AS ({sql.metrics_of('eq')}),
  wd AS (SELECT sy AS symbol, pid AS param_id, {WIDE}
         FROM (SELECT *, split_part(symbol, '|', 1) AS sy, split_part(split_part(symbol, '|', 2), '#', 1) AS seg,
                      cast(split_part(symbol, '#', 2) AS bigint) AS pid FROM mt) GROUP BY 1, 2),
  sc AS (SELECT *, CASE WHEN is_n_trades >= 3 THEN is_sharpe + 0.5 * is_cagr - abs(is_max_drawdown) - 0.5 * abs(is_sharpe - oos_sharpe) END AS score FROM wd)"""
ORACLE["sweep_trials"] = f"""{_SWEEP} SELECT symbol, param_id, round(is_sharpe, 6) AS is_sharpe, round(is_cagr, 6) AS is_cagr,
  round(is_max_drawdown, 6) AS is_max_drawdown, is_n_trades, round(oos_sharpe, 6) AS oos_sharpe, round(oos_cagr, 6) AS oos_cagr,
  round(oos_max_drawdown, 6) AS oos_max_drawdown, oos_n_trades, round(score, 6) AS score FROM sc"""
ORACLE["sweep_best"] = f"""{_SWEEP} SELECT symbol, param_id, coalesce(round(score, 6), 0.0) AS score, n_trials FROM (
    SELECT symbol, CASE WHEN score IS NOT NULL THEN param_id END AS param_id, score, count(*) OVER (PARTITION BY symbol) AS n_trials,
           row_number() OVER (PARTITION BY symbol ORDER BY score DESC NULLS LAST, param_id) AS rn FROM sc) WHERE rn = 1"""

ORACLE["sweep_trials_full"], ORACLE["sweep_best_full"] = ORACLE["sweep_trials"], ORACLE["sweep_best"]


def _grid(space: tuple) -> list[tuple]:
    """One parameter at a time, at five even steps from 75 to 125 % of its base; window lengths rounded, halves to even."""
    rows = []
    for name, kind, base in space:
        for i in range(5):
            value = 0.75 * base + (1.25 * base - 0.75 * base) * i / 4
            rows.append((name, round(value) if kind == "int" else value))
    return [(name, value, {name: value}) for name, value in rows if value >= 1 or isinstance(value, float)]


_GRID = _grid((("channel", "int", 20), ("exit_channel", "int", 10), ("atr_period", "int", 14), ("atr_mult", "float", 3.0),
               ("vol_mult", "float", 1.2)))
_grid_rows = ", ".join(f"({i}, '{g[0]}', cast({float(g[1])!r} AS double))" for i, g in enumerate(_GRID))
_SENS = f"""WITH RECURSIVE {sql.momentum_sets_cte(W, [g[2] for g in _GRID])}, {sql.trades_cte()}, {sql.EQ}, mt AS ({sql.metrics_of('eq')}),
  tb AS (SELECT mt.* EXCLUDE (symbol), split_part(symbol, '#', 1) AS symbol, param, value
         FROM mt JOIN (VALUES {_grid_rows}) g(pid, param, value) ON g.pid = cast(split_part(symbol, '#', 2) AS bigint))"""
ORACLE["sensitivity_table"] = f"{_SENS} SELECT symbol, param, round(value, 6) AS value, {sql.ROUNDED} FROM tb"
ORACLE["sensitivity_robustness"] = f"""{_SENS},
  pp AS (SELECT symbol, param, avg(sharpe) AS m, stddev_pop(sharpe) AS s FROM tb GROUP BY 1, 2)
  SELECT symbol, round(greatest(0, 1 - coalesce(avg(CASE WHEN abs(m) > 1e-9 THEN abs(s / m) END), 1)), 6) AS robustness FROM pp GROUP BY 1"""

_WF = f"""WITH RECURSIVE {sql.signals_cte('momentum_breakout', sql.window_bars())}, {sql.trades_cte()}, {sql.EQ},
  sz AS (SELECT symbol, max(size) AS size, max(n) AS n FROM nb GROUP BY 1),
  te AS (SELECT split_part(symbol, '|', 1) AS sy, cast(split_part(symbol, '|', 2) AS bigint) AS w, bar_no, ts, equity
         FROM eq JOIN sz USING (symbol) WHERE bar_no >= n - size),
  en AS (SELECT sy, w, arg_min(equity, bar_no) AS f, arg_max(equity, bar_no) AS l FROM te GROUP BY 1, 2),
  gr AS (SELECT *, exp(coalesce(sum(ln(l / f)) OVER (PARTITION BY sy ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS g FROM en),
  wf AS (SELECT te.sy AS symbol, ts, round(equity / f * g * 10000.0, 8) AS equity FROM te JOIN gr ON te.sy = gr.sy AND te.w = gr.w),
  we AS (SELECT *, row_number() OVER v AS bar_no, equity / lag(equity) OVER v - 1 AS ret, equity - lag(equity) OVER v AS pnl
         FROM wf WINDOW v AS (PARTITION BY symbol ORDER BY ts))"""
ORACLE["walk_forward_equity"] = f"{_WF} SELECT symbol, ts, round(equity, 4) AS equity FROM we"
ORACLE["walk_forward_metrics"] = f"{_WF}, wm AS ({sql.metrics_of('we')}) SELECT symbol, {sql.ROUNDED} FROM wm"

_FITSETS = [{"channel": 20}, {"channel": 30}]


def _fit(cte: str, bars: str) -> str:
    body = f"""WITH RECURSIVE {sql.momentum_sets_cte(bars, _FITSETS)}, {sql.trades_cte()}, {sql.EQ}, mt AS ({sql.metrics_of('eq')})
      SELECT mt.* EXCLUDE (symbol), split_part(symbol, '|', 1) AS symbol,
             cast(split_part(split_part(symbol, '|', 2), '#', 1) AS bigint) AS segment,
             cast(split_part(symbol, '#', 2) AS bigint) AS param_id FROM mt"""
    return f"{cte} AS ({body})"


ORACLE["walk_forward_fitted"] = f"""WITH {_fit('tst', sql.window_bars())}, {_fit('trn', sql.window_bars(train=True))},
  pk AS (SELECT symbol, segment, param_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, segment ORDER BY round(sharpe, 9) DESC, param_id) AS rn FROM trn) WHERE rn = 1)
  SELECT symbol, segment, param_id, {sql.ROUNDED} FROM tst JOIN pk USING (symbol, segment, param_id)"""

_LENGTHS = [{"channel": c, "exit_channel": x} for c in range(10, 50) for x in range(5, 17) if c == 10 or x == 5]
_TEST_BARS = f"""SELECT t.*, 10 + p.rising % 40 AS ch, 5 + p.rising % 12 AS xc, 14 AS ap, cast(3.0 AS double) AS am, cast(1.2 AS double) AS vm
  FROM ({sql.window_bars()}) t JOIN (SELECT symbol, cast(sum(CASE WHEN close > open THEN 1 ELSE 0 END) AS bigint) AS rising
                                     FROM ({sql.window_bars(train=True)}) GROUP BY 1) p USING (symbol)"""
ORACLE["walk_forward_fit_function"] = f"""WITH RECURSIVE {sql.momentum_sets_cte(_TEST_BARS, _LENGTHS, own=True)}, {sql.trades_cte()}, {sql.EQ},
  mt AS ({sql.metrics_of('eq')}), ln AS (SELECT DISTINCT symbol, ch, xc FROM ({_TEST_BARS}))
  SELECT {WKEY}, ch AS channel, xc AS exit_channel, {sql.ROUNDED} FROM mt JOIN ln USING (symbol)"""
_GIVEN_BARS = f"""SELECT *, 15 + 5 * cast(split_part(symbol, '|', 2) AS bigint) AS ch, 10 AS xc, 14 AS ap, cast(3.0 AS double) AS am,
  cast(1.2 AS double) AS vm FROM ({sql.window_bars()})"""
ORACLE["walk_forward_given"] = f"""WITH RECURSIVE {sql.momentum_sets_cte(_GIVEN_BARS, [{"channel": 15 + 5 * w} for w in range(5)], own=True)},
  {sql.trades_cte()}, {sql.EQ}, mt AS ({sql.metrics_of('eq', ann='8760.0')}) SELECT {WKEY}, {sql.ROUNDED} FROM mt"""

ORACLE["regime_gates"] = f"""WITH RECURSIVE {sql.signals_cte('regime_adaptive', sql.split_bars())}, {sql.trades_cte()}, {sql.EQ},
  mt AS ({sql.metrics_of('eq')}),
  wd AS (SELECT sy AS symbol, {WIDE} FROM (SELECT *, split_part(symbol, '|', 1) AS sy, split_part(symbol, '|', 2) AS seg FROM mt) GROUP BY 1),
  st AS (SELECT *, sum(moved) OVER (PARTITION BY symbol ORDER BY bar_no) AS stretch
         FROM (SELECT eq.symbol, bar_no, equity, sg.trend, CASE WHEN sg.trend IS DISTINCT FROM lag(sg.trend) OVER (PARTITION BY eq.symbol ORDER BY bar_no) THEN 1 ELSE 0 END AS moved
               FROM eq JOIN sg ON sg.symbol = eq.symbol AND sg.i = bar_no WHERE split_part(eq.symbol, '|', 2) = 'oos')),
  dd AS (SELECT split_part(symbol, '|', 1) AS symbol, CASE WHEN trend THEN 'trend' ELSE 'range' END AS regime, min(d) AS d
         FROM (SELECT *, equity / max(equity) OVER (PARTITION BY symbol, stretch ORDER BY bar_no) - 1 AS d FROM st) GROUP BY 1, 2),
  rg AS (SELECT symbol, bool_and(d >= -0.005) FILTER (regime = 'range') AS regime_range, bool_and(d >= -0.005) FILTER (regime = 'trend') AS regime_trend,
                coalesce(string_agg(CASE WHEN d < -0.005 THEN printf('Regime ''%s'' drawdown %.2f%% too deep', regime, d * 100) END, '; ' ORDER BY regime), '') AS regimes_failed
         FROM dd GROUP BY 1)
  SELECT symbol, regime_range, regime_trend, regimes_failed, coalesce(regimes_failed = '' AND oos_total_return > 0 AND oos_sharpe >= 1.2 AND oos_profit_factor >= 1.3
         AND abs(least(is_max_drawdown, oos_max_drawdown)) <= 0.005 AND oos_n_trades >= 30 AND (is_sharpe <= 0 OR oos_sharpe / is_sharpe >= 0.5), false) AS passed
  FROM wd JOIN rg USING (symbol)"""

_PF = f"""{SPLIT},
  sp AS (SELECT *, split_part(symbol, '|', 2) AS segment FROM eq),
  mb AS (SELECT segment, count(DISTINCT symbol) AS m FROM sp GROUP BY 1),
  pr AS (SELECT segment, ts, sum(coalesce(ret, 0)) / max(m) AS r FROM sp JOIN mb USING (segment) GROUP BY 1, 2),
  pe AS (SELECT segment, ts, row_number() OVER v - 1 AS bar_no, 10000.0 * exp(sum(ln(1 + r)) OVER v) AS equity
         FROM pr WINDOW v AS (PARTITION BY segment ORDER BY ts)),
  pq AS (SELECT *, equity / lag(equity) OVER (PARTITION BY segment ORDER BY ts) - 1 AS ret, cast(NULL AS double) AS pnl FROM pe)"""
ORACLE["portfolio_equity"] = f"{_PF} SELECT segment, ts, round(equity, 4) AS equity FROM pq"
ORACLE["portfolio_metrics"] = f"""{_PF}, pm AS ({sql.metrics_of('pq', 'segment')}), ta AS ({sql.metrics_of('sp', 'segment')}),
  mt AS (SELECT pm.segment, pm.cagr, pm.sharpe, pm.sortino, pm.calmar, pm.max_drawdown, pm.volatility, pm.total_return,
                ta.win_rate, ta.profit_factor, ta.avg_trade, ta.expectancy, ta.n_trades FROM pm JOIN ta USING (segment))
  SELECT segment, {sql.ROUNDED} FROM mt"""

ORACLE["portfolio_gates"] = f"""{_PF}, pm AS ({sql.metrics_of('pq', 'segment')}), ta AS ({sql.metrics_of('sp', 'segment')}),
  mt AS (SELECT pm.segment AS seg, pm.total_return, pm.sharpe, pm.cagr, pm.max_drawdown, ta.profit_factor, ta.n_trades FROM pm JOIN ta USING (segment)),
  wd AS (SELECT {WIDE} FROM mt), {_gates('wd', '', '1.2', '1.3', '0.2', '0.5', '30')}"""

ORACLE["strategy_leaderboard"] = " UNION ALL ".join(
    f"""SELECT * FROM (WITH RECURSIVE {sql.signals_cte(s_)}, {sql.trades_cte()}, {sql.EQ}, mt AS ({sql.metrics_of('eq')})
    SELECT '{s_}' AS strategy, round(avg(sharpe), 6) AS mean_sharpe, round(avg(total_return), 6) AS mean_return,
           round(min(max_drawdown), 6) AS worst_drawdown, cast(sum(n_trades) AS bigint) AS n_trades FROM mt)"""
    for s_ in ("trend_following", "momentum_breakout", "mean_reversion", "regime_adaptive", "breakout_rr"))

# --- risk and ledger ---------------------------------------------------------------


def risk_cte(resets: bool) -> str:
    flag = "day(ts) = 1" if resets else "false"
    week = "year(cast(date_trunc('week', {0}) AS date) + 3) * 100 + week({0})"
    return f"""a AS (SELECT *, lag(equity) OVER w AS pe, lag(ts) OVER w AS pt, CASE WHEN {flag} THEN 1 ELSE 0 END AS rs
           FROM ({EQUITY_SNAPSHOTS_SQL}) WINDOW w AS (PARTITION BY account ORDER BY ts)),
  b AS (SELECT *, coalesce(pe, 210000.0) AS base, sum(rs) OVER (PARTITION BY account ORDER BY ts) - rs AS ep,
               pt IS NULL OR cast(pt AS date) <> cast(ts AS date) AS nd,
               pt IS NULL OR {week.format('pt')} <> {week.format('ts')} AS nw FROM a),
  c AS (SELECT *, last_value(CASE WHEN nd THEN base END IGNORE NULLS) OVER v AS day_start,
               last_value(CASE WHEN nw THEN base END IGNORE NULLS) OVER v AS week_start,
               max(greatest(equity, CASE WHEN f = 1 THEN base END)) OVER (PARTITION BY account, ep ORDER BY ts) AS peak
        FROM (SELECT *, row_number() OVER (PARTITION BY account, ep ORDER BY ts) AS f FROM b)
        WINDOW v AS (PARTITION BY account ORDER BY ts)),
  d AS (SELECT *, equity / peak - 1 AS drawdown, equity / day_start - 1 AS daily_pnl, equity / week_start - 1 AS weekly_pnl FROM c),
  rk AS (SELECT *, max(CASE WHEN drawdown <= -0.17 THEN 1 ELSE 0 END) OVER (PARTITION BY account, ep ORDER BY ts) > 0 AS kill_switch FROM d)"""


ORACLE["risk_state"] = f"""WITH {risk_cte(True)} SELECT account, ts, round(day_start, 6) AS day_start, round(week_start, 6) AS week_start,
  round(peak, 6) AS peak, round(drawdown, 6) AS drawdown, round(daily_pnl, 6) AS daily_pnl, round(weekly_pnl, 6) AS weekly_pnl, kill_switch FROM rk"""
ORACLE["entry_decisions"] = f"""WITH {risk_cte(True)}, e AS (SELECT account, ts, CASE WHEN kill_switch THEN 'kill_switch_active'
    WHEN drawdown <= -0.17 THEN 'kill_switch_drawdown_breach' WHEN n_open >= 2 THEN 'max_concurrent_positions'
    WHEN daily_pnl <= -0.05 THEN 'daily_loss_limit' WHEN weekly_pnl <= -0.06 THEN 'weekly_loss_limit' ELSE 'ok' END AS reason FROM rk)
  SELECT account, ts, reason = 'ok' AS allowed, reason FROM e"""

_POS = f"""WITH RECURSIVE f AS MATERIALIZED (SELECT *, CASE WHEN side = 'buy' THEN qty ELSE -qty END AS mv,
      row_number() OVER (PARTITION BY symbol ORDER BY seq) AS i FROM ({LEDGER_FILLS_SQL})),
  p AS (SELECT symbol, cast(0 AS bigint) AS i, cast(NULL AS bigint) AS seq, cast(NULL AS timestamp) AS ts, cast(0 AS double) AS q,
               cast(NULL AS double) AS av, cast(0 AS double) AS rl FROM (SELECT DISTINCT symbol FROM f)
        UNION ALL
        SELECT f.symbol, f.i, f.seq, f.ts, CASE WHEN abs(p.q + mv) < 1e-12 AND av IS NOT NULL THEN 0 ELSE p.q + mv END,
               CASE WHEN av IS NULL THEN price WHEN abs(p.q + mv) < 1e-12 THEN NULL
                    WHEN (p.q >= 0 AND mv > 0) OR (p.q <= 0 AND mv < 0) THEN (av * p.q + price * mv) / (p.q + mv) ELSE av END,
               rl + CASE WHEN av IS NOT NULL AND p.q > 0 AND mv < 0 THEN (price - av) * least(-mv, p.q) ELSE 0 END
        FROM p JOIN f ON f.symbol = p.symbol AND f.i = p.i + 1),
  ps AS (SELECT * FROM p WHERE i > 0),
  la AS (SELECT symbol, arg_max(q, seq) AS q, arg_max({{'v': av}}, seq).v AS av FROM ps GROUP BY 1 HAVING abs(arg_max(q, seq)) >= 1e-12),
  px AS (SELECT symbol, arg_max(price, seq) AS price FROM f GROUP BY 1)"""
ORACLE["position_history"] = f"{_POS} SELECT symbol, seq, ts, q AS qty, round(av, 4) AS avg_price, round(rl, 4) AS realized_pnl FROM ps"
ORACLE["marked_positions"] = f"""{_POS} SELECT symbol, q AS qty, round(price, 9) AS price, round(q * price, 4) AS value,
  round((price - av) * q, 4) AS unrealized_pnl FROM la JOIN px USING (symbol)"""
ORACLE["account_equity"] = f"""{_POS} SELECT right(symbol, 1) AS venue, round(10000.0 + sum(q * price), 2) AS equity FROM la JOIN px USING (symbol) GROUP BY 1"""

_SYM = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_held = "CASE symbol " + " ".join(f"WHEN '{s}' THEN h{k}" for k, s in enumerate(_SYM)) + " END"
_upd = ", ".join(
    f"CASE WHEN symbol <> '{s}' OR status = 'rejected' THEN h{k} WHEN side = 'buy' THEN h{k} + qty ELSE h{k} - least(qty, h{k}) END AS h{k}"
    for k, s in enumerate(_SYM))
ORACLE["order_admission"] = f"""WITH RECURSIVE o AS MATERIALIZED (
    SELECT concat('A', cast(o_custkey % 100 AS varchar)) AS account, o_orderkey AS seq, o_orderpriority AS symbol,
           CASE WHEN o_custkey % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, cast(o_orderkey % 7 + 1 AS double) AS qty,
           CASE WHEN o_orderkey % 8 = 0 THEN round(o_totalprice / 2000, 2) ELSE round(o_totalprice / 1000, 2) END AS px,
           row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS i FROM orders),
  r AS (SELECT account, cast(0 AS bigint) AS i, cast(NULL AS bigint) AS seq, cast(10000 AS double) AS cash,
               {', '.join(f'cast(0 AS double) AS h{k}' for k in range(5))},
               cast(NULL AS varchar) AS status, cast(NULL AS varchar) AS reason, cast(0 AS double) AS qty, cast(0 AS double) AS fill
        FROM (SELECT DISTINCT account FROM o)
        UNION ALL
        SELECT account, i, seq,
               CASE WHEN status = 'rejected' THEN cash WHEN side = 'buy' THEN cash - qty * fill * 1.0005
                    ELSE cash + least(qty, held) * fill * 0.9995 END,
               {_upd}, status, CASE WHEN status = 'rejected' THEN CASE WHEN side = 'buy' THEN 'insufficient_cash' ELSE 'no_position' END END,
               qty, fill
        FROM (SELECT *, CASE WHEN side = 'buy' AND qty * fill * 1.0005 > cash + 1e-9 THEN 'rejected'
                             WHEN side = 'sell' AND least(qty, held) <= 0 THEN 'rejected' ELSE 'filled' END AS status
              FROM (SELECT o.*, r.cash, {', '.join(f'r.h{k}' for k in range(5))}, {_held.replace('CASE symbol', 'CASE o.symbol')} AS held,
                           px * CASE WHEN side = 'buy' THEN 1.0005 ELSE 0.9995 END AS fill
                    FROM r JOIN o ON o.account = r.account AND o.i = r.i + 1)))
  SELECT account, seq, status, reason, CASE WHEN status = 'filled' THEN qty ELSE 0 END AS filled_qty,
         CASE WHEN status = 'filled' THEN round(fill, 9) ELSE 0 END AS fill_price,
         CASE WHEN status = 'filled' THEN round(qty * fill * 0.0005, 11) ELSE 0 END AS fee, round(cash, 4) AS cash_left FROM r WHERE i > 0"""

ORACLE["idempotent_orders"] = """WITH x AS (SELECT concat('c', cast(o_custkey AS varchar)) AS client_id, o_orderkey AS seq,
    CASE o_orderkey % 4 WHEN 1 THEN 'filled' WHEN 2 THEN 'submitted' ELSE 'rejected' END AS status, o_totalprice FROM orders)
  SELECT client_id, seq, status, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY client_id
    ORDER BY CASE WHEN status = 'rejected' THEN 1 ELSE 0 END, CASE WHEN status = 'rejected' THEN -seq ELSE seq END) AS rn FROM x) WHERE rn = 1"""
ORACLE["trade_history"] = f"""SELECT symbol, ts, seq, side, qty, price FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS rn FROM ({LEDGER_FILLS_SQL})) WHERE rn <= 100"""
_OPEN = "SELECT concat('A', cast(o_custkey % 100 AS varchar)) AS account, o_orderpriority AS strategy_name, o_orderkey AS position_id, round(o_totalprice, 2) AS avg_price FROM orders WHERE o_orderstatus = 'O'"
ORACLE["open_positions"] = _OPEN
ORACLE["venue_summary"] = f"""WITH {risk_cte(False)},
  l AS (SELECT account, arg_max(equity, ts) AS equity, arg_max(drawdown, ts) AS drawdown FROM rk GROUP BY 1),
  h AS (SELECT account, count(*) AS n, string_agg(DISTINCT strategy_name, ',' ORDER BY strategy_name) AS st FROM ({_OPEN}) GROUP BY 1)
  SELECT account, round(coalesce(equity, 0), 6) AS equity, round(coalesce(drawdown, 0), 6) AS drawdown, coalesce(n, 0) AS n_positions,
         coalesce(st, '') AS strategies FROM l FULL JOIN h USING (account)"""
ORACLE["alert_rows"] = f"""WITH {risk_cte(False)}, {_HOURLY.replace('x AS', 'hx AS').replace('FROM x', 'FROM hx')}
  SELECT account AS subject, ts, 'drawdown' AS kind FROM rk WHERE drawdown < -0.12
  UNION ALL SELECT account, ts, 'daily_loss' FROM rk WHERE daily_pnl < -0.05
  UNION ALL SELECT concat('o', cast(o_orderkey AS varchar)), o_orderdate, 'rejected_order' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT symbol, ts, 'data_gap' FROM r WHERE gap""".replace(", a AS (SELECT r.symbol", ", an AS (SELECT r.symbol").replace(
    "\n  a AS (SELECT r.symbol", "\n  an AS (SELECT r.symbol").replace("FROM g JOIN a USING", "FROM g JOIN an USING")
ORACLE["event_log_counts"] = f"""WITH e AS (SELECT 'order' AS category, o_orderdate AS seen FROM orders
    UNION ALL SELECT 'fill', ts FROM ({LEDGER_FILLS_SQL})
    UNION ALL SELECT 'error', o_orderdate FROM orders WHERE o_orderstatus = 'F')
  SELECT category, cast(seen AS date) AS day, count(*) AS n, max(seen) AS last_at FROM e GROUP BY 1, 2"""

_CLOSE = f"""WITH RECURSIVE {sql.signals_cte('momentum_breakout')},
  k AS (
    SELECT symbol, cast(59 AS bigint) AS i, cast(10000 AS double) AS cash, cast(0 AS double) AS held, cast(NULL AS double) AS epx,
           cast(NULL AS double) AS st, cast(10000 AS double) AS peak, false AS killed, cast(NULL AS varchar) AS action,
           cast(NULL AS double) AS price, cast(NULL AS double) AS qty, cast(NULL AS double) AS pnl, cast(0 AS double) AS equity,
           cast(NULL AS timestamp) AS ts FROM (SELECT DISTINCT symbol FROM sg WHERE i = 60)
    UNION ALL
    SELECT symbol, i, cash2, held2, CASE WHEN action = 'open' THEN close * 1.0005 ELSE epx END,
           CASE WHEN action = 'open' THEN nst ELSE st1 END,
           greatest(pk1, CASE WHEN action IN ('stop', 'signal') THEN cash2 ELSE 0 END),
           kl1 OR (action IN ('stop', 'signal') AND cash2 / greatest(pk1, cash2) - 1 <= -0.2), action,
           CASE action WHEN 'open' THEN close * 1.0005 WHEN 'stop' THEN close * 0.9995 WHEN 'signal' THEN close * 0.9995 END,
           CASE WHEN action = 'open' THEN q WHEN action IS NOT NULL THEN held END,
           CASE WHEN action IN ('stop', 'signal') THEN (close * 0.9995 - epx) * held END, cash2 + held2 * close, ts
    FROM (SELECT *, CASE WHEN action = 'open' THEN cash - q * (close * 1.0005) * 1.0005
                         WHEN action IN ('stop', 'signal') THEN cash + held * (close * 0.9995) * 0.9995 ELSE cash END AS cash2,
                 CASE WHEN action = 'open' THEN q WHEN action IN ('stop', 'signal') THEN 0 ELSE held END AS held2
      FROM (SELECT *, CASE WHEN held > 0 THEN CASE WHEN close <= st1 THEN 'stop' WHEN exit THEN 'signal' END
                           WHEN entry AND NOT kl1 AND q > 0 AND q * (close * 1.0005) * 1.0005 <= cash + 1e-9 THEN 'open' END AS action
        FROM (SELECT *, CASE WHEN close > nst THEN least(val * 0.0075 / (close - nst), val / close) ELSE val / close END AS q,
                     killed OR val / pk1 - 1 <= -0.2 AS kl1
          FROM (SELECT *, greatest(peak, val) AS pk1, CASE WHEN stop IS NULL THEN st ELSE greatest(st, stop) END AS st1,
                       coalesce(stop, close * 0.95) AS nst
            FROM (SELECT s.*, k.cash, k.held, k.epx, k.st, k.peak, k.killed, k.cash + k.held * s.close AS val
                  FROM k JOIN sg s ON s.symbol = k.symbol AND s.i = k.i + 1))))))
  SELECT symbol, ts, action, round(price, 6) AS price, round(qty, 6) AS qty, round(pnl, 4) AS pnl, round(equity, 4) AS equity
  FROM k WHERE action IS NOT NULL"""
ORACLE["close_based_trades"] = _CLOSE
ORACLE["stream_positions"] = _CLOSE

ORACLE["stream_tick_bars"] = f"""SELECT symbol, ts, open, high, low, close, volume FROM ({EVENT_BARS_SQL})
  WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
ORACLE["stream_clean_bars"] = f"""SELECT DISTINCT symbol, ts, open, high, low, CASE WHEN day(ts) = 28 THEN 1.0 ELSE close END AS close, volume
  FROM ({FAULTY_BARS_SQL}) WHERE close IS NOT NULL"""
ORACLE["stream_signals"] = f"WITH RECURSIVE {sql.signals_cte('momentum_breakout')} SELECT symbol, ts, entry, exit, round(stop, 6) AS stop FROM sg"
ORACLE["stream_risk"] = f"""WITH {risk_cte(False)} SELECT account, ts, round(drawdown, 6) AS drawdown, round(daily_pnl, 6) AS daily_pnl,
  round(weekly_pnl, 6) AS weekly_pnl, kill_switch FROM rk"""
